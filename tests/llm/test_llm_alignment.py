"""Token alignment against a brute-force version; perfect hashing on its own."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from helpers_llm import DOCS, awkward, docs_of, words
from tokenizers import Tokenizer

from tracehound.llm import alignment
from tracehound.llm.alignment import COLUMNS, TOKENIZERS, Vocabularies, align_tokens
from tracehound.llm.perfect_hash import PerfectHash


@pytest.fixture(scope="module")
def vocabularies():
    return Vocabularies.read()


def decoders():
    a = Tokenizer.from_file(f"{TOKENIZERS}/{alignment.A_FILE}")
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=f"{TOKENIZERS}/{alignment.B_FILE}")
    letters = alignment.byte_letters()

    def of_a(i):
        token = a.id_to_token(i)
        return bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()

    def of_b(i):
        piece = b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()

    return a, b, of_a, of_b


def spans(ids, of):
    out, at = [], 0
    for i in ids:
        out.append((at, at + len(of(i))))
        at = out[-1][1]
    return out


def brute(texts):
    a, b, of_a, of_b = decoders()
    rows, found = [], []
    for text in texts:
        x, y = ([], []) if not text else (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text))
        whole = (" " + (text or "")).encode()
        if not text or b"".join(map(of_a, x)) != whole or b"".join(map(of_b, y)) != whole:
            rows.append((0, 0, 0, ""))
            found.append(Counter())
            continue
        p, q = spans(x, of_a), spans(y, of_b)
        shared = sorted({e for _, e in p} & {e for _, e in q})
        groups, low = [], 0
        for end in shared:
            inside = lambda s: low <= s[0] and s[1] <= end  # noqa: B023, E731
            groups.append(",".join(str(i) for i, s in zip(x, p) if inside(s)) + "|" + ",".join(str(i) for i, s in zip(y, q) if inside(s)))
            low = end
        links = Counter()
        for i, s in zip(x, p):
            for j, t in zip(y, q):
                if s[0] < t[1] and t[0] < s[1]:
                    links[i, j] += 1
        rows.append((len(x), len(y), len(groups), hashlib.sha256(";".join(groups).encode()).hexdigest()))
        found.append(links)
    counts = Counter(pair for links in found for pair in links)
    best = Counter()
    for (i, _), n in counts.items():
        best[i] = max(best[i], n)
    return [
        (n_a, n_b, n_groups, sum(links.values()), sum(n for p, n in links.items() if counts[p] == best[p[0]]), sum(n * counts[p] for p, n in links.items()), digest)
        for (n_a, n_b, n_groups, digest), links in zip(rows, found)
    ]


TEXTS = [
    "the house stands", "the house stands", "Ünïcödé straße naïve", "猫が好き 👩‍👩‍👧", "  two  blanks ", "\n\nlines\n\t\ttabs\r\n",
    "<|endoftext|> and <s> </s> <unk>", "▁ underline", "<0x41> bytes", "a\x00b", "x" * 3000, "ﬁ ligature １２３", "é é", "don't we'll I'm", "  　 ​",
]


@pytest.mark.parametrize("keys, held, fan_in, partial", [(1 << 18, 4_000_000, 16, 1_000_000), (50, 40, 2, 10)])
def test_alignment_equals_brute_force(spark, monkeypatch, vocabularies, keys, held, fan_in, partial):
    """The second run has many shards, packages and levels of sums."""
    for name, value in (("SHARD_KEYS", keys), ("HELD_PAIRS", held), ("FAN_IN", fan_in), ("PARTIAL_ROWS", partial), ("SLICE", 500)):
        monkeypatch.setattr(alignment, name, value)
    r = random.Random(3)
    texts = [None, "", *TEXTS, *(" ".join(r.choices(" ".join(t for t in TEXTS if len(t) < 100).split(), k=30)) for _ in range(20)), *[words(60, 9)] * 15]
    got = align_tokens(docs_of(spark, texts).repartition(5), vocabularies).select(*COLUMNS)
    got = {row["doc_id"]: tuple(row)[1:] for row in got.collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts)


def test_long_texts_and_repeated_null_ids(spark, vocabularies):
    rows = [(None, "word"), (None, "word"), (4, "long words " * 20_000), (4, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, 0.0, "", 1) for i, t in rows], DOCS)
    got = sorted(map(repr, (tuple(r) for r in align_tokens(docs, vocabularies).select(*COLUMNS[1:]).collect())))
    texts = ["word", "word", None]
    short = brute(texts)
    assert sum(repr(x) in got for x in short) == 3
    long = next(x for x in align_tokens(docs, vocabularies).collect() if x["n_a"] > 1000)
    assert long["n_links"] == long["n_a"] + long["n_b"] - long["n_groups"]


def test_awkward_tables(spark, vocabularies):
    texts = awkward([words(30, 2)])
    got = align_tokens(docs_of(spark, texts), vocabularies)
    assert got.count() == len(texts)
    assert align_tokens(spark.createDataFrame([], DOCS), vocabularies).collect() == []
    only = align_tokens(docs_of(spark, [None, ""]), vocabularies).select(*COLUMNS).collect()
    assert sorted(map(tuple, only)) == [(i, 0, 0, 0, 0, 0, 0, "") for i in (0, 1)]


def test_byte_table_is_the_one_of_the_vocabulary():
    a, *_ = decoders()
    letters = alignment.byte_letters()
    assert len(letters) == 256 and sorted(letters.values()) == list(range(256))
    assert set(letters) <= set(a.get_vocab())


def test_encoding_by_rank_gives_the_ids_of_the_vocabulary(vocabularies):
    """The split before the merges depends on classes of characters only: try every character."""
    encoders = alignment.Encoders(vocabularies)
    assert encoders.by_rank
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for start in range(0, len(chars), 50_000):
        texts = [f"a{c}b 1{c}2 .{c}, {c}  {c}" for c in chars[start : start + 50_000]]
        want = [e.ids for e in encoders.a.encode_batch_fast(texts, add_special_tokens=False)]
        assert list(encoders.encode_a(texts)) == want


def test_a_vocabulary_in_another_order_is_not_encoded_by_rank(vocabularies):
    import json

    vocabulary, letters = json.loads(vocabularies.a), alignment.byte_letters()
    assert len(alignment.ranked(vocabulary, letters)) == 50_256
    vocabulary["model"]["merges"][:2] = vocabulary["model"]["merges"][1::-1]
    assert alignment.ranked(vocabulary, letters) is None


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 70_000])
def test_perfect_hash_is_minimal(n):
    keys = np.unique(np.random.default_rng(n).integers(-(2**62), 2**62, n))
    hashed = PerfectHash.from_bytes(PerfectHash.build(keys).to_bytes())
    assert sorted(hashed.number(keys).tolist()) == list(range(len(keys))) and hashed.size == len(keys)
    others = np.setdiff1d(np.arange(100), keys)
    assert ((hashed.number(others) >= -1) & (hashed.number(others) < max(1, len(keys)))).all()


def test_a_pair_of_another_shard_is_an_error():
    keys = np.array([5, 9, 100])
    hashed = PerfectHash.build(keys)
    ordered = np.empty(3, np.int64)
    ordered[hashed.number(keys)] = keys
    assert ordered[alignment.numbers(hashed, ordered, np.array([100, 5]))].tolist() == [100, 5]
    with pytest.raises(KeyError):
        alignment.numbers(hashed, ordered, np.array([5, 6]))
