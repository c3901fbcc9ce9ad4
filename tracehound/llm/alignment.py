"""Cross-tokenizer alignment: which tokens of two vocabularies stand for the same bytes.

Each text is encoded by a byte-level vocabulary (A, with a blank put before the text) and by
a piece vocabulary (B, which adds that blank itself). Byte offsets where a token of A and one
of B both end cut the text into groups; a link is a pair of occurrences whose byte ranges
overlap. As no inner end is shared within a group, every stretch between two neighbouring
ends belongs to exactly one link, so links are found by merging the two lists of ends.

A pair's count is the number of documents that hold it linked. Counts live in dense vectors:
the distinct pairs are dealt to shards by hash, each shard builds a minimal perfect hash of
its pairs and stores them in its order, to verify every look-up; the sorted partial counts of
the tasks are scattered into one vector per shard and task group, and the vectors are summed
up a tree of fan-in ``FAN_IN``. The second pass aligns the stored tokens again and sends each
document's pairs to the shard that holds them; the shard looks counts up and returns two sums
per document. No table is broadcast but the highest count of each A id, which the vocabulary
bounds, and no task holds more than one shard and one batch. A pair that every document has
is spread with its shard over ``salts`` copies of the shard's vectors.

The driver sees the number of pairs and one number per A id. Tokens are encoded once, in
slices of ``SLICE`` characters, and stored as integers beside the digest of the groups. Null
and empty texts, and texts whose joined tokens differ from blank + text, have no tokens: zeros
and an empty digest. Texts are encoded whole. A null id keeps its row, repeated rows count as
documents of their own; empty tables give no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracehound.llm.common import query, table, text_of
from tracehound.llm.perfect_hash import PerfectHash, mix
from tracehound.runtime import materialize, scratch_path

TOKENIZERS = "/opt/tokenizers"
A_FILE = "byte_bpe_50k.json"
B_FILE = "piece_bpe_32k.model"

SLICE = 2_000_000  # characters encoded at once
SHARD_KEYS = 1 << 18
HELD_PAIRS = 4_000_000  # pairs a task gathers before it sorts and counts them
PARTIAL_ROWS = 1_000_000  # rows of partial counts that one task scatters
FAN_IN = 16
_SHARD_SEED = 1 << 20  # no level of a perfect hash gets that far
_BLANK = "▁"


@dataclass(frozen=True)
class Vocabularies:
    a: bytes
    b: bytes

    @classmethod
    def read(cls, folder: str = TOKENIZERS) -> Vocabularies:
        with open(os.path.join(folder, A_FILE), "rb") as a, open(os.path.join(folder, B_FILE), "rb") as b:
            return cls(a.read(), b.read())


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary.

    Printable bytes stand for themselves, the others for letters from 256 on.
    """
    printable = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


# Fixed value: how byte-level vocabularies of this kind split text before the merges.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def ranked(vocabulary: dict, letters: dict[str, int]) -> dict[bytes, int] | None:
    """Bytes to id of a vocabulary whose ids are its merge ranks, else None.

    Such a vocabulary can be encoded by rank, four times as fast and with the same ids.
    """
    split = vocabulary.get("pre_tokenizer") or {}
    model = vocabulary["model"]
    plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space", True)
    if not plain or vocabulary.get("normalizer") or model.get("type") != "BPE" or model.get("ignore_merges"):
        return None
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    made = [model["vocab"].get(a + b) for a, b in merges]
    special = {t["content"] for t in vocabulary.get("added_tokens", [])}
    entries = {t: i for t, i in model["vocab"].items() if t not in special}
    if None in made or made != sorted(set(made)) or len(entries) != len(made) + 256 or min(made, default=256) < 256:
        return None
    return {bytes(letters[c] for c in t): i for t, i in entries.items()}


class Encoders:
    """Both vocabularies: ids of texts, and the bytes and decimal names of ids."""

    def __init__(self, vocabularies: Vocabularies):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(vocabularies.a.decode())
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=vocabularies.b)
        letters = byte_letters()
        ranks = ranked(json.loads(vocabularies.a), letters)
        self.by_rank = ranks and tiktoken.Encoding("a", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        entries = sorted((i, t) for t, i in self.a.get_vocab(with_added_tokens=True).items())
        a_bytes = [b""] * (entries[-1][0] + 1)
        for i, token in entries:
            known = all(c in letters for c in token)
            a_bytes[i] = bytes(letters[c] for c in token) if known else token.encode()
        self.a_bytes = np.array(a_bytes, object)
        pieces = ((i, self.b.id_to_piece(i)) for i in range(self.b.vocab_size()))
        self.b_bytes = np.array([bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(_BLANK, " ").encode() for i, p in pieces], object)
        # the name of an id, then what follows it: a comma, or the end of its list
        self.a_names = np.array([b"%d%s" % (i, end) for i in range(len(a_bytes)) for end in (b",", b"|")], object)
        self.b_names = np.array([b"%d%s" % (i, end) for i in range(len(self.b_bytes)) for end in (b",", b";")], object)

    def encode_a(self, texts: list[str]) -> Iterator[list[int]]:
        if self.by_rank:
            return (self.by_rank.encode_ordinary(t) for t in texts)
        return (e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False))

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        nothing = np.zeros(0, np.int32)
        for text, x, y in zip(texts, self.encode_a([" " + t for t in texts]), self.b.encode(texts, num_threads=1)):
            whole = b" " + text.encode()
            x, y = np.array(x, np.int32), np.array(y, np.int32)
            same = text and b"".join(self.a_bytes[x].tolist()) == whole == b"".join(self.b_bytes[y].tolist())
            yield (x, y) if same else (nothing, nothing)


def token_sizes(encoders: Encoders) -> tuple[np.ndarray, np.ndarray]:
    """The number of bytes of every id of A and B."""
    return tuple(np.array([len(t) for t in tokens], np.int64) for tokens in (encoders.a_bytes, encoders.b_bytes))


def id_kinds(sizes: tuple[np.ndarray, np.ndarray]) -> list[type]:
    """The integers that the ids of A and B are stored as."""
    return [np.uint16 if len(s) <= 1 << 16 else np.uint32 for s in sizes]


_A_ENDS, _B_ENDS = 1, 2


def marks(a: np.ndarray, b: np.ndarray, sizes: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """For each byte behind which a token ends, in order: whether one of A, of B, or both."""
    a_ends, b_ends = np.cumsum(sizes[0][a]), np.cumsum(sizes[1][b])
    ends = np.zeros(a_ends[-1], np.uint8)
    ends[a_ends - 1] = _A_ENDS
    ends[b_ends - 1] |= _B_ENDS
    return ends[ends > 0]


def links(a: np.ndarray, b: np.ndarray, sizes: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """One pair key (A id times the size of B, plus B id) for each overlap."""
    ends = marks(a, b, sizes)
    of_a, of_b = ends & _A_ENDS, ends >> 1
    return a[np.cumsum(of_a, dtype=np.int32) - of_a].astype(np.int64) * len(sizes[1]) + b[np.cumsum(of_b, dtype=np.int32) - of_b]


def group_text(a: np.ndarray, b: np.ndarray, sizes: tuple[np.ndarray, np.ndarray], encoders: Encoders) -> tuple[int, bytes]:
    """Number of groups, and ``a1,a2|b1;a3|b2,b3``."""
    ends = marks(a, b, sizes)
    both = ends == _A_ENDS | _B_ENDS
    group = np.cumsum(both) - both
    a_group, b_group = group[(ends & _A_ENDS) > 0], group[ends >= _B_ENDS]
    a_size, b_size = np.bincount(a_group), np.bincount(b_group)
    # a token stands behind the tokens of its own kind before it and those of the other kind
    # in earlier groups; those of A come first within a group
    out = np.empty(len(a) + len(b), object)
    a_last, b_last = both[(ends & _A_ENDS) > 0], both[ends >= _B_ENDS]
    out[np.arange(len(a)) + (np.cumsum(b_size) - b_size)[a_group]] = encoders.a_names[2 * a + a_last]
    out[np.arange(len(b)) + np.cumsum(a_size)[b_group]] = encoders.b_names[2 * b + b_last]
    return len(a_size), b"".join(out.tolist())[:-1]


_TOKENS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, a binary, b binary"


def _slices(texts: list[str]) -> Iterator[list[str]]:
    held, chars = [], 0
    for t in texts:
        held.append(t)
        chars += len(t)
        if chars >= SLICE:
            yield held
            held, chars = [], 0
    yield held


def tokens_of(docs: DataFrame, vocabularies: Vocabularies, text: str = "text") -> DataFrame:
    """Ids of both vocabularies, counts and the digest of the groups, one row per document."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders = Encoders(vocabularies)
        sizes = token_sizes(encoders)
        kinds = id_kinds(sizes)
        for batch in batches:
            ids, at = batch.column(0), 0
            for texts in _slices(batch.column(1).to_pylist()):
                rows = []
                for a, b in encoders.encode(texts):
                    if len(a):
                        groups, named = group_text(a, b, sizes, encoders)
                        digest = hashlib.sha256(named).hexdigest()
                        # ends that both share are counted once
                        rows.append((len(a), len(b), groups, len(a) + len(b) - groups, digest, a.astype(kinds[0]).tobytes(), b.astype(kinds[1]).tobytes()))
                    else:
                        rows.append((0, 0, 0, 0, "", b"", b""))
                columns = list(zip(*rows)) or [()] * 7
                types = (*[pa.int64()] * 4, pa.string(), pa.binary(), pa.binary())
                yield pa.record_batch(
                    [ids.slice(at, len(texts)), *(pa.array(c, k) for c, k in zip(columns, types))],
                    names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "a", "b"],
                )
                at += len(texts)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(text).alias("t")).mapInArrow(of, _TOKENS)


def _aligned(batch: pa.RecordBatch, sizes: tuple[np.ndarray, np.ndarray]) -> Iterator[np.ndarray]:
    kinds = id_kinds(sizes)
    for cells in zip(batch.column("a"), batch.column("b")):
        a, b = (np.frombuffer(x.as_py(), kind).astype(np.int32) for x, kind in zip(cells, kinds))
        yield links(a, b, sizes) if len(a) else np.zeros(0, np.int64)


def partial_counts(tokens: DataFrame, sizes: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """pair and n: documents that hold it, summed within a task."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            pair, n = np.unique(np.concatenate([np.zeros(0, np.int64), *held]), return_counts=True)
            return pa.record_batch({"pair": pair, "n": n.astype(np.int64)})

        for batch in batches:
            for found in _aligned(batch, sizes):
                held.append(np.unique(found))
                size += len(held[-1])
                if size >= HELD_PAIRS:
                    yield flush()
                    held, size = [], 0
        yield flush()

    return tokens.select("a", "b").mapInArrow(of, "pair long, n long")


def _shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return (mix(keys, _SHARD_SEED) % np.uint64(shards)).astype(np.int32)


def _with_shard(rows: DataFrame, shards: int) -> DataFrame:
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column("shard", pa.array(_shard_of(batch.column("pair").to_numpy(), shards)))

    return rows.mapInArrow(of, f"{', '.join(f'{n} {t}' for n, t in rows.dtypes)}, shard int")


def build_shards(pairs: DataFrame, shards: int) -> DataFrame:
    """shard, hash and keys: the perfect hash of a shard's pairs, and the pairs in its order."""

    def build(group: pd.DataFrame) -> pd.DataFrame:
        keys = group["pair"].to_numpy()
        hashed = PerfectHash.build(keys)
        ordered = np.empty(len(keys), np.int64)
        ordered[hashed.number(keys)] = keys
        return pd.DataFrame({"shard": [group["shard"].iloc[0]], "hash": [hashed.to_bytes()], "keys": [ordered.tobytes()]})

    return _with_shard(pairs, shards).groupBy("shard").applyInPandas(build, "shard int, hash binary, keys binary")


def numbers(hashed: PerfectHash, keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places of ``wanted`` among ``keys``; every key found is compared with the one asked for."""
    at = hashed.number(wanted)
    if (at < 0).any() or (keys[at] != wanted).any():
        raise KeyError("a pair is missing from the shard that its hash names")
    return at


def dense_counts(partial: DataFrame, built: DataFrame, shards: int) -> DataFrame:
    """shard, hash, keys and counts: partial counts scattered by hash, then summed up a tree."""
    groups = max(1, -(-partial.count() // (PARTIAL_ROWS * shards)))
    level = F.expr(f"explode(sequence(0, {groups - 1}))")

    def scatter(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"shard": [], "grp": [], "counts": []})
        keys = np.frombuffer(left["keys"].iloc[0], np.int64)
        at = numbers(PerfectHash.from_bytes(left["hash"].iloc[0]), keys, right["pair"].to_numpy())
        counts = np.bincount(at, right["n"].to_numpy(), len(keys)).astype(np.int64)
        return pd.DataFrame({"shard": [left["shard"].iloc[0]], "grp": [left["grp"].iloc[0]], "counts": [counts.tobytes()]})

    def add(group: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(c, np.int64) for c in group["counts"])
        return pd.DataFrame({"shard": [group["shard"].iloc[0]], "grp": [group["grp"].iloc[0]], "counts": [total.tobytes()]})

    rows = _with_shard(partial, shards).withColumn("grp", F.pmod(F.spark_partition_id(), F.lit(groups)))
    tables = built.withColumn("grp", level).groupBy("shard", "grp")
    counts = tables.cogroup(rows.groupBy("shard", "grp")).applyInPandas(scatter, "shard int, grp int, counts binary")
    while groups > 1:
        groups = -(-groups // FAN_IN)
        counts = counts.withColumn("grp", F.floor(F.col("grp") / FAN_IN).cast("int")).groupBy("shard", "grp").applyInPandas(add, "shard int, grp int, counts binary")
    return built.join(counts.drop("grp"), "shard")


def best_counts(dense: DataFrame, n_a: int, n_b: int) -> np.ndarray:
    """The highest count of each A id."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.zeros(n_a, np.int64)
        for batch in batches:
            for keys, counts in zip(batch.column("keys"), batch.column("counts")):
                np.maximum.at(best, np.frombuffer(keys.as_py(), np.int64) // n_b, np.frombuffer(counts.as_py(), np.int64))
        used = np.flatnonzero(best)
        yield pa.record_batch({"id": used, "n": best[used]})

    out = np.zeros(n_a, np.int64)
    # one row per id of the vocabulary
    for row in dense.select("keys", "counts").mapInArrow(of, "id long, n long").groupBy("id").agg(F.max("n").alias("n")).collect():
        out[row["id"]] = row["n"]
    return out


_ASKED = "shard int, salt int, kind int, hash binary, keys binary, counts binary, rows binary, pairs binary, times binary"


def asked_pairs(tokens: DataFrame, sizes: tuple[np.ndarray, np.ndarray], shards: int, salts: int) -> DataFrame:
    """Every document's pairs with their number of links, packed by shard."""

    def pack(rows: list[np.ndarray], pairs: list[np.ndarray], times: list[np.ndarray], salt: int) -> pa.RecordBatch:
        row, pair, n = (np.concatenate(x) for x in (rows, pairs, times))
        shard = _shard_of(pair, shards)
        order = np.argsort(shard, kind="stable")
        row, pair, n, shard = row[order], pair[order], n[order], shard[order]
        used, starts = np.unique(shard, return_index=True)
        parts = list(zip(starts, [*starts[1:], len(shard)]))
        cells = {name: [x[s:e].tobytes() for s, e in parts] for name, x in (("rows", row), ("pairs", pair), ("times", n))}
        nothing = pa.nulls(len(used), pa.binary())
        return pa.record_batch(
            {"shard": used.astype(np.int32), "salt": np.full(len(used), salt, np.int32), "kind": np.ones(len(used), np.int32)}
            | {c: nothing for c in ("hash", "keys", "counts")} | {c: pa.array(v, pa.binary()) for c, v in cells.items()}
        )

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, pairs, times, size, salt = [], [], [], 0, None
        for batch in batches:
            for row, found in zip(batch.column("_row").to_numpy(), _aligned(batch, sizes)):
                # salts turn with every package, from a start that the rows decide
                salt = int(mix(np.array([row]), 0)[0] % np.uint64(salts)) if salt is None else salt
                pair, n = np.unique(found, return_counts=True)
                rows.append(np.full(len(pair), row, np.int64))
                pairs.append(pair)
                times.append(n.astype(np.int32))
                size += len(pair)
                if size >= HELD_PAIRS // 8:
                    yield pack(rows, pairs, times, salt)
                    rows, pairs, times, size, salt = [], [], [], 0, (salt + 1) % salts
        if size:
            yield pack(rows, pairs, times, salt)

    return tokens.select("_row", "a", "b").mapInArrow(of, _ASKED)


def look_up(dense: DataFrame, asked: DataFrame, best: np.ndarray, n_b: int, salts: int) -> DataFrame:
    """_row, n_best and count_sum of the pairs asked for, per package."""
    nothing = {c: F.lit(None).cast("binary") for c in ("rows", "pairs", "times")}
    tables = dense.withColumn("salt", F.expr(f"explode(sequence(0, {salts - 1}))")).withColumns({"kind": F.lit(0), **nothing})
    dealt = tables.select(asked.columns).unionByName(asked)
    dealt = dealt.repartition("shard", "salt").sortWithinPartitions("shard", "salt", "kind")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = keys = counts = None
        for batch in batches:
            for i, kind in enumerate(batch.column("kind").to_pylist()):
                if kind == 0:
                    hashed = PerfectHash.from_bytes(batch.column("hash")[i].as_py())
                    keys, counts = (np.frombuffer(batch.column(c)[i].as_py(), np.int64) for c in ("keys", "counts"))
                    continue
                rows, pairs = (np.frombuffer(batch.column(c)[i].as_py(), np.int64) for c in ("rows", "pairs"))
                times = np.frombuffer(batch.column("times")[i].as_py(), np.int32).astype(np.int64)
                n = counts[numbers(hashed, keys, pairs)]
                docs, at = np.unique(rows, return_inverse=True)
                n_best, count_sum = np.zeros(len(docs), np.int64), np.zeros(len(docs), np.int64)
                np.add.at(n_best, at, times * (n == best[pairs // n_b]))
                np.add.at(count_sum, at, times * n)
                yield pa.record_batch({"_row": docs, "n_best": n_best, "count_sum": count_sum})

    return dealt.mapInArrow(of, "_row long, n_best long, count_sum long")


def align_tokens(docs: DataFrame, vocabularies: Vocabularies, text: str = "text") -> DataFrame:
    """Per document: tokens, groups and links of both vocabularies, and how common its pairs are."""
    spark = docs.sparkSession
    encoders = Encoders(vocabularies)
    sizes = token_sizes(encoders)
    path = scratch_path(spark, "tokens")
    tokens_of(docs, vocabularies, text).withColumn("_row", F.monotonically_increasing_id()).write.parquet(path)
    tokens = spark.read.parquet(path)
    partial = materialize(partial_counts(tokens, sizes))
    pairs = materialize(partial.select("pair").distinct())
    shards = max(1, -(-pairs.count() // SHARD_KEYS))
    dense = materialize(dense_counts(partial, materialize(build_shards(pairs, shards)), shards))
    best = best_counts(dense, len(sizes[0]), len(sizes[1]))
    # some packages for each task, while a task's copies of the vectors stay few
    salts = max(1, -(-4 * int(spark.conf.get("spark.sql.shuffle.partitions")) // shards))
    found = look_up(dense, asked_pairs(tokens, sizes, shards, salts), best, len(sizes[1]), salts)
    sums = found.groupBy("_row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    zero = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("n_best", "count_sum")}
    return tokens.drop("a", "b").join(sums, "_row", "left").withColumns(zero).drop("_row")


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@query("op13_alignment")
def op13_alignment(spark, sf_dir: str) -> DataFrame:
    return align_tokens(table(spark, sf_dir, "documents"), Vocabularies.read()).select(*COLUMNS)
