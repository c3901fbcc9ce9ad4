import collections
import hashlib
import random

import numpy as np

import corpus_pipeline
from helpers_llm import DOCS, awkward, docs_of, words
from tracehound.llm import chosen_path, repeats
from tracehound.llm.chosen_path import COORDINATES, SMALL, TARGET, THRESHOLD, Shingler, jaccard_classes, leaves, meetings
from tracehound.llm.components import components
from tracehound.llm.mixing import Mix, leaf_budgets, mix_sources, with_leaf
from tracehound.llm.repeats import anchors, remove_repeats, repeated_starts


def near(text, n, seed):
    r, w = random.Random(seed), text.split()
    for _ in range(n):
        w[r.randrange(len(w))] = "zz" + str(r.randrange(1000))
    return " ".join(w)


def test_join_equals_brute_force(spark):
    base = [words(120, s) for s in range(20)]
    texts = awkward(base + [near(base[i % 5], 1 + i % 3, i) for i in range(SMALL + 60)] + ["a b c", "A, b c!"])
    got = {r.doc_id: r for r in jaccard_classes(docs_of(spark, texts)).collect()}
    sets = [set(Shingler()(t).tolist()) for t in texts]
    links, group = collections.Counter(), list(range(len(texts)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in range(len(texts)):
        for b in range(a + 1, len(texts)):
            both = len(sets[a] & sets[b])
            if both and both >= 0.8 * (len(sets[a]) + len(sets[b]) - both) - 1e-9:
                links[a] += 1
                links[b] += 1
                x, y = sorted((find(a), find(b)))
                group[y] = x
    assert len(got) == len(texts)
    assert [got[i].class_id for i in range(len(texts))] == [find(i) for i in range(len(texts))]
    assert [got[i].n_links for i in range(len(texts))] == [links[i] for i in range(len(texts))]
    assert sum(got[i].stands for i in got) == len({find(i) for i in range(len(texts))})


def test_pairs_at_the_threshold_meet(spark):
    r = np.random.default_rng(3)
    rows = []
    for pair in range(3000):  # few values a coordinate: all share nodes down to some depth
        sig = r.integers(0, 3, COORDINATES)
        other = np.where(r.random(COORDINATES) < THRESHOLD, sig, sig + 10 + r.integers(0, 3, COORDINATES))
        rows += [(bytes([half]) + pair.to_bytes(4, "big"), s.tolist()) for half, s in enumerate((sig, other))]
    classes = spark.createDataFrame(rows, "cid binary, sig array<int>").repartition(4).checkpoint()
    places = collections.defaultdict(set)
    for x in meetings(classes, THRESHOLD, TARGET).select("cid", "node").toPandas().itertuples():
        places[bytes(x.cid)].add(x.node)
    assert all(places[b"\0" + k] & places[b"\1" + k] for k in (pair.to_bytes(4, "big") for pair in range(3000)))


def test_tables_of_deep_levels_have_partitions_for_their_rows(spark, monkeypatch):
    monkeypatch.setattr(chosen_path, "SMALL", 8)
    held = {"spark.sql.shuffle.partitions": "20", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    rng = random.Random(4)
    classes = spark.createDataFrame([(k, [rng.randrange(3) for _ in range(COORDINATES)]) for k in range(300)], "cid long, sig array<int>").repartition(2).checkpoint()
    try:
        for key, value in held.items():
            spark.conf.set(key, value)
        found, depth = leaves(classes, 0, 2, THRESHOLD)
        assert depth == len(found) > 2
        assert all(part.rdd.getNumPartitions() == 1 for part in found[1:])
        assert meetings(classes, THRESHOLD, TARGET).rdd.getNumPartitions() <= 20
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    # every node that is searched is complete
    sizes = collections.Counter()
    for part in found:
        for r in part.collect():
            sizes[r.node, r.size] += 1
    assert sizes and all(size == n for (_, size), n in sizes.items())


def test_components_of_a_long_path(spark):
    path = list(range(401))
    random.Random(0).shuffle(path)
    got = components(spark.createDataFrame([*zip(path, path[1:], strict=False), (500, 501), (7, 7), (None, 3)], "a long, b long")).collect()
    assert {r.node: r.component for r in got} == {**dict.fromkeys(path, 0), 500: 500, 501: 500}


def test_join_reads_a_copied_text_once(spark, monkeypatch):
    held = []
    search = chosen_path.search
    monkeypatch.setattr(chosen_path, "search", lambda rows, threshold: held.append(rows.count()) or search(rows, threshold))
    text = words(120, 1)
    for copies in (2, 9):
        got = {r.doc_id: r for r in jaccard_classes(docs_of(spark, [text] * copies + [near(text, 1, 2)])).collect()}
        assert {(r.class_id, r.n_links) for r in got.values()} == {(0, copies)}
    assert held[0] == held[1] > 0


def test_join_of_nothing(spark):
    assert jaccard_classes(spark.createDataFrame([], DOCS)).count() == 0
    assert jaccard_classes(docs_of(spark, [None, ""])).count() == 2


def expect_removed(texts, length=200):
    data = [(t or "").encode() for t in texts]
    seen = collections.Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        mask = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                mask[i : i + length] = True
        spans = int((np.diff(np.concatenate([[0], mask.astype(int)])) == 1).sum())
        out.append((len(d), int(mask.sum()), spans, hashlib.sha256(bytes(np.frombuffer(d, np.uint8)[~mask])).hexdigest()))
    return out


def test_repeats_equal_brute_force(spark):
    shared, other = words(60, 1), words(45, 2) + "é" * 50
    texts = [words(90, 3) + shared + words(9, 4), shared[:250], words(5, 5) + shared + other, other + words(80, 6), "x" * 450, "ab" * 301, None, "", shared[20:219], words(70, 7), words(70, 7), "y" * 199]
    got = {r.doc_id: r for r in remove_repeats(docs_of(spark, texts)).collect()}
    assert [(got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) for i in range(len(texts))] == expect_removed(texts)
    assert remove_repeats(spark.createDataFrame([], DOCS)).count() == 0


def test_copies_bring_their_pieces_once(spark, monkeypatch):
    held = []
    sort = repeats._sorted_spans
    monkeypatch.setattr(repeats, "_sorted_spans", lambda pieces, length: held.append(pieces.count()) or sort(pieces, length))
    texts = [words(60, 1) + words(30, 2), words(60, 1) + words(30, 3)]
    for copies in (2, 9):
        got = sorted(repeats.remove_repeats(docs_of(spark, texts[:1] * copies + texts[1:])).collect(), key=lambda r: r.doc_id)
        assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got] == expect_removed(texts[:1] * copies + texts[1:])
    assert held[0] == held[1] > 0


def test_anchor_of_every_string():
    data = (words(400, 8) + "q" * 500).encode()
    place, first, last, _ = anchors(data)
    assert first[0] == 0 and last[-1] == len(data) - 200 and (first[1:] == last[:-1] + 1).all()
    assert ((place >= last) & (place + 16 <= first + 200)).all()


def test_columns_sort_like_all_pairs():
    pieces = [b"abcdefgh", b"xbcdefgh", b"abcdefgz", b"bcdefgh"]
    got = repeated_starts(pieces, np.array([3, 3, 3, 2]), 5)
    assert [g.tolist() for g in got] == [[0, 1, 2, 3], [1, 2, 3], [0, 1, 2], [0, 1, 2]] or [sorted(g.tolist()) for g in got] == [[0, 1, 2, 3], [1, 2, 3], [0, 1, 2], [0, 1, 2]]


def test_budgets_fill_siblings_first(spark):
    rows = [("a", "en", "s1", 100), ("a", "en", "s2", 10), ("a", "de", "s3", 5), ("b", "en", "s4", 1000)]
    mix = Mix(domains={}, domain_weight={"a": 1, "b": 1}, share_percent=20, max_epochs=1)
    got = {r.source: r.budget for r in leaf_budgets(spark.createDataFrame(rows, "domain string, lang string, source string, tokens long"), mix).collect()}
    # 223 tokens: a gets 111 of its 115, b 111; in a, German has only 5, so English gets 106: 10 and 96
    assert got == {"s1": 96, "s2": 10, "s3": 5, "s4": 111}


def test_mixing_keeps_to_budgets(spark):
    docs = docs_of(spark, awkward([words(5 + i % 7, i) for i in range(300)]))
    mix = Mix(domains={"web": ["src1", "src2"]}, share_percent=150, max_epochs=2)
    budget = {(r.domain, r.lang, r.source): r.budget for r in leaf_budgets(with_leaf(docs, mix), mix).collect()}
    used = collections.Counter()
    for r in mix_sources(docs, mix).collect():
        used[r.domain, r.lang, r.source] += r.tokens
        assert r.epoch in (0, 1)
    assert all(n <= budget[k] for k, n in used.items()) and len(used) > 4
    assert mix_sources(docs.limit(0), mix).count() == 0


def test_pipeline_small(spark, tmp_path):
    texts = [words(80, i) for i in range(60)] + [words(80, 0), None, "", words(30, 900) + " token = abcdef0123456789abcdef"]
    docs_of(spark, texts).select(*corpus_pipeline.COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, words(40, 3))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = {r.doc_id for r in rows}
    assert 3 not in ids and 60 not in ids and len(rows) > 20  # contaminated (its beginning is the item), a copy
    assert all("abcdef0123456789" not in (r.text or "") for r in rows)
