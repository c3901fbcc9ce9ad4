"""Importance resampling against a brute-force version, and its sort on its own."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from helpers_llm import DOCS, awkward, docs_of, words
from pyspark.sql import functions as F

from tracehound.llm import importance
from tracehound.llm.importance import Draw, importance_resample, rank_by_regular_sampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def features(text, order):
    found = WORD.findall((text or "").translate(LOWER))
    return len(found), [" ".join(found[i : i + n]) for n in range(1, order + 1) for i in range(len(found) - n + 1)]


def brute(rows, target, draw):
    bucket = lambda f: zlib.crc32(f.encode()) % draw.buckets
    s = Counter(bucket(f) for _, t in rows for f in features(t, draw.order)[1])
    t = Counter(bucket(f) for x in target for f in features(x, draw.order)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_s + draw.buckets) / ((s[b] + 1) * (big_t + draw.buckets))))
    out, pool = [], []
    for i, (doc_id, text) in enumerate(rows):
        n, found = features(text, draw.order)
        weight = sum(gain(bucket(f)) for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"{draw.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc_id, len(found), weight, score, None])
        if n >= draw.min_words:
            pool.append((-score, doc_id is None, doc_id or 0, i))
    for rank, (*_, i) in enumerate(sorted(pool)[: len(pool) * draw.percent // 100], 1):
        out[i][4] = rank
    return sorted(map(repr, map(tuple, out)))


@pytest.mark.parametrize("draw", [Draw(), Draw(order=2, buckets=97, seed="x", min_words=3, percent=60)])
def test_resampling_equals_brute_force(spark, draw):
    texts = awkward([words(25, i, "abcÄЖ猫 A.") for i in range(60)] + [words(30, 7)] * 20)
    target = [words(40, 3, "abc"), None, "", words(30, 7)]
    benchmark = spark.createDataFrame(list(enumerate(target)), "item_id long, text string")
    got = importance_resample(docs_of(spark, texts), benchmark, draw)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(repr(tuple(r)) for r in got.collect()) == brute(list(enumerate(texts)), target, draw)


def test_null_and_repeated_ids(spark):
    rows = [(None, words(30, 1)), (5, words(30, 2)), (5, words(30, 2)), (5, words(30, 2)), (None, words(30, 1)), (7, "few")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, 0.0, "", 1) for i, t in rows], DOCS)
    benchmark = spark.createDataFrame([(1, words(30, 2))], "item_id long, text string")
    draw = Draw(percent=80)
    got = importance_resample(docs, benchmark, draw).collect()
    assert sorted(repr(tuple(r)) for r in got) == brute(rows, [words(30, 2)], draw)
    assert sorted(r["rank"] for r in got if r["rank"]) == [1, 2, 3, 4]


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    target = spark.createDataFrame([], "item_id long, text string")
    assert importance_resample(none, target).collect() == []
    docs = docs_of(spark, [words(30, 1), words(30, 2)])
    got = importance_resample(docs, target, Draw(percent=50)).collect()
    assert sorted(repr(tuple(r)) for r in got) == brute([(0, words(30, 1)), (1, words(30, 2))], [], Draw(percent=50))


@pytest.mark.parametrize("partitions, samples", [(1, 1_000_000), (7, 1_000_000), (7, 7)])
def test_ranks_with_many_ties(spark, monkeypatch, partitions, samples):
    """Half of the rows are the same row; runs may give one sample each only."""
    monkeypatch.setattr(importance, "MAX_SAMPLES", samples)
    r = random.Random(1)
    rows = [(r.randint(0, 20), r.choice([None, *range(9)])) if i % 2 else (7, 3) for i in range(3000)]
    df = spark.createDataFrame([(i, s, d) for i, (s, d) in enumerate(rows)], "_row long, score long, doc_id long").repartition(partitions)
    want = {i: n for n, i in enumerate(sorted(range(3000), key=lambda i: (-rows[i][0], rows[i][1] is None, rows[i][1] or 0, i)), 1)}
    for limit in (0, 1, 700, 3000):
        got = {x["_row"]: x["rank"] for x in rank_by_regular_sampling(df, limit).collect()}
        assert got == {i: n if n <= limit else None for i, n in want.items()}


def test_segments_stay_even(spark):
    """Equal rows are told apart, so no segment gets more than about twice its share."""
    df = spark.range(20_000).select(F.col("id").alias("_row"), F.lit(5).cast("long").alias("score"), F.lit(1).cast("long").alias("doc_id")).repartition(8)
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        out = rank_by_regular_sampling(df, 20_000)
        sizes = out.groupBy(F.spark_partition_id()).count().toPandas()["count"]
        assert sizes.sum() == 20_000 and sizes.max() <= 2 * 20_000 / 16 + 8
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
