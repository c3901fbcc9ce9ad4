"""Top-k search against a brute-force version."""

import math
import random

import pytest

from tracehound.llm import topk
from tracehound.llm.topk import top_inner_products

SCHEMA = "vec_id long, embedding array<double>, label int, score double, block int, part int, v string"


def brute(rows, k, every, scale):
    ok = []
    for i, v in rows:
        if v is None or any(x is None or not math.isfinite(x) for x in v) or not all(math.isfinite(x * scale) for x in v):
            continue
        ok.append((i, [math.floor(x * scale) for x in v]))
    out = []
    for n, (i, q) in enumerate(ok):
        if i is None or i % every:
            continue
        found = [(sum(a * b for a, b in zip(q, v)), j) for m, (j, v) in enumerate(ok) if m != n]
        found = [(min(max(s, -(2**63)), 2**63 - 1), j) for s, j in found]
        found.sort(key=lambda x: (-x[0], x[1] is None, x[1] or 0))
        out += [(i, r, j, s) for r, (s, j) in enumerate(found[:k], 1)]
    return sorted(map(repr, out))


def run(spark, rows, **options):
    df = spark.createDataFrame([(i, v, 1, 0.5, 3, 4, "x") for i, v in rows], SCHEMA)
    return sorted(repr(tuple(r)) for r in top_inner_products(df, **options).collect())


def vectors(n, dims, seed, scale=1.0):
    r = random.Random(seed)
    return [(i, [r.gauss(0, 1) * scale * (1 if r.random() < 0.9 else 5) for _ in range(dims)]) for i in range(n)]


@pytest.mark.parametrize("block, head, dims", [(1024, 2048, 8), (16, 8, 8), (7, 6, 3), (50, 20, 1)])
def test_equals_brute_force(spark, monkeypatch, block, head, dims):
    monkeypatch.setattr(topk, "BLOCK", block)
    monkeypatch.setattr(topk, "HEAD", head)
    monkeypatch.setattr(topk, "_STEP", 5)
    monkeypatch.setattr(topk, "PART", 4)
    rows = vectors(300, dims, block)
    rows += [(1000 + i, rows[3][1]) for i in range(60)] + [(rows[i][0], rows[i][1]) for i in (0, 10, 11)]
    assert run(spark, rows, every=10) == brute(rows, 5, 10, 256.0)


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 2.0]), (1, None), (2, []), (3, [None, 1.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [0.0, 0.0]),
        (7, [1.0, 2.0, 3.0]), (None, [9.0, 9.0]), (None, [9.0, 9.0]), (-4, [-1.0, 0.001]), (8, [-0.5]),
        (10, [1.0, 2.0]), (10, [1.0, 2.0]), (12, [0.001, -0.001]),
    ]
    for k in (1, 3, 5, 50):
        assert run(spark, rows, k=k, every=2) == brute(rows, k, 2, 256.0)


def test_large_components_stay_exact(spark):
    rows = [(i, [float(2**40 + i), float(3**25 - 7 * i), -1.5]) for i in range(12)] + [(20, [1e300, 1.0]), (21, [-1e300]), (22, [1e308, 1.0])]
    assert run(spark, rows, k=4, every=2) == brute(rows, 4, 2, 256.0)


def test_no_rows_and_no_queries(spark):
    assert run(spark, []) == []
    assert run(spark, vectors(20, 4, 1)[1:], every=50) == []
    assert run(spark, [(50, [1.0])]) == []


def test_blocks_are_skipped(spark, monkeypatch):
    """With a few long vectors the short ones never meet a query."""
    monkeypatch.setattr(topk, "BLOCK", 50)
    met = []
    dealt = topk._met
    monkeypatch.setattr(topk, "_met", lambda df, *a: met.append(df.where("kind = 0").count()) or dealt(df, *a))
    rows = [(i, [100.0, 100.0 + i]) for i in range(50)] + [(50 + i, [0.5 + 0.01 * i, 0.0]) for i in range(1000)]
    assert run(spark, rows) == brute(rows, 5, 50, 256.0)
    assert met[0] < 1050
