"""Benchmark decontamination: item-sized windows, SimHash and multi-index Hamming search.

An item of m words is looked for in windows of m words. A window is taken wherever a text
holds one of an item's five-word shingles: it starts where that shingle puts the item, kept
inside the text. Any window with some shingle in common with an item has such a neighbour,
so no text that repeats an item escapes.

Windows and items get a 64-bit SimHash of their shingles, each weighted by its length in
characters. The bits are dealt into ``radius`` + 1 blocks: two fingerprints within the radius
agree in one block at least, so joining on (window size, block, bits) finds all of them.
At the threshold of 0.8 fingerprints differ in about 10 bits, hardly ever in more than 20.
Candidates within the radius are verified exactly: weighted Jaccard similarity of the two
shingle multisets.

Everything is Spark functions. The index of item shingles is broadcast up to ``MAX_INDEX``
rows; a larger one is joined with the narrow positions of all shingles, and only the rows
that match fetch their texts. Result: one row per (row of the input, item) found.

Null or wordless texts and items match nothing. Texts or items of fewer than five words are
one shingle. A text shorter than the item is one window. Repeated items and repeated rows
each give their rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracehound.llm.common import PLAIN_WORD, plain_words, query, table, text_key, text_of
from tracehound.runtime import materialize

WORDS = 5
THRESHOLD = 0.8
RADIUS = 20
BITS = 64
MAX_INDEX = 1_000_000


def _positions(words: Column) -> Column:
    return F.sequence(F.lit(0), F.greatest(F.size(words) - WORDS, F.lit(0)))


def shingle_hashes(words: Column) -> Column:
    """One hash per shingle; words behind the end are null and leave the hash alone."""
    hashed = lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WORDS)])
    return F.when(F.size(words) > 0, F.transform(_positions(words), hashed)).otherwise(F.array().cast("array<bigint>"))


def shingles(words: Column) -> Column:
    return F.transform(_positions(words), lambda i: F.array_join(F.slice(words, i + 1, F.lit(WORDS)), " "))


def with_fingerprint(rows: DataFrame, radius: int = RADIUS, words: str = "words") -> DataFrame:
    """Adds shingles, bits (array<boolean>) and blocks (array<int>) of a column of words."""
    count = radius + 1
    ends = [BITS * k // count for k in range(count + 1)]
    out = rows.withColumn("shingles", shingles(F.col(words)))
    out = out.withColumn("_hashed", F.expr("transform(shingles, s -> struct(xxhash64(s) as h, length(s) as w))"))
    # the hashed shingles are the outer array: inside a lambda they would be computed again for each bit
    votes = f"aggregate(_hashed, array_repeat(0, {BITS}), (s, x) -> transform(s, (v, b) -> v + if((shiftrightunsigned(x.h, b) & 1L) = 1L, x.w, -x.w)))"
    out = out.withColumn("bits", F.expr(f"transform({votes}, v -> v > 0)"))
    block = lambda a, b: F.aggregate(F.slice("bits", a + 1, b - a), F.lit(0), lambda s, x: s * 2 + x.cast("int"))
    return out.withColumn("blocks", F.array(*[block(a, b) for a, b in zip(ends, ends[1:], strict=False)])).drop("_hashed")


def similarity(a: Column, b: Column) -> Column:
    """Weighted Jaccard similarity of two arrays of shingles."""
    weight = lambda x: F.aggregate(x, F.lit(0), lambda s, g: s + F.length(g))
    held = lambda x, g: F.size(F.filter(x, lambda y: y == g))
    both = F.aggregate(F.array_distinct(a), F.lit(0), lambda s, g: s + F.length(g) * F.least(held(a, g), held(b, g)))
    return both / (weight(a) + weight(b) - both)


def windows(docs: DataFrame, items: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct windows of ``docs`` (keys, text): keys, start, size, words."""
    index = items.select(F.posexplode(shingle_hashes(F.col("words"))).alias("at", "hash"), F.size("words").alias("size")).distinct()
    start = F.greatest(F.least(F.col("pos") - F.col("at"), F.size("words") - F.col("size")), F.lit(0))
    cut = [*keys, "start", "size", F.expr("slice(words, start + 1, size)").alias("words")]
    texts = docs.select(*keys, plain_words(text_of("text")).alias("words"))
    spread = lambda *also: texts.select(*keys, *also, F.posexplode(shingle_hashes(F.col("words"))).alias("pos", "hash"))
    if index.count() <= MAX_INDEX:
        # texts ride along in generated code and are copied for matching positions only
        found = spread("words").join(F.broadcast(index), "hash")
        return found.withColumn("start", start).select(*cut).distinct()
    found = spread().join(index, "hash").select(*keys, "pos", "at", "size").distinct()
    same = [F.col(f"_{k}").eqNullSafe(F.col(k)) for k in keys]
    back = texts.distinct().join(found.withColumnsRenamed({k: f"_{k}" for k in keys}), same)
    return back.withColumn("start", start).select(*cut).distinct()


def contaminated(
    docs: DataFrame,
    items: DataFrame,
    threshold: float = THRESHOLD,
    radius: int = RADIUS,
    doc_id: str = "doc_id",
    item_id: str = "item_id",
) -> DataFrame:
    """doc_id, text_key, item_id, similarity (the best) and start (word, of the first best window)."""
    items = items.select(F.col(item_id).alias("item_id"), plain_words(text_of("text")).alias("words")).where(F.size("words") > 0)
    keyed = docs.select(F.col(doc_id).alias("doc_id"), text_key(text_of("text")).alias("text_key"), F.col("text").alias("text"))
    # written once: else filters that the optimizer infers would compute fingerprints again and again
    found = materialize(with_fingerprint(windows(keyed, items, ["doc_id", "text_key"]), radius))
    found = found.select("doc_id", "text_key", "start", "size", "shingles", "bits", "blocks", F.posexplode("blocks").alias("block", "value"))
    known = materialize(with_fingerprint(items, radius)).select("item_id", F.size("words").alias("size"), F.col("shingles").alias("_shingles"), F.col("bits").alias("_bits"), F.col("blocks").alias("_blocks"))
    known = known.select("*", F.posexplode("_blocks").alias("block", "value"))
    unequal = lambda a, b: F.size(F.filter(F.zip_with(a, b, lambda x, y: x != y), lambda x: x))
    first = F.array_position(F.zip_with("blocks", "_blocks", lambda x, y: x == y), True) - 1
    pairs = found.join(known, ["size", "block", "value"])
    # a pair meets in every block it shares; the first one speaks for it
    pairs = pairs.where((first == F.col("block")) & (unequal("bits", "_bits") <= radius))
    pairs = pairs.withColumn("similarity", similarity(F.col("shingles"), F.col("_shingles"))).where(F.col("similarity") >= threshold)
    best = pairs.groupBy("doc_id", "text_key", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("back"))).alias("best"))
    return best.select("doc_id", "text_key", "item_id", "best.similarity", (-F.col("best.back")).alias("start"))


def _sql() -> str:
    words = f"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{PLAIN_WORD}')"
    cut = f"unnest([{{'k': i, 's': array_to_string(w[i + 1:i + {WORDS}], ' ')}} for i in range(greatest(len(w) - {WORDS - 1}, 1))], recursive := true)"
    return rf"""
WITH d AS (SELECT DISTINCT doc_id, {words} AS w FROM documents),
it AS (SELECT item_id, {words} AS w FROM benchmark),
ds AS (SELECT doc_id, w, {cut} FROM d WHERE len(w) > 0),
ts AS (SELECT item_id, len(w) AS m, {cut} FROM it WHERE len(w) > 0),
win AS (
  SELECT DISTINCT ds.doc_id, ds.w, ts.m, greatest(least(ds.k - ts.k, len(ds.w) - ts.m), 0) AS start FROM ds JOIN ts USING (s)),
ws AS (SELECT doc_id, m, start, {cut} FROM (SELECT doc_id, m, start, w[start + 1:start + m] AS w FROM win)),
wc AS (SELECT doc_id, m, start, s, count(*) AS c FROM ws GROUP BY ALL),
tc AS (SELECT item_id, m, s, count(*) AS c FROM ts GROUP BY ALL),
wt AS (SELECT doc_id, m, start, sum(length(s) * c) AS total FROM wc GROUP BY ALL),
tt AS (SELECT item_id, sum(length(s) * c) AS total FROM tc GROUP BY ALL),
sim AS (
  SELECT doc_id, item_id, start, sum(length(s) * least(wc.c, tc.c)) AS common, any_value(wt.total) AS a, any_value(tt.total) AS b
  FROM wc JOIN tc USING (m, s) JOIN wt USING (doc_id, m, start) JOIN tt USING (item_id) GROUP BY ALL),
ok AS (SELECT doc_id, item_id, start, common / (a + b - common) AS similarity FROM sim WHERE common / (a + b - common) >= {THRESHOLD})
SELECT doc_id, item_id, max(similarity) AS similarity, arg_max(start, similarity * 1e6 - start * 1e-9)::INTEGER AS start FROM ok GROUP BY ALL
"""


@query("op2_decontaminate", _sql())
def op2_decontaminate(spark, sf_dir: str) -> DataFrame:
    out = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "item_id", "similarity", "start")
