"""Target-distribution importance resampling: draw the documents that look like a target.

Features are runs of one to ``order`` words, hashed by crc32 into ``buckets``. Two arrays
count them over all documents and all target texts; the gain of a bucket is the logarithm of
its smoothed share in the target over that in the documents, in whole thousandths. A
document's weight is the floored mean gain of its features; a Gumbel number from its id and
the seed is added, so the highest scores are a weighted draw without replacement.

The ranks come from parallel sorting by regular sampling. Every run (one partition of scored
rows, a few numbers each) is sorted where it lies and gives evenly spaced samples; the sorted
samples give the splitters; rows are exchanged by the segment between two splitters, each
segment is merged by the task that gets it, and the counts of the segments before it turn a
place in the segment into an exact rank. A segment holds at most about twice its fair share
of rows, as rows that tie in score and id are told apart by a running number. Segments behind
the last rank drawn are never exchanged.

The driver sees ``buckets`` counts, at most ``MAX_SAMPLES`` samples (beyond that many, runs
give fewer each) and one count a segment. Null texts have no words. Documents below
``min_words`` are scored, never drawn. A null id hashes as the empty text and loses ties;
repeated rows are drawn one by one. Empty tables give no rows; without any target text all
gains follow from the smoothing alone. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracehound.llm.common import query, table, text_of
from tracehound.runtime import materialize, scratch_path

# On bytes: lower() changes A-Z only, and every byte outside ASCII belongs to a word.
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")

SEGMENT_ROWS = 1_000_000
MAX_SAMPLES = 1_000_000
_INDEX = (1 << 33) - 1  # the part of monotonically_increasing_id that counts within a partition


@dataclass(frozen=True)
class Draw:
    """What to draw: hashed features, seed, and percent of the documents long enough."""

    order: int = 1
    buckets: int = 10_000
    seed: str = "2024"
    min_words: int = 20
    percent: int = 10


def feature_buckets(text: bytes, order: int, buckets: int) -> tuple[int, np.ndarray]:
    """Number of words, and the bucket of every feature."""
    words = _WORD.findall(text.lower())
    parts = [np.fromiter(map(zlib.crc32, words), np.uint32, len(words))]
    for n in range(2, order + 1):
        runs = [b" ".join(r) for r in zip(*(words[i:] for i in range(n)))]
        parts.append(np.fromiter(map(zlib.crc32, runs), np.uint32, len(runs)))
    return len(words), np.concatenate(parts) % np.uint32(buckets)


def _bytes(column: str) -> Column:
    return text_of(column).cast("binary")


def bucket_counts(texts: DataFrame, draw: Draw, text: str = "text") -> np.ndarray:
    """How many features of all texts fall into each bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(draw.buckets, np.int64)
        for batch in batches:
            for t in batch.column(0):
                total += np.bincount(feature_buckets(t.as_py(), draw.order, draw.buckets)[1], minlength=draw.buckets)
        used = np.flatnonzero(total)
        yield pa.record_batch({"bucket": used, "n": total[used]})

    sums = texts.select(_bytes(text).alias("t")).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(draw.buckets, np.int64)
    for row in sums.collect():  # one row per bucket
        out[row["bucket"]] = row["n"]
    return out


def bucket_gains(have: np.ndarray, want: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of smoothed shares, rounded down."""
    size, all_have, all_want = len(have), int(have.sum()), int(want.sum())
    ratios = ((int(t) + 1) * (all_have + size) / ((int(s) + 1) * (all_want + size)) for s, t in zip(have, want))
    return np.array([math.floor(1000 * math.log(r)) for r in ratios], np.int64)


def gumbel(seed: str, doc_id: int | None) -> int:
    """Thousandths of a Gumbel number that id and seed decide, rounded down."""
    name = f"{seed}:{'' if doc_id is None else doc_id}".encode()
    h = int(hashlib.sha256(name).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def score(docs: DataFrame, gains: np.ndarray, draw: Draw, text: str = "text") -> DataFrame:
    """doc_id, n_words, n_features, weight and score of every document."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            rows = []
            for doc_id, t in zip(ids, batch.column(1)):
                n_words, found = feature_buckets(t.as_py(), draw.order, draw.buckets)
                weight = int(gains[found].sum()) // len(found) if len(found) else 0
                rows.append((n_words, len(found), weight, weight + gumbel(draw.seed, doc_id)))
            cells = np.array(rows, np.int64).reshape(len(rows), 4).T
            yield pa.record_batch({"doc_id": pa.array(ids, pa.int64())} | dict(zip(("n_words", "n_features", "weight", "score"), cells)))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _bytes(text).alias("t"))
    return rows.mapInArrow(of, "doc_id long, n_words long, n_features long, weight long, score long")


_ORDER = (F.desc, "score"), (F.asc_nulls_last, "doc_id"), (F.asc, "_row")


def _keys(score: np.ndarray, doc_id: pa.Array, row: np.ndarray) -> tuple[np.ndarray, ...]:
    """The sort order of rows, last key first, as ``numpy.lexsort`` takes it."""
    return row, doc_id.fill_null(0).to_numpy(zero_copy_only=False), doc_id.is_null().to_numpy(zero_copy_only=False), -score


def _with_segment(rows: DataFrame, splitters: pa.RecordBatch) -> DataFrame:
    """Adds the number of splitters up to each row."""
    cut = [splitters.column(c) for c in ("score", "doc_id", "_row")]
    cut_keys = _keys(cut[0].to_numpy(), cut[1], cut[2].to_numpy())

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = _keys(batch.column("score").to_numpy(), batch.column("doc_id"), batch.column("_row").to_numpy())
            order = np.lexsort([np.concatenate(pair) for pair in zip(cut_keys, own)])
            passed = np.cumsum(order < splitters.num_rows)
            segment = np.empty(len(order), np.int32)
            segment[order] = passed
            yield batch.append_column("_segment", pa.array(segment[splitters.num_rows :]))

    return rows.mapInArrow(of, f"{', '.join(f'{n} {t}' for n, t in rows.dtypes)}, _segment int")


def rank_by_regular_sampling(rows: DataFrame, limit: int) -> DataFrame:
    """Adds ``rank`` to rows with score, doc_id and a unique ``_row``: 1 for the best, null beyond ``limit``."""
    spark = rows.sparkSession
    order = [make(c) for make, c in _ORDER]
    runs = materialize(rows.sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id()))
    run, place = F.shiftright("_place", 33), F.col("_place").bitwiseAND(F.lit(_INDEX))
    sizes = runs.groupBy(run.alias("_run")).agg(F.count(F.lit(1)).alias("_size"))
    n_runs, total = sizes.agg(F.count(F.lit(1)), F.coalesce(F.sum("_size"), F.lit(0))).first()
    segments = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // SEGMENT_ROWS))
    each = max(1, min(segments, MAX_SAMPLES // max(1, n_runs)))
    spaced = runs.withColumn("_run", run).join(F.broadcast(sizes), "_run")  # one row per run
    step = F.greatest(F.ceil(F.col("_size") / each), F.lit(1))
    samples = spaced.where(place % step == 0).select("score", "doc_id", "_row").toArrow().combine_chunks()
    samples = samples.take(np.lexsort(_keys(samples["score"].to_numpy(), samples["doc_id"].combine_chunks(), samples["_row"].to_numpy())))
    cuts = np.unique(np.arange(1, segments) * samples.num_rows // segments) if samples.num_rows else []
    splitters = samples.take(pa.array(cuts, pa.int64())).combine_chunks().to_batches()
    empty = pa.RecordBatch.from_pylist([], samples.schema)
    dealt = _with_segment(runs.drop("_place"), splitters[0] if splitters else empty)

    counts = dict(dealt.groupBy("_segment").count().collect())  # one row per segment
    before, done = [], 0
    for segment in range(segments + 1):
        before.append((segment, done))
        done += counts.get(segment, 0)
    needed = [s for s, ahead in before if ahead < limit and s in counts]
    last = max(needed, default=-1)
    merged = (
        dealt.where(F.col("_segment") <= last).repartitionById(segments + 1, F.col("_segment"))
        .sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit(_INDEX)))
    )
    ahead = spark.createDataFrame(before, "_segment int, _before long")  # one row per segment
    rank = F.col("_before") + F.col("_at") + 1
    ranked = merged.join(F.broadcast(ahead), "_segment").withColumn("rank", F.when(rank <= limit, rank)).drop("_at", "_before")
    return ranked.unionByName(dealt.where(F.col("_segment") > last).withColumn("rank", F.lit(None).cast("long"))).drop("_segment")


def importance_resample(docs: DataFrame, target: DataFrame, draw: Draw = Draw(), text: str = "text") -> DataFrame:
    """doc_id, n_features, weight, score and rank (null: not drawn) of every document."""
    spark = docs.sparkSession
    gains = bucket_gains(bucket_counts(docs, draw, text), bucket_counts(target, draw, text))
    path = scratch_path(spark, "importance")
    # written once: a few numbers per document, read again in splits of full size
    score(docs, gains, draw, text).withColumn("_row", F.monotonically_increasing_id()).write.parquet(path)
    scored = spark.read.parquet(path)
    long_enough = F.col("n_words") >= draw.min_words
    limit = scored.where(long_enough).count() * draw.percent // 100
    ranked = rank_by_regular_sampling(scored.where(long_enough), limit)
    rest = scored.where(~long_enough).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(rest).select("doc_id", "n_features", "weight", "score", "rank")


# crc32 in SQL: a table by eight steps for each byte value, then one step per byte of a word.
_SQL = r"""
WITH step AS (
  SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, b)) AS t),
words AS (
  SELECT 'd' AS side, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL
  SELECT 'b', item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
uses AS (SELECT side, doc_id, unnest(w) AS word FROM words),
vocabulary AS (SELECT DISTINCT word FROM uses),
bytes AS (
  SELECT word, list_transform(range(strlen(word)), lambda i: ('0x' || substr(hex(encode(word)), 2 * i + 1, 2))::BIGINT) AS b FROM vocabulary),
crc AS (
  SELECT word, xor(4294967295, list_reduce(b, lambda c, x: xor(step.t[xor(c & 255, x) + 1], c >> 8), 4294967295)) % 10000 AS bucket FROM bytes, step),
counts AS (SELECT side, bucket, count(*) AS n FROM uses JOIN crc USING (word) GROUP BY ALL),
totals AS (SELECT coalesce(sum(n) FILTER (side = 'd'), 0) AS s, coalesce(sum(n) FILTER (side = 'b'), 0) AS t FROM counts),
gains AS (
  SELECT bucket, floor(1000 * ln((coalesce(sum(n) FILTER (side = 'b'), 0) + 1)::DOUBLE * (any_value(totals.s) + 10000) / ((coalesce(sum(n) FILTER (side = 'd'), 0) + 1)::DOUBLE * (any_value(totals.t) + 10000)))) AS gain
  FROM counts, totals GROUP BY bucket),
means AS (SELECT doc_id, floor(avg(gain)) AS weight FROM uses JOIN crc USING (word) JOIN gains USING (bucket) WHERE side = 'd' GROUP BY doc_id),
scored AS (
  SELECT doc_id, len(w) AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5) / 4294967296))))::BIGINT AS score
  FROM words LEFT JOIN means USING (doc_id) WHERE side = 'd'),
ranks AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT scored.*, CASE WHEN place <= n * 10 // 100 THEN place END AS rank FROM scored LEFT JOIN ranks USING (doc_id)
"""


@query("op11_importance", _SQL)
def op11_importance(spark, sf_dir: str) -> DataFrame:
    return importance_resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
