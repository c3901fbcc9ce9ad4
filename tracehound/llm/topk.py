"""Exact top-k search by inner product, over vectors sorted by length.

Every vector is scaled and rounded down to whole numbers; the score is the exact inner
product. Vectors are numbered by descending length and cut into blocks. By the
Cauchy-Schwarz inequality a block can matter to a query only if the query's length times the
longest vector of the block reaches the query's k-th best score so far. A first score comes
from the ``head``, the longest vectors of all, so each query knows how many blocks it needs:
a prefix of the order. Queries are dealt in parts of like depth, each part meets each block it
needs in one task, and nothing else is paired.

Within a block, vectors are rotated by the right singular vectors of the head, which moves
most of their length into the first coordinates. The inner product over those plus the
product of the remaining lengths bounds the score; pairs whose bound stays below the query's
k-th score are dropped, a second, longer sum drops more, and the rest get their exact score.
The k-th score rises as a block is read from its longest vector to its shortest, and a query
leaves the block when length alone can no longer reach it. Bounds carry a slack for rounding;
a rotation fitted on other vectors would change the cost, never the result.

The driver sees the head (at most ``HEAD_BYTES``), one length per block (at most
``MAX_BLOCKS``) and one number per query part. A task holds one block and one batch of
queries. Null vectors and those with null or non-finite components take no part, as query or
candidate; vectors of different size are filled up with zeros, an empty one scores 0 with
all. A row is not its own candidate, another row of the same id is. Ties go to the smaller
id, null ids last; a null id is no query. Sums beyond 2^53 are taken in Python's integers and
end at the limits of a long. Empty tables give no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracehound.llm.common import query, table
from tracehound.runtime import materialize, number_rows

BLOCK = 1024
MAX_BLOCKS = 4096
PART = 16_384
HEAD = 2048
HEAD_BYTES = 16 << 20
_STEP = 256  # vectors of a block that are met at once
_QUERIES = 512
_EXACT = 2.0**53
_LONG = (1 << 63) - 1


def whole_vectors(vectors: DataFrame, scale: float, vector: str = "embedding", vec_id: str = "vec_id") -> DataFrame:
    """_row, vec_id, v (whole components as doubles, in bytes), size and length of the valid vectors."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row, name, v in zip(*(batch.column(i) for i in range(3))):
                if not v.is_valid:
                    continue
                whole = np.floor(v.values.cast(pa.float64()).to_numpy(zero_copy_only=False) * scale)
                if np.isfinite(whole).all():
                    with np.errstate(over="ignore"):
                        rows.append((row.as_py(), name.as_py(), whole.tobytes(), len(whole), float(np.sqrt(whole @ whole))))
            columns = list(zip(*rows)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.float64())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=["_row", "vec_id", "v", "size", "length"])

    rows = vectors.select(F.monotonically_increasing_id().alias("_row"), F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("v"))
    return rows.mapInArrow(of, "_row long, vec_id long, v binary, size int, length double")


def _matrix(cells: pa.Array, dims: int) -> np.ndarray:
    out = np.zeros((len(cells), dims))
    for i, cell in enumerate(cells):
        v = np.frombuffer(cell.as_py())
        out[i, : len(v)] = v
    return out


def exact_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows of ``a`` with all rows of ``b``."""
    with np.errstate(over="ignore", invalid="ignore"):
        largest = np.sqrt((a * a).sum(1).max(initial=0) * (b * b).sum(1).max(initial=0))
    if largest < _EXACT:  # no partial sum can leave the whole numbers a double holds
        return (a @ b.T).astype(np.int64)
    whole = [[int(x) for x in row] for row in b]
    sums = [[sum(int(x) * y for x, y in zip(p, q)) for q in whole] for p in a]
    return np.array([[min(max(s, -_LONG - 1), _LONG) for s in row] for row in sums], np.int64).reshape(len(a), len(b))


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """The k best of each row, in any order."""
    return np.partition(scores, scores.shape[1] - k, axis=1)[:, -k:]


class Block:
    """Vectors in descending length, rotated, with what is left of their lengths."""

    def __init__(self, rows: np.ndarray, ids: pa.Array, vectors: np.ndarray, rotation: np.ndarray):
        self.rows, self.ids, self.vectors, self.rotation = rows, ids, vectors, rotation
        dims = vectors.shape[1]
        self.cuts = sorted({max(1, dims // 8), max(1, dims // 2)}) if dims else []
        self.turned, self.rest = self._turn(vectors)
        self.lengths = self.rest[0]

    def _turn(self, vectors: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        with np.errstate(over="ignore", invalid="ignore"):
            turned = vectors @ self.rotation
            # rounded up, so that bounds stay bounds
            rest = [np.sqrt((turned[:, cut:] ** 2).sum(1)) * (1 + 1e-9) for cut in (0, *self.cuts)]
        return turned, rest

    def search(self, query_rows: np.ndarray, queries: np.ndarray, floors: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Query number, vector number and score of all pairs that may be among a query's best k."""
        turned, rest = self._turn(queries)
        floors = floors.copy()
        best = np.full((len(queries), k), -np.inf)
        with np.errstate(over="ignore", invalid="ignore"):
            for start in range(0, len(self.rows), _STEP):
                part = slice(start, start + _STEP)
                slack = 1e-9 * rest[0] * self.lengths[start] + 1e-9
                low = floors - slack - 1e-9 * np.where(np.isfinite(floors), np.abs(floors), 0)
                # a comparison with "not a number" must keep its pair
                active = np.flatnonzero(~(rest[0] * self.lengths[start] < low))
                if not len(active):
                    return
                alive = query_rows[active, None] != self.rows[None, part]
                for i, cut in enumerate(self.cuts, 1):
                    bound = turned[active, :cut] @ self.turned[part, :cut].T + np.outer(rest[i][active], self.rest[i][part])
                    alive &= ~(bound < low[active, None])
                    if not alive.any():
                        break
                asked, met = np.flatnonzero(alive.any(1)), np.flatnonzero(alive.any(0))
                if not len(asked):
                    continue
                scores = exact_scores(queries[active[asked]], self.vectors[start + met])
                alive, asked = alive[np.ix_(asked, met)], active[asked]
                best[asked] = _best(np.concatenate([best[asked], np.where(alive, scores, -np.inf)], axis=1), k)
                floors[asked] = np.maximum(floors[asked], best[asked].min(1))
                at, to = np.nonzero(alive & (scores >= low[asked, None]))
                yield asked[at], start + met[to], scores[at, to]


def _with_needs(queries: DataFrame, head: pa.Table, dims: int, k: int, longest: np.ndarray) -> DataFrame:
    """Adds ``floor``, the k-th best score within the head, and ``depth``, the number of blocks that can matter."""
    rows, vectors = head["_row"].to_numpy(), _matrix(head["v"].combine_chunks(), dims)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            floors = np.full(batch.num_rows, -np.inf)
            for start in range(0, batch.num_rows, _QUERIES):
                own = batch.column("_row").to_numpy()[start : start + _QUERIES]
                scores = exact_scores(_matrix(batch.column("v")[start : start + _QUERIES], dims), vectors)
                scores = np.where(own[:, None] == rows[None], -np.inf, scores)
                if scores.shape[1] >= k:
                    floors[start : start + _QUERIES] = _best(scores, k).min(1)
            lengths = batch.column("length").to_numpy()
            with np.errstate(over="ignore", invalid="ignore"):
                # blocks fall in length: those that reach the floor come first
                depth = [int((~(length * longest * (1 + 1e-9) + 1e-9 < low)).sum()) for length, low in zip(lengths, floors - 1e-9 * np.where(np.isfinite(floors), np.abs(floors), 0))]
            yield batch.append_column("floor", pa.array(floors)).append_column("depth", pa.array(depth, pa.int32()))

    return queries.mapInArrow(of, "_row long, vec_id long, v binary, length double, floor double, depth int")


def _met(dealt: DataFrame, dims: int, rotation: np.ndarray, k: int) -> DataFrame:
    """The best k of each query within each block it meets; a block's rows come before its queries."""
    names = ["_row", "query_id", "vec_id", "score"]

    def found(block: Block, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for start in range(0, batch.num_rows, _QUERIES):
            few = batch.slice(start, _QUERIES)
            rows = few.column("_row").to_numpy()
            hits = list(block.search(rows, _matrix(few.column("v"), dims), few.column("floor").to_numpy(), k))
            if not hits:
                continue
            at, to, scores = (np.concatenate(c) for c in zip(*hits))
            ids = block.ids.take(pa.array(to))
            order = np.lexsort((ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False), -scores.astype(float), at))
            at, scores, ids = at[order], scores[order], ids.take(pa.array(order))
            place = np.arange(len(at)) - np.searchsorted(at, at)
            top = np.flatnonzero(place < k)
            yield pa.record_batch([pa.array(rows[at[top]]), few.column("vec_id").take(pa.array(at[top])), ids.take(pa.array(top)), pa.array(scores[top])], names=names)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, waiting, block = None, [], None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("block", "part", "kind")], axis=1)
            edges = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
            for start, end in zip([0, *edges], [*edges, len(keys)]):
                piece = batch.slice(start, end - start)
                if tuple(keys[start, :2]) != key:
                    key, waiting, block = tuple(keys[start, :2]), [], None
                if keys[start, 2] == 0:
                    waiting.append(piece.select(["_row", "vec_id", "v"]))
                    continue
                if block is None:
                    rows = pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]
                    block = Block(rows.column("_row").to_numpy(), rows.column("vec_id"), _matrix(rows.column("v"), dims), rotation)
                    waiting = []
                yield from found(block, piece)

    return dealt.mapInArrow(of, "_row long, query_id long, vec_id long, score long")


def top_inner_products(vectors: DataFrame, k: int = 5, every: int = 50, scale: float = 256.0) -> DataFrame:
    """query_id, rank, vec_id and score: the best ``k`` other rows of each row whose id ``every`` divides."""
    spark = vectors.sparkSession
    valid = materialize(whole_vectors(vectors, scale))
    total, dims = valid.agg(F.count(F.lit(1)), F.coalesce(F.max("size"), F.lit(0))).first()
    rows = max(k + 1, min(HEAD, HEAD_BYTES // (8 * max(1, dims))))
    head = valid.orderBy(F.desc("length"), "_row").limit(rows).toArrow()  # bounded by HEAD_BYTES
    strongest = _matrix(head["v"].combine_chunks(), dims)
    strongest /= max(np.abs(strongest).max(initial=0), 1.0)
    rotation = np.linalg.svd(strongest, full_matrices=dims > len(strongest))[2].T if strongest.size else np.eye(dims)

    block_rows = max(BLOCK, -(-total // MAX_BLOCKS))
    ordered = number_rows(valid, F.desc("length"), F.col("_row"), name="place")
    ordered = materialize(ordered.withColumn("block", F.floor((F.col("place") - 1) / block_rows).cast("int")))
    longest = np.array([r[1] for r in sorted(ordered.groupBy("block").agg(F.max("length")).collect())], float)  # at most MAX_BLOCKS rows
    queries = _with_needs(ordered.where(F.col("vec_id") % every == 0).select("_row", "vec_id", "v", "length"), head, dims, k, longest)
    queries = number_rows(queries, F.desc("depth"), F.col("_row"), name="place")
    queries = materialize(queries.withColumn("part", F.floor((F.col("place") - 1) / PART).cast("int")))

    depths = [r[1] for r in sorted(queries.groupBy("part").agg(F.max("depth")).collect())]  # one row per part, falling
    parts = spark.createDataFrame([(b, sum(d > b for d in depths)) for b in range(len(longest))], "block int, parts int")
    empty = {"floor": F.lit(None).cast("double"), "kind": F.lit(0)}
    columns = ["block", "part", "kind", "place", "_row", "vec_id", "v", "floor"]
    candidates = ordered.join(F.broadcast(parts), "block").withColumn("part", F.explode(F.expr("slice(sequence(0, parts), 1, parts)"))).withColumns(empty)
    asked = queries.withColumn("block", F.explode(F.expr("slice(sequence(0, depth), 1, depth)"))).withColumn("kind", F.lit(1))
    dealt = candidates.select(*columns).unionByName(asked.select(*columns))
    dealt = dealt.repartition("block", "part").sortWithinPartitions("block", "part", "kind", "place")
    best = Window.partitionBy("_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    ranked = _met(dealt, dims, rotation, k).withColumn("rank", F.row_number().over(best))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT q.r, q.vec_id AS query_id, v.vec_id, list_inner_product(q.e, v.e)::BIGINT AS score
  FROM v q JOIN v ON q.r <> v.r WHERE q.vec_id % 50 = 0)
SELECT query_id, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM pairs
QUALIFY rank <= 5
"""


@query("op12_topk", _SQL)
def op12_topk(spark, sf_dir: str) -> DataFrame:
    return top_inner_products(table(spark, sf_dir, "embeddings"))
