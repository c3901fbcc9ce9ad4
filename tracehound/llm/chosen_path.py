"""N-gram Jaccard join along chosen paths.

A text is the set of its five-word shingles; texts with equal sets are one class and are
joined once. A class is embedded as 64 smallest hashes, so that two classes agree on a
coordinate as often as their sets' Jaccard similarity says. A run starts with all classes in
one node. A node picks one coordinate, and with probability 1/threshold - 1 another one; its
classes move to children by their value there, so similar ones stay together with the
branching factor that keeps a pair at the threshold alive. Nodes of one class end; small
nodes are searched by brute force; larger ones split again. A node that hardly shrinks when
it is split is dense, its classes really are alike: it is searched by brute force in pairs
of blocks, so no task holds more than two blocks. Runs are repeated until a pair at the
threshold has met with the target probability, given the deepest node seen. All runs draw on
the same coordinates, so a pair that agrees in few of them is weak in every run; the target
holds over the spread of that number, not only for its mean.

A pair that meets in several nodes belongs to the smallest of them: every class carries the
list of its nodes (32 bits of each: two nodes of a pair look alike with a chance of 1 in ten
million), so each node knows. A node first compares coordinates, and keeps the
classes that agree in enough of them with another one in a pair that belongs to it; only for
those are the texts fetched, and brute force counts exact Jaccard similarities on their
shingles. Thus a text travels for the pairs that are compared, not for every meeting. What
leaves a node is one row per class (its links there and the root of its linked group), never
its pairs.

Result: one row per input row with its class (smallest id among all texts linked to it
directly or through others), its number of links (other rows whose similarity reaches the
threshold, copies included) and whether it stands for its class. Words are lower-cased runs
of letters and digits. A text of fewer than five words is one shingle; null text and texts
without words are alone. Null ids come after all others. Repeated rows count as copies.
Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracehound.llm.common import query, table, text_key, text_of
from tracehound.llm.components import components
from tracehound.operators.bloom import where_maybe
from tracehound.runtime import materialize, shuffles_removed

WORDS = 5
THRESHOLD = 0.8
TARGET = 1 - 1e-6
COORDINATES = 64
SMALL = 128  # classes of a node that is searched as a whole
BLOCK = 384  # classes of a block of a dense node
AGREE = 35  # coordinates that must agree before texts are compared
FIRST_DEPTH = 4  # the first runs suffice for nodes that deep
DENSE = 0.6  # a node that keeps so much of its parent is dense
ROWS = 20_000  # of a task, once rows carry signatures of 256 bytes
MEMO_WORDS = 300_000

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_ODD = np.uint64(0x9E3779B97F4A7C15)
_SEEDS = np.random.default_rng(5).integers(1, 2**63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
# coordinates take half as long in 32 bits
_SHORT_SEEDS, _SHORT_ODD = (_SEEDS >> np.uint64(31)).astype(np.uint32) | np.uint32(1), np.uint32(0x85EBCA6B)


def _mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


class Shingler:
    """Distinct shingle hashes of texts, with a bounded memo of word hashes."""

    def __init__(self, words: int = WORDS):
        self.words, self.memo = words, {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = _WORD.findall(text.translate(_LOWER)) if text else []
        if not words:
            return np.zeros(0, np.uint64)
        memo = self.memo
        if len(memo) > MEMO_WORDS:
            memo.clear()
        for w in set(words).difference(memo):
            memo[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"))
        codes = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
        n = max(1, len(codes) - self.words + 1)
        with np.errstate(over="ignore"):
            out = np.zeros(n, np.uint64)
            for k in range(min(self.words, len(codes))):
                out = out * _ODD + codes[k : k + n]
            return np.unique(_mix(out + np.uint64(min(self.words, len(codes)))))


def signature(tokens: np.ndarray) -> np.ndarray:
    """The smallest hash of each coordinate, as 32-bit integers."""
    least = np.full(COORDINATES, np.iinfo(np.uint32).max, np.uint32)
    short = (tokens >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(short), 512):
        hashed = short[None, at : at + 512] * _SHORT_SEEDS[:, None]
        hashed ^= hashed >> np.uint32(15)
        hashed *= _SHORT_ODD
        least = np.minimum(least, hashed.min(1))
    return least.view(np.int32)


def signatures(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, text_key, set_key (fingerprint of the shingle set; null without words) and sig of every row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingles = Shingler()
        for batch in batches:
            keys, sigs = [], []
            for t in batch["text"]:
                tokens = shingles(t)
                keys.append(xxhash.xxh3_128_digest(tokens.tobytes()) if len(tokens) else None)
                sigs.append(signature(tokens) if len(tokens) else None)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "text_key": batch["text_key"], "set_key": keys, "sig": sigs})

    rows = docs.select(F.col(doc_id).alias("doc_id"), text_key(text_of(text)).alias("text_key"), F.col(text).alias("text"))
    kind = docs.schema[doc_id].dataType.simpleString()
    return rows.mapInPandas(run, f"doc_id {kind}, text_key long, set_key binary, sig array<int>")


def survival(depth: int, agree: float, threshold: float) -> float:
    """Chance that a pair that agrees in that share of coordinates meets in a node that deep in one run."""
    alive, more = 1.0, (1 / threshold - 1) * (1 - 1 / COORDINATES)  # a second coordinate may be the first again
    for _ in range(depth):
        hit = agree * alive
        alive = (1 - more) * hit + more * (1 - (1 - hit) ** 2)
    return alive


def missed(depth: int, runs: int, threshold: float) -> float:
    """Chance that a pair at the threshold never meets, though it agrees in ``AGREE`` coordinates or more."""
    out = 0.0
    for k in range(AGREE, COORDINATES + 1):
        share = math.comb(COORDINATES, k) * threshold**k * (1 - threshold) ** (COORDINATES - k)
        out += share * (1 - survival(depth, k / COORDINATES, threshold)) ** runs
    return out


def runs_needed(depth: int, threshold: float, target: float) -> int:
    runs = 1
    while missed(depth, runs, threshold) > 1 - target:
        runs += 1
    return runs


def _split(rows: DataFrame, threshold: float) -> DataFrame:
    """Children of each row's node; keeps cid, sig and the node's size as ``parent``."""
    pick = lambda k: F.pmod(F.xxhash64("node", F.lit(k)), F.lit(COORDINATES)).cast("int")
    child = lambda k: F.xxhash64("node", pick(k), F.get("sig", pick(k)))
    twice = F.pmod(F.xxhash64("node", F.lit(0)), F.lit(1000)) < int(1000 * (1 / threshold - 1))
    nodes = F.when(twice & (pick(1) != pick(2)), F.array(child(1), child(2))).otherwise(F.array(child(1)))
    return rows.select("cid", "sig", F.col("size").alias("parent"), F.explode(nodes).alias("node"))


def leaves(classes: DataFrame, first: int, runs: int, threshold: float) -> tuple[list[DataFrame], int]:
    """Rows (cid, node, size) of the nodes to search, for runs ``first`` and on; and the deepest level.

    Few rows split a second time. They fetch their signatures once and carry them from then on,
    in as many tasks as there are rows for.
    """
    total = classes.count()
    roots = F.explode(F.array(*[F.xxhash64(F.lit("run"), F.lit(r)) for r in range(first, first + runs)]))
    rows, found, depth = classes.select("cid", "sig", F.lit(total).cast("long").alias("size"), roots.alias("node")), [], 0
    fit = lambda df: df
    done = (F.col("size") <= SMALL) | (F.col("size") >= DENSE * F.col("parent"))
    while True:
        depth += 1
        children = _split(rows, threshold)
        sizes = children.groupBy("node").agg(F.count(F.lit(1)).alias("size"), F.max("parent").alias("parent")).where("size > 1")
        sizes = materialize(fit(sizes))
        if depth == 1:
            # nearly all classes are alone at once: they are dropped before the join
            kept = where_maybe(children.select("cid", "node"), sizes, ["node"]).join(sizes, "node")
        else:
            kept = children.select("cid", "node", "sig").join(sizes, "node").withColumn("sig", F.when(~done, F.col("sig")))
        kept = materialize(fit(kept))
        found.append(kept.where(done).select("cid", "node", "size"))
        large = kept.where(~done)
        left = large.count()
        if not left:
            return found, depth
        fit = lambda df, n=-(-left // ROWS): df.coalesce(n)
        rows = large.select("cid", "node", "size", "sig") if depth > 1 else materialize(fit(large.select("cid", "node", "size").join(where_maybe(classes.select("cid", "sig"), large, ["cid"]), "cid")))


def meetings(classes: DataFrame, threshold: float, target: float) -> DataFrame:
    """Rows (cid, node, size) of the nodes to search, of as many runs as the target takes."""
    found, runs, needed = [], 0, runs_needed(FIRST_DEPTH, threshold, target)
    while runs < needed:
        more, depth = leaves(classes, runs, needed - runs, threshold)
        found += more
        runs, needed = needed, max(needed, runs_needed(depth, threshold, target))
    places = found[0]
    for part in found[1:]:
        places = places.unionByName(part)
    # a union has the partitions of all its parts
    return places.coalesce(int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _between(pairs: np.ndarray, cross: int) -> np.ndarray:
    """Of a matrix of pairs each pair once; with ``cross`` only those between the first rows and the rest."""
    pairs = np.triu(pairs, 1)
    if cross:
        pairs[:cross, :cross] = False
        pairs[cross:, cross:] = False
    return pairs


def _short(nodes: np.ndarray) -> np.ndarray:
    """The upper half of node numbers, in the same order."""
    return (nodes.astype(np.int64) >> 32).astype(np.int32)


def _owned(node: int, homes: list[bytes]) -> np.ndarray:
    """Matrix of the pairs that share no node smaller than this one."""
    here = _short(np.array([node]))[0]
    smaller = [h[h < here] for h in (np.frombuffer(b, np.int32) for b in homes)]
    values, codes, counts = np.unique(np.concatenate(smaller), return_inverse=True, return_counts=True)
    if not (counts > 1).any():
        return np.ones((len(homes), len(homes)), bool)
    owner = np.repeat(np.arange(len(homes)), [len(h) for h in smaller])
    shared = counts[codes] > 1
    _, codes = np.unique(codes[shared], return_inverse=True)
    member = np.zeros((len(homes), codes.max() + 1), np.float32)
    member[owner[shared], codes] = 1
    return member @ member.T == 0


def _linked(sets: list[np.ndarray], cross: int, threshold: float) -> np.ndarray:
    """Matrix of the pairs of sets at or above the threshold: within all, or with ``cross`` between the first ones and the rest."""
    sizes = np.array([len(s) for s in sets], np.float64)
    values, codes, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), sizes.astype(np.int64))
    shared = counts[codes] > 1
    order = np.argsort(codes[shared], kind="stable")
    owner, codes = owner[shared][order], codes[shared][order]
    _, codes = np.unique(codes, return_inverse=True)
    both = np.zeros((len(sets), len(sets)), np.float32)
    at, width = 0, 4096
    while at < len(codes):  # few columns at a time
        end = int(np.searchsorted(codes, codes[at] + width))
        held = np.zeros((len(sets), width), np.float32)
        held[owner[at:end], codes[at:end] - codes[at]] = 1
        both += held @ held.T
        at = end
    return _between(both >= threshold * (sizes[:, None] + sizes[None, :] - both) - 1e-6, cross)


def _deal(rows: DataFrame, *columns: str) -> DataFrame:
    """Each row once for a small node; for a dense node once for every pair of blocks that its block is in."""
    blocks = F.when(F.col("size") <= SMALL, 1).otherwise(F.ceil(F.col("size") / BLOCK)).cast("int")
    own = F.pmod(F.xxhash64("cid", "node"), F.col("blocks")).cast("int")
    dealt = rows.withColumn("blocks", blocks).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.select("node", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "cid", *columns)


def _in_groups(dealt: DataFrame, make, schema: str) -> DataFrame:
    """Stream each (node, i, j) through ``make()(rows, cross)``; cross: how many rows are of the first of two blocks."""
    names = [f.split(" ")[0] for f in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        work, key, held = make(), None, []

        def close() -> list[tuple]:
            rows = sorted({r.cid: r for r in held}.values(), key=lambda r: (r.own, r.cid))
            cross = 0 if len(rows) < 2 or rows[0].i == rows[0].j else sum(r.own == rows[0].i for r in rows)
            return [] if len(rows) < 2 or (rows[0].i != rows[0].j and cross in (0, len(rows))) else work(rows, cross)

        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                if (r.node, r.i, r.j) != key:
                    out += close()
                    key, held = (r.node, r.i, r.j), []
                held.append(r)
            yield pd.DataFrame(out, columns=names)
        yield pd.DataFrame(close(), columns=names)

    return dealt.repartition("node", "i", "j").sortWithinPartitions("node", "i", "j").mapInPandas(run, schema)


def hopeful(rows: DataFrame) -> DataFrame:
    """Of rows (node, size, cid, sig, nodes) those, as (cid, node), that agree in ``AGREE`` coordinates with another class, in a pair that belongs to the node.

    A pair at the threshold fails to with a chance of about one in a million.
    """

    def make():
        def work(rows: list, cross: int) -> list[tuple]:
            sigs = np.frombuffer(b"".join(r.sig for r in rows), np.uint8).reshape(len(rows), COORDINATES)
            same = np.zeros((len(rows), len(rows)), np.uint8)
            for column in np.ascontiguousarray(sigs.T):
                same += column[:, None] == column[None, :]
            near = _between(same >= AGREE, cross)
            if near.any():
                near &= _owned(rows[0].node, [r.nodes for r in rows])
            return [(rows[k].cid, rows[k].node) for k in np.flatnonzero(near.any(0) | near.any(1))]

        return work

    return _in_groups(_deal(rows, "sig", "nodes"), make, "cid long, node long").distinct()


def search(rows: DataFrame, threshold: float) -> DataFrame:
    """Exact search in every node: rows (cid, root, links).

    ``rows``: node, size, cid, copies, nodes (all nodes of the class) and packed (its text).
    """

    def make():
        shingles, unpack = Shingler(), zstandard.ZstdDecompressor().decompress

        def work(rows: list, cross: int) -> list[tuple]:
            root = list(range(len(rows)))

            def find(x: int) -> int:
                while root[x] != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return x

            linked = _linked([shingles(unpack(r.packed).decode("utf-8", "surrogatepass")) for r in rows], cross, threshold)
            for a, b in zip(*(x.tolist() for x in np.nonzero(linked))):
                x, y = find(a), find(b)
                if x != y:
                    x, y = sorted((x, y), key=lambda k: rows[k].cid)
                    root[y] = x
            own = linked & _owned(rows[0].node, [r.nodes for r in rows])
            copies = np.array([r.copies for r in rows], np.int64)
            links = own @ copies + own.T @ copies
            return [(rows[k].cid, rows[find(k)].cid, int(links[k])) for k in range(len(rows)) if links[k] or find(k) != k]

        return work

    return _in_groups(_deal(rows, "copies", "nodes", "packed"), make, "cid long, root long, links long")


def _with_bytes(classes: DataFrame, places: DataFrame) -> DataFrame:
    """Classes that meet any other: cid, sig and nodes as bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            # the lowest byte of a coordinate tells unequal ones apart well enough to let go of most
            batch["sig"] = [(np.asarray(s, np.int32) & 255).astype(np.uint8).tobytes() for s in batch["sig"]]
            batch["nodes"] = [_short(np.asarray(n)).tobytes() for n in batch["nodes"]]
            yield batch

    # a class is in few nodes: at most two for each split on its way, in each run
    of_class = places.groupBy("cid").agg(F.collect_set("node").alias("nodes"))
    rows = of_class.join(classes.select("cid", "sig"), "cid").select("cid", "sig", "nodes")
    return rows.mapInPandas(run, "cid long, sig binary, nodes binary")


def _packed(docs: DataFrame, text: str) -> DataFrame:
    """Each different text once: text_key and its compressed bytes. Copies go before the shuffle, as far as a task sees them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            batch["packed"] = [pack(("" if t is None else t).encode("utf-8", "surrogatepass")) for t in batch["text"]]
            yield batch[["text_key", "packed"]]

    return docs.select(text_key(text_of(text)).alias("text_key"), F.col(text).alias("text")).mapInPandas(run, "text_key long, packed binary").dropDuplicates(["text_key"])


def _linked_classes(docs: DataFrame, threshold: float, target: float, doc_id: str, text: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Stored tables: all rows, classes of equal sets, links by class, and components."""
    members = materialize(signatures(docs, doc_id, text))
    classes = members.where("set_key is not null").groupBy("set_key").agg(F.min("text_key").alias("text_key"), F.first("sig").alias("sig"), F.count(F.lit(1)).alias("copies"))
    # a short number, as classes travel often
    classes = materialize(classes.withColumn("cid", F.monotonically_increasing_id()))
    met = materialize(meetings(classes, threshold, target))
    known = materialize(_with_bytes(where_maybe(classes, met, ["cid"]), met))
    near = hopeful(met.join(known.select("cid", "sig", "nodes"), "cid"))
    near = materialize(near.join(near.groupBy("node").agg(F.count(F.lit(1)).alias("size")), "node"))
    wanted = near.groupBy("cid").agg(F.collect_list(F.struct("node", "size")).alias("places"))
    wanted = materialize(wanted.join(classes.select("cid", "text_key", "copies"), "cid").join(known.select("cid", "nodes"), "cid"))
    # only texts that will be compared are packed and shuffled, and few others
    asked = where_maybe(docs.withColumn("_text_key", text_key(text_of(text))), wanted.select(F.col("text_key").alias("_text_key")), ["_text_key"])
    rows = wanted.join(_packed(asked, text), "text_key").withColumn("_at", F.explode("places"))
    links = materialize(search(rows.select("_at.node", "_at.size", "cid", "copies", "nodes", "packed"), threshold))
    label = components(links.select(F.col("cid").alias("a"), F.col("root").alias("b")))
    return members, classes, links, label


def jaccard_classes(docs: DataFrame, threshold: float = THRESHOLD, target: float = TARGET, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, text_key, class_id, n_links, stands (for its class)."""
    with shuffles_removed(docs.sparkSession):
        members, classes, links, label = _linked_classes(docs, threshold, target, doc_id, text)
    counted = links.groupBy("cid").agg(F.sum("links").alias("links"))
    labelled = (
        classes.select("set_key", "cid", "copies").join(counted, "cid", "left")
        .join(label.withColumnRenamed("node", "cid"), "cid", "left")
        .select("set_key", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "cid").alias("component"))
    )
    rows = members.select("doc_id", "text_key", "set_key").join(labelled, "set_key", "left")
    place = F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "text_key")
    firsts = rows.where("component is not null").groupBy("component").agg(F.min(place).alias("first"))
    return rows.join(firsts, "component", "left").select(
        "doc_id",
        "text_key",
        F.coalesce(F.col("first.doc_id"), F.col("doc_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        (F.col("first").isNull() | (F.col("first") == place)).alias("stands"),
    )


@query("op8_jaccard_join")
def op8_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")
