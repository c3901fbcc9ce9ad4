"""Exact substring dedup: column-wise suffix sorting of many documents at once.

Every byte inside a string of ``length`` bytes that also starts elsewhere is removed; strings
are judged on the input. A string's place among others is found by the multi-document
construction: one symbol per document is put in front of its suffix each round, suffixes are
sorted stably by that symbol over the order of the round before, and common prefixes are one
more than the least one between them before. Columns of symbols lie in a sequential file of
the task, read once, one column a round.

A round over whole documents would take as many rounds as the longest one has bytes, each
over the whole collection, so the documents of the construction are pieces. In every string
of ``length`` bytes the 16-byte gram with the least hash is its anchor; equal strings have
equal anchors at equal places. A piece is the bytes of all strings that share one anchor
place (at most 2 * length - 16). Pieces of one anchor gram are lined up at it and form a
collection, so rounds are bounded, and only suffixes of one round need comparing.

* Anchor places are counted by gram and piece. Grams that occur once are done. A piece that
  occurs twice is removed whole; it stays in its collection once, for other pieces to match.
  (Texts go by a 128-bit hash; copies of a text are pieces that occur twice.)
* Collections of more than ``HOT`` different pieces are not sorted in one task: their
  strings are counted by hash instead, which is exact up to 128-bit collisions and combines
  before the shuffle.

Null text is empty. Repeated rows count as occurrences; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracehound.llm.common import query, table, text_of
from tracehound.runtime import materialize, scratch_path

LENGTH = 200
GRAM = 16
HOT = 50_000
TOGETHER = 4096  # pieces of small collections sorted at once
_ODD = np.uint64(0x9E3779B97F4A7C15)
_LOW = np.uint64((1 << 20) - 1)
_CHUNK = 1 << 19


def anchors(data: bytes, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor places of all strings: place, first and last start of its strings, hash of its gram."""
    out: list[tuple[np.ndarray, ...]] = []
    wide = length - GRAM + 1
    for base in range(0, max(0, len(data) - length + 1), _CHUNK):
        part = np.frombuffer(data[base : base + _CHUNK + length - 1], np.uint8).astype(np.uint64) + np.uint64(1)
        with np.errstate(over="ignore"):
            power, span = _ODD, 1
            while span < GRAM:
                part = part[:-span] * power + part[span:]
                power, span = power * power, 2 * span
            part = (part ^ (part >> np.uint64(31))) * _ODD
            part ^= part >> np.uint64(29)
            n = len(part)
            # the place in the low bits: of equal hashes the last one is the least
            keyed = (part & ~_LOW) | (_LOW - np.arange(n, dtype=np.uint64))
        padded = np.full(-(-n // wide) * wide, np.iinfo(np.uint64).max, np.uint64)
        padded[:n] = keyed
        rows = padded.reshape(-1, wide)
        ahead = np.minimum.accumulate(rows, 1).ravel()
        behind = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
        least = np.minimum(behind[: n - wide + 1], ahead[wide - 1 : n])
        place = (_LOW - (least & _LOW)).astype(np.int64)
        first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
        last = np.append(first[1:], len(place)) - 1
        out.append((place[first] + base, first + base, last + base, part[place[first]].view(np.int64)))
    if not out:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def repeated_starts(pieces: list[bytes], left: np.ndarray, length: int = LENGTH) -> list[np.ndarray]:
    """For pieces lined up at their anchors (``left`` bytes before it): starts of strings that another piece holds at that place."""
    m, before = len(pieces), int(left.max())
    after = max(len(p) - int(n) for p, n in zip(pieces, left, strict=True))
    sizes = np.array([len(p) for p in pieces])
    found: list[tuple[np.ndarray, np.ndarray]] = []
    with tempfile.TemporaryFile() as file:
        flat = np.frombuffer(b"".join(pieces), np.uint8)
        at = np.cumsum(sizes) - sizes
        for column in range(after - 1, -before - 1, -1):  # the file holds the last column first
            inside = (column >= -left) & (column < sizes - left)
            symbols = np.full(m, -1, np.int16)
            symbols[inside] = flat[(at + left + column)[inside]]
            file.write(symbols.tobytes())
        file.seek(0)
        order, common = np.arange(m), np.zeros(m + 1, np.int16)
        for column in range(after - 1, -before - 1, -1):
            symbols = np.frombuffer(file.read(2 * m), np.int16)[order]
            by = np.argsort(symbols, kind="stable")
            between = np.minimum.reduceat(common, by + 1)[:-1]
            same = (symbols[by][1:] == symbols[by][:-1]) & (symbols[by][1:] >= 0)
            order, common = order[by], np.zeros(m + 1, np.int16)
            common[1:m] = np.where(same, np.minimum(between, length) + 1, 0)
            far = np.flatnonzero(common[1:m] >= length) + 1
            if len(far):
                who = np.unique(order[np.concatenate([far, far - 1])])
                found.append((who, np.full(len(who), column)))
    if not found:
        return [np.zeros(0, np.int64)] * m
    who, column = (np.concatenate(x) for x in zip(*found, strict=True))
    sort = np.lexsort((column, who))
    who, start = who[sort], column[sort]
    cuts = np.searchsorted(who, np.arange(m + 1))
    return [start[cuts[k] : cuts[k + 1]] + int(left[k]) for k in range(m)]


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of spans; touching spans are one run."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.append(True, starts[1:] > ends[:-1])
    return starts[new], ends[np.append(np.flatnonzero(new)[1:] - 1, len(ends) - 1)]


def _bytes(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass") if text else b""


def _places(texts: DataFrame, length: int) -> DataFrame:
    """Rows (tk, at, gram, piece) of all anchor places; piece: a hash of its bytes and place.

    ``at`` holds the place, how far its first string starts before it, and how far the last one starts after the first.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 500):
                frames = []
                for tk, text in zip(batch["tk"].iloc[at : at + 500], batch["text"].iloc[at : at + 500], strict=True):
                    data = _bytes(text)
                    place, first, last, gram = anchors(data, length)
                    spans = zip(place.tolist(), first.tolist(), last.tolist(), strict=True)
                    piece = np.fromiter((xxhash.xxh3_64_intdigest(data[f : e + length], a - f) for a, f, e in spans), np.uint64, len(place))
                    frames.append(pd.DataFrame({"tk": tk, "at": place << 16 | (place - first) << 8 | (last - first), "gram": gram, "piece": piece.view(np.int64)}))
                if frames:
                    yield pd.concat(frames)

    return texts.select("tk", "text").mapInPandas(run, "tk binary, at long, gram long, piece long")


def _packed(texts: DataFrame, *also: str) -> DataFrame:
    """tk, the text's compressed bytes, and further columns (name and type)."""
    names = [a.split(" ")[0] for a in also]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            batch["packed"] = [pack(_bytes(t)) for t in batch["text"]]
            yield batch[["tk", "packed", *names]]

    return texts.select("tk", "text", *names).mapInPandas(run, ", ".join(["tk binary", "packed binary", *also]))


def _pieces(wanted: DataFrame, packed: DataFrame, length: int) -> DataFrame:
    """Adds ``data``, the bytes of each wanted piece. A text's pieces are cut in slices of rows, never all at once."""
    names = ["tk", "first", "left", "gram", "counted", "large", "data"]
    schema = "tk binary, first int, left int, gram long, counted boolean, large boolean, data binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for tk, text, *spans in zip(*(batch.column(i) for i in range(batch.num_columns))):
                text, tk = unpack(text.as_py()), tk.as_py()
                # whole arrays: a row object for each span would take longer than all the rest
                at, gram, counted, large = (x.values.to_numpy(zero_copy_only=False) for x in spans)
                first = (at >> 16) - (at >> 8 & 255)
                end = first + (at & 255) + length
                for k in range(0, len(at), 20_000):
                    part = slice(k, k + 20_000)
                    data = [text[f:e] for f, e in zip(first[part].tolist(), end[part].tolist())]
                    left = (at[part] >> 16) - first[part]
                    yield pa.record_batch(
                        [pa.array([tk] * len(data), pa.binary()), pa.array(first[part], pa.int32()), pa.array(left, pa.int32()), pa.array(gram[part]),
                         pa.array(counted[part], pa.bool_()), pa.array(large[part], pa.bool_()), pa.array(data, pa.binary())], names=names,
                    )

    listed = F.collect_list(F.struct("at", "gram", "counted", "large"))
    spans = wanted.groupBy("tk").agg(listed.alias("s")).select("tk", *[F.col("s")[c].alias(c) for c in ("at", "gram", "counted", "large")])
    return spans.join(packed, "tk").select("tk", "packed", "at", "gram", "counted", "large").mapInArrow(run, schema)


def _first():
    return F.shiftright("at", 16) - F.shiftright("at", 8).bitwiseAND(255)


def _sorted_spans(pieces: DataFrame, length: int) -> DataFrame:
    """Spans (tk, start, end) of repeated strings found by the construction, for pieces not counted yet."""

    def solve(rows: list) -> list[tuple]:
        out = []
        starts = repeated_starts([r.data for r in rows], np.array([r.left for r in rows]), length)
        for r, found in zip(rows, starts, strict=True):
            if len(found) and not r.counted:
                a, b = merged(found + r.first, found + r.first + length)
                out += [(r.tk, s, e) for s, e in zip(a.tolist(), b.tolist(), strict=True)]
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, group, gram = [], [], None
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                if r.gram != gram:
                    held += group
                    group, gram = [], r.gram
                    if len(held) >= TOGETHER:  # whole collections only
                        out += solve(held)
                        held = []
                group.append(r)
            yield pd.DataFrame(out, columns=["tk", "start", "end"])
        if held or group:
            yield pd.DataFrame(solve(held + group), columns=["tk", "start", "end"])

    rows = pieces.where("not large").select("tk", "first", "left", "gram", "counted", "data")
    return rows.repartition("gram").sortWithinPartitions("gram").mapInPandas(run, "tk binary, start int, end int")


def _counted_spans(pieces: DataFrame, length: int) -> DataFrame:
    """The same for collections too large for one task: strings are counted by hash."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                starts = range(len(r.data) - length + 1)
                keys = [xxhash.xxh3_128_digest(r.data[k : k + length]) for k in starts]
                yield pd.DataFrame({"tk": r.tk, "start": [r.first + k for k in starts], "counted": r.counted, "key": keys})

    strings = pieces.where("large").select("tk", "first", "counted", "data").mapInPandas(run, "tk binary, start int, counted boolean, key binary")
    often = strings.groupBy("key").count().where("count > 1").select("key")
    return strings.where("not counted").join(often, "key").select("tk", "start", (F.col("start") + length).alias("end"))


def repeated_spans(texts: DataFrame, length: int = LENGTH) -> DataFrame:
    """Spans (tk, start, end) of bytes to remove from texts (tk, text)."""
    spark = texts.sparkSession
    path = scratch_path(spark, "places")
    _places(texts, length).write.parquet(path)
    places = spark.read.parquet(path)
    kinds = places.groupBy("gram", "piece").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("tk", "at")).alias("one"))
    grams = kinds.groupBy("gram").agg(F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("all")).where("all > 1")
    kinds = materialize(kinds.join(grams, "gram").select("gram", "piece", "n", "kinds", "one"))
    whole = places.join(kinds.where("n > 1").select("gram", "piece"), ["gram", "piece"])
    whole = whole.select("tk", _first().cast("int").alias("start"), (_first() + F.col("at").bitwiseAND(255) + length).cast("int").alias("end"))
    wanted = kinds.where("kinds > 1").select("one.*", "gram", (F.col("n") > 1).alias("counted"), (F.col("kinds") > HOT).alias("large"))
    # each different text once: its pieces were chosen once for all its copies
    pieces = _pieces(wanted, _packed(texts).dropDuplicates(["tk"]), length)
    spans = whole.unionByName(_sorted_spans(pieces, length))
    return spans if wanted.where("large").isEmpty() else spans.unionByName(_counted_spans(pieces, length))


def remove_repeats(docs: DataFrame, length: int = LENGTH, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (bytes) of every row."""
    key = F.unhex(F.md5(text_of(text)))
    texts = docs.select(text_of(text).alias("text"), key.alias("tk"))
    covered = materialize(repeated_spans(texts, length).groupBy("tk").agg(F.collect_set(F.struct("start", "end")).alias("spans")))
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_of(text).alias("text"), key.alias("tk"))
    packed = _packed(rows, f"doc_id {kind}")
    facts = packed.join(covered, "tk", "left").select("doc_id", "packed", "spans")
    return facts.mapInPandas(_cutter, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def _cutter(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    unpack = zstandard.ZstdDecompressor().decompress
    names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
    for batch in batches:
        for at in range(0, len(batch), 500):
            part, out = batch.iloc[at : at + 500], []
            for text, spans in zip(part["packed"], part["spans"], strict=True):
                data, starts, ends = unpack(text), np.zeros(0, np.int64), np.zeros(0, np.int64)
                if spans is not None and len(spans):
                    starts, ends = merged(np.array([s["start"] for s in spans]), np.array([s["end"] for s in spans]))
                edges = [0, *np.stack([starts, ends], 1).ravel().tolist(), len(data)]
                kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                out.append((len(data), len(data) - len(kept), len(starts), hashlib.sha256(kept).hexdigest(), kept))
            frame = pd.DataFrame(out, columns=names)
            frame.insert(0, "doc_id", part["doc_id"].to_numpy())
            yield frame


@query("op5_repeats")
def op5_repeats(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")
