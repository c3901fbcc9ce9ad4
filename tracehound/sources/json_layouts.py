"""JSON log files: one object per row, whatever the layout of the file.

Files hold one object per line, objects over several lines, or one array. The last two are
cut into blocks of lines, or of bytes for files with very long lines, and
``tracehound.functions.json_scan`` finds the objects in each block; no file has to fit into a
row or a task.

A number of an object is the number of the line it begins on. Array elements, and objects
that begin behind another one on the same line, have no line of their own: they are numbered
from ``extra_base`` on, densely, by file and place.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracehound.functions.json_scan import ArrayScan, ObjectScan, State, carry
from tracehound.functions.text import trim_blank
from tracehound.operators.parse_json import json_object
from tracehound.runtime import materialize

# Fixed value: share of lines that must be objects for a file of one object per line.
NDJSON_SHARE = 0.5
EXTRA_BASE = 1 << 62  # no run has so many lines
_BLOCK_LINES = 4096
_BLOCK_BYTES = 1 << 20

_OBJECT = ["event_seq", "source_file", "line_number", "line"]


# ---- blocks --------------------------------------------------------------------------


def line_blocks(lines: DataFrame) -> DataFrame:
    """One row per block: its text, and the number of each of its lines in file and input."""
    rows = F.array_sort(F.collect_list(F.struct("line_number", "event_seq", "line")))
    blocks = lines.withColumn("block", F.floor(F.col("line_number") / _BLOCK_LINES)).groupBy("source_file", "block").agg(rows.alias("rows"))
    return blocks.select(
        "source_file", "block", F.concat(F.array_join(F.col("rows")["line"], "\n"), F.lit("\n")).alias("text"),
        F.col("rows")["line_number"].alias("numbers"), F.col("rows")["event_seq"].alias("seqs"),
    )


def file_blocks(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Blocks of files read up to each closing brace, so that one long line is many rows.

    The reader drops the brace, and cannot tell whether the last piece of a file had one:
    the bytes of all pieces and the size of the file can.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, size, start = None, [], 0, 0

        def block() -> pa.RecordBatch:
            whole = b"}".join([*held, b""])
            cells = [[key[0]], [start], [whole.decode(errors="replace")], [len(whole)], [key[2]]]
            return pa.record_batch([pa.array(c, t) for c, t in zip(cells, (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()))], names=["source_file", "block", "text", "bytes", "size"])

        for batch in batches:
            for piece, *at in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if held and (at != key or size >= _BLOCK_BYTES):
                    yield block()
                    # a block has a byte at least, so its number stays below the next split
                    held, size, start = [], 0, start + 1
                if at != key:
                    key, start = at, at[1]
                held.append(piece)
                size += len(piece) + 1
        if held:
            yield block()

    meta = F.col("_metadata")
    pieces = spark.read.text(path, lineSep="}").select(
        F.col("value").cast("binary"), meta["file_path"], meta["file_block_start"], meta["file_size"]
    )
    blocks = materialize(pieces.mapInArrow(of, "source_file string, block long, text string, bytes long, size long"))
    last = blocks.groupBy("source_file").agg(F.max("block").alias("block"), (F.sum("bytes") > F.max("size")).alias("open_end"))
    text = F.when(F.coalesce("open_end", F.lit(False)), F.expr("left(text, length(text) - 1)")).otherwise(F.col("text"))
    none = F.lit(None).cast("array<long>")
    return blocks.join(last, ["source_file", "block"], "left").select("source_file", "block", text.alias("text"), none.alias("numbers"), none.alias("seqs"))


# ---- objects and elements ------------------------------------------------------------


def _one_by_one(batch: pa.RecordBatch) -> Iterator[tuple]:
    """Rows of a batch of blocks: only one text at a time is a Python object."""
    for i in range(batch.num_rows):
        yield tuple(column[i].as_py() for column in batch.columns)


def _states(blocks: DataFrame, scan: type) -> DataFrame:
    """The state each block starts in, the lines before it, and the depth at the end of its file."""

    def effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [pickle.dumps(scan(b, t).effect()) for _, b, t in _one_by_one(batch)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(found, pa.binary())], names=["source_file", "block", "effect"])

    def in_file(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("block")
        states, end = carry(scan, [pickle.loads(e) for e in rows["effect"]])
        return pd.DataFrame({
            "source_file": rows["source_file"], "block": rows["block"], "state": [pickle.dumps(s) for s, _ in states],
            "lines_before": [n for _, n in states], "end_depth": end.depth,
        })

    # one short row per block
    short = blocks.select("source_file", "block", "text").mapInArrow(effects, "source_file string, block long, effect binary")
    return short.groupBy("source_file").applyInPandas(in_file, "source_file string, block long, state binary, lines_before long, end_depth int")


_PARTS = (
    "source_file string, opened_block long, opened_at long, block long, text string, begins boolean, ends boolean, "
    "line_number long, event_seq long, first boolean, end_depth int"
)


def _cutter(scan: type) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    kinds = (pa.string(), *[pa.int64()] * 3, pa.string(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64(), pa.bool_(), pa.int32())
    names = [f.split()[0] for f in _PARTS.split(", ")]

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for file, block, text, numbers, seqs, state, before, depth in _one_by_one(batch):
                at, line, last = 0, 0, -1
                for p in scan(block, text).parts(pickle.loads(state)):
                    number = seq = None
                    first = False
                    if p.begins and scan is ObjectScan:
                        line += text.count("\n", at, p.opened[1])
                        at, first, last = p.opened[1], line != last, line
                        number = before + line + 1 if numbers is None else numbers[line]
                        seq = None if seqs is None else seqs[line]
                    rows.append((file, *p.opened, block, p.text, p.begins, p.ends, number, seq, first, depth))
                size += len(text)
                # what is held does not grow with the blocks of a batch
                if rows and size >= _BLOCK_BYTES:
                    yield table(rows)
                    rows, size = [], 0
        if rows:
            yield table(rows)

    return of


def _parts(blocks: DataFrame, scan: type) -> DataFrame:
    """What each block has of each object, with the line it begins on."""
    placed = blocks.join(_states(blocks, scan), ["source_file", "block"])
    return placed.select("source_file", "block", "text", "numbers", "seqs", "state", "lines_before", "end_depth").mapInArrow(_cutter(scan), _PARTS)


def _joined(blocks: DataFrame, scan: type) -> DataFrame:
    """Objects or elements that were closed; those that cross a block border are put together."""
    parts = materialize(_parts(blocks, scan))
    key = ["source_file", "opened_block", "opened_at"]
    about = ["line_number", "event_seq", "first", "end_depth"]
    whole = parts.where("begins and ends").select(*key, "text", *about)
    crossing = parts.where("not (begins and ends)").groupBy(*key).agg(
        # the parts of one object
        F.array_join(F.array_sort(F.collect_list(F.struct("block", "text")))["text"], "").alias("text"),
        *[F.max(c).alias(c) for c in about], F.max("ends").alias("ends"),
    )
    return whole.unionByName(crossing.where("ends").drop("ends"))


def _numbered(extras: DataFrame, place: Column, base: int) -> DataFrame:
    """``event_seq`` from ``base`` on, by file, block and place within the block."""
    groups = extras.groupBy("source_file", "opened_block").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.orderBy("source_file", "opened_block").rowsBetween(Window.unboundedPreceding, -1)
    # one row per block
    before = groups.select("source_file", "opened_block", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    return extras.join(before, ["source_file", "opened_block"]).withColumn("event_seq", F.lit(base).cast("long") + F.col("_before") + place)


def _in_block() -> Column:
    return F.row_number().over(Window.partitionBy("source_file", "opened_block").orderBy("opened_at")) - 1


def split_objects(blocks: DataFrame, extra_base: int = EXTRA_BASE) -> DataFrame:
    """Objects one after the other, over any lines."""
    found = _joined(blocks, ObjectScan)
    first = found.where("first and event_seq is not null")
    extras = _numbered(found.where("not (first and event_seq is not null)"), _in_block(), extra_base)
    return first.unionByName(extras.select(first.columns)).withColumnRenamed("text", "line").select(_OBJECT)


def array_elements(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Elements of array files, and the names of the files that are one valid array."""
    found = materialize(_joined(blocks, ArrayScan))
    text = trim_blank(F.col("text"))
    empty = text == ""
    json = F.when(F.startswith(text, F.lit("{")), json_object(text).isNotNull()).otherwise(F.try_parse_json(text).isNotNull())
    files = found.groupBy("source_file").agg(
        F.count(F.lit(1)).alias("n"), F.min("opened_at").alias("lowest"), F.max("end_depth").alias("depth"),
        F.count_if(empty).alias("empty"), F.count_if(~empty & ~json).alias("broken"),
    )
    nothing = (F.col("n") == 1) & (F.col("empty") == 1)
    valid = files.where((F.col("lowest") == 0) & (F.col("depth") == 0) & (F.col("broken") == 0) & ((F.col("empty") == 0) | nothing))
    return found.where(~empty), valid.select("source_file")


def _array_objects(elements: DataFrame, extra_base: int) -> DataFrame:
    numbered = _numbered(elements.drop("event_seq"), F.col("opened_at"), extra_base)
    return numbered.select("event_seq", "source_file", (F.col("opened_at") + 1).alias("line_number"), F.col("text").alias("line"))


# ---- layouts -------------------------------------------------------------------------


def _looks(lines: DataFrame) -> DataFrame:
    """Per file: ``ndjson``, ``array`` by its first character only, or ``objects``."""
    stats = lines.groupBy("source_file").agg(
        F.avg(json_object(F.col("line")).isNotNull().cast("double")).alias("share"),
        F.min_by(F.substring("line", 1, 1), "line_number").alias("first_char"),
    )
    return stats.select(
        "source_file",
        F.when(F.col("share") > NDJSON_SHARE, "ndjson").when(F.col("first_char") == "[", "array").otherwise("objects").alias("layout"),
    )


def _layouts(lines: DataFrame) -> tuple[DataFrame, dict[str, int], DataFrame | None]:
    """Layout per file, files of each layout, and the elements of the array files."""
    looks = materialize(_looks(lines))  # one row per file
    elements = None
    if not looks.where("layout = 'array'").isEmpty():
        candidates = lines.join(looks.where("layout = 'array'").select("source_file"), "source_file", "left_semi")
        elements, valid = array_elements(materialize(line_blocks(candidates)))
        # a bracket may also begin a banner line above objects
        looks = looks.join(valid.withColumn("_valid", F.lit(True)), "source_file", "left").select(
            "source_file", F.when((F.col("layout") == "array") & F.col("_valid").isNull(), "objects").otherwise(F.col("layout")).alias("layout")
        )
        looks = materialize(looks)
    return looks, dict(looks.groupBy("layout").count().collect()), elements  # at most three rows


def json_layout(lines: DataFrame) -> DataFrame:
    """Per file: ``array``, ``ndjson`` or ``objects`` (over any lines, one after the other)."""
    return _layouts(lines)[0]


def json_documents(lines: DataFrame, extra_base: int = EXTRA_BASE) -> DataFrame:
    """One JSON object per row from numbered lines, with the layout of its file."""
    looks, kinds, elements = _layouts(lines)

    def of(df: DataFrame, layout: str) -> DataFrame:
        return df.join(looks.where(F.col("layout") == layout), "source_file")

    out = of(lines, "ndjson").select(*_OBJECT, "layout")
    if "array" in kinds:
        rows = materialize(_array_objects(of(elements, "array").drop("layout"), extra_base))
        out = out.unionByName(rows.withColumn("layout", F.lit("array")))
        extra_base += rows.count()
    if "objects" in kinds:
        rows = split_objects(materialize(line_blocks(of(lines, "objects"))), extra_base)
        out = out.unionByName(rows.withColumn("layout", F.lit("objects")))
    return out.withColumn("line", trim_blank(F.col("line"))).where(json_object(F.col("line")).isNotNull())


def json_objects(lines: DataFrame, extra_base: int = EXTRA_BASE) -> DataFrame:
    """One JSON object per row from numbered lines of any of the three layouts."""
    return json_documents(lines, extra_base).drop("layout")


def scan_json_events(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One JSON object per row from files of any size, long lines included.

    A file that is one array gives its elements, any other file its objects; ``event_seq``
    numbers them by file and place. Files of one object per line whose lines may be broken
    are better read line by line.
    """
    blocks = file_blocks(spark, path)
    blocks = materialize(blocks)
    looks = blocks.groupBy("source_file").agg(F.min_by(F.substring(F.ltrim(F.regexp_replace("text", r"^\s+", "")), 1, 1), "block").alias("first_char"))
    elements, valid = array_elements(blocks.join(looks.where("first_char = '['"), "source_file", "left_semi"))
    valid = materialize(valid)
    arrays = materialize(_array_objects(elements.join(valid, "source_file", "left_semi"), 1))
    objects = split_objects(blocks.join(valid, "source_file", "left_anti"), arrays.count() + 1)
    out = arrays.unionByName(objects)
    return out.withColumn("line", trim_blank(F.col("line"))).where(json_object(F.col("line")).isNotNull())
