"""Raw log lines with exact line numbers, and the file catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracehound.functions.labels import human_size
from tracehound.functions.text import trim_blank
from tracehound.runtime import materialize

# Fixed value: file types that count as logs.
ALLOWED_EXTENSIONS = [".log", ".json", ".txt", ".csv"]

def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def raw_text(reader, path: str | list[str]) -> DataFrame:
    """Physical lines of text files with their file and the block they are read from.

    ``reader`` is ``spark.read`` or ``spark.readStream``.
    """
    return reader.text(path, lineSep="\n").select(
        F.col("value").alias("text"),
        F.col("_metadata.file_path").alias("source_file"),
        F.col("_metadata.file_block_start").alias("_block"),
    )


MAX_BROADCAST_BLOCKS = 500_000


def line_blocks(text: DataFrame) -> DataFrame:
    """One row per block that a task reads: its lines, and those before it in file and input.

    Only this much of the input goes through a window. Blocks are the splits of the files, so
    the table is some ten thousand times smaller than the input; it is stored.
    """
    per_block = text.withColumn("_pos", F.monotonically_increasing_id()).groupBy("source_file", "_block").agg(
        F.min("_pos").alias("_first"), F.count(F.lit(1)).alias("_n")
    )
    in_file = Window.partitionBy("source_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    overall = Window.orderBy("source_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    return materialize(per_block.select(
        "source_file", "_block", "_first", "_n",
        F.coalesce(F.sum("_n").over(in_file), F.lit(0)).alias("_off"),
        F.coalesce(F.sum("_n").over(overall), F.lit(0)).alias("_seq"),
    ))


def beside_blocks(df: DataFrame, blocks: DataFrame, on: list[str]) -> DataFrame:
    """Join with a table of one row per block or file: without a shuffle while it is small."""
    small = blocks.count() <= MAX_BROADCAST_BLOCKS
    return df.join(F.broadcast(blocks) if small else blocks, on)


def number_lines(
    text: DataFrame, seq_base: int = 0, keep_blank: bool = False, blocks: DataFrame | None = None, before: DataFrame | None = None
) -> DataFrame:
    """``event_seq, source_file, line_number, line`` from ``raw_text`` rows.

    Files stay splittable: each block numbers its own lines by their place in the task that
    reads it, and the line counts of the earlier blocks are added. Sequence numbers follow
    file name and line number, after ``seq_base``. ``before`` holds ``source_file, lines`` of
    files whose first lines came in earlier batches.
    """
    blocks = line_blocks(text) if blocks is None else blocks
    if before is not None:
        known = blocks.join(before, "source_file", "left")
        blocks = known.withColumn("_off", F.col("_off") + F.coalesce("lines", F.lit(0))).drop("lines")
    lines = text.withColumn("_pos", F.monotonically_increasing_id())
    place = F.col("_pos") - F.col("_first") + 1
    out = beside_blocks(lines, blocks, ["source_file", "_block"]).select(
        (F.lit(seq_base).cast("long") + F.col("_seq") + place).alias("event_seq"),
        "source_file", (F.col("_off") + place).alias("line_number"), trim_blank(F.col("text")).alias("line"),
    )
    return out if keep_blank else out.where("line <> ''")


def scan_log_lines(spark: SparkSession, path: str | list[str], keep_blank: bool = False) -> DataFrame:
    """Numbered, trimmed lines of text files of any size; blank lines are dropped."""
    return number_lines(raw_text(spark.read, path), keep_blank=keep_blank)


def _allowed_glob() -> str:
    """Pattern of allowed file names in any case; others are left out when files are listed."""
    any_case = lambda text: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in text)
    return "*{" + ",".join(map(any_case, ALLOWED_EXTENSIONS)) + "}"


def file_catalog(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Per log file: size, lines, preview. Files with other extensions are never opened."""
    meta = F.col("_metadata")
    rows = spark.read.option("pathGlobFilter", _allowed_glob()).text(path, lineSep="\n").select(
        F.col("value").alias("text"), meta["file_path"].alias("source_file"), meta["file_size"].alias("size_bytes"),
        meta["file_modification_time"].alias("modified"), meta["file_block_start"].alias("_block"),
    )
    blocks = line_blocks(rows)
    placed = beside_blocks(rows.withColumn("_pos", F.monotonically_increasing_id()), blocks, ["source_file", "_block"])
    number = F.col("_off") + F.col("_pos") - F.col("_first")
    # the preview needs at most its own length in lines
    early = F.when(number <= PREVIEW_CHARS, F.struct(number.alias("n"), F.substring("text", 1, PREVIEW_CHARS + 1).alias("t")))
    files = placed.groupBy("source_file", "size_bytes", "modified").agg(
        F.count_if(trim_blank(F.col("text")) != "").alias("lines"),
        F.array_sort(F.collect_list(early)).alias("_first_lines"),
    ).withColumn("_head", F.array_join(F.col("_first_lines")["t"], "\n"))
    preview = F.substring("_head", 1, PREVIEW_CHARS)
    return files.select(
        file_name(F.col("source_file")).alias("filename"), "source_file", "size_bytes",
        human_size(F.col("size_bytes")).alias("size_human"), "lines", "modified",
        F.when(F.length("_head") > PREVIEW_CHARS, F.concat(preview, F.lit("..."))).otherwise(preview).alias("preview"),
    )


# Fixed value: characters of a file shown in the catalog.
PREVIEW_CHARS = 200
