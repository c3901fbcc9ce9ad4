"""Live feeds: new log files in a folder become event, alert and stats tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from tracehound.operators.detect import detect_all
from tracehound.operators.formats import FORMATS, LogFormat, parse_auto, split_rejects
from tracehound.operators.rules import RULES, Rule
from tracehound.sources.json_layouts import EXTRA_BASE
from tracehound.sources.lines import line_blocks, number_lines, raw_text
from tracehound.sources.tail import stream_tail

def stream_source(spark: SparkSession, folder: str, max_files: int | None = None) -> DataFrame:
    """Lines of files that appear in a folder; hidden files are skipped.

    The file source reads each file once: logs come as rotated chunks. ``stream_tail`` reads
    files that grow. Start with an empty folder and a fresh checkpoint to ignore older files.
    """
    reader = spark.readStream.option("latestFirst", "false")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return raw_text(reader, folder)


def _append(df: DataFrame, path: str, epoch: int) -> None:
    # a batch that runs again after a failure replaces its own partition
    (
        df.withColumn("epoch", F.lit(epoch))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("epoch")
        .parquet(path)
    )


_TOTALS = "lines long, extras long, events long, alerts long"
_COUNTERS = [f.split()[0] for f in _TOTALS.split(", ")]


def _totals_before(spark: SparkSession, out_dir: str, epoch: int) -> dict[str, int]:
    """What all earlier batches numbered and found; each batch stores its running totals."""
    batches = read_feed(spark, out_dir, "batches")
    none = dict.fromkeys(_COUNTERS, 0)
    if batches is None:
        return none
    # batches are numbered without gaps; one that has none before it starts anew
    row = batches.where(F.col("epoch") == epoch - 1).select(*[f"{c}_total" for c in _COUNTERS]).first()
    return dict(zip(_COUNTERS, row)) if row else none


def _store_totals(spark: SparkSession, out_dir: str, epoch: int, before: dict[str, int], now: dict[str, int]) -> None:
    row = [now[c] for c in _COUNTERS] + [before[c] + now[c] for c in _COUNTERS]
    schema = f"{_TOTALS}, {', '.join(f'{c}_total long' for c in _COUNTERS)}"
    _append(spark.createDataFrame([row], schema), f"{out_dir}/batches", epoch)


def process_chunk(
    text: DataFrame, epoch: int, out_dir: str, rules: Sequence[Rule] = RULES,
    formats: dict[str, LogFormat] = FORMATS, options: dict[str, dict] | None = None,
) -> None:
    """Parse and detect one batch of new lines; files of unknown format are skipped.

    Threshold rules see each file of a batch on its own, without state from earlier ones.
    Numbers go on where the batch before ended, so an event keeps a number of its own among
    all batches. What was counted on the way is stored per batch and per file: the running
    totals need no second look at the events.
    """
    # read several times: for its blocks, to find formats, to parse
    text = text.persist()
    try:
        _process(text, epoch, out_dir, rules, formats, options)
    finally:
        text.unpersist()


def _process(
    text: DataFrame, epoch: int, out_dir: str, rules: Sequence[Rule], formats: dict[str, LogFormat], options: dict[str, dict] | None
) -> None:
    spark = text.sparkSession
    before = _totals_before(spark, out_dir, epoch)
    now = dict.fromkeys(_COUNTERS, 0)
    blocks = line_blocks(text)
    now["lines"] = blocks.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    if now["lines"]:
        files = read_feed(spark, out_dir, "files")
        known = None
        if files is not None:
            known = files.where(F.col("epoch") < epoch).groupBy("source_file").agg(F.sum("lines").alias("lines"))
        lines = number_lines(text, before["lines"], blocks=blocks, before=known)
        extra_base = EXTRA_BASE + before["extras"]
        options = {**(options or {}), "json": {**(options or {}).get("json", {}), "extra_base": extra_base}}
        events, _ = split_rejects(parse_auto(lines, None, formats, options))
        seen = Observation()
        _append(events.observe(seen, F.count(F.lit(1)).alias("n"), F.max("event_seq").alias("last")), f"{out_dir}/events", epoch)
        now["events"] = seen.get["n"]
        now["extras"] = max(0, (seen.get["last"] or 0) + 1 - extra_base)
    if now["events"]:
        stored = read_feed(spark, out_dir, "events").where(F.col("epoch") == epoch)
        fired = Observation()
        alerts = detect_all(stored, rules, scope=("source_file",)).observe(fired, F.count(F.lit(1)).alias("n"))
        _append(alerts, f"{out_dir}/alerts", epoch)
        now["alerts"] = fired.get["n"]
        # a narrow count; one row per file
        parsed = stored.groupBy("source_file").agg(F.count(F.lit(1)).alias("events"))
        per_file = blocks.groupBy("source_file").agg(F.sum("_n").alias("lines")).join(parsed, "source_file", "left")
        _append(per_file.withColumn("events", F.coalesce("events", F.lit(0))), f"{out_dir}/files", epoch)
    elif now["lines"]:
        per_file = blocks.groupBy("source_file").agg(F.sum("_n").alias("lines"))
        _append(per_file.withColumn("events", F.lit(0).cast("long")), f"{out_dir}/files", epoch)
    _store_totals(spark, out_dir, epoch, before, now)


def start_stream(
    spark: SparkSession, folder: str, out_dir: str, checkpoint: str, rules: Sequence[Rule] = RULES,
    formats: dict[str, LogFormat] = FORMATS, options: dict[str, dict] | None = None,
    max_files: int | None = None, available_now: bool = False, interval: str = "1 second",
    tail: bool = False, existing: str = "skip",
) -> StreamingQuery:
    """Run the batch parsers and rules on new lines; feeds are Parquet tables.

    Each new file is one chunk, read once; with ``tail`` the files of the folder may grow,
    and what was appended since the last batch is read.
    """
    text = stream_tail(spark, folder, existing) if tail else stream_source(spark, folder, max_files)
    writer = text.writeStream.option("checkpointLocation", checkpoint).foreachBatch(
        lambda df, epoch: process_chunk(df, epoch, out_dir, rules, formats, options)
    )
    trigger = {"availableNow": True} if available_now else {"processingTime": interval}
    return writer.trigger(**trigger).start()


def read_feed(spark: SparkSession, out_dir: str, feed: str) -> DataFrame | None:
    """The ``events`` or ``alerts`` table, None before the first row arrived."""
    path = f"{out_dir}/{feed}"
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(jvm_path) or len(fs.listStatus(jvm_path)) == 0:
        return None
    folders = [s.getPath().getName() for s in fs.listStatus(jvm_path)]
    if not any(name.startswith("epoch=") for name in folders):
        return None
    return spark.read.parquet(path)


def stream_stats(batches: DataFrame, files: DataFrame, progress: DataFrame | None = None) -> DataFrame:
    """Running totals after each batch, from the feeds ``batches`` and ``files`` alone.

    A file counts from the first batch in which it gave events. ``progress`` adds the rows
    that came too late for the stateful rules, see ``ProgressLog``.
    """
    first = files.where("events > 0").groupBy("source_file").agg(F.min("epoch").alias("epoch"))
    # one row per batch
    upto = Window.orderBy("epoch").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = batches.join(first.groupBy("epoch").agg(F.count(F.lit(1)).alias("files")), "epoch", "left")
    dropped = F.lit(0).cast("long")
    if progress is not None:
        rows = rows.join(progress.groupBy("epoch").agg(F.sum("dropped_rows").alias("dropped_rows")), "epoch", "full")
        dropped = F.sum(F.coalesce("dropped_rows", F.lit(0))).over(upto)
    return rows.select(
        "epoch", F.sum(F.coalesce("files", F.lit(0))).over(upto).alias("files_watched"),
        F.sum(F.coalesce("events", F.lit(0))).over(upto).alias("events_processed"),
        F.sum(F.coalesce("alerts", F.lit(0))).over(upto).alias("alerts_generated"),
        dropped.alias("rows_dropped"),
    )


class ProgressLog(StreamingQueryListener):
    """Stores what each batch of a session's streams took in and dropped as too late.

    Add it with ``spark.streams.addListener``; the table has ``query, epoch, input_rows,
    dropped_rows``, one row per batch.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        dropped = sum(o.numRowsDroppedByWatermark for o in p.stateOperators)
        row = (p.name or str(p.id), p.batchId, p.numInputRows, dropped)
        rows = self.spark.createDataFrame([row], "query string, epoch long, input_rows long, dropped_rows long")
        rows.coalesce(1).write.mode("append").parquet(self.path)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def stream_latest(feed: DataFrame, n: int = 100) -> DataFrame:
    """Newest rows of a feed: a top-k."""
    return feed.orderBy(F.desc("ts"), F.desc("event_seq")).limit(n)
