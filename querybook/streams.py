"""Streaming queries: each runs its stream over all given data, then reads the feed."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querybook.book import query
from querybook.inputs import CHAIN_WINDOW, Inputs, log_rules
from querybook.oracle import PREDICATES, threshold_alerts, with_ctes
from querybook.parsing import _WEB_ENDPOINT, _WEB_IP, _WEB_OK, _URL, sql_base64, sql_html
from tracehound.operators.rules import ThresholdRule
from tracehound.runtime import scratch_path
from tracehound.streaming import live, stateful

_RULES = log_rules()
_LOGIN_NO, _LOGIN = next((i, r) for i, r in enumerate(_RULES, 1) if isinstance(r, ThresholdRule))


def landed(x: Inputs) -> str:
    """Web access lines of the log as chunk files, one per day."""
    path = scratch_path(x.spark, "landing")
    lines = x.lines_wide.select(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_seq", F.col("web_line").alias("value"))
    (
        lines.repartition("day").sortWithinPartitions("day", "event_seq").select("day", "value")
        .write.partitionBy("day").text(path)
    )
    return path


def run_live(x: Inputs, **options) -> tuple[DataFrame, DataFrame]:
    out = scratch_path(x.spark, "feeds")
    q = live.start_stream(
        x.spark, landed(x), out, scratch_path(x.spark, "offsets"), _RULES, available_now=True, **options
    )
    q.awaitTermination()
    return live.read_feed(x.spark, out, "events"), live.read_feed(x.spark, out, "alerts")


_WEB_EVENTS = f"""SELECT event_seq, ts, strftime(ts, '%Y-%m-%d') AS day, {_WEB_IP} AS ip, {_WEB_IP} AS ip_group, {sql_html(sql_base64(_URL.format(_WEB_ENDPOINT)))} AS endpoint,
 status_code, web_line AS raw_line, 'nginx' AS source, '' AS auth_result FROM lines WHERE {_WEB_OK}"""


@query("stream_source", with_ctes("SELECT web_line AS text, count(*) AS n FROM lines GROUP BY 1", "lines"))
def _(x):
    out = scratch_path(x.spark, "stream-lines")
    q = (
        live.stream_source(x.spark, landed(x)).select("text").writeStream.format("parquet")
        .option("path", out).option("checkpointLocation", scratch_path(x.spark, "offsets"))
        .trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return x.spark.read.parquet(out).groupBy("text").agg(F.count(F.lit(1)).alias("n"))


_TAILED = f"""SELECT event_seq, ts, {_WEB_IP} AS ip, {sql_html(sql_base64(_URL.format(_WEB_ENDPOINT)))} AS endpoint, line_no
 FROM (SELECT *, row_number() OVER (PARTITION BY source_file ORDER BY event_seq) AS line_no FROM lines) l WHERE {_WEB_OK}"""


def _grow(x: Inputs, folder: str, share: float) -> None:
    """Write the log files up to a share of their bytes, most likely into the middle of a line."""

    def write(rows: pd.DataFrame) -> pd.DataFrame:
        lines = rows.sort_values("event_seq")["web_line"]
        data = "".join(f"{line}\n" for line in lines).encode()
        store, root = pafs.FileSystem.from_uri(folder)
        with store.open_output_stream(f"{root}/{rows['source_file'].iloc[0]}") as f:
            f.write(data[: int(len(data) * share)])
        return pd.DataFrame({"n": [len(lines)]})

    pafs.FileSystem.from_uri(folder)[0].create_dir(pafs.FileSystem.from_uri(folder)[1])
    # a file has 500 lines
    x.lines_wide.select("source_file", "event_seq", "web_line").groupBy("source_file").applyInPandas(write, "n long").count()


@query("stream_tail", with_ctes("SELECT ts, ip, endpoint, line_no AS line_number, count(*) AS n FROM tailed GROUP BY ALL", "lines", extra={"tailed": _TAILED}))
def _(x):
    folder, out, offsets = (scratch_path(x.spark, name) for name in ("tail", "feeds", "offsets"))
    for share in (0, 0.3, 0.65, 1):
        _grow(x, folder, share)
        live.start_stream(x.spark, folder, out, offsets, _RULES, available_now=True, tail=True).awaitTermination()
    return live.read_feed(x.spark, out, "events").groupBy("ts", "ip", "endpoint", "line_number").agg(F.count(F.lit(1)).alias("n"))


def _alerts_sql() -> str:
    from querybook.oracle import _regex_alerts

    regex = _regex_alerts(_RULES).replace("FROM ev", "FROM wev")
    parts = [f"SELECT rule_id, ip, matched_pattern, ts FROM ({regex}) r"]
    for i, r in enumerate(_RULES, 1):
        if isinstance(r, ThresholdRule):
            # a file holds one day: the rule sees days on their own
            sql = threshold_alerts(r, i).replace("FROM ev", "FROM wev")
            sql = sql.replace("PARTITION BY grp", "PARTITION BY day, grp")
            parts.append(f"SELECT rule_id, ip, matched_pattern, ts FROM ({sql}) t")
    return " UNION ALL ".join(parts)


@query("stream_parse_detect", with_ctes(
    f"SELECT rule_id, ip, matched_pattern, count(*) AS n FROM ({_alerts_sql()}) a GROUP BY ALL", "lines", extra={"wev": _WEB_EVENTS}))
def _(x):
    return run_live(x)[1].groupBy("rule_id", "ip", "matched_pattern").agg(F.count(F.lit(1)).alias("n"))


@query("stream_threshold_batch", with_ctes(
    f"SELECT rule_id, ip, ts, matched_pattern FROM ({_alerts_sql()}) a WHERE rule_id IN ('BRUTE_FORCE_LOGIN', 'BRUTE_FORCE_RAPID_REQUESTS')", "lines", extra={"wev": _WEB_EVENTS}))
def _(x):
    return run_live(x)[1].where("phase = 1").select("rule_id", "ip", "ts", "matched_pattern")


@query("stream_sinks", with_ctes(
    f"SELECT 'event' AS feed, count(*) AS n FROM wev UNION ALL SELECT 'alert', count(*) FROM ({_alerts_sql()}) a", "lines", extra={"wev": _WEB_EVENTS}))
def _(x):
    ev, al = run_live(x)
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("feed"), "n")
    return one(ev, "event").unionByName(one(al, "alert"))


@query("stream_latest", with_ctes("SELECT ts, ip, endpoint FROM wev ORDER BY ts DESC, event_seq DESC LIMIT 100", "lines", extra={"wev": _WEB_EVENTS}))
def _(x):
    return live.stream_latest(run_live(x)[0], 100).select("ts", "ip", "endpoint")


# Days of the month that arrive together; each part is one batch.
_PARTS = [(1, 8), (9, 16), (17, 24), (25, 31)]
_DELAY = 3000  # seconds an event is late at most; less than the watermark of an hour
_END = "2100-01-01 00:00:00"


def _arrives(delay: int) -> Column:
    """Day of the month on which an event arrives, up to ``delay`` seconds late, in its month."""
    late = F.timestamp_seconds(F.unix_seconds("ts") + F.col("event_seq") * 7919 % delay)
    return F.when(F.month(late) != F.month("ts"), F.lit(31)).otherwise(F.dayofmonth(late))


def _run_in_parts(
    x: Inputs, tables: list[DataFrame], make: Callable[..., DataFrame], name: str, delay: int = _DELAY
) -> DataFrame:
    """Land the rows of all tables part by part, late and shuffled, and run the same stream after each.

    Offsets and state live in one checkpoint, so later parts meet the state of the earlier
    ones, and the order does not hang on file times. The last part is the end of the input.
    """
    sources = [scratch_path(x.spark, f"{name}-in{i}") for i in range(len(tables))]
    out, offsets = scratch_path(x.spark, name), scratch_path(x.spark, "offsets")
    result = None
    for part in [*_PARTS, None]:
        for df, source in zip(tables, sources):
            rows = stateful.end_of_input(x.spark, df.schema, _END) if part is None else df.where(_arrives(delay).between(*part))
            rows.write.mode("append").parquet(source)
        result = make(*[x.spark.readStream.schema(df.schema).parquet(s) for df, s in zip(tables, sources)])
        q = (
            result.writeStream.format("parquet").option("path", out)
            .option("checkpointLocation", offsets).outputMode("append")
            .trigger(availableNow=True).start()
        )
        q.awaitTermination()
    return x.spark.read.schema(result.schema).parquet(out)


@query("stream_threshold_stateful", with_ctes(
    f"SELECT ip_group AS grp, event_seq, ts FROM ({threshold_alerts(_LOGIN, _LOGIN_NO)}) t", "ev"))
def _(x):
    return _run_in_parts(x, [x.ev], lambda ev: stateful.stream_threshold(ev, _LOGIN, "1 hour"), "stateful")


@query("stream_chains", with_ctes("SELECT ip, start_time, end_time, event_count FROM chains", "chains"))
def _(x):
    # the batch chains know all alerts of an address, however far away
    chains = lambda ev, al: stateful.stream_chains(ev, al, CHAIN_WINDOW, watermark="1 hour", horizon="40 days")
    return _run_in_parts(x, [x.ev, x.al], chains, "chains")


_TOO_LATE = 3 * 3600  # seconds an event is late at most, with a watermark of an hour
_PART_SQL = " ".join(f"WHEN d <= {last} THEN {i}" for i, (_, last) in enumerate(_PARTS))
_ARRIVED = f"""SELECT *, CASE {_PART_SQL} END AS part FROM (
  SELECT *, CASE WHEN month(late) <> month(ts) THEN 31 ELSE dayofmonth(late) END AS d FROM (
  SELECT *, ts + to_seconds(CAST(event_seq * 7919 % {_TOO_LATE} AS INT)) AS late FROM ev) l) m"""
# what has come before a part moves the watermark it meets
_DROPPED = f"""SELECT count(*) AS n FROM arrived a JOIN (
  SELECT part, max(max(ts)) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM arrived GROUP BY part) w USING (part)
  WHERE {PREDICATES[_LOGIN.rule_id]} AND a.ts <= w.seen - INTERVAL 1 HOUR"""


@query("stream_stats", with_ctes(
    f"""SELECT count(DISTINCT day) AS files_watched, count(*) AS events_processed, (SELECT count(*) FROM ({_alerts_sql()}) a) AS alerts_generated,
    (SELECT n FROM dropped) AS rows_dropped FROM wev""", "lines", "ev", extra={"wev": _WEB_EVENTS, "arrived": _ARRIVED, "dropped": _DROPPED}))
def _(x):
    out, log = scratch_path(x.spark, "feeds"), scratch_path(x.spark, "progress")
    live.start_stream(x.spark, landed(x), out, scratch_path(x.spark, "offsets"), _RULES, available_now=True, max_files=10).awaitTermination()
    listener = live.ProgressLog(x.spark, log)
    x.spark.streams.addListener(listener)
    try:
        late = lambda ev: stateful.stream_threshold(ev, _LOGIN, "1 hour")
        _run_in_parts(x, [x.ev], late, "late", _TOO_LATE)
        # reports come from a thread of their own
        x.spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    finally:
        x.spark.streams.removeListener(listener)
    read = lambda feed: live.read_feed(x.spark, out, feed)
    totals = live.stream_stats(read("batches"), read("files"), x.spark.read.parquet(log))
    return totals.orderBy(F.desc("epoch")).limit(1).drop("epoch")
