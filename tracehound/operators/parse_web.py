"""Web access log lines to events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracehound.functions.decode import DEFAULT_STEPS, Decoder, deobfuscate
from tracehound.functions.text import capture, captured, trim_blank
from tracehound.schema import EVENT_COLUMNS

# Fixed value: the combined access log format.
WEB_PATTERN = (
    r'^(\S+)\s+\S+\s+(\S+)\s+\[([^\]]+)\]\s+"(\S+)\s+(\S+)\s+\S+"\s+(\d{3})\s+(\d+)\s+"([^"]*)"\s+"([^"]*)"'
)
WEB_SOURCE = "nginx"


def parse_ts_web(text: Column) -> Column:
    """``dd/Mon/yyyy:HH:mm:ss ±hhmm``, else an ISO time, else NULL."""
    return F.coalesce(
        F.try_to_timestamp(text, F.lit("d/MMM/yyyy:HH:mm:ss Z")), F.try_to_timestamp(text)
    )


def web_fields(lines: DataFrame) -> DataFrame:
    """The nine captured fields of every matching line; other lines are dropped."""
    names = ["ip", "remote_user", "time_text", "method", "raw_endpoint", "status_text",
             "bytes_text", "referer", "user_agent"]
    found = lines.withColumn("line", trim_blank(F.col("line"))).withColumn(
        "_m", capture(F.col("line"), WEB_PATTERN, len(names))
    ).where(captured(F.col("_m"), len(names)))
    return found.select(
        *[c for c in found.columns if c != "_m"], *[F.get("_m", F.lit(i)).alias(n) for i, n in enumerate(names, 1)]
    )


def web_derived(fields: DataFrame, steps: Sequence[Decoder] = DEFAULT_STEPS) -> DataFrame:
    """Event columns that follow from the captured fields."""
    dash = lambda c: F.when(F.col(c) == "-", F.lit("")).otherwise(F.col(c))
    status = F.col("status_text").cast("int")
    return fields.select(
        "event_seq", parse_ts_web(F.col("time_text")).alias("ts"), F.lit(WEB_SOURCE).alias("source"),
        "source_file", "ip", "method",
        deobfuscate(F.col("raw_endpoint"), steps).alias("endpoint"),
        status.alias("status_code"),
        F.when(status >= 400, "warn").otherwise("info").alias("log_level"),
        "user_agent", dash("remote_user").alias("user"), F.col("line").alias("raw_line"),
        F.col("line_number").cast("long").alias("line_number"),
        F.create_map(
            F.lit("bodyBytes"), F.col("bytes_text").try_cast("long").cast("string"),
            F.lit("referer"), dash("referer"),
            F.lit("rawEndpoint"), F.col("raw_endpoint"),
        ).alias("metadata"),
    )


def parse_web_access(lines: DataFrame, steps: Sequence[Decoder] = DEFAULT_STEPS) -> DataFrame:
    """``event_seq, source_file, line_number, line`` to events."""
    return web_derived(web_fields(lines), steps).select(*EVENT_COLUMNS)


def is_web_line(line: Column) -> Column:
    return F.regexp_like(line, F.lit(WEB_PATTERN))
