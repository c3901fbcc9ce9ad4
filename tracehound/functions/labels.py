"""Presentation columns: report time, score band, status class, human sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def report_time(ts: Column) -> Column:
    text = F.date_format(ts, "yyyy-MM-dd HH:mm:ss")
    return F.coalesce(F.concat(text, F.lit(" UTC")), F.lit("N/A"))


def iso_time(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


# Field names of an event as JSON, in order, with the columns they come from.
EVENT_JSON_FIELDS = [
    ("timestamp", "ts"), ("source", "source"), ("sourceFile", "source_file"), ("ip", "ip"), ("method", "method"),
    ("endpoint", "endpoint"), ("statusCode", "status_code"), ("logLevel", "log_level"), ("userAgent", "user_agent"),
    ("user", "user"), ("rawLine", "raw_line"), ("lineNumber", "line_number"), ("metadata", "metadata"),
]


def event_json(fields: list[tuple[str, str]] = EVENT_JSON_FIELDS) -> Column:
    """An event as JSON text, with all its fields or some; a missing value stays as null."""
    values = [(iso_time(F.col(c)) if c == "ts" else F.col(c)).alias(name) for name, c in fields]
    return F.to_json(F.struct(*values), {"ignoreNullFields": "false"})


def score_band(score: Column) -> Column:
    return F.when(score >= 70, "red").when(score >= 40, "orange").otherwise("green")


def status_class(status: Column) -> Column:
    return (
        F.when(status >= 500, "server_error")
        .when(status >= 400, "client_error")
        .when(status >= 300, "redirect")
        .otherwise("ok")
    )


def human_size(size: Column) -> Column:
    """Bytes as B, KB or MB with one decimal."""
    def show(divisor: int, unit: str) -> Column:
        return F.concat(F.format_string("%.1f", size / F.lit(float(divisor))), F.lit(f" {unit}"))

    return (
        F.when(size == 0, F.lit("0 B"))
        .when(size < 1024, show(1, "B"))
        .when(size < 1024**2, show(1024, "KB"))
        .otherwise(show(1024**2, "MB"))
    )
