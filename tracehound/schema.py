"""Event schema, severity scale and the sort keys shared by all operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENT_SCHEMA = T.StructType(
    [
        T.StructField("event_seq", T.LongType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("source", T.StringType()),
        T.StructField("source_file", T.StringType()),
        T.StructField("ip", T.StringType()),
        T.StructField("method", T.StringType()),
        T.StructField("endpoint", T.StringType()),
        T.StructField("status_code", T.IntegerType()),
        T.StructField("log_level", T.StringType()),
        T.StructField("user_agent", T.StringType()),
        T.StructField("user", T.StringType()),
        T.StructField("raw_line", T.StringType()),
        T.StructField("line_number", T.LongType()),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    ]
)
EVENT_COLUMNS = EVENT_SCHEMA.fieldNames()

# The four columns that identify "the same event" when alerts are matched back.
# The key is not unique: repeated requests within one timestamp share it.
KEY_COLUMNS = ["ts", "ip", "endpoint", "source"]

# Severity scale, highest first, and the score of one alert.
SEVERITY_LEVELS = ["CRITICAL", "HIGH", "MEDIUM", "LOW"]
SEVERITY_WEIGHTS = {"CRITICAL": 25, "HIGH": 15, "MEDIUM": 8, "LOW": 3}
UNKNOWN_ALERT_WEIGHT = 3
UNKNOWN_PATTERN_WEIGHT = 5

UNKNOWN_GROUP = "unknown"


def group_of(col: Column) -> Column:
    """Grouping value of a field: empty and missing values fall into one group."""
    return F.coalesce(F.nullif(col.cast("string"), F.lit("")), F.lit(UNKNOWN_GROUP))


def with_ip_group(df: DataFrame) -> DataFrame:
    return df.withColumn("ip_group", group_of(F.col("ip")))


def severity_weight(severity: Column, unknown: int = UNKNOWN_ALERT_WEIGHT) -> Column:
    expr = F.lit(unknown)
    for level, weight in SEVERITY_WEIGHTS.items():
        expr = F.when(severity == level, F.lit(weight)).otherwise(expr)
    return expr


def severity_rank(severity: Column) -> Column:
    """4 for CRITICAL down to 1 for LOW; 0 for a severity outside the scale."""
    expr = F.lit(0)
    for i, level in enumerate(SEVERITY_LEVELS):
        expr = F.when(severity == level, F.lit(len(SEVERITY_LEVELS) - i)).otherwise(expr)
    return expr


def severity_of_rank(rank: Column) -> Column:
    """Inverse of ``max(severity_rank)``: no alert gives LOW, only unknown ones MEDIUM."""
    expr = F.when(rank.isNull(), F.lit("LOW")).otherwise(F.lit("MEDIUM"))
    for i, level in enumerate(SEVERITY_LEVELS):
        expr = F.when(rank == len(SEVERITY_LEVELS) - i, F.lit(level)).otherwise(expr)
    return expr


def max_severity(severity: Column) -> Column:
    """Aggregate: highest severity of a group."""
    return severity_of_rank(F.max(severity_rank(severity)))


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


_SEQ_SPACE = str(10**19)  # more than the largest sequence number


def first_event_order() -> Column:
    """Aggregate: earliest event by (time, input order) as one decimal.

    A minimum over a struct makes Spark sort all rows before it aggregates; over a
    decimal it stays a hash aggregate.
    """
    wide = micros(F.col("ts")).cast("decimal(38,0)") * F.lit(_SEQ_SPACE).cast("decimal(20,0)")
    return F.min(wide + F.col("event_seq"))


def first_event_seq(first_seen: Column, order: Column) -> Column:
    """Sequence number inside ``first_event_order``, given the time that belongs to it."""
    base = micros(first_seen).cast("decimal(38,0)") * F.lit(_SEQ_SPACE).cast("decimal(20,0)")
    return (order - base).cast("long")


def alert_order() -> Column:
    """Sortable identity of an alert.

    Regex alerts come first, by event and rule; threshold alerts follow, by rule
    and first event of the group. A struct instead of a running number: it needs
    no global sort and compares the same way in ``min_by`` and ``array_sort``.
    """
    return F.struct("phase", "ord_major", "ord_minor")
