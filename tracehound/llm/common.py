"""Columns and helpers that several training-data operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

# Words of the contracts: runs without ASCII white space; and, after A-Z is lower-cased,
# runs of ASCII digits and letters and of anything outside ASCII.
SPACED_WORD = r"[^\x20\x09-\x0D]+"
PLAIN_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def query(name: str, sql: str | None = None):
    """Register ``f(spark, sf_dir) -> DataFrame`` and its SQL twin under a name."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str | Column) -> Column:
    """A text column in which null is the empty text."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, _UPPER, _UPPER.lower())


def plain_words(text: Column) -> Column:
    """Array of lower-cased words of a text."""
    return F.regexp_extract_all(ascii_lower(text), F.lit(PLAIN_WORD), F.lit(0))


def unused(df: DataFrame, *names: str) -> list[str]:
    """Column names that the table does not have yet, made from these."""
    out = []
    for name in names:
        while name in df.columns:
            name += "_"
        out.append(name)
    return out


def text_key(text: Column) -> Column:
    """64-bit key of a text, to tell rows of one id apart."""
    return F.xxhash64(text)
