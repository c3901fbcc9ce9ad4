"""Registration of queries with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from querybook.inputs import Inputs, present

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``f(inputs) -> DataFrame`` under a name."""

    def add(f: Callable[[Inputs], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: present(f(Inputs(spark, sf_dir)))
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add
