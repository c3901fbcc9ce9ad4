"""Session settings, shared checkpoint folder, materialisation, row numbering."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Session settings the operators count on; all can be changed at runtime.
SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # the JVM never compiles a method above 8,000 bytes: longer ones run many times slower than
    # projections in parts, whose filters then keep to the order of their conditions
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.subexpressionElimination.skipForShortcutExpr": "true",
}

# Can only be given when the session is made: call-site capture on every column call
# makes building the larger plans twice as slow.
BUILDER_CONF = {"spark.python.sql.dataFrameDebugging.enabled": "false"}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in SESSION_CONF.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir`` of the session.

    Only a local-mode session without that setting gets a temporary folder.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured
    current = sc.getCheckpointDir()
    if current:
        return current
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="tracehound-")
    sc.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Compute once and cut the lineage with a reliable checkpoint."""
    spark = df.sparkSession
    folder = shared_dir(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Actions on tables made inside remove their shuffle files when they end.

    For jobs of many checkpoints, whose shuffles are never read again; otherwise the files
    stay until the driver happens to collect its garbage.
    """
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


_INDEX_BITS = 33  # monotonically_increasing_id keeps the row index in the low bits


def number_rows(df: DataFrame, *order: Column | str, name: str = "row_no") -> DataFrame:
    """Dense 1-based numbers in the given total order, without a one-task window.

    A range-partitioned sort balances the rows (ties are split by the unique last
    key), every partition numbers its own rows, and partition offsets come from a
    table with one row per partition. The sorted rows are checkpointed so that both
    readers see the same partitioning even when an executor is lost.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = materialize(ranged.withColumn("_pos", F.monotonically_increasing_id()))
    part = F.shiftright(F.col("_pos"), _INDEX_BITS)
    sizes = ranged.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    index = F.col("_pos").bitwiseAND(F.lit((1 << _INDEX_BITS) - 1))
    return (
        ranged.withColumn("_part", part)
        # one row per partition: bounded by the partition count, not by the data
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_off") + index + 1)
        .drop("_pos", "_part", "_off")
    )
