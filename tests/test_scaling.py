"""Work is dealt to all tasks, long plans stay compiled, and read shuffles leave the disk."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from querybook.inputs import LINES_SQL, Inputs
from tracehound.operators.parse_web import parse_web_access
from tracehound.runtime import configure, materialize, shuffles_removed


def test_log_is_derived_by_all_tasks(spark, tmp_path):
    ts = dt.datetime(2024, 1, 2, 3, 4, 5)
    rows = [(i, ts, i % 7, "click", 1.0, f'{{"k": {i % 60}}}') for i in range(400)] + [(3, ts, 3, "view", 1.0, '{"k": 1}')] * 2
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    lines = Inputs(spark, str(tmp_path)).sql(LINES_SQL)
    assert lines.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert lines.count() == len(rows)


def test_web_lines_without_generated_stages(spark):
    """Other lines are dropped before their fields are looked at, whichever way conditions are evaluated."""
    configure(spark)
    good = '1.2.3.4 - u [02/Jan/2024:03:04:05 +0000] "GET /a HTTP/1.1" 200 12 "-" "agent"'
    lines = spark.createDataFrame([(1, "f", 1, good), (2, "f", 2, "free text")], "event_seq long, source_file string, line_number long, line string")
    limits = {"spark.sql.codegen.hugeMethodLimit": "1", "spark.sql.subexpressionElimination.skipForShortcutExpr": "false"}
    before = {k: spark.conf.get(k) for k in limits}
    try:
        for k, v in limits.items():
            spark.conf.set(k, v)
        found = parse_web_access(materialize(lines)).where(F.col("ts").isNotNull()).select("event_seq", "status_code").collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert [tuple(r) for r in found] == [(1, 200)]


def test_shuffles_of_stored_tables_are_removed(spark):
    def files() -> int:
        return sum(f.getName().startswith("shuffle_") for f in _all(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()))

    def _all(seq):
        return [seq.apply(i) for i in range(seq.size())]

    def counted():
        return spark.range(1000).repartition(4, "id").groupBy((F.col("id") % 7).alias("k")).count()

    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    setting, before = spark.conf.get(key, "false"), files()
    with shuffles_removed(spark):
        stored = materialize(counted())
    assert files() <= before
    assert spark.conf.get(key, "false") == setting
    assert sorted(r["count"] for r in stored.collect()) == sorted(r["count"] for r in counted().collect())
