"""Incident tables: every result table, partitioned by incident and by the save that wrote it.

A save stages the rows of all tables under a name of its own, where no reader looks, and then
puts one small file per incident in place that names the save. That file is replaced in one
step, so a reader sees the incident before or after the save, never between; a save that
fails half-way changes nothing. The rows it replaced stay until the next save of the incident,
for readers that have begun; ``incident_vacuum`` removes what no file names.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracehound.schema import SEVERITY_LEVELS

DETAIL_TABLES = [
    "events", "alerts", "attackers", "attacker_endpoints", "attacker_user_agents", "chains",
    "pattern_hits", "graph_nodes", "graph_edges", "attack_types", "files",
]
INCIDENT_TABLE = "incidents"
_COMMITS = "commits"
_TYPES = "array<struct<type:string,count:bigint,severity:string>>"


def _path(root: str, table: str) -> str:
    return f"{root.rstrip('/')}/{table}"


# ---- files that name the current save ------------------------------------------------


def _fs(spark: SparkSession, path: str):
    """File system and path as the cluster knows them."""
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm_path


def _escaped(spark: SparkSession, incident_id: str) -> str:
    # the name Spark itself gives the partition folder, special characters escaped
    return spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(incident_id)


def _manifest(spark: SparkSession, root: str, incident_id: str) -> str:
    return f"{_path(root, _COMMITS)}/{_escaped(spark, incident_id)}.json"


def _put_in_place(spark: SparkSession, root: str, incident_id: str, commit: str) -> None:
    """Write beside the old file, then rename over it: one step for every reader."""
    jvm = spark.sparkContext._jvm
    target = _manifest(spark, root, incident_id)
    staged = f"{_path(root, _COMMITS)}/.{uuid.uuid4().hex}"
    fs, path = _fs(spark, staged)
    out = fs.create(path, True)
    out.write(json.dumps({"incident_id": incident_id, "commit": commit}).encode())
    out.close()
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(path).toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(fs.makeQualified(path), fs.makeQualified(_fs(spark, target)[1]), how)


def incident_commits(spark: SparkSession, root: str) -> DataFrame:
    """``incident_id, commit``: the save that each incident shows."""
    schema = "incident_id string, commit string"
    fs, path = _fs(spark, _path(root, _COMMITS))
    if not fs.exists(path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(_path(root, _COMMITS))


def _commit_of(spark: SparkSession, root: str, incident_id: str) -> str | None:
    target = _manifest(spark, root, incident_id)
    fs, path = _fs(spark, target)
    if not fs.exists(path):
        return None
    row = spark.read.schema("incident_id string, commit string").json(target).first()
    return row["commit"]


# ---- saving --------------------------------------------------------------------------


def incident_row(
    tables: dict[str, DataFrame], incident_id: str, created_at: Column | None = None, status: str = "analyzed"
) -> DataFrame:
    """Summary row of one incident, with its categories in order of appearance."""
    types = tables["attack_types"].agg(
        # one entry per category
        F.transform(
            F.array_sort(F.collect_list(F.struct("first", "category", "count", "severity"))),
            lambda t: F.struct(t["category"].alias("type"), t["count"].alias("count"), t["severity"].alias("severity")),
        ).alias("attack_types")
    )
    # two one-row tables side by side
    return tables["summary"].join(F.broadcast(types)).select(
        F.lit(incident_id).alias("incident_id"),
        (F.current_timestamp() if created_at is None else created_at).alias("created_at"),
        F.lit(status).alias("status"), "*",
    )


def save_incidents(tables: dict[str, DataFrame], root: str) -> None:
    """Persist rows of one or many incidents; ``incident_id`` is a column of every table.

    The incidents saved are those of the table ``incidents``; saving one again replaces it.
    """
    spark = tables[INCIDENT_TABLE].sparkSession
    commit = uuid.uuid4().hex
    for name, df in tables.items():
        df.withColumn("commit", F.lit(commit)).write.mode("append").partitionBy("incident_id", "commit").parquet(_path(root, name))
    # one row per incident saved
    saved = _stored(spark, root, INCIDENT_TABLE).where(F.col("commit") == commit).select("incident_id").distinct().collect()
    for row in saved:
        before = _commit_of(spark, root, row["incident_id"])
        _put_in_place(spark, root, row["incident_id"], commit)
        _remove_commits(spark, root, row["incident_id"], {commit, before})


def save_incident(
    tables: dict[str, DataFrame], root: str, incident_id: str, created_at: Column | None = None
) -> None:
    """Persist all result tables under one id; saving an id again replaces it."""
    found = {name: tables[name].withColumn("incident_id", F.lit(incident_id)) for name in DETAIL_TABLES if name in tables}
    save_incidents({**found, INCIDENT_TABLE: incident_row(tables, incident_id, created_at)}, root)


# ---- reading -------------------------------------------------------------------------


def _stored(spark: SparkSession, root: str, table: str) -> DataFrame:
    """Rows of all saves. Ids stay text even when they look like numbers."""
    found = spark.read.parquet(_path(root, table)).schema
    fields = [T.StructField(f.name, T.StringType()) if f.name in ("incident_id", "commit") else f for f in found]
    return spark.read.schema(T.StructType(fields)).parquet(_path(root, table))


def read_table(spark: SparkSession, root: str, table: str = INCIDENT_TABLE) -> DataFrame:
    """All incidents of one table, each as its current save has it."""
    return _stored(spark, root, table).join(incident_commits(spark, root), ["incident_id", "commit"], "left_semi").drop("commit")


def incident_get(spark: SparkSession, root: str, incident_id: str, table: str = INCIDENT_TABLE) -> DataFrame:
    """Rows of one incident; id and save select a folder, nothing else is read."""
    current = F.col("commit") == F.lit(_commit_of(spark, root, incident_id))
    return _stored(spark, root, table).where((F.col("incident_id") == incident_id) & current).drop("commit")


def incident_list(incidents: DataFrame) -> DataFrame:
    """Summary rows, newest first; missing metrics become zero or empty."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    has = lambda c: c in incidents.columns
    by_severity = F.col("alerts_by_severity") if has("alerts_by_severity") else F.lit(None)
    counts = [F.coalesce(by_severity[s] if has("alerts_by_severity") else by_severity, F.lit(0)).cast("long").alias(s) for s in SEVERITY_LEVELS]
    types = F.col("attack_types") if has("attack_types") else F.lit(None).cast(_TYPES)
    return incidents.select(
        "incident_id", "created_at", F.coalesce("status", F.lit("unknown")).alias("status"),
        zero("total_events"), zero("total_alerts"), zero("threat_score"), "top_attacker_ip",
        F.struct(*counts).alias("alerts_by_severity"),
        F.coalesce(types, F.array().cast(_TYPES)).alias("attack_types"),
    ).orderBy(F.desc("created_at"), "incident_id")


def incident_count(incidents: DataFrame) -> DataFrame:
    return incidents.agg(F.count_distinct("incident_id").alias("incident_count"))


# ---- removing ------------------------------------------------------------------------


def _tables(spark: SparkSession, root: str) -> list[str]:
    fs, path = _fs(spark, root)
    found = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
    return [name for name in found if name != _COMMITS]


def _remove_commits(spark: SparkSession, root: str, incident_id: str, keep: set[str | None]) -> bool:
    removed = False
    for table in _tables(spark, root):
        fs, folder = _fs(spark, f"{_path(root, table)}/incident_id={_escaped(spark, incident_id)}")
        if not fs.exists(folder):
            continue
        for status in fs.listStatus(folder):
            if status.getPath().getName().removeprefix("commit=") not in keep:
                removed = fs.delete(status.getPath(), True) or removed
    return removed


def incident_delete(spark: SparkSession, root: str, incident_id: str) -> bool:
    """Remove one incident; tells whether it existed. It is gone for readers in one step."""
    fs, path = _fs(spark, _manifest(spark, root, incident_id))
    existed = fs.exists(path) and fs.delete(path, False)
    _remove_commits(spark, root, incident_id, set())
    return existed


def incident_vacuum(spark: SparkSession, root: str) -> None:
    """Remove rows of failed and replaced saves. No save may be running."""
    current = {r["incident_id"]: r["commit"] for r in incident_commits(spark, root).collect()}  # one row per incident
    unescape = spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
    for table in _tables(spark, root):
        fs, path = _fs(spark, _path(root, table))
        for status in fs.listStatus(path):
            name = status.getPath().getName()
            if name.startswith("incident_id="):
                incident_id = unescape(name.removeprefix("incident_id="))
                _remove_commits(spark, root, incident_id, {current.get(incident_id)})
