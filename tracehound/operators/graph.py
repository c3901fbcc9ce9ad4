"""Attacker -> endpoint -> resource graph as two tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracehound.operators.correlate import attacker_order
from tracehound.operators.scoring import answered_ok
from tracehound.schema import max_severity

# Fixed value: a reached resource is always of this severity.
RESOURCE_SEVERITY = "CRITICAL"


def contacts(attackers: DataFrame, ev: DataFrame, al: DataFrame) -> DataFrame:
    """(attacker, endpoint) pairs with request counts, severity and attacker rank.

    Matches the raw address: events without one belong to no attacker here, although
    they form the "unknown" group elsewhere.
    """
    ranked = attackers.select("ip", attacker_order().alias("rank"))
    seen = (
        ev.where("endpoint <> '' and ip <> ''")
        .groupBy("ip", "endpoint")
        .agg(F.count(F.lit(1)).alias("request_count"), F.count_if(answered_ok()).alias("ok_count"))
    )
    alerts = al.where("endpoint <> ''").groupBy("ip", "endpoint").agg(
        F.count(F.lit(1)).alias("alert_count"), max_severity(F.col("severity")).alias("severity")
    )
    return (
        seen.join(ranked, "ip")
        .join(alerts, ["ip", "endpoint"], "left")
        .withColumn("severity", F.coalesce("severity", F.lit("LOW")))
        .withColumn("alert_count", F.coalesce("alert_count", F.lit(0)))
    )


def attacker_nodes(attackers: DataFrame) -> DataFrame:
    geo = "geo" if "geo" in attackers.columns else F.lit(None).cast("string").alias("geo")
    return attackers.select(
        F.concat(F.lit("ip_"), "ip").alias("id"), F.lit("attacker").alias("type"),
        F.col("ip").alias("label"), "threat_score", geo,
    )


def endpoint_nodes(pairs: DataFrame) -> DataFrame:
    """One node per endpoint, described by the highest-ranked attacker that used it."""
    first = pairs.groupBy("endpoint").agg(
        F.min_by(F.struct("request_count", "severity"), "rank").alias("top")
    )
    return first.select(
        F.concat(F.lit("ep_"), "endpoint").alias("id"), F.lit("endpoint").alias("type"),
        F.col("endpoint").alias("label"), "top.request_count", "top.severity",
    )


def attacker_edges(pairs: DataFrame) -> DataFrame:
    return pairs.select(
        F.concat(F.lit("ip_"), "ip").alias("source"),
        F.concat(F.lit("ep_"), "endpoint").alias("target"),
        F.col("request_count").alias("weight"), "severity",
    )


def resource_edges(pairs: DataFrame) -> DataFrame:
    """Endpoints that were attacked and answered 200, with the resource they reach."""
    last = F.element_at(F.split("endpoint", "/"), -1)
    reached = pairs.where("ok_count > 0 and alert_count > 0")
    return (
        reached.groupBy("endpoint")
        .agg(F.min_by("ok_count", "rank").alias("weight"))
        .select(
            F.concat(F.lit("ep_"), "endpoint").alias("source"),
            F.concat(F.lit("res_"), F.when(last == "", F.col("endpoint")).otherwise(last)).alias("target"),
            "weight", F.lit(RESOURCE_SEVERITY).alias("severity"),
        )
    )


def resource_nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("target").alias("id")).distinct().select(
        "id", F.lit("resource").alias("type"), F.expr("substr(id, 5)").alias("label"),
        F.lit(RESOURCE_SEVERITY).alias("severity"),
    )


def blast_radius(attackers: DataFrame, ev: DataFrame, al: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All nodes and all edges."""
    pairs = contacts(attackers, ev, al)
    reached = resource_edges(pairs)
    nodes = (
        attacker_nodes(attackers)
        .unionByName(endpoint_nodes(pairs), allowMissingColumns=True)
        .unionByName(resource_nodes(reached), allowMissingColumns=True)
    )
    return nodes, attacker_edges(pairs).unionByName(reached)


def graph_filter(nodes: DataFrame, edges: DataFrame, types: list[str]) -> tuple[DataFrame, DataFrame]:
    """Nodes of the chosen types, and the edges that keep both ends."""
    kept = nodes.where(F.col("type").isin(types))
    ids = kept.select("id")
    return kept, (
        edges.join(ids, edges["source"] == ids["id"], "left_semi").join(
            kept.select(F.col("id").alias("_target")), F.col("target") == F.col("_target"), "left_semi"
        )
    )
