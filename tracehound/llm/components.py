"""Connected components of an edge table, by smallest label, hooked roots and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracehound.runtime import materialize


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Columns node and component (smallest node of it) for every node with an edge.

    Each round takes the smallest label among neighbours, for the node and for the node that
    was its label (so whole regions move at once), then the label of that label. Rounds go on
    until no label moves; then neighbours agree, so the labels are those of the components.
    Labels are aggregated before they are joined, and every round is written to the shared
    folder, so its lineage stays short and a lost executor repeats one round at most.
    """
    pairs = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(F.col(a).alias("a"), F.col(b).alias("b"))
    both = materialize(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")).select("node", F.least("node", "near").alias("component")))
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("component").alias("near"))
        met = labels.join(near, labels["node"] == near["a"]).select("node", "component", "near")
        hooks = met.groupBy(F.col("component").alias("root")).agg(F.min("near").alias("hook"))
        seen = met.join(hooks, met["node"] == hooks["root"], "left").select("node", F.least("component", "near", "hook").alias("component"), F.col("component").alias("old"))
        jump = seen.select(F.col("node").alias("to"), F.col("component").alias("next"))
        new = materialize(seen.join(jump, seen["component"] == jump["to"], "left").select("node", F.least("component", F.coalesce("next", "component")).alias("component"), (F.least("component", F.coalesce("next", "component")) != F.col("old")).alias("moved")))
        labels = new.select("node", "component")
        if new.where("moved").isEmpty():
            return labels
