"""Time-ordered event pages with the alerts of each event."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracehound.runtime import number_rows
from tracehound.schema import micros

# Pages that start within this many events are cut from a top-k; later ones by cells.
TOP_K_REACH = 50_000
CELL_SECONDS = 60


def alerts_at(al: DataFrame) -> DataFrame:
    """Alerts per address and time, as an array of (rule, count) entries.

    Run-length encoded: the array is bounded by the number of rules even when one
    moment of one address holds millions of alerts.
    """
    return (
        al.groupBy("ip", "ts", "rule_ordinal", "rule_id", "severity", "category", "description")
        .agg(F.count(F.lit(1)).alias("times"))
        .groupBy("ip", "ts")
        .agg(
            F.array_sort(
                F.collect_list(
                    F.struct("rule_ordinal", "rule_id", "severity", "category", "description", "times")
                )
            ).alias("alerts")
        )
    )


def timeline_alerts(ev: DataFrame, al: DataFrame) -> DataFrame:
    """Events with the alerts that share their address and time."""
    return ev.join(alerts_at(al), ["ip", "ts"], "left").withColumn(
        "alert_count",
        F.coalesce(F.aggregate("alerts", F.lit(0).cast("long"), lambda n, a: n + a["times"]), F.lit(0)),
    )


def timeline_rows(
    ev: DataFrame, page: int = 1, page_size: int = 100, top_k_reach: int = TOP_K_REACH
) -> DataFrame:
    """Events of one page, with their position in time order.

    A page near the start is a top-k. A deep page first counts events per minute,
    keeps the minutes the page falls into and numbers only their events, so its cost
    does not grow with the page number.
    """
    start = (page - 1) * page_size
    if start + page_size <= top_k_reach:
        top = ev.orderBy("ts", "event_seq").limit(start + page_size)
        position = F.row_number().over(Window.orderBy("ts", "event_seq"))
        # the limit bounds this window
        return top.withColumn("position", position).where(F.col("position") > start)
    cell = F.coalesce(F.floor(micros(F.col("ts")) / (CELL_SECONDS * 1_000_000)), F.lit(-(1 << 62)))
    counts = ev.groupBy(cell.alias("_cell")).agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edges = counts.withColumn("_upto", F.sum("_n").over(upto))
    on_page = edges.where((F.col("_upto") > start) & (F.col("_upto") - F.col("_n") < start + page_size))
    first = on_page.agg(F.min(F.col("_upto") - F.col("_n")).alias("_base"))
    # every kept minute holds an event of the page: at most page_size rows
    inside = ev.withColumn("_cell", cell).join(F.broadcast(on_page.select("_cell")), "_cell", "left_semi")
    numbered = number_rows(inside.drop("_cell"), "ts", "event_seq", name="_in_page")
    # one row
    placed = numbered.join(F.broadcast(first)).withColumn("position", F.col("_base") + F.col("_in_page"))
    return placed.where(F.col("position").between(start + 1, start + page_size)).drop("_base", "_in_page")


def timeline(ev: DataFrame, al: DataFrame, page: int = 1, page_size: int = 100) -> DataFrame:
    return timeline_alerts(timeline_rows(ev, page, page_size), al)


def page_info(ev: DataFrame, page: int = 1, page_size: int = 100) -> DataFrame:
    return ev.agg(F.count(F.lit(1)).alias("total_events")).select(
        "total_events", F.lit(page).alias("page"), F.lit(page_size).alias("page_size"),
        F.ceil(F.col("total_events") / page_size).cast("int").alias("total_pages"),
    )


def timeline_filter(events: DataFrame, source: str | None = None, ip_part: str | None = None) -> DataFrame:
    """Rows of one source and with a text inside the address."""
    out = events
    if source:
        out = out.where(F.col("source") == source)
    if ip_part:
        out = out.where(F.contains(F.col("ip"), F.lit(ip_part)))
    return out


def recent_alerts(timeline_df: DataFrame) -> DataFrame:
    """Events that have alerts, with the first one."""
    first: Column = F.col("alerts")[0]
    return timeline_df.where(F.size("alerts") > 0).select(
        "event_seq", "ts", "ip", first["rule_id"].alias("rule_id"), first["severity"].alias("severity")
    )
