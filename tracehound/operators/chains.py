"""Attack chains: sessions of suspicious events per address.

Everything is built from rows that were aggregated first: one row per event key,
then one per (address, time cell). Repeated events collapse before any shuffle on
the address, and the session step orders cells, not events, so an address that
holds a large part of the log does not end up in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracehound.operators.bloom import where_maybe
from tracehound.operators.scoring import ScoreConfig, successful_attack
from tracehound.runtime import materialize
from tracehound.schema import (
    KEY_COLUMNS,
    alert_order,
    group_of,
    micros,
    severity_weight,
)

# Statuses that make an event suspicious on their own.
SUSPICIOUS_STATUS = [401, 403]


def suspect_ips(al: DataFrame) -> DataFrame:
    """Address groups with at least one alert."""
    return al.select("ip_group").distinct()


def benign_ips(ev: DataFrame, al: DataFrame) -> DataFrame:
    groups = ev.select(group_of(F.col("ip")).alias("ip_group")).distinct()
    return groups.join(suspect_ips(al), "ip_group", "left_anti")


def alert_keys(al: DataFrame) -> DataFrame:
    """One row per event key and category that has alerts."""
    return al.groupBy(*KEY_COLUMNS, "category").agg(
        F.count(F.lit(1)).alias("n_alerts"),
        F.sum(severity_weight(F.col("severity"))).alias("weight"),
        F.min(alert_order()).alias("first_alert"),
    )


def _failed() -> Column:
    return F.coalesce(F.col("status_code").isin(SUSPICIOUS_STATUS), F.lit(False))


def _maybe_suspicious(ev: DataFrame, al: DataFrame) -> DataFrame:
    """Events that can be suspicious, found in the scan.

    Bloom filters of the alerted keys and of the suspect addresses let only few others
    through, so neither the harmless part of the log nor a busy address is shuffled.
    """
    timed = ev.where("ts is not null").withColumn("ip_group", group_of(F.col("ip")))
    return where_maybe(where_maybe(timed, al, KEY_COLUMNS, otherwise=_failed()), al, ["ip_group"])


def suspicious_keys(ev: DataFrame, al: DataFrame) -> DataFrame:
    """Suspicious events of suspect addresses, one row per event key.

    An event is suspicious when its status says so or when any alert of the same
    address carries its key. ``n_events`` counts the suspicious events of the key. Events
    are aggregated by key before anything is joined.
    """
    alerted = al.select(*KEY_COLUMNS).distinct().withColumn("alerted", F.lit(True))
    failed = _failed()
    per_key = _maybe_suspicious(ev, al).groupBy("ip_group", *KEY_COLUMNS).agg(
        F.count(F.lit(1)).alias("n_all"),
        F.count_if(failed).alias("n_failed"),
        F.count_if(successful_attack()).alias("n_success"),
        F.min("event_seq").alias("first_seq"),
        F.min(F.when(failed, F.col("event_seq"))).alias("first_failed_seq"),
    )
    alerted_key = F.coalesce(F.col("alerted"), F.lit(False))
    return (
        per_key.join(suspect_ips(al), "ip_group", "left_semi")
        .join(alerted, KEY_COLUMNS, "left")
        .withColumn("alerted", alerted_key)
        .where("alerted or n_failed > 0")
        .select(
            "ip_group", *KEY_COLUMNS, "alerted",
            F.when(alerted_key, F.col("n_all")).otherwise(F.col("n_failed")).alias("n_events"),
            # without an alert only rejected requests are suspicious, none of them a success
            F.when(alerted_key, F.col("n_success")).otherwise(0).alias("n_success"),
            F.when(alerted_key, F.col("first_seq"))
            .otherwise(F.col("first_failed_seq"))
            .alias("first_seq"),
        )
    )


def suspicious_events(ev: DataFrame, al: DataFrame) -> DataFrame:
    """The suspicious events themselves."""
    alerted = al.select(*KEY_COLUMNS).distinct().withColumn("alerted", F.lit(True))
    return (
        _maybe_suspicious(ev, al)
        .join(suspect_ips(al), "ip_group", "left_semi")
        .join(alerted, KEY_COLUMNS, "left")
        .where(F.coalesce(F.col("alerted"), F.lit(False)) | _failed())
        .drop("alerted")
    )


def _cell(window_seconds: int) -> Column:
    return F.floor(micros(F.col("ts")) / (max(window_seconds, 1) * 1_000_000))


def chain_cells(keys: DataFrame, window_seconds: int) -> DataFrame:
    """(address, time cell) rows with the number of the session they belong to.

    A cell is one window long, so events of one cell are never apart by more than the
    window and always share a session; only the gap between cells is left to test.
    The rows ordered per address are bounded by the length of the log divided by the
    window, whatever the number of events.
    """
    cells = keys.groupBy("ip_group", _cell(window_seconds).alias("cell")).agg(
        F.min("ts").alias("start_time"),
        F.max("ts").alias("end_time"),
        F.sum("n_events").alias("n_events"),
        F.sum("n_success").alias("n_success"),
        F.array_sort(F.collect_set("source")).alias("sources"),
    )
    ordered = Window.partitionBy("ip_group").orderBy("cell")
    gap = micros(F.col("start_time")) - micros(F.lag("end_time").over(ordered))
    return cells.withColumn(
        "starts", F.when(F.coalesce(gap <= window_seconds * 1_000_000, F.lit(False)), 0).otherwise(1)
    ).withColumn(
        "session",
        F.sum("starts").over(ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
    )


def chain_parts(
    ev: DataFrame, al: DataFrame, window_seconds: int, min_events: int
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Suspicious keys, numbered chains, and the (address, cell) to chain map.

    The keys are materialised: three readers follow, and each would scan the log.
    """
    keys = materialize(suspicious_keys(ev, al))
    cells = chain_cells(keys, window_seconds)
    sessions = cells.groupBy("ip_group", "session").agg(
        F.min("start_time").alias("start_time"),
        F.max("end_time").alias("end_time"),
        F.sum("n_events").alias("event_count"),
        F.sum("n_success").alias("n_success"),
        # sets of sources, not lists of cells: bounded by the kinds of logs
        F.size(F.array_distinct(F.flatten(F.collect_set("sources")))).alias("source_count"),
    )
    numbered = sessions.where(F.col("event_count") >= min_events).withColumn(
        "chain_no", F.row_number().over(Window.partitionBy("ip_group").orderBy("session"))
    )
    members = cells.select("ip_group", "cell", "session").join(
        numbered.select("ip_group", "session", "chain_no"), ["ip_group", "session"]
    ).select("ip_group", "cell", "chain_no")
    return keys, numbered, members


def chain_alerts(
    ev: DataFrame, al: DataFrame, window_seconds: int = 300, min_events: int = 2
) -> DataFrame:
    """Alerts of each chain, run-length encoded.

    Every chain event brings along all alerts that carry its key, so k equal events
    repeat them k times; ``times`` is that k instead of k copies of the row.
    """
    keys, _, members = chain_parts(ev, al, window_seconds, min_events)
    placed = al.join(keys.where("alerted").select(*KEY_COLUMNS, F.col("n_events").alias("times")), KEY_COLUMNS)
    return placed.withColumn("cell", _cell(window_seconds)).join(members, ["ip_group", "cell"]).drop("cell")


def chain_events(
    ev: DataFrame, al: DataFrame, window_seconds: int = 300, min_events: int = 2
) -> DataFrame:
    """Suspicious events with the chain they belong to, one row per event."""
    _, _, members = chain_parts(ev, al, window_seconds, min_events)
    events = suspicious_events(ev, al).withColumn("cell", _cell(window_seconds))
    return events.join(members, ["ip_group", "cell"]).drop("cell")


def attack_chains(
    ev: DataFrame,
    al: DataFrame,
    window_seconds: int = 300,
    min_events: int = 2,
    config: ScoreConfig = ScoreConfig(),
) -> DataFrame:
    """One row per chain with counts, score and the categories in order of appearance."""
    keys, chains, members = chain_parts(ev, al, window_seconds, min_events)
    per_cell = (
        alert_keys(al)
        .join(keys.where("alerted").select("ip_group", *KEY_COLUMNS, "n_events", "first_seq"), KEY_COLUMNS)
        .groupBy("ip_group", _cell(window_seconds).alias("cell"), "category")
        .agg(
            F.sum(F.col("n_alerts") * F.col("n_events")).alias("n_alerts"),
            F.sum(F.col("weight") * F.col("n_events")).alias("weight"),
            F.min(F.struct("ts", "first_seq", "first_alert")).alias("first"),
        )
    )
    per_chain = (
        per_cell.join(members, ["ip_group", "cell"])
        .groupBy("ip_group", "chain_no", "category")
        .agg(F.sum("n_alerts").alias("n_alerts"), F.sum("weight").alias("weight"), F.min("first").alias("first"))
        .groupBy("ip_group", "chain_no")
        .agg(
            F.sum("n_alerts").alias("alert_count"),
            F.sum("weight").alias("weight"),
            # one entry per category
            F.array_sort(F.collect_list(F.struct("first", "category")))["category"].alias("categories"),
        )
    )
    count, none = F.coalesce(F.col("alert_count"), F.lit(0)), F.array().cast("array<string>")
    score = (
        F.coalesce(F.col("weight"), F.lit(0))
        + (F.col("source_count") - 1) * config.source_bonus
        + F.col("n_success") * config.success_bonus
    )
    return (
        chains.join(per_chain, ["ip_group", "chain_no"], "left")
        .select(
            F.col("ip_group").alias("ip"), "chain_no", "start_time", "end_time", "event_count",
            count.alias("alert_count"),
            F.least(score, F.lit(config.max_score)).cast("int").alias("threat_score"),
            F.coalesce("categories", none).alias("categories"),
        )
        .withColumn("description", chain_description(F.col("categories"), F.col("event_count")))
    )


def chain_description(categories: Column, event_count: Column) -> Column:
    return F.when(
        F.size(categories) > 0,
        F.concat(F.lit("Attack chain: "), F.array_join(categories, " → ")),
    ).otherwise(
        F.concat(F.lit("Suspicious activity chain ("), event_count.cast("string"), F.lit(" events)"))
    )
