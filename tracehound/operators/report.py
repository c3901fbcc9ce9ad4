"""Incident summary, report sections and dashboard aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracehound.functions.labels import report_time, score_band
from tracehound.operators.correlate import attacker_order, top_endpoints
from tracehound.operators.detect import severity_counts
from tracehound.runtime import number_rows
from tracehound.schema import SEVERITY_LEVELS, alert_order


# ---- summary -------------------------------------------------------------------------


def summary_severity(al: DataFrame) -> DataFrame:
    """One row with zero-filled counters; severities outside the scale are ignored."""
    return al.agg(*severity_counts())


def summary_attack_types(al: DataFrame) -> DataFrame:
    """Categories with count and the severity of their first alert.

    Order by ``first`` for the order of appearance.
    """
    return al.groupBy("category").agg(
        F.count(F.lit(1)).alias("count"),
        F.min_by("severity", alert_order()).alias("severity"),
        F.min(alert_order()).alias("first"),
    )


def incident_summary(ev: DataFrame, al: DataFrame, attackers: DataFrame) -> DataFrame:
    """One row: totals, time range, highest score and who has it."""
    totals = ev.agg(
        F.count(F.lit(1)).alias("total_events"), F.min("ts").alias("time_start"), F.max("ts").alias("time_end")
    )
    alerts = al.agg(F.count(F.lit(1)).alias("total_alerts"), *severity_counts())
    top = attackers.agg(F.min_by(F.struct("ip", "threat_score"), attacker_order()).alias("t")).select(
        F.col("t.ip").alias("top_attacker_ip"),
        F.coalesce(F.col("t.threat_score"), F.lit(0)).alias("threat_score"),
    )
    # three one-row aggregates side by side
    return totals.join(F.broadcast(alerts)).join(F.broadcast(top)).select(
        "total_events", "total_alerts", "threat_score", "top_attacker_ip", "time_start", "time_end",
        F.struct(*SEVERITY_LEVELS).alias("alerts_by_severity"),
    )


# ---- report sections -----------------------------------------------------------------


def report_attackers(attackers: DataFrame, endpoints: DataFrame, listed: int = 15) -> DataFrame:
    """Profile rows with report times and the first endpoints."""
    return attackers.join(top_endpoints(endpoints, listed), "ip", "left").select(
        "ip", "threat_score", score_band(F.col("threat_score")).alias("score_band"),
        "total_requests", "alert_count",
        report_time(F.col("first_seen")).alias("first_seen"),
        report_time(F.col("last_seen")).alias("last_seen"),
        F.coalesce(F.nullif(F.array_join("attack_types", ", "), F.lit("")), F.lit("N/A")).alias("attack_types"),
        "targeted_endpoints",
    )


def report_timeline(ev: DataFrame, rows: int = 50, width: int = 40) -> DataFrame:
    """First events in stored order; the endpoint column is cut for display."""
    first = ev.orderBy("event_seq").limit(rows)
    status = F.col("status_code")
    return first.select(
        # the limit bounds this window
        F.row_number().over(Window.orderBy("event_seq")).alias("row_no"),
        F.coalesce(F.date_format("ts", "HH:mm:ss"), F.lit("N/A")).alias("time"),
        "source", "ip",
        F.coalesce(F.nullif("method", F.lit("")), F.lit("—")).alias("method"),
        F.coalesce(F.nullif(F.substring("endpoint", 1, width), F.lit("")), F.lit("—")).alias("endpoint"),
        F.when(status >= 400, "error").when(status > 0, "ok").otherwise("—").alias("status_mark"),
        "status_code",
    )


def report_alerts(al: DataFrame, width: int = 30) -> DataFrame:
    """All alerts, numbered in alert order; the matched text is cut for display."""
    return number_rows(al, "phase", "ord_major", "ord_minor").select(
        "row_no", "severity", "rule_id", "category",
        F.coalesce(F.nullif(F.substring("matched_pattern", 1, width), F.lit("")), F.lit("—")).alias("pattern"),
        F.coalesce(F.nullif("ip", F.lit("")), F.lit("—")).alias("ip"),
    )


def report_chains(chains: DataFrame) -> DataFrame:
    return chains.select(
        "ip", "chain_no", "threat_score",
        report_time(F.col("start_time")).alias("start_time"),
        report_time(F.col("end_time")).alias("end_time"),
        "description", "event_count", "alert_count",
    )


def report_evidence(al: DataFrame, rows: int = 20) -> DataFrame:
    """Raw lines behind the first alerts."""
    first = al.orderBy("phase", "ord_major", "ord_minor").limit(rows)
    # the limit bounds this window
    order = Window.orderBy("phase", "ord_major", "ord_minor")
    return (
        first.withColumn("row_no", F.row_number().over(order))
        .where("raw_line <> ''")
        .select("row_no", "rule_id", "severity", "raw_line")
    )


# Advice per detected category with its detail, and the general advice.
CATEGORY_ADVICE = [
    ("SQL Injection", "Implement parameterized queries",
     "SQL injection attempts detected. Review all database query construction."),
    ("Brute Force", "Enable rate limiting and account lockout",
     "Brute force attempts detected. Implement CAPTCHA after 3 failed attempts."),
    ("Path Traversal", "Sanitize file path inputs",
     "Path traversal attempts detected. Validate and canonicalize all file paths."),
    ("XSS", "Implement Content Security Policy (CSP)",
     "XSS attempts detected. Sanitize all user input and enable CSP headers."),
    ("Command Injection", "Avoid shell command execution from user input",
     "Command injection attempts detected. Use parameterized system calls."),
]
GENERAL_ADVICE = [
    ("Review WAF rules", "Ensure Web Application Firewall rules cover all detected attack patterns."),
    ("Preserve log files", "Retain all referenced log files as forensic evidence for potential legal proceedings."),
]
ESCALATION_ADVICE = ("Escalate to security team", "High threat score indicates an active and sophisticated attack.")
BLOCK_ADVICE = "Block IP"
BLOCK_SCORE = 50
ESCALATION_SCORE = 70


def report_recommendations(attackers: DataFrame, al: DataFrame) -> DataFrame:
    """Rows ``section, subject, advice, detail, threat_score, alert_count``.

    Sections follow the report: 1 block an address, 2 category advice, 3 escalation,
    4 general advice.
    """
    spark = attackers.sparkSession
    none = F.lit(None).cast("int").alias("threat_score"), F.lit(None).cast("long").alias("alert_count")
    score, alerts = F.col("threat_score"), F.coalesce("alert_count", F.lit(0)).cast("long")
    block = attackers.where(score >= BLOCK_SCORE).select(
        F.lit(1).alias("section"), F.col("ip").alias("subject"), F.lit(BLOCK_ADVICE).alias("advice"),
        F.format_string("Threat score %d/100 with %d alerts", score, alerts).alias("detail"),
        "threat_score", alerts.alias("alert_count"),
    )
    texts = spark.createDataFrame(CATEGORY_ADVICE, "category string, advice string, detail string")
    by_category = texts.join(al.select("category").distinct(), "category", "left_semi").select(
        F.lit(2).alias("section"), F.col("category").alias("subject"), "advice", "detail", *none
    )
    worst = attackers.agg(F.max("threat_score").alias("threat_score"))
    escalate = worst.where(score >= ESCALATION_SCORE).select(
        F.lit(3).alias("section"), F.lit("incident").alias("subject"), F.lit(ESCALATION_ADVICE[0]).alias("advice"),
        F.lit(ESCALATION_ADVICE[1]).alias("detail"), "threat_score", F.lit(None).cast("long").alias("alert_count"),
    )
    general = spark.createDataFrame(GENERAL_ADVICE, "advice string, detail string").select(
        F.lit(4).alias("section"), F.lit("incident").alias("subject"), "advice", "detail", *none
    )
    return block.unionByName(by_category).unionByName(escalate).unionByName(general)


# ---- dashboard -----------------------------------------------------------------------


def dash_totals(incidents: DataFrame) -> DataFrame:
    """Totals over all incidents; the mean score rounds halves up."""
    return incidents.agg(
        F.coalesce(F.sum("total_events"), F.lit(0)).alias("total_events"),
        F.coalesce(F.sum("total_alerts"), F.lit(0)).alias("total_alerts"),
        F.count(F.lit(1)).alias("incident_count"),
        F.coalesce(F.floor(F.avg("threat_score") + F.lit(0.5)), F.lit(0)).alias("avg_score"),
    )


def _severity_sums(incidents: DataFrame) -> DataFrame:
    return incidents.agg(
        *[F.coalesce(F.sum(F.col("alerts_by_severity")[s]), F.lit(0)).alias(s) for s in SEVERITY_LEVELS]
    )


def dash_severity_totals(incidents: DataFrame) -> DataFrame:
    """Count per severity and its share of the largest, in percent."""
    sums = _severity_sums(incidents)
    largest = F.greatest(*[F.col(s) for s in SEVERITY_LEVELS], F.lit(1))
    pairs = ", ".join(f"'{s}', {s}" for s in SEVERITY_LEVELS)
    return sums.withColumn("largest", largest).selectExpr(
        f"stack({len(SEVERITY_LEVELS)}, {pairs}) as (severity, alert_count)", "largest"
    ).select("severity", "alert_count", (F.col("alert_count") * 100.0 / F.col("largest")).alias("share"))


def dash_active_threats(incidents: DataFrame) -> DataFrame:
    """Critical and high alerts together."""
    return _severity_sums(incidents).select((F.col("CRITICAL") + F.col("HIGH")).alias("active_threats"))
