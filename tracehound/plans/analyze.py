"""From log files to the tables of one incident."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracehound.operators.correlate import PATTERNS, Pattern, correlate
from tracehound.operators.detect import detect_all
from tracehound.operators.enrich import GEO_COLUMNS, enrich_attackers
from tracehound.operators.formats import (
    FORMATS,
    LogFormat,
    detect_format,
    file_parse_report,
    parse_auto,
    split_rejects,
)
from tracehound.operators.report import incident_summary, summary_attack_types
from tracehound.operators.rules import RULES, Rule
from tracehound.operators.scoring import ScoreConfig
from tracehound.runtime import materialize
from tracehound.sources.lines import scan_log_lines


@dataclass
class Options:
    rules: Sequence[Rule] = field(default_factory=lambda: RULES)
    patterns: Sequence[Pattern] = field(default_factory=lambda: PATTERNS)
    score: ScoreConfig = ScoreConfig()
    formats: dict[str, LogFormat] = field(default_factory=lambda: FORMATS)
    parse: dict[str, dict] = field(default_factory=dict)
    geo: DataFrame | None = None
    geo_by: str = "exact"


def no_geo(spark: SparkSession) -> DataFrame:
    """Empty lookup table: private addresses resolve, all others are unavailable."""
    return spark.createDataFrame(
        [], "ip string, country string, city string, lat double, lon double, isp string, org string, as_name string"
    ).select("ip", *GEO_COLUMNS)


def analyze(ev: DataFrame, options: Options | None = None) -> dict[str, DataFrame]:
    """Alerts, correlation, enrichment and summary of normalised events.

    Alerts are materialised: every later table reads them, and they are a small part
    of the events. Events themselves stay lazy; pass a stored table when parsing them
    again for each consumer would cost more than reading it.
    """
    opt = options or Options()
    ok, rejects = split_rejects(ev)
    alerts = materialize(detect_all(ok, opt.rules))
    tables = correlate(ok, alerts, opt.score, opt.patterns)
    geo = opt.geo if opt.geo is not None else no_geo(ev.sparkSession)
    tables["attackers"] = enrich_attackers(tables["attackers"], geo, opt.geo_by)
    tables.update(
        events=ok,
        alerts=alerts,
        rejects=rejects,
        summary=incident_summary(ok, alerts, tables["attackers"]),
        attack_types=summary_attack_types(alerts),
    )
    return tables


def analyze_files(
    spark: SparkSession, path: str | list[str], options: Options | None = None, fmt: str | None = None
) -> dict[str, DataFrame]:
    """The same from log files, with one row per file on how it was read."""
    opt = options or Options()
    lines = scan_log_lines(spark, path)
    if fmt:
        detected = lines.select("source_file").distinct().select(
            "source_file", F.lit(fmt).alias("format"), F.lit(100).alias("confidence"),
            F.lit(None).cast("string").alias("error"),
        )
    else:
        detected = materialize(detect_format(lines, opt.formats))
    events = materialize(parse_auto(lines, fmt, opt.formats, opt.parse, detected))
    tables = analyze(events, opt)
    tables["files"] = file_parse_report(detected, events)
    return tables
