"""Per-address correlation: patterns, profiles, threat scores, ranking."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracehound.operators.chains import attack_chains, suspect_ips
from tracehound.operators.scoring import (
    DATA_PARTS,
    TRAVERSAL_PARTS,
    ScoreConfig,
    answered_ok,
    endpoint_has,
    successful_attack,
)
from tracehound.schema import (
    UNKNOWN_PATTERN_WEIGHT,
    alert_order,
    first_event_order,
    first_event_seq,
    group_of,
    severity_weight,
)


def sort_events(ev: DataFrame) -> DataFrame:
    """Time order; equal times keep input order."""
    return ev.orderBy("ts", "event_seq")


def group_by_ip(ev: DataFrame) -> DataFrame:
    return ev.groupBy(group_of(F.col("ip")).alias("ip_group")).agg(
        F.count(F.lit(1)).alias("event_count"),
        F.min("ts").alias("first_seen"),
        F.max("ts").alias("last_seen"),
    )


def alerts_by_ip(al: DataFrame) -> DataFrame:
    return al.groupBy("ip_group").agg(
        F.count(F.lit(1)).alias("alert_count"),
        F.sum(severity_weight(F.col("severity"))).alias("alert_weight"),
    )


@dataclass(frozen=True)
class Pattern:
    """A multi-event pattern as aggregates over one address, and a test on them."""

    pattern_id: str
    name: str
    severity: str
    counters: dict[str, Callable[[], Column]]
    test: Callable[[], Column]
    text: Callable[[], Column]


def _number(name: str) -> Column:
    return F.col(name).cast("string")


def _failed() -> Column:
    return F.coalesce(F.col("status_code") == 401, F.lit(False))


def _forbidden() -> Column:
    return F.coalesce(F.col("status_code") == 403, F.lit(False))


def _login_ok() -> Column:
    return answered_ok() & endpoint_has(["login"])


# Pattern ids, names, severities, limits and texts.
PATTERNS: list[Pattern] = [
    Pattern(
        "CORR_CREDENTIAL_STUFFING", "Credential Stuffing", "CRITICAL",
        {
            "n_failed": lambda: F.count_if(_failed()),
            "last_failed": lambda: F.max(F.when(_failed(), F.col("ts"))),
            "first_login": lambda: F.min(F.when(_login_ok(), F.col("ts"))),
        },
        lambda: (F.col("n_failed") >= 3) & (F.col("first_login") > F.col("last_failed")),
        lambda: F.concat(_number("n_failed"), F.lit(" failed logins then successful login")),
    ),
    Pattern(
        "CORR_UNAUTHORIZED_ACCESS", "Unauthorized Access Attempt", "HIGH",
        {
            "n_failed": lambda: F.count_if(_failed()),
            "n_forbidden": lambda: F.count_if(_forbidden()),
        },
        lambda: (F.col("n_failed") >= 1) & (F.col("n_forbidden") >= 1),
        lambda: F.concat(
            _number("n_failed"), F.lit(" failed logins + "), _number("n_forbidden"),
            F.lit(" forbidden accesses"),
        ),
    ),
    Pattern(
        "CORR_SUCCESSFUL_TRAVERSAL", "Successful Path Traversal", "CRITICAL",
        {"n_traversal": lambda: F.count_if(answered_ok() & endpoint_has(TRAVERSAL_PARTS))},
        lambda: F.col("n_traversal") > 0,
        lambda: F.concat(_number("n_traversal"), F.lit(" successful path traversal(s)")),
    ),
    Pattern(
        "CORR_DATA_EXFILTRATION", "Potential Data Exfiltration", "CRITICAL",
        {"n_data": lambda: F.count_if(answered_ok() & endpoint_has(DATA_PARTS))},
        lambda: (F.col("n_data") > 0) & (F.col("alert_count") > 0),
        lambda: F.concat(
            F.lit("Data endpoint accessed after "), _number("alert_count"), F.lit(" attack alerts")
        ),
    ),
]


def ip_stats(ev: DataFrame, al: DataFrame, patterns: Sequence[Pattern] = PATTERNS) -> DataFrame:
    """All per-address counters of suspect addresses in one pass over the events.

    Plain aggregates, combined before the shuffle: the hottest address costs one row
    per task. Patterns, scores and profiles are projections of this table.
    """
    counters: dict[str, Callable[[], Column]] = {}
    for pattern in patterns:
        counters.update(pattern.counters)
    per_ip = ev.groupBy(group_of(F.col("ip")).alias("ip_group")).agg(
        F.count(F.lit(1)).alias("total_requests"),
        F.min("ts").alias("first_seen"),
        F.max("ts").alias("last_seen"),
        first_event_order().alias("first_event"),
        F.count_distinct("source").alias("source_count"),
        F.count_if(successful_attack()).alias("n_success"),
        *[make().alias(name) for name, make in counters.items()],
    )
    return per_ip.join(alerts_by_ip(al), "ip_group")


def _hits(patterns: Sequence[Pattern]) -> Column:
    """Array of the patterns that hold, at most one entry per pattern."""
    entries = [
        F.when(
            p.test(),
            F.struct(
                F.lit(p.pattern_id).alias("pattern_id"), F.lit(p.name).alias("name"),
                F.lit(p.severity).alias("severity"), p.text().alias("description"),
            ),
        )
        for p in patterns
    ]
    return F.array_compact(F.array(*entries))


def pattern_hits(ev: DataFrame, al: DataFrame, patterns: Sequence[Pattern] = PATTERNS) -> DataFrame:
    return (
        ip_stats(ev, al, patterns)
        .select(F.col("ip_group").alias("ip"), F.explode(_hits(patterns)).alias("hit"))
        .select("ip", "hit.*")
    )


def _score(patterns: Sequence[Pattern], config: ScoreConfig) -> Column:
    pattern_weight = F.lit(0)
    for p in patterns:
        weight = severity_weight(F.lit(p.severity), UNKNOWN_PATTERN_WEIGHT)
        pattern_weight = pattern_weight + F.when(p.test(), weight).otherwise(0)
    return (
        F.col("alert_weight")
        + (F.col("source_count") - 1) * config.source_bonus
        + pattern_weight
        + F.col("n_success") * config.success_bonus
    )


def threat_score(
    ev: DataFrame,
    al: DataFrame,
    config: ScoreConfig = ScoreConfig(),
    patterns: Sequence[Pattern] = PATTERNS,
) -> DataFrame:
    """Score of each suspect address, before and after the cap."""
    raw = _score(patterns, config)
    return ip_stats(ev, al, patterns).select(
        F.col("ip_group").alias("ip"),
        raw.cast("long").alias("raw_score"),
        F.least(raw, F.lit(config.max_score)).cast("int").alias("threat_score"),
    )


def attacker_endpoints(ev: DataFrame, al: DataFrame) -> DataFrame:
    """Distinct endpoints of each suspect address with their first use, in long form."""
    return (
        ev.where("endpoint <> ''")
        .groupBy(group_of(F.col("ip")).alias("ip_group"), "endpoint")
        .agg(
            F.count(F.lit(1)).alias("request_count"),
            F.min("ts").alias("first_ts"),
            first_event_order().alias("first_event"),
        )
        .join(suspect_ips(al), "ip_group", "left_semi")
        .select(
            F.col("ip_group").alias("ip"), "endpoint", "request_count", "first_ts",
            first_event_seq(F.col("first_ts"), F.col("first_event")).alias("first_seq"),
        )
    )


def attacker_user_agents(ev: DataFrame, al: DataFrame) -> DataFrame:
    """Distinct user agents of each suspect address with their first use, in long form."""
    return (
        ev.where("user_agent <> ''")
        .groupBy(group_of(F.col("ip")).alias("ip_group"), "user_agent")
        .agg(F.min("ts").alias("first_ts"), first_event_order().alias("first_event"))
        .join(suspect_ips(al), "ip_group", "left_semi")
        .select(
            F.col("ip_group").alias("ip"), "user_agent", "first_ts",
            first_event_seq(F.col("first_ts"), F.col("first_event")).alias("first_seq"),
        )
    )


def attack_types(al: DataFrame) -> DataFrame:
    """Categories of each address in order of their first alert."""
    return (
        al.groupBy("ip_group", "category")
        .agg(F.min(alert_order()).alias("first"))
        .groupBy("ip_group")
        # one entry per category
        .agg(F.array_sort(F.collect_list(F.struct("first", "category")))["category"].alias("attack_types"))
        .withColumnRenamed("ip_group", "ip")
    )


def attacker_profile(
    ev: DataFrame,
    al: DataFrame,
    config: ScoreConfig = ScoreConfig(),
    patterns: Sequence[Pattern] = PATTERNS,
) -> DataFrame:
    """One row per suspect address.

    Endpoints and agents are counted here and listed in ``attacker_endpoints`` and
    ``attacker_user_agents``: their number per address has no bound.
    """
    stats = ip_stats(ev, al, patterns).select(
        F.col("ip_group").alias("ip"),
        F.least(_score(patterns, config), F.lit(config.max_score)).cast("int").alias("threat_score"),
        "total_requests", "alert_count", "source_count", "first_seen", "last_seen",
        first_event_seq(F.col("first_seen"), F.col("first_event")).alias("first_seq"),
    )
    # distinct pairs were made with both columns as key, so the count per address is cheap
    endpoints = attacker_endpoints(ev, al).groupBy("ip").agg(F.count(F.lit(1)).alias("endpoint_count"))
    out = stats.join(attack_types(al), "ip").join(endpoints, "ip", "left")
    agents = F.lit(0).cast("long")
    if "user_agent" in ev.columns:
        counted = attacker_user_agents(ev, al).groupBy("ip").agg(F.count(F.lit(1)).alias("_agents"))
        out, agents = out.join(counted, "ip", "left"), F.coalesce(F.col("_agents"), F.lit(0))
    return out.select(
        "ip", "threat_score", "total_requests", "alert_count", "source_count",
        F.coalesce("endpoint_count", F.lit(0)).alias("endpoint_count"),
        agents.alias("user_agent_count"), "attack_types", "first_seen", "last_seen", "first_seq",
    )


def attacker_order() -> Column:
    """Sortable rank of an attacker: score first, earliest appearance on ties."""
    return F.struct(-F.col("threat_score"), F.col("first_seen"), F.col("first_seq"))


def rank_attackers(attackers: DataFrame) -> DataFrame:
    """Attackers, highest score first; ties keep the order of first appearance."""
    return attackers.orderBy(F.desc("threat_score"), "first_seen", "first_seq")


def top_attacker(attackers: DataFrame) -> DataFrame:
    return attackers.agg(F.min_by(F.struct("ip", "threat_score"), attacker_order()).alias("t")).select(
        F.col("t.ip").alias("ip"), F.col("t.threat_score").alias("threat_score")
    ).where("ip is not null")


def top_endpoints(endpoints: DataFrame, n: int = 15) -> DataFrame:
    """First ``n`` endpoints of each address as an array (a report feature)."""
    first = Window.partitionBy("ip").orderBy("first_ts", "first_seq")
    return (
        endpoints.withColumn("rn", F.row_number().over(first))
        .where(F.col("rn") <= n)
        .groupBy("ip")
        .agg(F.array_sort(F.collect_list(F.struct("rn", "endpoint")))["endpoint"].alias("targeted_endpoints"))
    )


def correlate(
    ev: DataFrame,
    al: DataFrame,
    config: ScoreConfig = ScoreConfig(),
    patterns: Sequence[Pattern] = PATTERNS,
) -> dict[str, DataFrame]:
    """Every correlation table of one log."""
    from tracehound.operators.graph import blast_radius

    attackers = attacker_profile(ev, al, config, patterns)
    nodes, edges = blast_radius(attackers, ev, al)
    return {
        "attackers": attackers,
        "attacker_endpoints": attacker_endpoints(ev, al),
        "attacker_user_agents": attacker_user_agents(ev, al),
        "chains": attack_chains(ev, al, config.window_seconds, config.min_events, config),
        "pattern_hits": pattern_hits(ev, al, patterns),
        "graph_nodes": nodes,
        "graph_edges": edges,
    }
