"""Enrichment, incidents, summary, timeline, report and dashboard."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querybook.book import query
from querybook.inputs import CHAIN_WINDOW, log_rules
from querybook.oracle import q, with_ctes
from tracehound.functions.ips import ip_to_long, is_private_ip
from tracehound.functions.labels import report_time, score_band, status_class
from tracehound.operators import chains as ch
from tracehound.operators import correlate as co
from tracehound.operators import enrich as en
from tracehound.operators import report as re
from tracehound.operators import timeline as tl
from tracehound.operators.detect import severity_counts
from tracehound.operators.scoring import ScoreConfig
from tracehound.plans.analyze import Options, analyze
from tracehound.runtime import scratch_path
from tracehound.schema import SEVERITY_LEVELS, alert_order
from tracehound.sources import incidents as inc

# ---- enrichment ----------------------------------------------------------------------


def sql_private(ip: str) -> str:
    o = [f"TRY_CAST(split_part({ip}, '.', {i}) AS INT)" for i in range(1, 5)]
    return (
        f"({ip} = '' OR length({ip}) - length(replace({ip}, '.', '')) <> 3 OR coalesce({o[0]} = 10 OR ({o[0]} = 172 AND {o[1]} BETWEEN 16 AND 31) "
        f"OR ({o[0]} = 192 AND {o[1]} = 168) OR {o[0]} = 127 OR ({o[0]} = 0 AND {o[1]} = 0 AND {o[2]} = 0 AND {o[3]} = 0), false))"
    )


_TEXT_IPS = r"SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]{1,3}(?:\.[0-9]{1,3}){3}')) AS ip FROM documents"


@query("is_private_ip", f"SELECT doc_id, ip, {sql_private('ip')} AS is_private, count(*) AS n FROM ({_TEXT_IPS}) d GROUP BY ALL")
def _(x):
    found = x.table("documents").select(
        "doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}"), F.lit(0))).alias("ip"))
    return found.groupBy("doc_id", "ip", is_private_ip(F.col("ip")).alias("is_private")).agg(F.count(F.lit(1)).alias("n"))


@query("dedupe_ips", with_ctes("SELECT DISTINCT ip FROM ev", "ev"))
def _(x):
    return en.dedupe_ips(x.ev)


_PRIVATE = """'Private Network' AS country, 'N/A' AS city, CAST(0 AS DOUBLE) AS lat, CAST(0 AS DOUBLE) AS lon, 'Private/Reserved' AS isp, 'Internal Network' AS org, 'N/A' AS as_name"""


@query("enrich_private", with_ctes(f"SELECT DISTINCT ip, {_PRIVATE}, true AS is_private FROM ev WHERE {sql_private('ip')}", "ev"))
def _(x):
    return en.enrich(x.ev, x.geo).where("is_private").drop("enrichment_error")


def sql_enriched(source: str) -> str:
    text = lambda c: f"coalesce(nullif(g.{c}, ''), 'Unknown')"
    return f"""SELECT e.ip, CASE WHEN p THEN 'Private Network' WHEN g.ip IS NULL THEN 'Unavailable' ELSE {text('country')} END AS country,
 CASE WHEN p THEN 'N/A' WHEN g.ip IS NULL THEN 'Unavailable' ELSE {text('city')} END AS city,
 CASE WHEN p OR g.ip IS NULL THEN 0.0::DOUBLE ELSE coalesce(g.lat, 0) END AS lat, CASE WHEN p OR g.ip IS NULL THEN 0.0::DOUBLE ELSE coalesce(g.lon, 0) END AS lon,
 CASE WHEN p THEN 'Private/Reserved' WHEN g.ip IS NULL THEN 'Unavailable' ELSE {text('isp')} END AS isp,
 CASE WHEN p THEN 'Internal Network' WHEN g.ip IS NULL THEN 'Unavailable' ELSE {text('org')} END AS org,
 CASE WHEN p THEN 'N/A' WHEN g.ip IS NULL THEN 'Unavailable' ELSE {text('as_name')} END AS as_name, p AS is_private
 FROM (SELECT DISTINCT ip, {sql_private('ip')} AS p FROM ev) e LEFT JOIN {source} g ON g.ip = e.ip AND NOT p"""


@query("enrich_geo_join", with_ctes(f"SELECT * FROM ({sql_enriched('geo')}) r WHERE NOT is_private AND country <> 'Unavailable'", "ev", "geo"))
def _(x):
    return en.enrich(x.ev, x.geo).where("not is_private and enrichment_error is null").drop("enrichment_error")


_RANGED = """SELECT ip, arg_min(country, "end" - start) AS country, arg_min(city, "end" - start) AS city, arg_min(lat, "end" - start) AS lat,
 arg_min(lon, "end" - start) AS lon, arg_min(isp, "end" - start) AS isp, arg_min(org, "end" - start) AS org, arg_min(as_name, "end" - start) AS as_name FROM (
 SELECT DISTINCT ip, CAST(split_part(ip, '.', 1) AS BIGINT) * 16777216 + CAST(split_part(ip, '.', 2) AS BIGINT) * 65536
  + CAST(split_part(ip, '.', 3) AS BIGINT) * 256 + CAST(split_part(ip, '.', 4) AS BIGINT) AS n FROM ev WHERE ip <> '') e
 JOIN networks w ON e.n BETWEEN w.start AND w."end" GROUP BY ip"""


@query("enrich_geo_range", with_ctes(f"SELECT * FROM ({sql_enriched('ranged')}) r", "ev", "networks", extra={"ranged": _RANGED}))
def _(x):
    return en.enrich(x.ev, x.networks, by="range").drop("enrichment_error")


@query("ip_to_long", with_ctes(
    "SELECT DISTINCT ip, CAST(split_part(ip, '.', 1) AS BIGINT) * 16777216 + CAST(split_part(ip, '.', 2) AS BIGINT) * 65536 + CAST(split_part(ip, '.', 3) AS BIGINT) * 256 + CAST(split_part(ip, '.', 4) AS BIGINT) AS ip_number FROM ev WHERE ip <> ''", "ev"))
def _(x):
    return en.dedupe_ips(x.ev).select("ip", ip_to_long(F.col("ip")).alias("ip_number")).where("ip_number is not null")


@query("enrich_fallback", with_ctes(
    f"SELECT *, 'address not in the lookup table' AS enrichment_error FROM ({sql_enriched('geo')}) r WHERE country = 'Unavailable'", "ev", "geo"))
def _(x):
    return en.enrich(x.ev, x.geo).where("enrichment_error is not null")


@query("enrich_attackers", with_ctes(
    f"""SELECT p.ip, p.threat_score, p.alert_count, g.country, g.lat, g.isp, g.org, g.as_name, g.is_private
    FROM prof p LEFT JOIN ({sql_enriched('geo')}) g ON g.ip = CASE WHEN p.ip = 'unknown' THEN '' ELSE p.ip END""", "prof", "geo"))
def _(x):
    return en.enrich_attackers(co.attacker_profile(x.ev, x.al), x.geo).selectExpr(
        "ip", "threat_score", "alert_count", "geo.country as country", "geo.lat as lat", "isp", "org", "as_name", "is_private")


# ---- incidents: one per week ---------------------------------------------------------

_SEV_SQL = ", ".join(f"count(*) FILTER (WHERE severity = '{s}') AS {s}" for s in SEVERITY_LEVELS)
_WEEK_SCORE = "CASE severity WHEN 'CRITICAL' THEN 25 WHEN 'HIGH' THEN 15 WHEN 'MEDIUM' THEN 8 WHEN 'LOW' THEN 3 ELSE 3 END"
INCIDENTS = {
    "incidents": f"""SELECT e.incident_id, e.time_end AS created_at, 'analyzed' AS status, e.total_events, coalesce(a.total_alerts, 0) AS total_alerts,
 CAST(least(100, coalesce(s.threat_score, 0)) AS INT) AS threat_score, s.top_attacker_ip, coalesce(CRITICAL, 0) AS CRITICAL, coalesce(HIGH, 0) AS HIGH, coalesce(MEDIUM, 0) AS MEDIUM, coalesce(LOW, 0) AS LOW
 FROM (SELECT incident_id, count(*) AS total_events, max(ts) AS time_end FROM week_ev GROUP BY 1) e
 LEFT JOIN (SELECT incident_id, count(*) AS total_alerts, {_SEV_SQL} FROM week_al GROUP BY 1) a USING (incident_id)
 LEFT JOIN (SELECT incident_id, max(w) AS threat_score, min(ip_group) FILTER (WHERE w = m) AS top_attacker_ip FROM (
  SELECT incident_id, ip_group, w, max(w) OVER (PARTITION BY incident_id) AS m FROM (
  SELECT incident_id, ip_group, sum({_WEEK_SCORE}) AS w FROM week_al GROUP BY 1, 2) y) z GROUP BY 1) s USING (incident_id)""",
}


def weekly(x):
    """Incident rows of the log cut into weeks, and the alerts behind them."""
    week = lambda df: df.withColumn("incident_id", F.date_format(F.date_trunc("week", "ts"), "yyyy-MM-dd"))
    ev, al = week(x.ev), week(x.al)
    totals = ev.groupBy("incident_id").agg(F.count(F.lit(1)).alias("total_events"), F.max("ts").alias("created_at"))
    alerts = al.groupBy("incident_id").agg(F.count(F.lit(1)).alias("total_alerts"), *severity_counts())
    from tracehound.schema import severity_weight

    kinds = al.groupBy("incident_id", "category").agg(
        F.count(F.lit(1)).alias("count"), F.min_by("severity", alert_order()).alias("severity"), F.min(alert_order()).alias("first"))
    # one entry per category
    kinds = kinds.groupBy("incident_id").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("first", "category", "count", "severity"))),
        lambda t: F.struct(t["category"].alias("type"), t["count"].alias("count"), t["severity"].alias("severity"))).alias("attack_types"))
    scores = al.groupBy("incident_id", "ip_group").agg(F.sum(severity_weight(F.col("severity"))).alias("w"))
    top = scores.groupBy("incident_id").agg(
        F.min(F.struct((-F.col("w")).alias("neg"), "ip_group")).alias("t"))
    rows = (
        totals.join(alerts, "incident_id", "left").join(top, "incident_id", "left").join(kinds, "incident_id", "left")
        .select(
            "incident_id", "created_at", F.lit("analyzed").alias("status"), "total_events", "total_alerts",
            F.least(F.lit(100), -F.col("t.neg")).cast("int").alias("threat_score"), F.col("t.ip_group").alias("top_attacker_ip"),
            F.struct(*[F.coalesce(s, F.lit(0)).alias(s) for s in SEVERITY_LEVELS]).alias("alerts_by_severity"),
            "attack_types",
        )
    )
    return rows, al


def _store(x) -> str:
    root = scratch_path(x.spark, "incidents")
    rows, al = weekly(x)
    inc.save_incidents({"alerts": al, inc.INCIDENT_TABLE: rows}, root)
    return root


_LISTED = "incident_id, created_at, status, total_events, total_alerts, threat_score, top_attacker_ip"


def _inc(sql: str, *more: str) -> str:
    return with_ctes(sql, "week_ev", "week_al", *more, extra=INCIDENTS)


# Per stored table: rows, and a sum over a column.
_STORED_SUMS = {
    "events": "event_seq", "alerts": "event_seq", "attackers": "threat_score", "attacker_endpoints": "length(endpoint)",
    "attacker_user_agents": "length(user_agent)", "chains": "event_count", "pattern_hits": "length(description)",
    "graph_nodes": "length(id)", "graph_edges": "weight", "attack_types": "count", "files": "events", "incidents": "total_events",
}
_USED = "SELECT DISTINCT ip_group, {0} FROM ev WHERE {0} <> '' AND ip_group IN (SELECT ip_group FROM sus_ip)"
_STORED_SQL = {
    "events": "ev", "alerts": "al", "attackers": "prof", "chains": "chains", "pattern_hits": "hits", "graph_edges": "edges",
    "attacker_endpoints": f"({_USED.format('endpoint')}) t", "attacker_user_agents": f"({_USED.format('user_agent')}) t",
    "graph_nodes": "(SELECT concat('ip_', ip) AS id FROM prof UNION ALL SELECT id FROM ep_nodes UNION ALL SELECT DISTINCT target FROM res) t",
    "attack_types": "(SELECT category, count(*) AS count FROM al GROUP BY 1) t",
    "files": "(SELECT source, count(*) AS events FROM ev GROUP BY 1) t", "incidents": "(SELECT count(*) AS total_events FROM ev) t",
}


@query("sink_incident", with_ctes(" UNION ALL ".join(
    f"SELECT '{t}' AS stored, count(*) AS n, CAST(coalesce(sum({c}), 0) AS BIGINT) AS total FROM {_STORED_SQL[t]}" for t, c in _STORED_SUMS.items()),
    "prof", "chains", "hits", "edges", "ep_nodes", "res", "al", "sus_ip"))
def _(x):
    root = scratch_path(x.spark, "incidents")
    tables = analyze(x.ev, Options(rules=log_rules(), score=ScoreConfig(window_seconds=CHAIN_WINDOW)))
    # stands for the report on files, which these events do not come from
    tables["files"] = x.ev.groupBy("source").agg(F.count(F.lit(1)).alias("events"))
    inc.save_incident(tables, root, "whole log")
    read = [inc.incident_get(x.spark, root, "whole log", t).agg(
        F.lit(t).alias("stored"), F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.expr(c)), F.lit(0)).cast("long").alias("total"))
        for t, c in _STORED_SUMS.items()]
    return reduce(DataFrame.unionByName, read)


_KINDS_SQL = """SELECT incident_id, string_agg(concat(category, ':', n, ':', severity), ', ' ORDER BY f) AS attack_types FROM (
 SELECT incident_id, category, count(*) AS n, arg_min(severity, (phase, ord_major, ord_minor)) AS severity, min((phase, ord_major, ord_minor)) AS f
 FROM week_al GROUP BY 1, 2) k GROUP BY 1"""


@query("incident_list", _inc(
    f"SELECT {_LISTED}, CRITICAL, HIGH, MEDIUM, LOW, coalesce(attack_types, '') AS attack_types FROM incidents LEFT JOIN ({_KINDS_SQL}) k USING (incident_id) ORDER BY created_at DESC"))
def _(x):
    rows = inc.incident_list(inc.read_table(x.spark, _store(x)))
    kind = F.transform("attack_types", lambda t: F.concat_ws(":", t["type"], t["count"].cast("string"), t["severity"]))
    return rows.select(*_LISTED.split(", "), "alerts_by_severity.*", F.array_join(kind, ", ").alias("attack_types"))


@query("incident_get", _inc(f"SELECT {_LISTED}, CRITICAL, HIGH, MEDIUM, LOW FROM incidents WHERE incident_id = '2024-01-15'"))
def _(x):
    row = inc.incident_get(x.spark, _store(x), "2024-01-15")
    return row.select(*_LISTED.split(", "), "alerts_by_severity.*")


@query("incident_delete", _inc("SELECT incident_id, count(*) AS alerts FROM week_al WHERE incident_id <> '2024-01-08' GROUP BY 1"))
def _(x):
    root = _store(x)
    if not inc.incident_delete(x.spark, root, "2024-01-08"):
        raise AssertionError("the incident was stored before")
    return inc.read_table(x.spark, root, "alerts").groupBy("incident_id").agg(F.count(F.lit(1)).alias("alerts"))


@query("incident_count", _inc("SELECT count(*) AS incident_count FROM incidents"))
def _(x):
    return inc.incident_count(inc.read_table(x.spark, _store(x)))


# ---- summary -------------------------------------------------------------------------


@query("incident_summary", with_ctes(
    f"""SELECT total_events, total_alerts, r.threat_score, r.ip AS top_attacker_ip, time_start, time_end, {', '.join(SEVERITY_LEVELS)} FROM
    (SELECT count(*) AS total_events, min(ts) AS time_start, max(ts) AS time_end FROM ev) e, (SELECT count(*) AS total_alerts, {_SEV_SQL} FROM al) a,
    (SELECT ip, threat_score FROM ranked WHERE rnk = 1) r""", "ranked", "al"))
def _(x):
    return re.incident_summary(x.ev, x.al, co.attacker_profile(x.ev, x.al)).select("*", "alerts_by_severity.*").drop("alerts_by_severity")


@query("summary_severity", with_ctes(f"SELECT {_SEV_SQL} FROM al", "al"))
def _(x):
    return re.summary_severity(x.al)


@query("summary_attack_types", with_ctes(
    """SELECT category, count, severity, row_number() OVER (ORDER BY f) AS place FROM (SELECT category, count(*) AS count,
    arg_min(severity, (phase, ord_major, ord_minor)) AS severity, min((phase, ord_major, ord_minor)) AS f FROM al GROUP BY 1) t""", "al"))
def _(x):
    from pyspark.sql import Window

    # one row per category
    return re.summary_attack_types(x.al).withColumn("place", F.row_number().over(Window.orderBy("first"))).drop("first")


@query("top_attacker", with_ctes("SELECT ip, threat_score FROM ranked WHERE rnk = 1", "ranked"))
def _(x):
    return co.top_attacker(co.attacker_profile(x.ev, x.al))


# ---- timeline ------------------------------------------------------------------------

_PLACED = "SELECT *, row_number() OVER (ORDER BY ts, event_seq) AS position FROM ev"


@query("timeline_page", with_ctes(
    f"SELECT position, event_seq, ts, ip, total_pages FROM ({_PLACED}) p, (SELECT CAST(ceil(count(*) / 40.0) AS INT) AS total_pages FROM ev) t WHERE position BETWEEN 81 AND 120", "ev"))
def _(x):
    rows = tl.timeline_rows(x.ev, page=3, page_size=40)
    # one row
    return rows.join(F.broadcast(tl.page_info(x.ev, 3, 40).select("total_pages"))).select("position", "event_seq", "ts", "ip", "total_pages")


@query("timeline_page_deep", with_ctes(f"SELECT position, event_seq, ts, ip FROM ({_PLACED}) p WHERE position BETWEEN 7001 AND 7100", "ev"))
def _(x):
    return tl.timeline_rows(x.ev, page=71, page_size=100, top_k_reach=0).select("position", "event_seq", "ts", "ip")


@query("timeline_alerts", with_ctes(
    "SELECT e.event_seq, e.ts, e.ip, coalesce(a.n, 0) AS alert_count FROM ev e LEFT JOIN (SELECT ip, ts, count(*) AS n FROM al GROUP BY 1, 2) a ON a.ip = e.ip AND a.ts = e.ts", "ev", "al"))
def _(x):
    return tl.timeline_alerts(x.ev, x.al).select("event_seq", "ts", "ip", "alert_count")


@query("timeline_filter", with_ctes("SELECT event_seq, ts, ip, source FROM ev WHERE source = 'auth' AND contains(ip, '203.0')", "ev"))
def _(x):
    return tl.timeline_filter(x.ev, "auth", "203.0").select("event_seq", "ts", "ip", "source")


@query("dash_recent_alerts", with_ctes(
    """SELECT e.event_seq, e.ts, e.ip, a.rule_id, a.severity FROM ev e JOIN (SELECT ip, ts, arg_min(rule_id, rule_ordinal) AS rule_id,
    arg_min(severity, rule_ordinal) AS severity FROM al GROUP BY 1, 2) a ON a.ip = e.ip AND a.ts = e.ts""", "ev", "al"))
def _(x):
    return tl.recent_alerts(tl.timeline_alerts(x.ev, x.al))


# ---- report --------------------------------------------------------------------------


@query("report_attackers", with_ctes(
    f"""SELECT p.ip, p.threat_score, total_requests, alert_count, strftime(first_seen, '%Y-%m-%d %H:%M:%S UTC') AS first_seen, strftime(last_seen, '%Y-%m-%d %H:%M:%S UTC') AS last_seen,
    t.attack_types, coalesce(e.eps, '') AS endpoints FROM prof p
    JOIN (SELECT ip_group, string_agg(category, ', ' ORDER BY f) AS attack_types FROM (SELECT ip_group, category, min((phase, ord_major, ord_minor)) AS f FROM al GROUP BY 1, 2) c GROUP BY 1) t ON t.ip_group = p.ip
    LEFT JOIN (SELECT ip_group, string_agg(endpoint, {q(' | ')} ORDER BY rn) AS eps FROM (
      SELECT *, row_number() OVER (PARTITION BY ip_group ORDER BY f) AS rn FROM (SELECT ip_group, endpoint, min((ts, event_seq)) AS f FROM ev WHERE endpoint <> '' GROUP BY 1, 2) b) c WHERE rn <= 15 GROUP BY 1) e ON e.ip_group = p.ip""", "prof", "al"))
def _(x):
    rows = re.report_attackers(co.attacker_profile(x.ev, x.al), co.attacker_endpoints(x.ev, x.al))
    return rows.withColumn("endpoints", F.coalesce(F.array_join("targeted_endpoints", " | "), F.lit(""))).drop("targeted_endpoints", "score_band")


@query("report_timeline", with_ctes(
    """SELECT CAST(row_number() OVER (ORDER BY event_seq) AS INT) AS row_no, strftime(ts, '%H:%M:%S') AS time, source, ip, method, substr(endpoint, 1, 40) AS endpoint,
    CASE WHEN status_code >= 400 THEN 'error' ELSE 'ok' END AS status_mark, status_code FROM ev ORDER BY event_seq LIMIT 50""", "ev"))
def _(x):
    return re.report_timeline(x.ev)


@query("report_alerts", with_ctes(
    """SELECT row_number() OVER (ORDER BY phase, ord_major, ord_minor) AS row_no, severity, rule_id, category, substr(matched_pattern, 1, 30) AS pattern,
    CASE WHEN ip = '' THEN '—' ELSE ip END AS ip FROM al""", "al"))
def _(x):
    return re.report_alerts(x.al)


@query("report_chains", with_ctes(
    """SELECT ip, chain_no, threat_score, strftime(start_time, '%Y-%m-%d %H:%M:%S UTC') AS start_time, strftime(end_time, '%Y-%m-%d %H:%M:%S UTC') AS end_time,
    CASE WHEN cats IS NOT NULL THEN concat('Attack chain: ', cats) ELSE concat('Suspicious activity chain (', event_count, ' events)') END AS description, event_count, alert_count FROM chains""", "chains"))
def _(x):
    return re.report_chains(ch.attack_chains(x.ev, x.al, CHAIN_WINDOW))


@query("report_evidence", with_ctes(
    """SELECT CAST(row_no AS INT) AS row_no, rule_id, severity, raw_line FROM (SELECT *, row_number() OVER (ORDER BY phase, ord_major, ord_minor) AS row_no FROM al) a WHERE row_no <= 20 AND raw_line <> ''""", "al"))
def _(x):
    return re.report_evidence(x.al)


_ADVICE = ", ".join(f"({', '.join(map(q, row))})" for row in re.CATEGORY_ADVICE)
_GENERAL = ", ".join(f"({', '.join(map(q, row))})" for row in re.GENERAL_ADVICE)


@query("report_recommendations", with_ctes(
    f"""SELECT 1 AS section, ip AS subject, 'Block IP' AS advice, concat('Threat score ', threat_score, '/100 with ', alert_count, ' alerts') AS detail, threat_score, alert_count
    FROM prof WHERE threat_score >= 50
    UNION ALL SELECT 2, category, advice, detail, NULL, NULL FROM (VALUES {_ADVICE}) t(category, advice, detail) WHERE category IN (SELECT category FROM al)
    UNION ALL SELECT 3, 'incident', {', '.join(map(q, re.ESCALATION_ADVICE))}, m, NULL FROM (SELECT max(threat_score) AS m FROM prof) x WHERE m >= 70
    UNION ALL SELECT 4, 'incident', a, d, NULL, NULL FROM (VALUES {_GENERAL}) g(a, d)""", "prof", "al"))
def _(x):
    return re.report_recommendations(co.attacker_profile(x.ev, x.al), x.al)


@query("report_time_format", with_ctes(
    "SELECT event_seq, coalesce(strftime(CASE WHEN k % 10 > 0 THEN ts END, '%Y-%m-%d %H:%M:%S UTC'), 'N/A') AS time FROM ev", "ev"))
def _(x):
    return x.ev.select("event_seq", report_time(F.when(F.col("k") % 10 > 0, F.col("ts"))).alias("time"))


# ---- dashboard -----------------------------------------------------------------------


@query("dash_totals", _inc(
    """SELECT CAST(sum(total_events) AS BIGINT) AS total_events, CAST(sum(total_alerts) AS BIGINT) AS total_alerts, count(*) AS incident_count,
    CAST(floor(avg(threat_score) + 0.5) AS BIGINT) AS avg_score FROM incidents"""))
def _(x):
    return re.dash_totals(weekly(x)[0])


@query("dash_severity_totals", _inc(
    f"""SELECT severity, alert_count, alert_count * 100.0::DOUBLE / greatest(max(alert_count) OVER (), 1) AS share FROM (
    {' UNION ALL '.join(f"SELECT '{s}' AS severity, CAST(sum({s}) AS BIGINT) AS alert_count FROM incidents" for s in SEVERITY_LEVELS)}) t"""))
def _(x):
    return re.dash_severity_totals(weekly(x)[0])


@query("dash_active_threats", _inc("SELECT CAST(sum(CRITICAL) + sum(HIGH) AS BIGINT) AS active_threats FROM incidents"))
def _(x):
    return re.dash_active_threats(weekly(x)[0])


@query("score_band", with_ctes(
    "SELECT ip, CASE WHEN s >= 70 THEN 'red' WHEN s >= 40 THEN 'orange' ELSE 'green' END AS band FROM (SELECT ip, raw_score % 100 AS s FROM score) t", "score"))
def _(x):
    return co.threat_score(x.ev, x.al).select("ip", score_band(F.col("raw_score") % 100).alias("band"))


@query("status_class", with_ctes(
    "SELECT CASE WHEN s >= 500 THEN 'server_error' WHEN s >= 400 THEN 'client_error' WHEN s >= 300 THEN 'redirect' ELSE 'ok' END AS class, count(*) AS n FROM (SELECT status_code + k % 3 * 60 AS s FROM ev) t GROUP BY 1", "ev"))
def _(x):
    return x.ev.groupBy(status_class(F.col("status_code") + F.col("k") % 3 * 60).alias("class")).agg(F.count(F.lit(1)).alias("n"))
