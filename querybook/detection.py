"""Rules, detection and correlation queries."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from querybook.book import query
from querybook.inputs import CHAIN_WINDOW, log_rules
from querybook.oracle import q, rank, threshold_alerts, unrank, weight, with_ctes
from tracehound.operators import chains as ch
from tracehound.operators import correlate as co
from tracehound.operators import detect as de
from tracehound.operators import graph as gr
from tracehound.operators.rules import RULES, RegexRule, ThresholdRule, rule_stats
from tracehound.operators.scoring import ScoreConfig
from tracehound.runtime import materialize
from tracehound.schema import KEY_COLUMNS, max_severity, with_ip_group

_RULES = log_rules()
_LOGIN, _RAPID = [r for r in _RULES if isinstance(r, ThresholdRule)]
_LOGIN_NO, _RAPID_NO = [i for i, r in enumerate(_RULES, 1) if isinstance(r, ThresholdRule)]

ALERT = "phase, rule_ordinal, ord_major, ord_minor, rule_id, category, severity, description, matched_pattern, event_seq, ts, ip, ip_group, endpoint, source, raw_line"
SHORT = "rule_id, category, severity, description, matched_pattern, event_seq, ts, ip, endpoint, source"


# ---- one key per rule ----------------------------------------------------------------

for _i, _rule in enumerate(_RULES, 1):
    if isinstance(_rule, RegexRule):
        _hits = ", ".join(f"nullif(regexp_extract({f}, {q(_rule.regex)}, 0), '')" for f in _rule.fields)
        _sql = with_ctes(
            f"SELECT * FROM (SELECT event_seq, ip, coalesce({_hits}) AS matched_pattern FROM ev) x WHERE matched_pattern IS NOT NULL",
            "ev",
        )
    else:
        _sql = with_ctes(f"SELECT event_seq, ip, matched_pattern FROM ({threshold_alerts(_rule, _i)}) t", "ev")

    @query(f"rule_{_rule.rule_id.lower()}", _sql)
    def _(x, rule=_rule):
        return de.detect_all(x.ev, [rule]).select("event_seq", "ip", "matched_pattern")


@query("rule_xss_script_tag_pages",
       f"SELECT page_id, regexp_extract(html, {q(RULES[17].regex)}, 0) AS matched_pattern FROM pages WHERE regexp_matches(html, {q(RULES[17].regex)})")
def _(x):
    rule = replace(next(r for r in RULES if r.rule_id == "XSS_SCRIPT_TAG"), fields=("raw_line",))
    pages = x.table("pages").select("page_id", F.col("html").alias("raw_line"))
    return pages.select("page_id", F.expr(de.rule_match(pages, rule)).alias("matched_pattern")).where("matched_pattern is not null")


# ---- detection -----------------------------------------------------------------------


@query("detect_regex", with_ctes(f"SELECT {ALERT} FROM al_regex", "al_regex"))
def _(x):
    return de.detect_regex(x.ev, _RULES)


# A field of the metadata, and a column where the metadata has no such entry.
_FIELD_PATTERN = r"pam_\w+|agent/[35]$"


@query("detect_custom_field_rule", with_ctes(
    f"""SELECT * FROM (SELECT event_seq, coalesce(nullif(regexp_extract(auth_result, '(?i){_FIELD_PATTERN}', 0), ''),
    nullif(regexp_extract(user_agent, '(?i){_FIELD_PATTERN}', 0), '')) AS matched_pattern FROM ev) y WHERE matched_pattern IS NOT NULL""", "ev"))
def _(x):
    rule = RegexRule("CUSTOM", "Custom", "LOW", "metadata rule", _FIELD_PATTERN, fields=("authResult", "user_agent"))
    return de.detect_regex(x.ev, [rule]).select("event_seq", "matched_pattern")


@query("detect_threshold_login", with_ctes(f"SELECT {SHORT} FROM ({threshold_alerts(_LOGIN, _LOGIN_NO)}) t", "ev"))
def _(x):
    return de.detect_threshold(x.ev, _LOGIN, _LOGIN_NO).select(*SHORT.split(", "))


@query("detect_threshold_rapid", with_ctes(f"SELECT {SHORT} FROM ({threshold_alerts(_RAPID, _RAPID_NO)}) t", "ev"))
def _(x):
    return de.detect_threshold(x.ev, _RAPID, _RAPID_NO).select(*SHORT.split(", "))


_GENERIC = ThresholdRule("SCAN", "Recon", "LOW", "Many searches per agent", lambda df: F.contains("endpoint", F.lit("?")),
                         threshold=12, window_seconds=86400, group_by="user_agent")


@query("detect_threshold_generic", with_ctes(
    f"SELECT {SHORT} FROM ({threshold_alerts(_GENERIC, 1, predicate=chr(99) + 'ontains(endpoint, ' + q('?') + ')', group='user_agent')}) t", "ev"))
def _(x):
    return de.detect_threshold(x.ev, _GENERIC).select(*SHORT.split(", "))


@query("threshold_alert_text", with_ctes(
    f"SELECT ip, description, matched_pattern FROM ({threshold_alerts(_LOGIN, _LOGIN_NO)} UNION ALL {threshold_alerts(_RAPID, _RAPID_NO)}) t", "ev"))
def _(x):
    return de.detect_all(x.ev, [_LOGIN, _RAPID]).select("ip", "description", "matched_pattern")


@query("detect_all", with_ctes(f"SELECT {ALERT} FROM al", "al"))
def _(x):
    return de.detect_all(x.ev, _RULES)


@query("alerts_by_event", with_ctes(
    f"SELECT {', '.join(KEY_COLUMNS)}, rule_id, rule_ordinal, count(*) AS alert_count, min(event_seq) AS first_event_seq FROM al_regex GROUP BY ALL", "al_regex"))
def _(x):
    return de.alerts_by_event(de.detect_regex(x.ev, _RULES))


_RULE_ROWS = ", ".join(
    f"({i}, {q(r.rule_id)}, {q(r.category)}, '{'regex' if isinstance(r, RegexRule) else 'threshold'}')" for i, r in enumerate(_RULES, 1))


@query("rule_stats", with_ctes(
    f"""SELECT category, total_rules, regex_rules, threshold_rules, coalesce(alert_count, 0) AS alert_count FROM (
    SELECT category, count(*) AS total_rules, count(*) FILTER (WHERE kind = 'regex') AS regex_rules,
     count(*) FILTER (WHERE kind = 'threshold') AS threshold_rules FROM (VALUES {_RULE_ROWS}) r(n, rule_id, category, kind) GROUP BY category) a
    LEFT JOIN (SELECT category, count(*) AS alert_count FROM al GROUP BY category) b USING (category)""", "al"))
def _(x):
    counts = de.alerts_by_category(x.al)
    return rule_stats(x.spark, _RULES).join(counts, "category", "left").withColumn(
        "alert_count", F.coalesce("alert_count", F.lit(0)))


@query("alerts_by_category", with_ctes("SELECT category, count(*) AS alert_count FROM al GROUP BY category", "al"))
def _(x):
    return de.alerts_by_category(x.al)


@query("alerts_by_severity", with_ctes(
    "SELECT s.severity, count(al.event_seq) AS alert_count FROM (VALUES ('CRITICAL'), ('HIGH'), ('MEDIUM'), ('LOW')) s(severity) LEFT JOIN al USING (severity) GROUP BY 1", "al"))
def _(x):
    return de.alerts_by_severity(x.al)


_CUSTOM = [
    RegexRule("ADMIN_AREA", "Recon", "LOW", "admin area", r"/admin/\w+", fields=("endpoint",)),
    RegexRule("EXPORT", "Exfiltration", "URGENT", "data export", r"/data/(export|dump)", ignore_case=False, fields=("endpoint", "raw_line")),
    replace(_LOGIN, rule_id="LOGINS", threshold=3, window_seconds=86400),
]


@query("custom_rules", with_ctes(
    f"""SELECT rule_id, severity, event_seq, matched_pattern FROM (
    SELECT 'ADMIN_AREA' AS rule_id, 'LOW' AS severity, event_seq, regexp_extract(endpoint, '(?i)/admin/\\w+', 0) AS matched_pattern FROM ev WHERE regexp_matches(endpoint, '(?i)/admin/\\w+')
    UNION ALL SELECT 'EXPORT', 'URGENT', event_seq, coalesce(nullif(regexp_extract(endpoint, '/data/(export|dump)', 0), ''), nullif(regexp_extract(raw_line, '/data/(export|dump)', 0), '')) FROM ev
      WHERE regexp_matches(endpoint, '/data/(export|dump)') OR regexp_matches(raw_line, '/data/(export|dump)')
    UNION ALL SELECT rule_id, severity, event_seq, matched_pattern FROM ({threshold_alerts(_CUSTOM[2], 3, predicate="(status_code IN (401, 403) OR auth_result IN ('failed', 'pam_failure'))")}) t) y""", "ev"))
def _(x):
    return de.detect_all(x.ev, _CUSTOM).select("rule_id", "severity", "event_seq", "matched_pattern")


# ---- correlation ---------------------------------------------------------------------


@query("sort_events", with_ctes("SELECT event_seq, ts, ip FROM ev ORDER BY ts, event_seq", "ev"))
def _(x):
    return co.sort_events(x.ev.select("event_seq", "ts", "ip"))


@query("group_by_ip", with_ctes(
    "SELECT ip_group, count(*) AS event_count, min(ts) AS first_seen, max(ts) AS last_seen FROM ev GROUP BY ip_group", "ev"))
def _(x):
    return co.group_by_ip(x.ev)


@query("alerts_by_ip", with_ctes("SELECT ip_group, alert_count, alert_weight FROM ip_al", "ip_al"))
def _(x):
    return co.alerts_by_ip(x.al)


@query("suspect_ips", with_ctes("SELECT ip_group FROM sus_ip", "sus_ip"))
def _(x):
    return ch.suspect_ips(x.al)


@query("benign_ips", with_ctes("SELECT DISTINCT ip_group FROM ev WHERE ip_group NOT IN (SELECT ip_group FROM sus_ip)", "ev", "sus_ip"))
def _(x):
    return ch.benign_ips(x.ev, x.al)


for _p in co.PATTERNS:
    _key = {"CORR_CREDENTIAL_STUFFING": "pattern_credential_stuffing", "CORR_UNAUTHORIZED_ACCESS": "pattern_unauthorized",
            "CORR_SUCCESSFUL_TRAVERSAL": "pattern_traversal_success", "CORR_DATA_EXFILTRATION": "pattern_exfiltration"}[_p.pattern_id]

    @query(_key, with_ctes(f"SELECT * FROM hits WHERE pattern_id = '{_p.pattern_id}'", "hits"))
    def _(x, p=_p):
        return co.pattern_hits(x.ev, x.al, [p])


@query("pattern_hits", with_ctes("SELECT * FROM hits", "hits"))
def _(x):
    return co.pattern_hits(x.ev, x.al)


@query("suspicious_events", with_ctes("SELECT event_seq, ts, ip, endpoint, status_code FROM sus", "sus"))
def _(x):
    return ch.suspicious_events(x.ev, x.al).select("event_seq", "ts", "ip", "endpoint", "status_code")


_CHAIN_SQL = """SELECT ip, chain_no, start_time, end_time, event_count, alert_count, threat_score,
 CASE WHEN cats IS NOT NULL THEN concat('Attack chain: ', cats) ELSE concat('Suspicious activity chain (', event_count, ' events)') END AS description FROM chains"""


@query("attack_chains", with_ctes(_CHAIN_SQL, "chains"))
def _(x):
    return ch.attack_chains(x.ev, x.al, CHAIN_WINDOW).drop("categories")


@query("chain_events", with_ctes("SELECT ip_group, chain_no, event_seq FROM chain_ev", "chain_ev"))
def _(x):
    return ch.chain_events(x.ev, x.al, CHAIN_WINDOW).select("ip_group", "chain_no", "event_seq")


@query("chain_alerts", with_ctes(
    "SELECT ip_group, chain_no, rule_id, severity, event_seq, count(*) AS times FROM chain_al GROUP BY ALL", "chain_al"))
def _(x):
    return ch.chain_alerts(x.ev, x.al, CHAIN_WINDOW).select("ip_group", "chain_no", "rule_id", "severity", "event_seq", "times")


@query("chain_description", with_ctes(
    f"SELECT description, count(*) AS chains, CAST(sum(event_count) AS BIGINT) AS events FROM ({_CHAIN_SQL}) c GROUP BY description", "chains"))
def _(x):
    return ch.attack_chains(x.ev, x.al, CHAIN_WINDOW).groupBy("description").agg(
        F.count(F.lit(1)).alias("chains"), F.sum("event_count").alias("events"))


@query("chain_window_override", with_ctes(
    """SELECT ip_group AS ip, start_time, end_time, event_count FROM (
    SELECT ip_group, session, min(ts) AS start_time, max(ts) AS end_time, count(*) AS event_count FROM (
    SELECT *, sum(starts) OVER (PARTITION BY ip_group ORDER BY ts, event_seq ROWS UNBOUNDED PRECEDING) AS session FROM (
    SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY ip_group ORDER BY ts, event_seq) <= INTERVAL '3600' SECOND THEN 0 ELSE 1 END AS starts FROM sus) x) y
    GROUP BY ip_group, session) z WHERE event_count >= 3""", "sus"))
def _(x):
    return ch.attack_chains(x.ev, x.al, 3600, min_events=3).select("ip", "start_time", "end_time", "event_count")


_PROFILE = "ip, threat_score, total_requests, alert_count, source_count, endpoint_count, user_agent_count, first_seen, last_seen"


@query("attacker_profile", with_ctes(
    f"""SELECT {_PROFILE}, attack_types FROM prof JOIN (SELECT ip_group, string_agg(category, ',' ORDER BY f) AS attack_types FROM (
    SELECT ip_group, category, min((phase, ord_major, ord_minor)) AS f FROM al GROUP BY ip_group, category) t GROUP BY ip_group) a ON a.ip_group = prof.ip""", "prof", "al"))
def _(x):
    return co.attacker_profile(x.ev, x.al).select(
        *_PROFILE.split(", "), F.array_join("attack_types", ",").alias("attack_types"))


@query("attacker_endpoints", with_ctes(
    "SELECT ip_group AS ip, endpoint, count(*) AS request_count, min(ts) AS first_ts, min_by(event_seq, (ts, event_seq)) AS first_seq FROM ev WHERE endpoint <> '' AND ip_group IN (SELECT ip_group FROM sus_ip) GROUP BY ALL", "ev", "sus_ip"))
def _(x):
    return co.attacker_endpoints(x.ev, x.al)


@query("attacker_user_agents", with_ctes(
    "SELECT ip_group AS ip, user_agent, min(ts) AS first_ts, min_by(event_seq, (ts, event_seq)) AS first_seq FROM ev WHERE user_agent <> '' AND ip_group IN (SELECT ip_group FROM sus_ip) GROUP BY ALL", "ev", "sus_ip"))
def _(x):
    return co.attacker_user_agents(x.ev, x.al)


@query("threat_score", with_ctes("SELECT ip, raw_score, CAST(least(raw_score, 100) AS INT) AS threat_score FROM score", "score"))
def _(x):
    return co.threat_score(x.ev, x.al)


@query("threat_score_weights", with_ctes(
    f"""SELECT s.ip_group AS ip, CAST(least(2000, alert_weight + (source_count - 1) * 25 + coalesce(h.w, 0) + n_success * 5) AS INT) AS threat_score
    FROM stats s LEFT JOIN (SELECT ip, sum({weight('severity', 5)}) AS w FROM hits GROUP BY ip) h ON h.ip = s.ip_group""", "stats", "hits"))
def _(x):
    config = ScoreConfig(max_score=2000, source_bonus=25, success_bonus=5)
    return co.threat_score(x.ev, x.al, config).select("ip", "threat_score")


@query("rank_attackers", with_ctes("SELECT ip, threat_score, first_seen FROM ranked ORDER BY rnk", "ranked"))
def _(x):
    return co.rank_attackers(co.attacker_profile(x.ev, x.al)).select("ip", "threat_score", "first_seen")


@query("graph_attacker_nodes", with_ctes("SELECT concat('ip_', ip) AS id, 'attacker' AS type, ip AS label, threat_score FROM prof", "prof"))
def _(x):
    return gr.attacker_nodes(co.attacker_profile(x.ev, x.al)).drop("geo")


def _pairs(x):
    return gr.contacts(co.attacker_profile(x.ev, x.al), x.ev, x.al)


@query("graph_endpoint_nodes", with_ctes("SELECT id, type, label, request_count, severity FROM ep_nodes", "ep_nodes"))
def _(x):
    return gr.endpoint_nodes(_pairs(x))


@query("graph_attacker_edges", with_ctes(
    "SELECT concat('ip_', ip) AS source, concat('ep_', endpoint) AS target, request_count AS weight, severity FROM pairs", "pairs"))
def _(x):
    return gr.attacker_edges(_pairs(x))


@query("graph_resources", with_ctes("SELECT * FROM res", "res"))
def _(x):
    return gr.resource_edges(_pairs(x))


@query("graph_filter", with_ctes(
    "SELECT source, target, weight, severity FROM edges WHERE source LIKE 'ip_%' AND target LIKE 'ep_%'", "edges"))
def _(x):
    nodes, edges = gr.blast_radius(materialize(co.attacker_profile(x.ev, x.al)), x.ev, x.al)
    return gr.graph_filter(nodes, edges, ["attacker", "endpoint"])[1]


@query("max_severity", with_ctes(
    f"""SELECT e.ip_group, {unrank('a.r')} AS severity FROM (SELECT DISTINCT ip_group FROM ev) e
    LEFT JOIN (SELECT ip_group, max({rank('severity')}) AS r FROM al GROUP BY ip_group) a USING (ip_group)""", "ev", "al"))
def _(x):
    worst = x.al.groupBy("ip_group").agg(max_severity(F.col("severity")).alias("severity"))
    return with_ip_group(x.ev).select("ip_group").distinct().join(worst, "ip_group", "left").withColumn(
        "severity", F.coalesce("severity", F.lit("LOW")))

