"""SQL building blocks for the checks: the same questions in plain SQL."""

from __future__ import annotations

from querybook.inputs import (
    CHAIN_WINDOW,
    GEO_SQL,
    LINES_SQL,
    LOG_SQL,
    NETWORK_SQL,
    log_rules,
)
from tracehound.operators.rules import RegexRule
from tracehound.schema import SEVERITY_LEVELS, SEVERITY_WEIGHTS


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def tables(sql: str) -> str:
    return sql.replace("{events}", "events").replace("{nation}", "nation")


KEY = ["ts", "ip", "endpoint", "source"]


def weight(col: str, unknown: int = 3) -> str:
    cases = " ".join(f"WHEN '{s}' THEN {w}" for s, w in SEVERITY_WEIGHTS.items())
    return f"CASE {col} {cases} ELSE {unknown} END"


def rank(col: str) -> str:
    cases = " ".join(f"WHEN '{s}' THEN {4 - i}" for i, s in enumerate(SEVERITY_LEVELS))
    return f"CASE {col} {cases} ELSE 0 END"


def unrank(expr: str) -> str:
    cases = " ".join(f"WHEN {4 - i} THEN '{s}'" for i, s in enumerate(SEVERITY_LEVELS))
    return f"CASE WHEN {expr} IS NULL THEN 'LOW' ELSE CASE {expr} {cases} ELSE 'MEDIUM' END END"


def _regex_alerts(rules) -> str:
    parts = []
    for i, r in enumerate(rules, 1):
        if not isinstance(r, RegexRule):
            continue
        hits = ", ".join(f"nullif(regexp_extract({f}, {q(r.regex)}, 0), '')" for f in r.fields)
        parts.append(
            f"SELECT 0 AS phase, {i} AS rule_ordinal, event_seq AS ord_major, CAST({i} AS BIGINT) AS ord_minor, "
            f"{q(r.rule_id)} AS rule_id, {q(r.category)} AS category, {q(r.severity)} AS severity, "
            f"{q(r.description)} AS description, coalesce({hits}) AS matched_pattern, "
            "event_seq, ts, ip, ip_group, endpoint, source, raw_line FROM ev"
        )
    return "SELECT * FROM (" + " UNION ALL ".join(parts) + ") a WHERE matched_pattern IS NOT NULL"


PREDICATES = {
    "BRUTE_FORCE_LOGIN": "(status_code IN (401, 403) OR auth_result IN ('failed', 'pam_failure'))",
    "BRUTE_FORCE_RAPID_REQUESTS": "(contains(lower(endpoint), '/login') OR contains(lower(endpoint), '/admin/login') "
    "OR contains(lower(endpoint), '/auth') OR contains(lower(endpoint), '/signin') OR contains(lower(endpoint), '/api/auth'))",
}


def threshold_alerts(r, ordinal: int, predicate: str | None = None, group: str = "ip") -> str:
    n, w = r.threshold, r.window_seconds
    predicate = predicate or PREDICATES[r.rule_id]
    return f"""SELECT 1 AS phase, {ordinal} AS rule_ordinal, CAST({ordinal} AS BIGINT) AS ord_major, first_seq AS ord_minor,
 {q(r.rule_id)} AS rule_id, {q(r.category)} AS category, {q(r.severity)} AS severity,
 concat({q(r.description)}, ' ({n} events from ', grp, ' in {w}s)') AS description, '{n} events in {w}s window' AS matched_pattern,
 event_seq, ts, ip, ip_group, endpoint, source, raw_line
FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY ts, event_seq) AS rn FROM (
  SELECT *, lag(ts, {n - 1}) OVER (PARTITION BY grp ORDER BY ts, event_seq) AS before,
    min(event_seq) OVER (PARTITION BY grp) AS first_seq
  FROM (SELECT *, coalesce(nullif({group}, ''), 'unknown') AS grp FROM ev WHERE {predicate}) m) w
  WHERE ts - before <= INTERVAL '{w}' SECOND) f WHERE rn = 1"""


def _threshold_all(rules) -> str:
    parts = [threshold_alerts(r, i) for i, r in enumerate(rules, 1) if not isinstance(r, RegexRule)]
    return " UNION ALL ".join(f"({p})" for p in parts)


def bad_ok(endpoint: str = "endpoint") -> str:
    return f"(status_code = 200 AND (contains({endpoint}, '../') OR contains({endpoint}, '/etc/') OR contains({endpoint}, 'UNION')))"


_ON_KEY = " AND ".join(f"s.{c} = a.{c}" for c in KEY)
_RULES = log_rules()

CTES: dict[str, str] = {
    "log": tables(LOG_SQL),
    "lines": tables(LINES_SQL),
    "geo": tables(GEO_SQL),
    "networks": tables(NETWORK_SQL),
    "ev": "SELECT *, url_decode(url_decode(url_decode(endpoint_raw))) AS endpoint, coalesce(nullif(ip, ''), 'unknown') AS ip_group FROM log",
    "al_regex": _regex_alerts(_RULES),
    "al": f"SELECT * FROM al_regex UNION ALL {_threshold_all(_RULES)}",
    "sus_ip": "SELECT DISTINCT ip_group FROM al",
    "ip_al": f"SELECT ip_group, count(*) AS alert_count, CAST(sum({weight('severity')}) AS BIGINT) AS alert_weight FROM al GROUP BY ip_group",
    "stats": f"""SELECT e.ip_group, count(*) AS total_requests, min(ts) AS first_seen, max(ts) AS last_seen, count(DISTINCT source) AS source_count,
 count(*) FILTER (WHERE {bad_ok()}) AS n_success, count(*) FILTER (WHERE status_code = 401) AS n_failed,
 max(ts) FILTER (WHERE status_code = 401) AS last_failed, min(ts) FILTER (WHERE status_code = 200 AND contains(endpoint, 'login')) AS first_login,
 count(*) FILTER (WHERE status_code = 403) AS n_forbidden,
 count(*) FILTER (WHERE status_code = 200 AND (contains(endpoint, '../') OR contains(endpoint, '/etc/'))) AS n_traversal,
 count(*) FILTER (WHERE status_code = 200 AND (contains(endpoint, '/api/users') OR contains(endpoint, '/api/data') OR contains(endpoint, '/export'))) AS n_data,
 count(DISTINCT CASE WHEN endpoint <> '' THEN endpoint END) AS endpoint_count,
 count(DISTINCT CASE WHEN user_agent <> '' THEN user_agent END) AS user_agent_count,
 any_value(alert_count) AS alert_count, any_value(alert_weight) AS alert_weight
 FROM ev e JOIN ip_al USING (ip_group) GROUP BY e.ip_group""",
    "hits": """SELECT ip_group AS ip, 'CORR_CREDENTIAL_STUFFING' AS pattern_id, 'Credential Stuffing' AS name, 'CRITICAL' AS severity,
  concat(n_failed, ' failed logins then successful login') AS description FROM stats WHERE n_failed >= 3 AND first_login > last_failed
 UNION ALL SELECT ip_group, 'CORR_UNAUTHORIZED_ACCESS', 'Unauthorized Access Attempt', 'HIGH',
  concat(n_failed, ' failed logins + ', n_forbidden, ' forbidden accesses') FROM stats WHERE n_failed >= 1 AND n_forbidden >= 1
 UNION ALL SELECT ip_group, 'CORR_SUCCESSFUL_TRAVERSAL', 'Successful Path Traversal', 'CRITICAL',
  concat(n_traversal, ' successful path traversal(s)') FROM stats WHERE n_traversal > 0
 UNION ALL SELECT ip_group, 'CORR_DATA_EXFILTRATION', 'Potential Data Exfiltration', 'CRITICAL',
  concat('Data endpoint accessed after ', alert_count, ' attack alerts') FROM stats WHERE n_data > 0""",
    "score": f"""SELECT s.ip_group AS ip, CAST(alert_weight + (source_count - 1) * 10 + coalesce(h.w, 0) + n_success * 15 AS BIGINT) AS raw_score
 FROM stats s LEFT JOIN (SELECT ip, sum({weight('severity', 5)}) AS w FROM hits GROUP BY ip) h ON h.ip = s.ip_group""",
    "prof": """SELECT s.ip_group AS ip, CAST(least(raw_score, 100) AS INT) AS threat_score, total_requests, alert_count, source_count, endpoint_count,
 user_agent_count, first_seen, last_seen, f.first_seq FROM stats s JOIN score c ON c.ip = s.ip_group
 JOIN (SELECT ip_group, min_by(event_seq, (ts, event_seq)) AS first_seq FROM ev GROUP BY ip_group) f ON f.ip_group = s.ip_group""",
    "ranked": "SELECT *, row_number() OVER (ORDER BY threat_score DESC, first_seen, first_seq) AS rnk FROM prof",
    "keys": f"SELECT DISTINCT {', '.join(KEY)} FROM al",
    "sus": f"""SELECT s.*, a.ts IS NOT NULL AS alerted FROM ev s LEFT JOIN keys a ON {_ON_KEY}
 WHERE s.ip_group IN (SELECT ip_group FROM sus_ip) AND (a.ts IS NOT NULL OR s.status_code IN (401, 403))""",
    "sess": f"""SELECT *, sum(starts) OVER (PARTITION BY ip_group ORDER BY ts, event_seq ROWS UNBOUNDED PRECEDING) AS session FROM (
 SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY ip_group ORDER BY ts, event_seq) <= INTERVAL '{CHAIN_WINDOW}' SECOND THEN 0 ELSE 1 END AS starts FROM sus) x""",
    "chain_no": """SELECT ip_group, session, row_number() OVER (PARTITION BY ip_group ORDER BY session) AS chain_no FROM (
 SELECT ip_group, session FROM sess GROUP BY ip_group, session HAVING count(*) >= 2) x""",
    "chain_ev": "SELECT s.*, c.chain_no FROM sess s JOIN chain_no c USING (ip_group, session)",
    "chain_al": f"""SELECT s.ip_group, s.chain_no, s.ts AS ev_ts, s.event_seq AS ev_seq, a.rule_id, a.category, a.severity, a.event_seq, a.phase, a.ord_major, a.ord_minor
 FROM chain_ev s JOIN al a ON {_ON_KEY}""",
    "chains": f"""SELECT e.ip_group AS ip, e.chain_no, start_time, end_time, event_count, coalesce(alert_count, 0) AS alert_count,
 CAST(least(100, coalesce(w, 0) + (source_count - 1) * 10 + n_success * 15) AS INT) AS threat_score, cats FROM (
 SELECT ip_group, chain_no, min(ts) AS start_time, max(ts) AS end_time, count(*) AS event_count, count(DISTINCT source) AS source_count,
  count(*) FILTER (WHERE {bad_ok()}) AS n_success FROM chain_ev GROUP BY ip_group, chain_no) e
 LEFT JOIN (SELECT ip_group, chain_no, count(*) AS alert_count, sum({weight('severity')}) AS w FROM chain_al GROUP BY ip_group, chain_no) a USING (ip_group, chain_no)
 LEFT JOIN (SELECT ip_group, chain_no, string_agg(category, ' → ' ORDER BY f) AS cats FROM (
   SELECT ip_group, chain_no, category, min((ev_ts, ev_seq, phase, ord_major, ord_minor)) AS f FROM chain_al GROUP BY ip_group, chain_no, category) y
   GROUP BY ip_group, chain_no) c USING (ip_group, chain_no)""",
    "pairs": f"""SELECT e.ip, e.endpoint, e.request_count, e.ok_count, r.rnk, coalesce(a.alert_count, 0) AS alert_count, coalesce(a.severity, 'LOW') AS severity
 FROM (SELECT ip, endpoint, count(*) AS request_count, count(*) FILTER (WHERE status_code = 200) AS ok_count FROM ev WHERE ip <> '' AND endpoint <> '' GROUP BY ip, endpoint) e
 JOIN ranked r ON r.ip = e.ip
 LEFT JOIN (SELECT ip, endpoint, count(*) AS alert_count, {unrank('max(' + rank('severity') + ')')} AS severity FROM al WHERE endpoint <> '' GROUP BY ip, endpoint) a
  ON a.ip = e.ip AND a.endpoint = e.endpoint""",
    "res": """SELECT concat('ep_', endpoint) AS source, concat('res_', coalesce(nullif(string_split(endpoint, '/')[-1], ''), endpoint)) AS target,
 arg_min(ok_count, rnk) AS weight, 'CRITICAL' AS severity FROM pairs WHERE ok_count > 0 AND alert_count > 0 GROUP BY endpoint""",
    "ep_nodes": "SELECT concat('ep_', endpoint) AS id, 'endpoint' AS type, endpoint AS label, arg_min(request_count, rnk) AS request_count, arg_min(severity, rnk) AS severity FROM pairs GROUP BY endpoint",
    "edges": "SELECT concat('ip_', ip) AS source, concat('ep_', endpoint) AS target, request_count AS weight, severity FROM pairs UNION ALL SELECT * FROM res",
    "week_al": "SELECT *, strftime(date_trunc('week', ts), '%Y-%m-%d') AS incident_id FROM al",
    "week_ev": "SELECT *, strftime(date_trunc('week', ts), '%Y-%m-%d') AS incident_id FROM ev",
}

NEEDS: dict[str, list[str]] = {
    "ev": ["log"], "al_regex": ["ev"], "al": ["al_regex", "ev"], "sus_ip": ["al"], "ip_al": ["al"],
    "stats": ["ev", "ip_al"], "hits": ["stats"], "score": ["stats", "hits"], "prof": ["stats", "score", "ev"],
    "ranked": ["prof"], "keys": ["al"], "sus": ["ev", "keys", "sus_ip"], "sess": ["sus"], "chain_no": ["sess"],
    "chain_ev": ["sess", "chain_no"], "chain_al": ["chain_ev", "al"], "chains": ["chain_ev", "chain_al"],
    "pairs": ["ev", "ranked", "al"], "res": ["pairs"], "ep_nodes": ["pairs"], "edges": ["pairs", "res"],
    "week_al": ["al"], "week_ev": ["ev"],
}


def with_ctes(body: str, *names: str, extra: dict[str, str] | None = None) -> str:
    """Query with the named building blocks and all they need in front."""
    order: list[str] = []

    def add(name: str) -> None:
        for need in NEEDS.get(name, []):
            add(need)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    parts = [f"{n} AS MATERIALIZED ({CTES[n]})" for n in order]
    parts += [f"{n} AS MATERIALIZED ({sql})" for n, sql in (extra or {}).items()]
    return f"WITH {', '.join(parts)} {body}" if parts else body
