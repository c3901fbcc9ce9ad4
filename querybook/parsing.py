"""Sources, parsers, decoders and format detection."""

from __future__ import annotations

from pyspark.sql import functions as F

from querybook.book import query
from querybook.inputs import JSON_LINE, MIXED_LINE, REF_NOW
from querybook.oracle import with_ctes
from tracehound.functions import decode as d
from tracehound.functions.labels import EVENT_JSON_FIELDS, event_json
from tracehound.operators import formats as fo
from tracehound.operators import parse_auth as pa
from tracehound.operators import parse_json as pj
from tracehound.operators import parse_web as pw
from tracehound.runtime import scratch_path
from tracehound.sources.json_layouts import json_documents, scan_json_events
from tracehound.sources.lines import file_catalog, scan_log_lines


def _now():
    return F.lit(REF_NOW).cast("timestamp")


# ---- decoders ------------------------------------------------------------------------


def sql_base64(x: str) -> str:
    """Tokens that cover the text; runs that decode to mostly printable text are replaced."""
    body = "rtrim(t, '=')"
    usable = f"substr({body}, 1, length({body}) - CASE WHEN length({body}) % 4 = 1 THEN 1 ELSE 0 END)"
    padded = f"rpad({usable}, CAST(ceil(length({usable}) / 4.0) * 4 AS INT), '=')"
    text = f"TRY(decode(from_base64({padded})))"
    printable = f"length(regexp_replace({text}, '[^\\x20-\\x7E]', '', 'g'))"
    ok = f"length({body}) >= 8 AND length(t) - length({body}) <= 2 AND {text} IS NOT NULL AND length({text}) > 2 AND {printable} > length({text}) * 0.8"
    return (
        f"array_to_string(list_transform(regexp_extract_all({x}, '[A-Za-z0-9+/]+=*|[^A-Za-z0-9+/]+'), "
        f"lambda t: CASE WHEN regexp_matches(t, '^[A-Za-z0-9+/]') AND {ok} THEN {text} ELSE t END), '')"
    )


def _sql_codes(x: str, token: str, digits: str, base: str) -> str:
    number = f"CAST(concat('0x', {digits}) AS INT)" if base == "hex" else f"CAST({digits} AS INT)"
    return (
        f"array_to_string(list_transform(regexp_extract_all({x}, '(?s){token}|.'), "
        f"lambda t: CASE WHEN regexp_full_match(t, '{token}') THEN chr({number}) ELSE t END), '')"
    )


def sql_unicode(x: str) -> str:
    wide = _sql_codes(x, r"\\u[0-9A-Fa-f]{4}", "substr(t, 3)", "hex")
    return _sql_codes(wide, r"\\x[0-9A-Fa-f]{2}", "substr(t, 3)", "hex")


def sql_html(x: str) -> str:
    for name, char in d.NAMED_ENTITIES:
        x = f"replace({x}, '{name}', {chr(39) * 4 if char == chr(39) else chr(39) + char + chr(39)})"
    x = _sql_codes(x, "&#x[0-9A-Fa-f]+;", "regexp_extract(t, '[0-9A-Fa-f]+', 0)", "hex")
    return _sql_codes(x, "&#[0-9]+;", "regexp_extract(t, '[0-9]+', 0)", "dec")


_URL = "url_decode(url_decode(url_decode({})))"


@query("decode_url_iter", with_ctes(f"SELECT event_seq, {_URL.format('endpoint_raw')} AS decoded FROM log", "log"))
def _(x):
    return x.log.select("event_seq", d.decode_url_iter(F.col("endpoint_raw")).alias("decoded"))


@query("decode_base64_segments", with_ctes(f"SELECT event_seq, {sql_base64('endpoint_raw')} AS decoded FROM log", "log"))
def _(x):
    return x.log.select("event_seq", d.decode_base64_segments(F.col("endpoint_raw")).alias("decoded"))


# Angle brackets as \u escapes, the letter e as \x escape.
_ESCAPED = "replace(replace(endpoint_text, '<', concat(chr(92), 'u003c')), 'e', concat(chr(92), 'x65'))"


@query("decode_unicode_escapes", with_ctes(f"SELECT event_seq, {sql_unicode(_ESCAPED)} AS decoded FROM log", "log"))
def _(x):
    return x.log.select("event_seq", d.decode_unicode_escapes(F.expr(_ESCAPED)).alias("decoded"))


@query("decode_html_entities", f"SELECT page_id, md5({sql_html('html')}) AS decoded_md5, length({sql_html('html')}) AS decoded_length FROM pages")
def _(x):
    decoded = x.table("pages").select("page_id", d.decode_html_entities(F.col("html")).alias("t"))
    return decoded.select("page_id", F.md5("t").alias("decoded_md5"), F.length("t").alias("decoded_length"))


_STEPS = {
    "s1": f"SELECT event_seq, endpoint_raw, {_URL.format('endpoint_raw')} AS t FROM log",
    "s2": f"SELECT event_seq, endpoint_raw, {sql_base64('t')} AS u FROM s1",
    "s3": f"SELECT event_seq, endpoint_raw, {sql_unicode('u')} AS t FROM s2",
    "s4": f"SELECT event_seq, endpoint_raw, {sql_html('t')} AS decoded FROM s3",
}


@query("deobfuscate", with_ctes("SELECT event_seq, decoded FROM s4", "log", extra=_STEPS))
def _(x):
    return x.log.select("event_seq", d.deobfuscate(F.col("endpoint_raw")).alias("decoded"))


@query("deobfuscate_changed", with_ctes(
    "SELECT endpoint_raw AS original, decoded, endpoint_raw <> decoded AS changed, count(*) AS n FROM s4 GROUP BY ALL", "log", extra=_STEPS))
def _(x):
    pairs = x.log.select(F.col("endpoint_raw").alias("original"), d.deobfuscate(F.col("endpoint_raw")).alias("decoded"))
    return pairs.withColumn("changed", F.col("original") != F.col("decoded")).groupBy(
        "original", "decoded", "changed").agg(F.count(F.lit(1)).alias("n"))


@query("add_transform", with_ctes(
    f"SELECT event_seq, upper({_URL.format('replace(endpoint_raw, chr(63), chr(38))')}) AS decoded FROM log", "log"))
def _(x):
    steps = d.add_transform((d.decode_url_iter,), lambda c: F.replace(c, F.lit("?"), F.lit("&")), 0)
    steps = d.add_transform(steps, F.upper)
    return x.log.select("event_seq", d.deobfuscate(F.col("endpoint_raw"), steps).alias("decoded"))


# ---- web access lines ----------------------------------------------------------------

# Lines with a blank inside the request do not match the format.
_WEB_OK = "NOT (k >= 50 AND endpoint_text LIKE '% %')"
_WEB_ENDPOINT = "CASE WHEN k >= 50 THEN endpoint_text ELSE endpoint_raw END"
_WEB_IP = "CASE WHEN ip = '' THEN '-' ELSE ip END"


@query("parse_web_access", with_ctes(
    f"""SELECT event_seq, ts, 'nginx' AS source, {_WEB_IP} AS ip, method, {sql_html(sql_base64(_URL.format(_WEB_ENDPOINT)))} AS endpoint,
    status_code, user_agent, line_number FROM lines WHERE {_WEB_OK}""", "lines"))
def _(x):
    return pw.parse_web_access(x.lines("web_line")).select(
        "event_seq", "ts", "source", "ip", "method", "endpoint", "status_code", "user_agent", "line_number")


@query("parse_web_derived", with_ctes(
    f"""SELECT event_seq, CASE WHEN status_code >= 400 THEN 'warn' ELSE 'info' END AS log_level, CASE WHEN k % 4 = 0 THEN '' ELSE concat('u', k) END AS user,
    CASE WHEN k % 3 = 0 THEN '' ELSE 'http://x/' END AS referer, {_WEB_ENDPOINT} AS raw_endpoint, CAST(k * 10 AS VARCHAR) AS body_bytes FROM lines WHERE {_WEB_OK}""", "lines"))
def _(x):
    return pw.web_derived(pw.web_fields(x.lines("web_line")), steps=()).selectExpr(
        "event_seq", "log_level", "user", "metadata['referer'] as referer",
        "metadata['rawEndpoint'] as raw_endpoint", "metadata['bodyBytes'] as body_bytes")


@query("parse_ts_web", with_ctes(f"SELECT event_seq, ts FROM lines WHERE {_WEB_OK}", "lines"))
def _(x):
    return pw.web_fields(x.lines("web_line")).select("event_seq", pw.parse_ts_web(F.col("time_text")).alias("ts"))


# ---- authentication lines ------------------------------------------------------------

_PAST = f"CASE WHEN ts > TIMESTAMP '{REF_NOW}' THEN ts - INTERVAL 1 YEAR ELSE ts END"
_SERVICE = "CASE WHEN k % 2 = 0 THEN 'sshd' ELSE 'sudo' END"


@query("parse_auth_syslog", with_ctes(
    f"""SELECT event_seq, {_PAST} AS ts, concat('host', k % 3) AS hostname, {_SERVICE} AS service,
    CASE WHEN k % 2 = 0 THEN CAST(k + 100 AS VARCHAR) END AS pid, regexp_extract(auth_line, ': (.*)$', 1) AS message FROM lines""", "lines"))
def _(x):
    return pa.parse_auth_syslog(x.lines("auth_line"), _now()).selectExpr(
        "event_seq", "ts", "metadata['hostname'] as hostname", "metadata['service'] as service",
        "metadata['pid'] as pid", "metadata['message'] as message")


@query("parse_auth_message", with_ctes(
    """SELECT event_seq, CASE WHEN k % 10 IN (5, 6, 7, 9) THEN '' ELSE addr END AS ip, CASE WHEN k % 10 = 9 THEN '' ELSE concat('u', k) END AS user,
    CASE k % 10 WHEN 5 THEN 'SUDO' WHEN 6 THEN 'SESSION' WHEN 7 THEN 'SESSION' WHEN 9 THEN '' ELSE 'AUTH' END AS method,
    CASE k % 10 WHEN 5 THEN concat('/bin/cat /etc/shadow ', k) WHEN 6 THEN '/session/open' WHEN 7 THEN '/session/close' WHEN 9 THEN '' ELSE '/login' END AS endpoint,
    CASE k % 10 WHEN 0 THEN 401 WHEN 1 THEN 200 WHEN 2 THEN 200 WHEN 3 THEN 429 WHEN 4 THEN 403 WHEN 6 THEN 200 WHEN 7 THEN 200 WHEN 8 THEN 401 END AS status_code,
    CASE k % 10 WHEN 0 THEN 'warn' WHEN 3 THEN 'error' WHEN 4 THEN 'warn' WHEN 5 THEN 'warn' WHEN 8 THEN 'warn' ELSE 'info' END AS log_level,
    CASE k % 10 WHEN 0 THEN 'failed' WHEN 1 THEN 'success' WHEN 2 THEN 'success' WHEN 3 THEN 'max_attempts' WHEN 4 THEN 'disconnected' WHEN 8 THEN 'pam_failure' END AS auth_result,
    CASE k % 10 WHEN 1 THEN 'password' WHEN 2 THEN 'publickey' END AS auth_method, CASE WHEN k % 10 <= 3 THEN CAST(k AS VARCHAR) END AS port,
    CASE k % 10 WHEN 6 THEN 'opened' WHEN 7 THEN 'closed' END AS session_action, CASE WHEN k % 10 = 5 THEN 'root' END AS target_user,
    CASE WHEN k % 10 = 9 THEN concat('Received signal ', k) END AS raw_message FROM lines""", "lines"))
def _(x):
    m = "metadata['{}'] as {}"
    return pa.parse_auth_syslog(x.lines("auth_line"), _now()).selectExpr(
        "event_seq", "ip", "user", "method", "endpoint", "status_code", "log_level",
        *[m.format(*p) for p in (("authResult", "auth_result"), ("authMethod", "auth_method"), ("port", "port"),
                                 ("sessionAction", "session_action"), ("targetUser", "target_user"), ("rawMessage", "raw_message"))])


@query("parse_ts_syslog", with_ctes(f"SELECT event_seq, {_PAST} AS ts FROM lines", "lines"))
def _(x):
    f = pa.syslog_fields(x.lines("auth_line"))
    clock = F.concat_ws(":", "hh", "mm", "ss")
    return f.select("event_seq", pa.parse_ts_syslog(F.col("month"), F.col("day"), clock, _now()).alias("ts"))


# ---- JSON lines ----------------------------------------------------------------------

_JSON_OK = "event_seq % 11 <> 10"
_LEVEL = "CASE k % 6 WHEN 0 THEN 'error' WHEN 1 THEN 'warn' WHEN 2 THEN 'debug' WHEN 4 THEN 'error' ELSE 'info' END"
_STATUS = "CASE WHEN k % 7 IN (0, 1) THEN NULL ELSE status_code END"


def _objects(x):
    lines = x.lines("json_line")
    return pj.json_fields(lines.withColumn("obj", pj.json_object(F.col("line"))).where("obj is not null"))


@query("parse_json_fields", with_ctes(
    f"""SELECT event_seq, ts, ip, upper(method) AS method, {sql_html(sql_base64(_URL.format('endpoint_raw')))} AS endpoint, {_STATUS} AS status_code, {_LEVEL} AS log_level,
    concat('u', k) AS user, concat('m', k) AS message FROM lines WHERE {_JSON_OK}""", "lines"))
def _(x):
    return pj.parse_json(x.lines("json_line"), _now()).selectExpr(
        "event_seq", "ts", "ip", "method", "endpoint", "status_code", "log_level", "user", "metadata['message'] as message")


@query("parse_json_metadata", with_ctes(
    f"""SELECT event_seq, CAST(k AS VARCHAR) AS extra, concat('m', k) AS message, CASE WHEN endpoint_raw <> e THEN endpoint_raw END AS raw_endpoint,
    CASE WHEN endpoint_raw <> e THEN 3 ELSE 2 END AS entries FROM (SELECT *, {sql_html(sql_base64(_URL.format('endpoint_raw')))} AS e FROM lines) l WHERE {_JSON_OK}""", "lines"))
def _(x):
    return pj.parse_json(x.lines("json_line"), _now()).selectExpr(
        "event_seq", "metadata['extra'] as extra", "metadata['message'] as message",
        "metadata['rawEndpoint'] as raw_endpoint", "size(metadata) as entries")


@query("normalize_level", with_ctes(f"SELECT {_LEVEL} AS log_level, count(*) AS n FROM lines WHERE {_JSON_OK} GROUP BY 1", "lines"))
def _(x):
    return _objects(x).groupBy(pj.normalize_level(F.col("f_level")).alias("log_level")).agg(F.count(F.lit(1)).alias("n"))


@query("normalize_method_status", with_ctes(
    f"SELECT upper(method) AS method, {_STATUS} AS status_code, count(*) AS n FROM lines WHERE {_JSON_OK} GROUP BY ALL", "lines"))
def _(x):
    return _objects(x).groupBy(
        pj.normalize_method(F.col("f_method")).alias("method"), pj.normalize_status(F.col("f_status")).alias("status_code")
    ).agg(F.count(F.lit(1)).alias("n"))


@query("parse_ts_iso", with_ctes(f"SELECT event_seq, ts, ts AS from_millis FROM lines WHERE {_JSON_OK}", "lines"))
def _(x):
    millis = F.unix_millis(F.col("f_timestamp").cast("timestamp")).cast("string")
    return _objects(x).select("event_seq", pj.parse_ts_iso(F.col("f_timestamp"), _now()).alias("ts"),
                              pj.parse_ts_iso(millis, _now()).alias("from_millis"))


# ---- events --------------------------------------------------------------------------


@query("event_key", with_ctes("SELECT ts, ip, endpoint, source, count(*) AS n FROM ev GROUP BY ALL", "ev"))
def _(x):
    return x.ev.groupBy("ts", "ip", "endpoint", "source").agg(F.count(F.lit(1)).alias("n"))


_WEB_DECODED = sql_html(sql_base64(_URL.format(_WEB_ENDPOINT)))


@query("events_to_json", with_ctes(
    f"""SELECT event_seq, to_json({{'timestamp': strftime(ts, '%Y-%m-%dT%H:%M:%S.000Z'), 'source': 'nginx', 'sourceFile': source_file, 'ip': {_WEB_IP}, 'method': method,
    'endpoint': {_WEB_DECODED}, 'statusCode': status_code, 'logLevel': CASE WHEN status_code >= 400 THEN 'warn' ELSE 'info' END, 'userAgent': user_agent,
    'user': CASE WHEN k % 4 = 0 THEN '' ELSE concat('u', k) END, 'rawLine': web_line, 'lineNumber': line_number,
    'metadata': {{'bodyBytes': CAST(k * 10 AS VARCHAR), 'referer': CASE WHEN k % 3 = 0 THEN '' ELSE 'http://x/' END, 'rawEndpoint': {_WEB_ENDPOINT}}}}})::VARCHAR AS event_json
    FROM lines WHERE {_WEB_OK}
    UNION ALL SELECT event_seq, to_json({{'timestamp': strftime(ts, '%Y-%m-%dT%H:%M:%S.000Z'), 'source': 'none', 'statusCode': NULL, 'metadata': NULL}})::VARCHAR FROM lines WHERE k = 7""", "lines"))
def _(x):
    web = pw.parse_web_access(x.lines("web_line")).select("event_seq", event_json().alias("event_json"))
    # an event that has little more than a time
    bare = x.lines_wide.where("k = 7").select("event_seq", "ts", F.lit("none").alias("source"), *[
        F.lit(None).cast(t).alias(c) for c, t in (("status_code", "int"), ("metadata", "map<string,string>"))])
    kept = [(n, c) for n, c in EVENT_JSON_FIELDS if c in bare.columns]
    return web.unionByName(bare.select("event_seq", event_json(kept).alias("event_json")))


# ---- formats -------------------------------------------------------------------------

# Confidence of a file of each kind, from its first ten lines.
_SAMPLE = f"SELECT *, row_number() OVER (PARTITION BY source_file ORDER BY line_number) AS rn, {_WEB_OK} AND (file_kind = 0 OR (file_kind = 3 AND k < 20)) AS is_web FROM lines"
_DETECT = f"""SELECT source_file, file_kind, CASE WHEN file_kind = 1 THEN 100 WHEN file_kind = 2 THEN 80
  ELSE CAST(floor(100.0 * count(*) FILTER (WHERE is_web) / count(*) + 0.5) AS INT) END AS conf FROM ({_SAMPLE}) s WHERE rn <= 10 GROUP BY source_file, file_kind"""
_KIND = "CASE file_kind WHEN 0 THEN 'nginx' WHEN 1 THEN 'auth' WHEN 2 THEN 'json' ELSE 'nginx' END"


def _mixed(x):
    return x.lines(MIXED_LINE)


@query("detect_format", with_ctes(
    f"SELECT source_file, CASE WHEN conf >= 50 THEN {_KIND} END AS format, conf AS confidence FROM det", "lines", extra={"det": _DETECT}))
def _(x):
    return fo.detect_format(_mixed(x)).drop("error")


_EVENTS_SQL = f"""SELECT l.event_seq, l.source_file, {_KIND} AS format FROM lines l JOIN det d ON d.source_file = l.source_file AND d.conf >= 50
  WHERE CASE l.file_kind WHEN 0 THEN {_WEB_OK} WHEN 1 THEN true WHEN 2 THEN {_JSON_OK} ELSE k < 20 AND {_WEB_OK} END"""
_EVENTS_SQL = _EVENTS_SQL.replace("CASE file_kind", "CASE l.file_kind")


def _routed(x):
    options = {"auth": {"ref_now": _now()}, "json": {"now": _now()}}
    return fo.route_by_format(_mixed(x), options=options)


@query("route_by_format", with_ctes(
    f"SELECT event_seq, source_file, CASE format WHEN 'json' THEN 'app' ELSE format END AS source FROM ({_EVENTS_SQL}) e", "lines", extra={"det": _DETECT}))
def _(x):
    return _routed(x).select("event_seq", "source_file", "source")


@query("file_parse_report", with_ctes(
    f"""SELECT d.source_file AS filename, CASE WHEN conf >= 50 THEN {_KIND} END AS format, CASE WHEN conf >= 50 THEN conf END AS confidence, coalesce(n, 0) AS events,
    CASE WHEN conf < 50 THEN concat('Could not auto-detect log format. Best guess: ', CASE WHEN conf > 0 THEN 'nginx' ELSE 'none' END, ' (confidence: ', conf,
     '%). Minimum required: 50%. Supported formats: nginx, auth, json') END AS error
    FROM det d LEFT JOIN (SELECT source_file, count(*) AS n FROM ({_EVENTS_SQL}) e GROUP BY 1) c USING (source_file)""", "lines", extra={"det": _DETECT}))
def _(x):
    return fo.file_parse_report(fo.detect_format(_mixed(x)), _routed(x)).drop("source_file")


@query("scan_multi_source_union", with_ctes(
    f"""SELECT 'nginx' AS source, count(*) AS events, min(event_seq) AS first_seq FROM lines WHERE {_WEB_OK}
    UNION ALL SELECT 'auth', count(*), min(event_seq) FROM lines UNION ALL SELECT 'app', count(*), min(event_seq) FROM lines WHERE {_JSON_OK}""", "lines"))
def _(x):
    union = (
        pw.parse_web_access(x.lines("web_line"))
        .unionByName(pa.parse_auth_syslog(x.lines("auth_line"), _now()))
        .unionByName(pj.parse_json(x.lines("json_line"), _now()))
    )
    return union.groupBy("source").agg(F.count(F.lit(1)).alias("events"), F.min("event_seq").alias("first_seq"))


# Scores of the registered format beside those of the known ones; on a tie the known one stays.
_DETECT_OWN = f"""SELECT *, CASE WHEN fconf > conf THEN 'free' ELSE {_KIND} END AS best, greatest(fconf, conf) AS top FROM (
  SELECT d.*, f.fconf FROM det d JOIN (
    SELECT source_file, CAST(floor(100.0 * count(*) FILTER (WHERE file_kind = 3 AND k >= 20) / count(*) + 0.5) AS INT) AS fconf
    FROM ({_SAMPLE}) s WHERE rn <= 10 GROUP BY source_file) f USING (source_file)) c"""


@query("register_format", with_ctes(
    f"""SELECT o.source_file, CASE WHEN top >= 50 THEN best END AS format, top AS confidence, coalesce(events, 0) AS events FROM own o LEFT JOIN (
      SELECT l.source_file, count(*) AS events FROM lines l JOIN own o ON o.source_file = l.source_file AND o.top >= 50
      WHERE CASE o.best WHEN 'free' THEN k >= 20 WHEN 'auth' THEN true WHEN 'json' THEN {_JSON_OK} ELSE {_WEB_OK} AND (l.file_kind = 0 OR k < 20) END GROUP BY 1) e USING (source_file)
    UNION ALL SELECT 'forced', 'free', NULL, count(*) FROM lines WHERE file_kind = 3 AND k >= 20""", "lines", extra={"det": _DETECT, "own": _DETECT_OWN}))
def _(x):
    def free_events(lines):
        return pw.web_derived(lines.where("line like 'free text %'").selectExpr(
            "*", "'' as ip", "'-' as remote_user", "cast(null as string) as time_text", "'' as method", "line as raw_endpoint",
            "'0' as status_text", "'0' as bytes_text", "'-' as referer", "'' as user_agent"), steps=()).withColumn("source", F.lit("free"))

    own = fo.register_format(fo.FORMATS, "free", lambda line: F.startswith(line, F.lit("free text")), free_events)
    lines = _mixed(x)
    found = fo.detect_format(lines, own)
    options = {"auth": {"ref_now": _now()}, "json": {"now": _now()}}
    events = fo.parse_auto(lines, None, own, options, found).groupBy("source_file").agg(F.count(F.lit(1)).alias("events"))
    forced = fo.parse_auto(lines, "free", own).agg(F.count(F.lit(1)).alias("events")).select(
        F.lit("forced").alias("source_file"), F.lit("free").alias("format"), F.lit(None).cast("int").alias("confidence"), "events")
    routed = found.join(events, "source_file", "left").select("source_file", "format", "confidence", F.coalesce("events", F.lit(0)).alias("events"))
    return routed.unionByName(forced)


# ---- files ---------------------------------------------------------------------------


def _written(x, column: str, name: str) -> str:
    """The derived lines as text files in the shared folder."""
    path = scratch_path(x.spark, name)
    x.lines_wide.select("file_kind", F.expr(column).alias("value")).write.partitionBy("file_kind").text(path)
    return path


@query("scan_log_lines", with_ctes(
    f"SELECT trim({MIXED_LINE}) AS line, count(*) AS n, true AS numbered, true AS ordered FROM lines GROUP BY 1", "lines"))
def _(x):
    path = _written(x, MIXED_LINE, "lines")
    lines = scan_log_lines(x.spark, f"{path}/*")
    # a file of the query has at most a part of some thousand lines
    files = lines.groupBy("source_file").agg(
        (F.count_distinct("line_number") == F.max("line_number")).alias("numbered"),
        F.array_join(F.array_sort(F.collect_list(F.struct("line_number", "line")))["line"], "\n").alias("joined"),
        F.array_join(F.array_sort(F.collect_list(F.struct("event_seq", "line")))["line"], "\n").alias("by_seq"))
    whole = x.spark.read.text(f"{path}/*", wholetext=True).select(F.col("_metadata.file_path").alias("source_file"), "value")
    files = files.join(whole, "source_file").select(
        "source_file", "numbered", ((F.col("joined") == F.rtrim(F.regexp_replace("value", r"\s+$", ""))) & (F.col("joined") == F.col("by_seq"))).alias("ordered"))
    return lines.join(files, "source_file").groupBy("line").agg(
        F.count(F.lit(1)).alias("n"), F.every("numbered").alias("numbered"), F.every("ordered").alias("ordered"))


@query("file_catalog", with_ctes(
    f"""SELECT sum(bytes) AS size_bytes, sum(n) AS lines, true AS previewed, true AS sized FROM (
    SELECT CAST(sum(strlen({MIXED_LINE}) + 1) AS BIGINT) AS bytes, count(*) AS n FROM lines) f""", "lines"))
def _(x):
    path = _written(x, MIXED_LINE, "catalog")
    # refused whatever they hold
    x.lines_wide.select(F.col("web_line").alias("value")).write.option("compression", "gzip").text(f"{path}/file_kind=9")
    # a preview begins like the file, a size reads like the bytes
    whole = x.spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("source_file"), F.concat(F.substring("value", 1, 200), F.lit("...")).alias("begin"))
    units = F.when(F.col("size_bytes") < 1024**2, F.format_string("%.1f KB", F.col("size_bytes") / 1024)).otherwise(
        F.format_string("%.1f MB", F.col("size_bytes") / 1024**2))
    return file_catalog(x.spark, f"{path}/*").join(whole, "source_file").agg(
        F.sum("size_bytes").alias("size_bytes"), F.sum("lines").alias("lines"),
        F.every(F.col("preview") == F.col("begin")).alias("previewed"), F.every(F.col("size_human") == units).alias("sized"))


# By kind of file: objects one per line; below a banner, over several lines or two on one;
# an array over many lines; an array on one line. Every object has quotes and braces in a string.
_NOTED = "concat(chr(123), ' \"note\": \"say ', chr(92), '\"', chr(125), ' ', chr(123), chr(92), '\" \",', substr(" + JSON_LINE + ", 2))"
_LAYOUT_LINES = f"""WITH objects AS (
  SELECT source_file, event_seq, file_kind, {_NOTED} AS j, event_seq = min(event_seq) OVER (PARTITION BY source_file) AS first,
    event_seq = max(event_seq) OVER (PARTITION BY source_file) AS last
  FROM {{lines}} WHERE file_kind = 0 OR event_seq % 11 <> 10),
parted AS (
  SELECT *, CASE WHEN file_kind = 0 THEN array(j)
    WHEN file_kind = 1 AND event_seq % 4 = 3 THEN array(concat(j, ' ', replace(j, '"username": "u', '"username": "v')))
    ELSE split(j, '(?<=,) ') END AS own
  FROM objects WHERE file_kind < 3),
framed AS (
  SELECT source_file, event_seq, CASE WHEN file_kind = 1 AND first THEN concat(array('[boot] service started'), own)
    WHEN file_kind = 2 THEN concat(array(if(first, '[', ',')), own, if(last, array(']'), array())) ELSE own END AS parts
  FROM parted)
SELECT source_file, event_seq * 100 + i AS line_number, event_seq * 100 + i AS event_seq, part AS line FROM (SELECT *, posexplode(parts) AS (i, part) FROM framed)
UNION ALL
SELECT source_file, min(event_seq), min(event_seq) * 100, concat('[', array_join(array_sort(collect_list(struct(event_seq, j))).j, ', '), ']')
FROM objects WHERE file_kind = 3 GROUP BY source_file"""
_LAYOUT_OBJECTS = f"""SELECT file_kind, concat('u', k) AS user, endpoint_raw AS endpoint FROM lines WHERE {_JSON_OK}
  UNION ALL SELECT file_kind, concat('v', k), endpoint_raw FROM lines WHERE {_JSON_OK} AND file_kind = 1 AND event_seq % 4 = 3"""


@query("scan_json_events", with_ctes(
    """SELECT CASE file_kind WHEN 0 THEN 'ndjson' WHEN 1 THEN 'objects' ELSE 'array' END AS layout, "user", endpoint, count(*) AS n FROM obj GROUP BY ALL
    UNION ALL SELECT 'files' AS layout, "user", endpoint, count(*) AS n FROM obj WHERE file_kind > 0 GROUP BY ALL""", "lines", extra={"obj": _LAYOUT_OBJECTS}))
def _(x):
    lines = x.spark.sql(_LAYOUT_LINES, lines=x.lines_wide)
    path = scratch_path(x.spark, "json-files")
    kinds = x.lines_wide.where("file_kind > 0").select("source_file").distinct()
    written = lines.join(kinds, "source_file", "left_semi").repartition("source_file").sortWithinPartitions("source_file", "line_number")
    written.select("source_file", F.col("line").alias("value")).write.partitionBy("source_file").text(path)
    found = json_documents(lines).select("layout", "line").unionByName(
        scan_json_events(x.spark, path).select(F.lit("files").alias("layout"), "line"))
    obj = pj.json_object(F.col("line"))
    return found.select("layout", obj["username"].alias("user"), obj["path"].alias("endpoint")).groupBy(
        "layout", "user", "endpoint").agg(F.count(F.lit(1)).alias("n"))
