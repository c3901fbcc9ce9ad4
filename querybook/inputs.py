"""Log views derived from the given tables, in SQL text both engines run."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracehound.functions.decode import decode_url_iter
from tracehound.operators.detect import detect_all
from tracehound.operators.rules import RULES, ThresholdRule
from tracehound.runtime import configure, scratch_path
from tracehound.schema import group_of

# One attack text per regex rule; '~' stands for a backslash, '^' for a single quote.
PAYLOADS = [
    "/s?q=1 UNION/**/SELECT a", "/s?q=x^ OR ^1^=^1", "/s?q=drop  table t", "/s?q=insert into t",
    "/s?q=delete from t", "/s?q=admin^ ; --", "/s?q=sleep (5)", "/s?q=information_schema.tables",
    "/s?q=unhex(1)", "/ssh/attempt", "/..~..~x", "/f?p=/etc/group", "/proc/self/environ",
    "/windows~system.ini", "/.git/config", "/q=< script src=x>", "/q=onclick =x",
    "/q=JavaScript :x", "/q=<img src=x onfoo=1>", "/q=<svg/onbar=1>", "/q=data:text/html,x",
    "/r?c=;  whoami", "/r?c=a | sort", "/r?c=`x`", "/r?c=$(x)", "/r?c=nc -e",
    "/%252e%252e%252f%252e%252e%252fwin.ini", "/d?p=Li4vLi4vZXRjL3Bhc3N3ZA==",
    "/x?y=&#x3c;svg onload=1&#62;", "/contact",
]


def sql_text(text: str) -> str:
    """SQL literal without a quote or backslash inside, so both engines read the same."""
    out = f"'{text}'"
    if "~" in text:
        out = f"replace({out}, '~', chr(92))"
    if "^" in text:
        out = f"replace({out}, '^', chr(39))"
    return out


_PAYLOAD_CASE = "CASE CAST(k % 30 AS INT) " + " ".join(
    f"WHEN {i} THEN {sql_text(p)}" for i, p in enumerate(PAYLOADS)
) + " END"

# A third of the events come from one address, one in 41 has none, and the rest is
# spread over addresses whose number grows with the data. One user in ten is harmless,
# and one in ten fails first and gets in later.
LOG_SQL = f"""
SELECT event_seq, ts, ip, source, etype, k, user_id,
  CASE etype WHEN 'error' THEN 'POST' WHEN 'signup' THEN 'POST' ELSE 'GET' END AS method,
  CASE etype WHEN 'error' THEN 401 WHEN 'click' THEN CASE WHEN k % 20 = 19 THEN 403 ELSE 200 END
    ELSE 200 END AS status_code,
  CASE WHEN source = 'auth' AND k % 25 = 24 THEN 'pam_failure' ELSE '' END AS auth_result,
  concat('agent/', CAST(user_id % 7 AS STRING)) AS user_agent,
  endpoint_text, replace(endpoint_text, ' ', '%20') AS endpoint_raw,
  CASE WHEN etype = 'click' AND k % 30 = 9
    THEN concat('maximum authentication attempts exceeded for root ', CAST(event_seq AS STRING))
    ELSE concat(source, ' ', etype, ' ', endpoint_text) END AS raw_line
FROM (
SELECT *, CASE etype WHEN 'error' THEN '/admin/login' WHEN 'signup' THEN '/login'
    WHEN 'purchase' THEN CASE CAST(k % 3 AS INT) WHEN 0 THEN '/api/users' WHEN 1 THEN '/api/data/export'
      ELSE '/checkout' END
    WHEN 'view' THEN '/about' ELSE {_PAYLOAD_CASE} END AS endpoint_text
FROM (
SELECT event_id AS event_seq, user_id, CAST(regexp_extract(props, '[0-9]+', 0) AS INT) AS k,
  CASE WHEN event_id % 3 = 1 THEN date_trunc('hour', ts) ELSE date_trunc('second', ts) END AS ts,
  CASE WHEN event_id % 41 = 0 THEN '' WHEN user_id % 3 = 0 THEN '10.0.0.1'
    ELSE concat(CASE WHEN user_id % 2 = 0 THEN '203.0.' ELSE '10.1.' END,
      CAST(CAST(floor(user_id / 250) AS INT) AS STRING), '.', CAST(user_id % 250 AS STRING)) END AS ip,
  CASE CAST(event_id % 3 AS INT) WHEN 0 THEN 'nginx' WHEN 1 THEN 'auth' ELSE 'app' END AS source,
  CASE WHEN user_id % 3 = 0 THEN event_type WHEN user_id % 10 = 7 THEN 'view'
    WHEN user_id % 10 = 8 AND event_type = 'error' AND ts >= DATE '2024-01-20' THEN 'view'
    WHEN user_id % 10 = 8 AND event_type = 'signup' AND ts < DATE '2024-01-25' THEN 'view'
    ELSE event_type END AS etype
FROM {{events}}) e0) e1
"""

_MONTHS = "JanFebMarAprMayJunJulAugSepOctNovDec"


def _two(expr: str) -> str:
    return f"lpad(CAST({expr} AS STRING), 2, '0')"


def _month(ts: str) -> str:
    return f"substr('{_MONTHS}', CAST((month({ts}) - 1) * 3 + 1 AS INT), 3)"


def _clock(ts: str) -> str:
    return f"concat({_two(f'hour({ts})')}, ':', {_two(f'minute({ts})')}, ':', {_two(f'second({ts})')})"


def _q(text: str) -> str:
    return "'" + text + "'"


# Lines written five and a half hours ahead of UTC carry that offset.
WEB_LINE = (
    "concat(CASE WHEN ip = '' THEN '-' ELSE ip END, ' - ', CASE WHEN k % 4 = 0 THEN '-' ELSE concat('u', CAST(k AS STRING)) END, ' [', "
    f"{_two('day(local_ts)')}, '/', {_month('local_ts')}, '/', CAST(year(local_ts) AS STRING), ':', {_clock('local_ts')}, "
    "CASE WHEN event_seq % 5 = 0 THEN ' +0530' ELSE ' +0000' END, '] \"', method, ' ', "
    "CASE WHEN k >= 50 THEN endpoint_text ELSE endpoint_raw END, ' HTTP/1.1\" ', CAST(status_code AS STRING), ' ', "
    "CAST(k * 10 AS STRING), ' \"', CASE WHEN k % 3 = 0 THEN '-' ELSE 'http://x/' END, '\" \"', user_agent, '\"')"
)
AUTH_MESSAGE = """CASE CAST(k % 10 AS INT)
 WHEN 0 THEN concat('Failed password for invalid user u', CAST(k AS STRING), ' from ', addr, ' port ', CAST(k AS STRING), ' ssh2')
 WHEN 1 THEN concat('Accepted password for u', CAST(k AS STRING), ' from ', addr, ' port ', CAST(k AS STRING), ' ssh2')
 WHEN 2 THEN concat('Accepted publickey for u', CAST(k AS STRING), ' from ', addr, ' port ', CAST(k AS STRING), ' ssh2')
 WHEN 3 THEN concat('maximum authentication attempts exceeded for u', CAST(k AS STRING), ' from ', addr, ' port ', CAST(k AS STRING))
 WHEN 4 THEN concat('Disconnecting authenticating user u', CAST(k AS STRING), ' ', addr, ' port ', CAST(k AS STRING), ': too many')
 WHEN 5 THEN concat('u', CAST(k AS STRING), ' : TTY=pts/0 ; PWD=/home/u ; USER=root ; COMMAND=/bin/cat /etc/shadow ', CAST(k AS STRING))
 WHEN 6 THEN concat('pam_unix(sshd:session): session opened for user u', CAST(k AS STRING), ' by (uid=0)')
 WHEN 7 THEN concat('pam_unix(sshd:session): session closed for user u', CAST(k AS STRING))
 WHEN 8 THEN concat('pam_unix(sudo:auth): authentication failure; logname=x ruser=y rhost=', addr, ' user=u', CAST(k AS STRING))
 ELSE concat('Received signal ', CAST(k AS STRING)) END"""
AUTH_LINE = (
    f"concat({_month('ts')}, ' ', lpad(CAST(day(ts) AS STRING), 2, ' '), ' ', {_clock('ts')}, ' host', CAST(k % 3 AS STRING), "
    f"CASE WHEN k % 2 = 0 THEN concat(' sshd[', CAST(k + 100 AS STRING), ']: ') ELSE ' sudo: ' END, {AUTH_MESSAGE})"
)
# Three spellings of the same fields; one line in eleven is cut off.
JSON_LINE = (
    "concat(chr(123), ' \"', CASE CAST(event_seq % 3 AS INT) WHEN 0 THEN 'timestamp' WHEN 1 THEN '@timestamp' ELSE 'ts' END, '\": \"', "
    f"CAST(year(ts) AS STRING), '-', {_two('month(ts)')}, '-', {_two('day(ts)')}, 'T', {_clock('ts')}, 'Z\", \"', "
    "CASE CAST(event_seq % 2 AS INT) WHEN 0 THEN 'level' ELSE 'severity' END, '\": \"', "
    "CASE CAST(k % 6 AS INT) WHEN 0 THEN 'FATAL' WHEN 1 THEN 'Warning' WHEN 2 THEN 'trace' WHEN 3 THEN 'notice' WHEN 4 THEN 'err' ELSE '' END, '\", \"', "
    "CASE CAST(event_seq % 3 AS INT) WHEN 0 THEN 'ip' WHEN 1 THEN 'client_ip' ELSE 'clientIp' END, '\": \"', ip, '\", \"method\": \"', lower(method), "
    "'\", \"path\": \"', replace(endpoint_raw, chr(92), concat(chr(92), chr(92))), '\", \"', "
    "CASE CAST(event_seq % 2 AS INT) WHEN 0 THEN 'statusCode\": ' ELSE 'http_status\": ' END, "
    "CASE WHEN k % 7 = 0 THEN '0' WHEN k % 7 = 1 THEN '\"n/a\"' ELSE CAST(status_code AS STRING) END, "
    "', \"user\": null, \"username\": \"u', CAST(k AS STRING), '\", \"msg\": \"m', CAST(k AS STRING), '\", \"extra\": ', CAST(k AS STRING), "
    "CASE WHEN event_seq % 11 = 10 THEN '' ELSE concat(' ', chr(125)) END)"
)
LINES_SQL = f"""
SELECT *, concat('part-', CAST(CAST(floor(event_seq / 500) AS INT) AS STRING), '.log') AS source_file,
  event_seq % 500 + 1 AS line_number, CAST(floor(event_seq / 500) AS INT) % 4 AS file_kind,
  {WEB_LINE} AS web_line, {AUTH_LINE} AS auth_line, {JSON_LINE} AS json_line
FROM (SELECT *, CASE WHEN event_seq % 5 = 0 THEN ts + INTERVAL '330' MINUTE ELSE ts END AS local_ts,
  CASE WHEN ip = '' THEN 'gateway' ELSE ip END AS addr FROM ({LOG_SQL}) l0) l1
"""
# Files of 500 lines: web, auth, JSON, and files no parser knows.
MIXED_LINE = (
    "CASE file_kind WHEN 0 THEN web_line WHEN 1 THEN auth_line WHEN 2 THEN json_line "
    "ELSE CASE WHEN k < 20 THEN web_line ELSE concat('free text ', CAST(k AS STRING)) END END"
)
REF_NOW = "2024-01-20 00:00:00"

# The derived log is spread over 30 days, so the rules get wider windows.
LOGIN_WINDOW = 2 * 86400
RAPID_WINDOW = 5 * 86400
CHAIN_WINDOW = 6 * 3600


def log_rules() -> list:
    windows = {"BRUTE_FORCE_LOGIN": LOGIN_WINDOW, "BRUTE_FORCE_RAPID_REQUESTS": RAPID_WINDOW}
    return [
        replace(r, window_seconds=windows[r.rule_id]) if isinstance(r, ThresholdRule) else r for r in RULES
    ]


_STORED: dict[tuple[str, str, str], str] = {}


class Inputs:
    """The derived tables of one data folder as lazy DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = configure(spark)
        self.sf_dir = sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def events(self) -> DataFrame:
        """The ``events`` table, dealt evenly to all tasks while it is narrow.

        A file is read by one task for each of its row groups at most, some of them empty;
        deriving the log from a row costs far more than sending it.
        """
        df = self.table("events")
        tasks = 2 * self.spark.sparkContext.defaultParallelism
        return df.repartition(tasks) if df.rdd.getNumPartitions() < tasks else df

    def sql(self, text: str) -> DataFrame:
        return self.spark.sql(text, events=self.events())

    def stored(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """Derived table, written once per session and data folder to the shared folder.

        Stands for the tables a user of the operators has: raw lines as landed,
        normalised events, and the alerts that correlation starts from.
        """
        key = (self.spark.sparkContext.applicationId, self.sf_dir, name)
        if key not in _STORED:
            path = scratch_path(self.spark, f"querybook-{name}")
            df = build()
            width = self.spark.sparkContext.defaultParallelism
            if df.rdd.getNumPartitions() < width:
                df = df.repartition(width)
            df.write.parquet(path)
            _STORED[key] = path
        return self.spark.read.parquet(_STORED[key])

    @cached_property
    def log(self) -> DataFrame:
        return self.stored("log", lambda: self.sql(LOG_SQL))

    @cached_property
    def lines_wide(self) -> DataFrame:
        return self.stored("lines", lambda: self.sql(LINES_SQL))

    def lines(self, column: str) -> DataFrame:
        return self.lines_wide.select(
            "event_seq", "source_file", "line_number", F.expr(column).alias("line")
        )

    @cached_property
    def ev(self) -> DataFrame:
        """Events with the endpoint percent-decoded."""
        return self.stored("events", self._events)

    def _events(self) -> DataFrame:
        return self.sql(LOG_SQL).select(
            "event_seq", F.col("ts").cast("timestamp").alias("ts"), "source", "ip", "method",
            decode_url_iter(F.col("endpoint_raw")).alias("endpoint"), "status_code", "user_agent",
            "raw_line", F.create_map(F.lit("authResult"), F.col("auth_result")).alias("metadata"), "k",
        )

    @cached_property
    def al(self) -> DataFrame:
        """Alerts as correlation input; detection itself is queried without this table."""
        return self.stored("alerts", lambda: detect_all(self.ev, log_rules()))

    @cached_property
    def geo(self) -> DataFrame:
        """Lookup by address, one row per public address of every second user."""
        return self.spark.sql(GEO_SQL, events=self.table("events"), nation=self.table("nation"))

    @cached_property
    def networks(self) -> DataFrame:
        return self.spark.sql(NETWORK_SQL, nation=self.table("nation"))


# Addresses of users whose number divides by four, named after a nation; some fields empty.
GEO_SQL = """
SELECT ip, n_name AS country, CASE WHEN n_nationkey % 3 = 0 THEN '' ELSE concat('city ', CAST(n_nationkey AS STRING)) END AS city,
  CAST(n_nationkey AS DOUBLE) AS lat, CAST(n_regionkey AS DOUBLE) AS lon, concat('isp ', n_name) AS isp,
  concat('org ', CAST(n_regionkey AS STRING)) AS org, CASE WHEN n_nationkey % 2 = 0 THEN '' ELSE concat('AS', CAST(n_nationkey AS STRING)) END AS as_name
FROM (SELECT DISTINCT concat('203.0.', CAST(CAST(floor(user_id / 250) AS INT) AS STRING), '.', CAST(user_id % 250 AS STRING)) AS ip,
  CAST(user_id % 25 AS INT) AS nk FROM {events} WHERE user_id % 4 = 0) u JOIN {nation} n ON n.n_nationkey = u.nk
"""
# Networks of ten addresses each within 203.0.0.0/16, inside one wide network.
NETWORK_SQL = """
SELECT CAST(3405774848 + n_nationkey * 10 AS BIGINT) AS start, CAST(3405774848 + n_nationkey * 10 + 7 AS BIGINT) AS end,
  n_name AS country, concat('city ', CAST(n_nationkey AS STRING)) AS city, CAST(n_nationkey AS DOUBLE) AS lat,
  CAST(n_regionkey AS DOUBLE) AS lon, concat('isp ', n_name) AS isp, 'org' AS org, 'AS1' AS as_name
FROM {nation}
UNION ALL SELECT CAST(3405774848 AS BIGINT), CAST(3405774848 + 131071 AS BIGINT), 'WIDE', 'wide city', CAST(1 AS DOUBLE), CAST(2 AS DOUBLE), 'wide isp', 'wide org', 'AS2'
FROM {nation} WHERE n_nationkey = 0
"""


def present(df: DataFrame) -> DataFrame:
    """Times without a zone, as the SQL side has them."""
    return df.select(
        *[
            F.col(f.name).cast("timestamp_ntz").alias(f.name) if isinstance(f.dataType, T.TimestampType) else f.name
            for f in df.schema.fields
        ]
    )


def ip_group_of(df: DataFrame) -> DataFrame:
    return df.withColumn("ip_group", group_of(F.col("ip")))
