"""Linux authentication log lines to events."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracehound.functions.text import capture, captured, sql_literal, trim_blank
from tracehound.schema import EVENT_COLUMNS

# Fixed value: the syslog line format.
SYSLOG_PATTERN = (
    r"^(\w{3})\s+(\d{1,2})\s+(\d{2}):(\d{2}):(\d{2})\s+(\S+)\s+(\S+?)(?:\[(\d+)\])?:\s+(.+)$"
)
AUTH_SOURCE = "auth"


@dataclass(frozen=True)
class MessageKind:
    """One kind of message: where its values sit and what they mean.

    Numbers are group positions. ``extra`` maps metadata names to a group or a text.
    """

    pattern: str
    user: int
    ip: int | None = None
    method: str = "AUTH"
    endpoint: str | int = "/login"
    status: int | None = None
    level: str = "info"
    extra: dict[str, int | str] = field(default_factory=dict)


# Message patterns and their meaning; the first match decides.
MESSAGE_KINDS: list[MessageKind] = [
    MessageKind(r"Failed password for (?:invalid user )?(\S+) from (\S+) port (\d+)",
                1, 2, status=401, level="warn", extra={"authResult": "failed", "port": 3}),
    MessageKind(r"Accepted password for (\S+) from (\S+) port (\d+)",
                1, 2, status=200, extra={"authResult": "success", "authMethod": "password", "port": 3}),
    MessageKind(r"Accepted publickey for (\S+) from (\S+) port (\d+)",
                1, 2, status=200, extra={"authResult": "success", "authMethod": "publickey", "port": 3}),
    MessageKind(r"maximum authentication attempts exceeded for (\S+) from (\S+) port (\d+)",
                1, 2, status=429, level="error", extra={"authResult": "max_attempts", "port": 3}),
    MessageKind(r"Disconnecting (?:authenticating )?user (\S+) (\S+) port (\d+)",
                1, 2, status=403, level="warn", extra={"authResult": "disconnected"}),
    MessageKind(r"(\S+)\s*:\s*TTY=\S+\s*;\s*PWD=(\S+)\s*;\s*USER=(\S+)\s*;\s*COMMAND=(.+)$",
                1, method="SUDO", endpoint=4, level="warn",
                extra={"pwd": 2, "targetUser": 3, "command": 4}),
    MessageKind(r"pam_unix\(\S+\):\s+session opened for user (\S+)",
                1, method="SESSION", endpoint="/session/open", status=200,
                extra={"sessionAction": "opened"}),
    MessageKind(r"pam_unix\(\S+\):\s+session closed for user (\S+)",
                1, method="SESSION", endpoint="/session/close", status=200,
                extra={"sessionAction": "closed"}),
    MessageKind(r"pam_unix\(\S+\):\s+authentication failure;.*ruser=(\S*).*rhost=(\S*)\s+user=(\S+)",
                3, 2, status=401, level="warn", extra={"authResult": "pam_failure"}),
]


def parse_ts_syslog(
    month: Column, day: Column, clock: Column, ref_now: Column | None = None, tz: str = "UTC"
) -> Column:
    """Time without a year: the reference year, or the one before for future dates."""
    now = F.current_timestamp() if ref_now is None else ref_now
    year = F.year(F.from_utc_timestamp(now, tz))

    def in_year(y: Column) -> Column:
        text = F.concat_ws(" ", y.cast("string"), month, day, clock, F.lit(tz))
        return F.try_to_timestamp(text, F.lit("yyyy MMM d HH:mm:ss VV"))

    this_year = in_year(year)
    # a leap day that this year does not have was last year's
    return F.when(this_year.isNull() | (this_year > now), in_year(year - 1)).otherwise(this_year)


def syslog_fields(lines: DataFrame) -> DataFrame:
    """Captured base fields of every syslog line; other lines are dropped."""
    names = ["month", "day", "hh", "mm", "ss", "hostname", "service", "pid", "message"]
    found = lines.withColumn("line", trim_blank(F.col("line"))).withColumn(
        "_m", capture(F.col("line"), SYSLOG_PATTERN, len(names))
    ).where(captured(F.col("_m"), len(names)))
    return found.select(
        *[c for c in found.columns if c != "_m"], *[F.get("_m", F.lit(i)).alias(n) for i, n in enumerate(names, 1)]
    )


def message_fields(df: DataFrame) -> DataFrame:
    """Adds ip, user, method, endpoint, status, level and metadata from ``message``."""
    message = F.col("message")
    kind = F.lit(None).cast("int")
    groups = F.lit(None).cast("array<string>")
    for i, k in reversed(list(enumerate(MESSAGE_KINDS))):
        n = max([g for g in (k.user, k.ip, k.endpoint, *k.extra.values()) if isinstance(g, int)] + [1])
        hit = F.regexp_like(message, F.lit(k.pattern))
        kind = F.when(hit, F.lit(i)).otherwise(kind)
        # runs only for the kind that was found
        groups = F.when(F.col("_kind") == i, capture(message, k.pattern, n)).otherwise(groups)
    tagged = df.withColumn("_kind", kind).withColumn("_g", groups)

    def by_kind(get: Callable[[MessageKind], int | str | None], default: str = "null") -> str:
        """SQL of a value that depends on the kind: a group, a text, or nothing."""
        kinds: dict[int | str, list[str]] = {}
        for i, k in enumerate(MESSAGE_KINDS):
            if get(k) is not None:
                kinds.setdefault(get(k), []).append(str(i))
        cases = " ".join(
            f"when _kind in ({', '.join(at)}) then {f'_g[{v}]' if isinstance(v, int) else sql_literal(v)}"
            for v, at in kinds.items()
        )
        return f"case {cases} else {default} end"

    extra_names = sorted({n for k in MESSAGE_KINDS for n in k.extra})
    entries = ", ".join(f"'{n}', {by_kind(lambda k, n=n: k.extra.get(n))}" for n in extra_names)
    status = by_kind(lambda k: None if k.status is None else str(k.status))
    return tagged.selectExpr(
        *[c for c in tagged.columns if c not in ("_kind", "_g")],
        f"{by_kind(lambda k: k.ip, sql_literal(''))} as ip",
        f"{by_kind(lambda k: k.user, sql_literal(''))} as user",
        f"{by_kind(lambda k: k.method, sql_literal(''))} as method",
        f"{by_kind(lambda k: k.endpoint, sql_literal(''))} as endpoint",
        f"cast({status} as int) as status_code",
        f"{by_kind(lambda k: k.level, sql_literal('info'))} as log_level",
        f"map_filter(map({entries}, 'rawMessage', if(_kind is null, message, null)), (k, v) -> v is not null) as _extra",
    )


def parse_auth_syslog(lines: DataFrame, ref_now: Column | None = None, tz: str = "UTC") -> DataFrame:
    """``event_seq, source_file, line_number, line`` to events; endpoints are not decoded."""
    fields = message_fields(syslog_fields(lines))
    clock = F.concat_ws(":", "hh", "mm", "ss")
    base = F.create_map(
        F.lit("hostname"), F.col("hostname"), F.lit("service"), F.col("service"),
        F.lit("pid"), F.nullif(F.col("pid"), F.lit("")), F.lit("message"), F.col("message"),
    )
    return fields.select(
        "event_seq", parse_ts_syslog(F.col("month"), F.col("day"), clock, ref_now, tz).alias("ts"),
        F.lit(AUTH_SOURCE).alias("source"), "source_file", "ip", "method", "endpoint", "status_code",
        "log_level", F.lit("").alias("user_agent"), "user", F.col("line").alias("raw_line"),
        F.col("line_number").cast("long").alias("line_number"),
        F.map_concat("_extra", base).alias("metadata"),
    ).select(*EVENT_COLUMNS)


def is_syslog_line(line: Column) -> Column:
    return F.regexp_like(line, F.lit(SYSLOG_PATTERN))
