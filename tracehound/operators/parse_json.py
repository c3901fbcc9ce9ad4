"""JSON application log objects to events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracehound.functions.decode import DEFAULT_STEPS, Decoder, deobfuscate
from tracehound.functions.text import bind, leading_int, sql_literal, trim_blank
from tracehound.schema import EVENT_COLUMNS

JSON_SOURCE = "app"

# Names a field can have, in order of preference.
FIELD_ALIASES = {
    "timestamp": ["timestamp", "time", "date", "datetime", "@timestamp", "ts", "created_at", "logged_at"],
    "ip": ["ip", "remote_addr", "client_ip", "src_ip", "source_ip", "remote_ip", "clientIp"],
    "level": ["level", "severity", "loglevel", "log_level", "priority"],
    "endpoint": ["endpoint", "path", "url", "uri", "request_uri", "route"],
    "method": ["method", "http_method", "request_method", "verb"],
    "status": ["statusCode", "status_code", "status", "http_status", "response_code"],
    "user": ["user", "username", "userId", "user_id", "account"],
    "message": ["message", "msg", "text", "description", "log"],
}
# Log level names.
LEVEL_NAMES = {
    "error": ["error", "err", "fatal", "critical", "crit", "alert", "emerg"],
    "warn": ["warn", "warning"],
    "debug": ["debug", "trace", "verbose"],
}


def _more_behind(text: Column) -> Column:
    """Whether a closing brace outside strings is followed by anything but a comma or a closing one."""
    behind = F.lit(r"\}\s*[^\s,}\]]")
    # strings are only taken out where the whole text gives cause
    outside = F.regexp_replace(text, r'"(?:\\.|[^"\\])*"', '""')
    return F.regexp_like(text, behind) & F.regexp_like(outside, behind)


def json_object(text: Column) -> Column:
    """Top-level fields of a JSON object as text, NULL for anything else.

    A repeated name keeps its last value. The built-in parser stops behind the first object,
    so text with another one behind it is told apart by what follows a closing brace.
    """
    looks_like_one = F.startswith(text, F.lit("{")) & F.endswith(text, F.lit("}")) & ~_more_behind(text)
    parsed = F.from_json(text, "map<string,string>")

    def last_wins(m: Column) -> Column:
        names = F.array_distinct(F.map_keys(m))
        last = lambda k: F.element_at(
            F.filter(F.map_entries(m), lambda e: e["key"] == k), -1
        )["value"]
        return F.when(
            F.size(names) < F.size(F.map_keys(m)), F.map_from_arrays(names, F.transform(names, last))
        ).otherwise(m)

    return F.when(looks_like_one, bind(parsed, last_wins))


def canonical_json(text: Column) -> Column:
    """Compact text of an object: no blanks outside strings, plain characters unescaped."""
    compact = F.regexp_replace(text, r'("(?:\\.|[^"\\])*")|\s+', "$1")
    slashes = F.when(
        F.contains(compact, F.lit("\\/")),
        F.regexp_replace(compact, r"(?<!\\)((?:\\\\)*)\\/", "$1/"),
    ).otherwise(compact)

    def plain(token: Column) -> Column:
        code = F.conv(F.substr(token, F.lit(3)), 16, 10).cast("int")
        keep = code.between(32, 126) & ~code.isin(34, 92)
        return F.when(F.regexp_like(token, F.lit(r"^\\u[0-9A-Fa-f]{4}$")) & keep, F.chr(code)).otherwise(token)

    def unescape(t: Column) -> Column:
        parts = F.regexp_extract_all(t, F.lit(r"(?s)\\u[0-9A-Fa-f]{4}|\\.|[^\\]+|\\"), F.lit(0))
        return F.array_join(F.transform(parts, plain), "")

    return bind(slashes, lambda t: F.when(F.contains(t, F.lit("\\u")), unescape(t)).otherwise(t))


def find_field(obj: str, name: str) -> Column:
    """First alias with a value that is neither null nor empty; ``obj`` is a column name.

    A loop over the alias list: 47 written-out lookups make a method too large for the JIT.
    """
    aliases = ", ".join(sql_literal(a) for a in FIELD_ALIASES[name])
    return F.expr(f"get(filter(transform(array({aliases}), a -> {obj}[a]), v -> v <> ''), 0)")


def normalize_level(level: Column) -> Column:
    lowered = F.lower(level)
    out = F.lit("info")
    for name, words in LEVEL_NAMES.items():
        out = F.when(lowered.isin(words), F.lit(name)).otherwise(out)
    return out


def normalize_method(method: Column) -> Column:
    return F.upper(F.coalesce(method, F.lit("")))


def normalize_status(status: Column) -> Column:
    """Leading integer; zero and text give NULL."""
    return F.nullif(leading_int(status), F.lit(0))


def parse_ts_iso(text: Column, now: Column | None = None) -> Column:
    """ISO time or epoch milliseconds; a missing value is the ingest time, a bad one NULL."""
    number = text.try_cast("long")
    # years 1 to 9999; finer units than milliseconds and nonsense give NULL
    millis = F.timestamp_millis(F.when(number.between(-62_135_596_800_000, 253_402_300_799_999), number))
    parsed = F.when(F.regexp_like(text, F.lit(r"^-?\d{9,}$")), millis).otherwise(F.try_to_timestamp(text))
    return F.when(text.isNull(), F.current_timestamp() if now is None else now).otherwise(parsed)


def json_fields(objects: DataFrame) -> DataFrame:
    """Adds one column ``f_<name>`` per logical field of ``obj``."""
    return objects.select("*", *[find_field("obj", n).alias(f"f_{n}") for n in FIELD_ALIASES])


def json_metadata(obj: str, message: str, raw_endpoint: str, endpoint: str) -> Column:
    """Fields under no alias, the message, and the endpoint as sent when it was encoded.

    All arguments are column names.
    """
    known = ", ".join(sql_literal(a) for aliases in FIELD_ALIASES.values() for a in aliases)
    changed = f"coalesce({raw_endpoint} <> {endpoint}, false)"
    return F.expr(
        f"""map_concat(
          map_filter({obj}, (k, v) -> k not in ({known}) and not ({changed} and k = 'rawEndpoint')),
          map('message', {message}),
          if({changed}, map('rawEndpoint', {raw_endpoint}), cast(map() as map<string,string>)))"""
    )


def parse_json(
    objects: DataFrame, now: Column | None = None, steps: Sequence[Decoder] = DEFAULT_STEPS
) -> DataFrame:
    """``event_seq, source_file, line_number, line`` (one object per row) to events."""
    text = objects.withColumn("line", trim_blank(F.col("line")))
    found = json_fields(text.withColumn("obj", json_object(F.col("line"))).where("obj is not null"))
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    decoded = (
        found.withColumn("raw_endpoint", blank("f_endpoint"))
        .withColumn("message", blank("f_message"))
        .withColumn("endpoint", deobfuscate(F.col("raw_endpoint"), steps))
    )
    return decoded.select(
        "event_seq", parse_ts_iso(F.col("f_timestamp"), now).alias("ts"),
        F.lit(JSON_SOURCE).alias("source"), "source_file", blank("f_ip").alias("ip"),
        normalize_method(F.col("f_method")).alias("method"), "endpoint",
        normalize_status(F.col("f_status")).alias("status_code"),
        normalize_level(F.col("f_level")).alias("log_level"), F.lit("").alias("user_agent"),
        blank("f_user").alias("user"), canonical_json(F.col("line")).alias("raw_line"),
        F.col("line_number").cast("long").alias("line_number"),
        json_metadata("obj", "message", "raw_endpoint", "endpoint").alias("metadata"),
    ).select(*EVENT_COLUMNS)
