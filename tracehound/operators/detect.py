"""Detection: regex rules in one projection, threshold rules by time cells."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracehound.functions.text import bind, sql_literal
from tracehound.operators.bloom import where_maybe
from tracehound.operators.rules import (
    RULES,
    RegexRule,
    Rule,
    ThresholdRule,
    regex_rules,
    threshold_rules,
)
from tracehound.runtime import materialize
from tracehound.schema import KEY_COLUMNS, SEVERITY_LEVELS, group_of, micros

ALERT_COLUMNS = [
    "phase", "rule_ordinal", "ord_major", "ord_minor",
    "rule_id", "category", "severity", "description", "matched_pattern",
    "event_seq", "ts", "ip", "ip_group", "endpoint", "source", "raw_line",
]

_EVENT_PART = ["event_seq", "ts", "ip", "endpoint", "source", "raw_line"]


def rule_field(df: DataFrame, name: str) -> str:
    """SQL of the field a rule looks at.

    A rule may name a metadata entry; without one the event column is used.
    """
    if name in ("endpoint", "raw_line"):
        return name
    top = f"cast(`{name}` as string)" if name in df.columns else "cast(null as string)"
    if "metadata" not in df.columns:
        return top
    return f"coalesce(nullif(metadata[{sql_literal(name)}], ''), {top})"


def rule_match(df: DataFrame, rule: RegexRule) -> str:
    """SQL of the matched text in the first field that matches, else NULL."""
    regex = sql_literal(rule.regex)
    found = [f"nullif(regexp_extract({rule_field(df, f)}, {regex}, 0), '')" for f in rule.fields]
    return f"coalesce({', '.join(found)})"


def any_rule_guard(df: DataFrame, rules: Sequence[RegexRule]) -> Column:
    """Whether any rule can match, cheap for the harmless lines that make up most logs.

    Plain word search settles nearly all of them; the patterns of rules without words
    are tried as one. What passes is decided by the patterns themselves.
    """
    tests = []
    for field in dict.fromkeys(f for r in rules for f in r.fields):
        mine = [r for r in rules if field in r.fields]
        text = F.expr(rule_field(df, field))
        words: dict[str, list[str]] = {}
        for word, also in dict.fromkeys(n for r in mine for n in r.needs):
            # words that need the same companion are looked for once it is there
            words.setdefault(also or word, []).append(word)
        if words:
            rows = ", ".join(
                f"struct({sql_literal(a)} as a, array({', '.join(map(sql_literal, more))}) as more)"
                for a, more in words.items()
            )
            # a loop over a constant list: written out it makes a method too large for the JIT
            found = bind(
                F.lower(text),
                lambda t, rows=rows: F.exists(
                    F.expr(f"array({rows})"),
                    lambda n: F.contains(t, n["a"]) & F.exists(n["more"], lambda w: F.contains(t, w)),
                ),
            )
            tests.append(F.coalesce(found, F.lit(False)))
        for pattern in _joined([r for r in mine if not r.needs]):
            tests.append(F.coalesce(F.regexp_like(text, F.lit(pattern)), F.lit(False)))
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def _joined(rules: Sequence[RegexRule]) -> list[str]:
    """One alternation for all rules; patterns with group references stay on their own."""
    alone = [r.regex for r in rules if re.search(r"\\[1-9]|\\k<|\(\?<[A-Za-z]", r.pattern)]
    together = [
        f"(?i:{r.pattern})" if r.ignore_case else f"(?:{r.pattern})" for r in rules if r.regex not in alone
    ]
    return alone + (["|".join(together)] if together else [])


def detect_regex(ev: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Alerts of all regex rules: one scan, at most one alert per rule and event."""
    wanted = regex_rules(rules)
    only = [r for _, r in wanted]
    hits = ", ".join(f"struct({i} as rule_ordinal, {rule_match(ev, r)} as text)" for i, r in wanted)
    about = F.element_at(_rule_texts(rules), F.col("hit.rule_ordinal"))
    return (
        ev.where(any_rule_guard(ev, only))
        .select(*_EVENT_PART, F.explode(F.expr(f"array({hits})")).alias("hit"))
        .where(F.col("hit.text").isNotNull())
        .withColumn("rule", about)
        .selectExpr(
            "0 as phase", "hit.rule_ordinal", "event_seq as ord_major",
            "cast(hit.rule_ordinal as bigint) as ord_minor", "rule.*", "hit.text as matched_pattern",
            *_EVENT_PART,
        )
        .withColumn("ip_group", group_of(F.col("ip")))
        .select(*ALERT_COLUMNS)
    )


def _rule_texts(rules: Sequence[Rule]) -> Column:
    """Constant array of (id, category, severity, description), by rule position."""
    rows = [
        {"rule_id": r.rule_id, "category": r.category, "severity": r.severity, "description": r.description}
        for r in rules
    ]
    return F.from_json(
        F.lit(json.dumps(rows)),
        "array<struct<rule_id:string,category:string,severity:string,description:string>>",
    )


HEAVY_CELLS = 1024
MIN_SPLIT_ROWS = 10_000
_SPLITS_PER_TASK = 16


def with_salt(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds ``salt``, which splits the groups that hold more than their share of all rows.

    A frequency sketch over the groups finds those above a sixteenth of an even task, of
    which there are at most sixteen times the tasks; each gets as many parts as its load
    asks for. The sketch counts too high at worst, which only means more parts.
    """
    tasks = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = F.xxhash64(*keys)
    size, heavy = cells.select(key.alias("k")).agg(
        F.count(F.lit(1)), F.expr(f"approx_top_k(k, {HEAVY_CELLS}, {16 * HEAVY_CELLS})")
    ).first()
    share = max(MIN_SPLIT_ROWS, size // (_SPLITS_PER_TASK * tasks))
    parts = [(h["item"], -(-h["count"] // share)) for h in heavy or [] if h["count"] > share]
    if not parts:
        return cells.withColumn("salt", F.lit(0))
    table = cells.sparkSession.createDataFrame(parts, "_k long, _parts long")  # at most HEAVY_CELLS rows
    found = cells.withColumn("_k", key).join(F.broadcast(table), "_k", "left")
    salt = F.pmod(F.xxhash64("event_seq"), F.coalesce("_parts", F.lit(1).cast("long")))
    return found.withColumn("salt", salt).drop("_k", "_parts")


def first_crossings(
    events: DataFrame, threshold: int, window_seconds: int, salts: int | None = None, by: Sequence[str] = ("grp",)
) -> DataFrame:
    """First event of each group that completes ``threshold`` events in the window.

    Input: the ``by`` columns, ``event_seq, t`` (microseconds). Output: the ``by``
    columns, ``event_seq, first_seq``.

    Event i crosses exactly when the event ``threshold - 1`` places before it, in
    (time, input order), is at most the window away. Time is cut into cells one
    window long, so that place is in the same cell or the one before: of each cell
    only its first ``threshold`` events can be the first crossing (the next one would
    come after it), and only its last ``threshold - 1`` matter to the next cell. Both
    are kept and the rest of the cell is never needed. A group that holds a large part
    of all rows is spread over its cells, and a single busy cell over salts: as many as its
    measured load asks for, or a given number for every cell.
    """
    need = threshold - 1
    width = max(window_seconds, 1) * 1_000_000
    cells = events.where(F.col("t").isNotNull()).withColumn("cell", F.floor(F.col("t") / width))
    cells = cells.withColumn("first_seq", F.col("event_seq"))

    def keep_ends(df: DataFrame, *keys: Column | str) -> DataFrame:
        part = Window.partitionBy(*keys)
        return (
            df.withColumn("rn", F.row_number().over(part.orderBy("t", "event_seq")))
            .withColumn("n", F.count(F.lit(1)).over(part))
            .withColumn("first_seq", F.min("first_seq").over(part))
            .withColumn("head", F.col("rn") <= threshold)
            .withColumn("tail", F.col("rn") > F.col("n") - need)
            .where("head or tail")
        )

    if salts is None:
        cells = keep_ends(with_salt(cells, [*by, "cell"]), *by, "cell", "salt")
    elif salts > 1:
        cells = keep_ends(cells, *by, "cell", F.pmod(F.col("event_seq"), F.lit(salts)))
    ends = keep_ends(cells, *by, "cell")
    placed = ends.select(
        *by, "event_seq", "t", "first_seq",
        F.explode(
            F.array(
                F.struct(F.col("cell"), F.col("head").alias("own")),
                F.struct(
                    F.when(F.col("tail"), F.col("cell") + 1).alias("cell"), F.lit(False).alias("own")
                ),
            )
        ).alias("p"),
    ).where("p.cell is not null").select(*by, "event_seq", "t", "first_seq", "p.cell", "p.own")
    in_cell = Window.partitionBy(*by, "cell").orderBy("t", "event_seq")
    before = F.lag("t", need).over(in_cell) if need > 0 else F.col("t")
    return (
        placed.withColumn("before", before)
        .withColumn(
            "crossing",
            F.when(
                F.col("own") & (F.col("t") - F.col("before") <= window_seconds * 1_000_000),
                F.struct("t", "event_seq"),
            ),
        )
        .groupBy(*by)
        .agg(F.min("crossing").alias("crossing"), F.min("first_seq").alias("first_seq"))
        .where("crossing is not null")
        .select(*by, F.col("crossing.event_seq").alias("event_seq"), "first_seq")
    )


def _fired(
    ev: DataFrame, rule: ThresholdRule, rule_ordinal: int, salts: int | None, scope: Sequence[str]
) -> DataFrame:
    """One narrow row per group that crossed the rule's threshold."""
    matching = ev.where(rule.predicate(ev)).select(
        *scope, group_of(F.col(rule.group_by)).alias("grp"), "event_seq", micros(F.col("ts")).alias("t")
    )
    if salts is None:
        # narrow rows of the few events that match: measured first, then split
        matching = materialize(matching)
    count, window = F.lit(str(rule.threshold)), F.lit(f"{rule.window_seconds}s")
    by = ("grp", *scope)
    return first_crossings(matching, rule.threshold, rule.window_seconds, salts, by).select(
        F.lit(1).alias("phase"),
        F.lit(rule_ordinal).alias("rule_ordinal"),
        F.lit(rule_ordinal).cast("long").alias("ord_major"),
        F.col("first_seq").alias("ord_minor"),
        F.lit(rule.rule_id).alias("rule_id"),
        F.lit(rule.category).alias("category"),
        F.lit(rule.severity).alias("severity"),
        threshold_text(rule.description, count, F.col("grp"), window).alias("description"),
        F.concat(count, F.lit(" events in "), window, F.lit(" window")).alias("matched_pattern"),
        "event_seq",
    )


MAX_BROADCAST_FIRED = 100_000


def detect_thresholds(
    ev: DataFrame, rules: Sequence[tuple[int, ThresholdRule]], salts: int | None = None, scope: Sequence[str] = ()
) -> DataFrame:
    """At most one alert per rule and group, on the first event that reaches the threshold.

    ``scope`` names columns that keep events apart, such as the file they came from.
    Only narrow rows go through the windows; the full events are fetched afterwards, once
    for all rules, for the few that fired: a stored table, broadcast while it is small. Beyond
    that a Bloom filter of their numbers drops nearly all other events in the scan.
    """
    fired = materialize(reduce(DataFrame.unionByName, [_fired(ev, r, i, salts, scope) for i, r in rules]))
    events = ev.select(*_EVENT_PART)
    if fired.count() <= MAX_BROADCAST_FIRED:
        found = events.join(F.broadcast(fired), "event_seq")
    else:
        found = where_maybe(events, fired, ["event_seq"]).join(fired, "event_seq")
    return found.withColumn("ip_group", group_of(F.col("ip"))).select(*ALERT_COLUMNS)


def detect_threshold(
    ev: DataFrame, rule: ThresholdRule, rule_ordinal: int = 1, salts: int | None = None
) -> DataFrame:
    return detect_thresholds(ev, [(rule_ordinal, rule)], salts)


def threshold_text(description: str, count: Column, group: Column, window: Column) -> Column:
    return F.concat(
        F.lit(f"{description} ("), count, F.lit(" events from "), group, F.lit(" in "), window, F.lit(")")
    )


def detect_all(
    ev: DataFrame, rules: Sequence[Rule] = RULES, salts: int | None = None, scope: Sequence[str] = ()
) -> DataFrame:
    """Regex alerts and threshold alerts of a rule list, ordered by ``alert_order``."""
    parts = [detect_regex(ev, rules)] if regex_rules(rules) else []
    windowed = threshold_rules(rules)
    parts += [detect_thresholds(ev, windowed, salts, scope)] if windowed else []
    return reduce(DataFrame.unionByName, parts)


def alerts_by_event(al: DataFrame) -> DataFrame:
    """Regex alerts per event key, run-length encoded.

    Equal keys repeat the same rule; a row per (key, rule) with its count holds the
    whole result and cannot grow into one oversized list.
    """
    return al.where("phase = 0").groupBy(*KEY_COLUMNS, "rule_id", "rule_ordinal").agg(
        F.count(F.lit(1)).alias("alert_count"),
        F.min("event_seq").alias("first_event_seq"),
    )


def alerts_by_category(al: DataFrame) -> DataFrame:
    return al.groupBy("category").agg(F.count(F.lit(1)).alias("alert_count"))


def severity_counts() -> list[Column]:
    """Aggregates: one zero-filled counter per severity."""
    return [F.count_if(F.col("severity") == s).alias(s) for s in SEVERITY_LEVELS]


def alerts_by_severity(al: DataFrame) -> DataFrame:
    """Four rows, zero-filled; severities outside the scale are ignored."""
    totals = al.agg(*severity_counts())
    pairs = ", ".join(f"'{s}', {s}" for s in SEVERITY_LEVELS)
    return totals.selectExpr(f"stack({len(SEVERITY_LEVELS)}, {pairs}) as (severity, alert_count)")
