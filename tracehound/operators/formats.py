"""Format detection per file, routing to parsers, and the parser registry."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracehound.functions.text import trim_blank
from tracehound.operators.parse_auth import is_syslog_line, parse_auth_syslog
from tracehound.operators.parse_json import json_object, parse_json
from tracehound.operators.parse_web import is_web_line, parse_web_access
from tracehound.runtime import materialize
from tracehound.schema import EVENT_COLUMNS
from tracehound.sources.json_layouts import EXTRA_BASE, json_objects
from tracehound.sources.lines import file_name

# Sample sizes in lines and the confidence a format needs.
SAMPLE_LINES = 10
JSON_SAMPLE_LINES = 50
MIN_CONFIDENCE = 50
JSON_CONFIDENCE = 80
JSON_DOUBT = 10
HEAD_LINES_PER_LINE = 4  # lines looked at for each line of the sample, blank ones included


@dataclass(frozen=True)
class LogFormat:
    """A per-line test and a parser from numbered lines to events.

    ``detect`` sees one line; the share of matching sample lines is the confidence.
    """

    name: str
    detect: Callable[[Column], Column]
    parse: Callable[..., DataFrame]


def _is_json_line(line: Column) -> Column:
    return json_object(line).isNotNull()


def _parse_json_lines(lines: DataFrame, extra_base: int = EXTRA_BASE, **options) -> DataFrame:
    return parse_json(json_objects(lines, extra_base), **options)


FORMATS: dict[str, LogFormat] = {
    "nginx": LogFormat("nginx", is_web_line, parse_web_access),
    "auth": LogFormat("auth", is_syslog_line, parse_auth_syslog),
    "json": LogFormat("json", _is_json_line, _parse_json_lines),
}


def register_format(
    formats: dict[str, LogFormat],
    name: str,
    detect: Callable[[Column], Column],
    parse: Callable[..., DataFrame],
) -> dict[str, LogFormat]:
    """Registry with one more format; a known name is replaced in place."""
    return {**formats, name: LogFormat(name, detect, parse)}


def _percent(hit: Column) -> Column:
    """Share of true values, rounded to whole percent, halves up."""
    return F.floor(F.avg(F.coalesce(hit, F.lit(False)).cast("double")) * 100 + 0.5).cast("int")


def _json_sample_parses() -> Column:
    """Whether the joined sample holds an object: as array, per line, or one after another."""
    sample = F.array_join(F.array_sort(F.collect_list(F.struct("line_number", "line")))["line"], "\n")
    as_array = F.size(F.from_json(sample, "array<string>")) > 0
    parts = F.split(sample, r"(?<=\})\s*\n(?=\{)")
    return F.coalesce(as_array, F.lit(False)) | F.exists(parts, lambda p: json_object(trim_blank(p)).isNotNull())


def _first_lines(lines: DataFrame, n: int) -> DataFrame:
    """The first ``n`` non-blank lines of each file with their rank ``_rn``.

    One pass without a sort: of each file the lines up to a fixed number are collected, which
    are enough unless many are blank. Only files for which they are not, though they go on,
    are ranked as a whole.
    """
    reach = HEAD_LINES_PER_LINE * n
    early = F.when(F.col("line_number") <= reach, F.struct("line_number", "line"))
    heads = materialize(lines.groupBy("source_file").agg(
        F.array_sort(F.collect_list(early)).alias("head"), F.max("line_number").alias("last")
    ))
    short = (F.size("head") < n) & (F.col("last") > reach)
    out = heads.where(~short).select("source_file", F.posexplode(F.slice("head", 1, n)).alias("_at", "l")).select(
        "source_file", "l.*", (F.col("_at") + 1).alias("_rn")
    )
    if heads.where(short).isEmpty():
        return out
    place = Window.partitionBy("source_file").orderBy("line_number")
    # rank filter: each task keeps only the first lines of a file before the shuffle
    ranked = lines.join(heads.where(short).select("source_file"), "source_file", "left_semi").withColumn("_rn", F.row_number().over(place))
    return out.unionByName(ranked.where(F.col("_rn") <= n).select(*out.columns))


def format_scores(
    lines: DataFrame, formats: dict[str, LogFormat] = FORMATS,
    sample: int = SAMPLE_LINES, json_sample: int = JSON_SAMPLE_LINES,
) -> DataFrame:
    """Confidence of every format for every file, from its first non-blank lines.

    All detectors are applied to one sample and scored in one aggregate.
    """
    head = _first_lines(lines, max(sample, json_sample))
    small = F.col("_rn") <= sample
    scores = []
    for name, fmt in formats.items():
        if name == "json":
            scores += [
                F.min_by(F.substring("line", 1, 1), "_rn").alias("_first"),
                _percent(F.when(F.col("_rn") <= json_sample, F.coalesce(fmt.detect(F.col("line")), F.lit(False)))).alias("_ratio"),
                _json_sample_parses().alias("_parses"),
            ]
        else:
            scores.append(
                F.floor(
                    F.avg(F.when(small, F.coalesce(fmt.detect(F.col("line")), F.lit(False)).cast("double"))) * 100 + 0.5
                ).cast("int").alias(name)
            )
    out = head.groupBy("source_file").agg(*scores)
    if "json" in formats:
        braces = F.col("_first").isin("{", "[")
        out = out.withColumn(
            "json",
            F.when(braces, F.when(F.col("_parses"), JSON_CONFIDENCE).otherwise(JSON_DOUBT)).otherwise(F.col("_ratio")),
        )
    return out.select("source_file", *formats)


def detect_format(
    lines: DataFrame, formats: dict[str, LogFormat] = FORMATS, min_confidence: int = MIN_CONFIDENCE,
    sample: int = SAMPLE_LINES, json_sample: int = JSON_SAMPLE_LINES,
) -> DataFrame:
    """Best format per file; ties keep the earlier registration.

    Files below the confidence limit keep their row with ``format`` NULL and an error.
    """
    scores = format_scores(lines, formats, sample, json_sample)
    best = F.greatest(*[F.col(n) for n in formats], F.lit(0))
    guess = F.coalesce(*[F.when((F.col(n) == best) & (best > 0), F.lit(n)) for n in formats])
    ok = best >= min_confidence
    return scores.select(
        "source_file", F.when(ok, guess).alias("format"), best.alias("confidence"),
        F.when(
            ~ok,
            F.concat(
                F.lit("Could not auto-detect log format. Best guess: "), F.coalesce(guess, F.lit("none")),
                F.lit(" (confidence: "), best.cast("string"),
                F.lit(f"%). Minimum required: {min_confidence}%. Supported formats: {', '.join(formats)}"),
            ),
        ).alias("error"),
    )


def parse_as(
    lines: DataFrame, fmt: str, formats: dict[str, LogFormat] = FORMATS, options: dict | None = None
) -> DataFrame:
    """Parse all lines with one named format."""
    if fmt not in formats:
        raise ValueError(f"Unknown format: {fmt}. Supported: {', '.join(formats)}")
    return formats[fmt].parse(lines, **(options or {})).select(*EVENT_COLUMNS)


def route_by_format(
    lines: DataFrame, formats: dict[str, LogFormat] = FORMATS, detected: DataFrame | None = None,
    options: dict[str, dict] | None = None,
) -> DataFrame:
    """Parse each file with its detected format; undetected files give no events.

    ``options`` holds keyword arguments per format, such as the reference time.
    """
    # one row per file, needed once per format; the optimizer broadcasts it while it is small
    found = materialize(detect_format(lines, formats) if detected is None else detected)
    found = found.where("format is not null").select("source_file", "format")
    present = {row[0] for row in found.select("format").distinct().collect()}  # at most the formats
    # each parser reads the lines once; formats that no file has are not parsed at all
    names = [name for name in formats if name in present] or list(formats)[:1]
    parts = []
    for name in names:
        own = lines.join(found.where(F.col("format") == name).select("source_file"), "source_file")
        parts.append(parse_as(own, name, formats, (options or {}).get(name)))
    return reduce(DataFrame.unionByName, parts)


def parse_auto(
    lines: DataFrame, fmt: str | None = None, formats: dict[str, LogFormat] = FORMATS,
    options: dict[str, dict] | None = None, detected: DataFrame | None = None,
) -> DataFrame:
    """Events of all files: by detection, or with a forced format."""
    if fmt:
        return parse_as(lines, fmt, formats, (options or {}).get(fmt))
    return route_by_format(lines, formats, detected, options)


def split_rejects(ev: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events with a valid time, and those without."""
    return ev.where("ts is not null"), ev.where("ts is null")


def file_parse_report(detected: DataFrame, ev: DataFrame) -> DataFrame:
    """Per file: name, format, confidence and event count, or the error."""
    counts = ev.groupBy("source_file").agg(F.count(F.lit(1)).alias("events"))
    return detected.join(counts, "source_file", "left").select(
        file_name(F.col("source_file")).alias("filename"), "source_file", "format",
        F.when(F.col("error").isNull(), F.col("confidence")).alias("confidence"),
        F.coalesce("events", F.lit(0)).alias("events"), "error",
    )
