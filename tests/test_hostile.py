"""Input that must not end a job or bend a result."""

import json

from pyspark.sql import functions as F

from tracehound.functions import decode as d
from tracehound.operators.parse_auth import parse_ts_syslog
from tracehound.operators.parse_json import parse_ts_iso
from tracehound.operators.parse_web import parse_web_access
from tracehound.sources.json_layouts import json_layout, json_objects


def lines_of(spark, files):
    rows, seq = [], 0
    for name, text in files.items():
        for no, line in enumerate(text.split("\n"), 1):
            rows.append((seq, name, no, line))
            seq += 1
    return spark.createDataFrame(rows, "event_seq long, source_file string, line_number long, line string")


def test_oversized_character_reference(spark):
    df = spark.createDataFrame([("a&#99999999999999999999999;b&#65;&#65601;",)], "t string")
    got = df.select(d.decode_html_entities(F.col("t")).alias("o")).first()["o"]
    assert got == "a" + chr(int("99999999999999999999999") % 65536) + "bAA"


def test_epochs_out_of_range_are_null(spark):
    df = spark.createDataFrame([("1700000000000",), ("1700000000000000000",), ("1700000000000000",), ("99999999999999999999999",)], "t string")
    got = [r[0] is None for r in df.select(parse_ts_iso(F.col("t"))).collect()]
    assert got == [False, True, True, True]


def test_leap_day_of_last_year(spark):
    now = F.lit("2025-01-10 00:00:00").cast("timestamp")
    df = spark.createDataFrame([("Feb", "29", "10:00:00"), ("Jan", "9", "10:00:00")], "m string, d string, c string")
    got = [str(r[0]) for r in df.select(parse_ts_syslog(F.col("m"), F.col("d"), F.col("c"), now)).collect()]
    assert got == ["2024-02-29 10:00:00", "2025-01-09 10:00:00"]


def test_line_numbers_beyond_32_bits(spark):
    line = '192.0.2.9 - - [01/Mar/2025:10:00:00 +0000] "GET /a HTTP/1.1" 200 5 "-" "x"'
    df = spark.createDataFrame([(0, "f.log", 3_000_000_000, line)], "event_seq long, source_file string, line_number long, line string")
    assert parse_web_access(df).first()["line_number"] == 3_000_000_000


def test_array_elements_never_share_a_number(spark):
    one_line = json.dumps([{"user": f"u{i}"} for i in range(6)])
    files = {"a.json": one_line, "b.json": "\n".join(json.dumps({"user": f"v{i}"}) for i in range(8)), "c.json": one_line}
    rows = json_objects(lines_of(spark, files)).collect()
    assert len(rows) == 20 and len({r.event_seq for r in rows}) == 20
    for name in files:
        own = sorted((r for r in rows if r.source_file == name), key=lambda r: r.event_seq)
        assert [r.line_number for r in own] == list(range(1, len(own) + 1))


def test_bracket_line_above_objects(spark):
    text = "[boot] service started\n" + "\n".join(json.dumps({"user": f"u{i}"}) for i in range(10))
    lines = lines_of(spark, {"a.json": text})
    assert json_layout(lines).first()["layout"] == "ndjson"
    assert json_objects(lines).count() == 10
