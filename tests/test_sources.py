"""Files, layouts, formats, incidents, timeline, enrichment, streaming."""

import json
import os

import pytest
from pyspark.sql import functions as F

from sample_logs import PROBER, app_objects, auth_lines, web_lines, write_all
from tracehound.functions.ips import ip_to_long, is_private_ip
from tracehound.functions.labels import human_size
from tracehound.operators import formats as fo
from tracehound.operators import timeline as tl
from tracehound.operators.enrich import enrich
from tracehound.operators.parse_auth import parse_auth_syslog
from tracehound.operators.parse_json import canonical_json, json_object, parse_json
from tracehound.operators.parse_web import parse_web_access
from tracehound.operators.rules import ThresholdRule, failed_auth
from tracehound.plans.analyze import Options, analyze_files
from tracehound.runtime import number_rows
from tracehound.sources import incidents as inc
from tracehound.sources.json_layouts import json_layout, json_objects
from tracehound.sources.lines import file_catalog, scan_log_lines
from tracehound.streaming import live, stateful


def lines(spark, *files):
    rows = [(f * 1000 + i, f"f{f}", i, t) for f, text in enumerate(files) for i, t in enumerate(text, 1)]
    return spark.createDataFrame(rows, "event_seq long, source_file string, line_number long, line string")


def now():
    return F.lit("2026-12-01 00:00:00").cast("timestamp")


# ---- files ---------------------------------------------------------------------------


def test_line_numbers_across_blocks(spark, tmp_path):
    text = [f"line {i}" if i % 7 else "" for i in range(1, 5001)]
    (tmp_path / "big.log").write_text("\n".join(text))
    (tmp_path / "a.log").write_text("  x  \r\n\ny")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = scan_log_lines(spark, str(tmp_path)).orderBy("event_seq").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [(r["line_number"], r["line"]) for r in rows[:2]] == [(1, "x"), (3, "y")]
    big = [(r["line_number"], r["line"]) for r in rows[2:]]
    assert big == [(i, t) for i, t in enumerate(text, 1) if t]


def test_file_catalog(spark, tmp_path):
    (tmp_path / "a.log").write_text("x" * 300 + "\n\ny\n")
    (tmp_path / "b.TXT").write_text("short")
    (tmp_path / "c.bin").write_text("no")
    rows = {r["filename"]: r for r in file_catalog(spark, str(tmp_path)).collect()}
    assert set(rows) == {"a.log", "b.TXT"}
    assert rows["a.log"]["lines"] == 2 and rows["a.log"]["preview"] == "x" * 200 + "..."
    assert rows["b.TXT"]["size_human"] == "5.0 B" and rows["b.TXT"]["preview"] == "short"


def test_human_size(spark):
    df = spark.createDataFrame([(0,), (512,), (2048,), (5 * 1024**3,)], "n long")
    assert [r[0] for r in df.select(human_size(F.col("n"))).collect()] == ["0 B", "512.0 B", "2.0 KB", "5120.0 MB"]


# ---- JSON ----------------------------------------------------------------------------


def test_layouts(spark):
    objects = app_objects() * 3
    nested = [{"a": [{"b": 1}, {"b": "x}\n{"}], "user": "u"}, {"c": {"d": 2}}]
    df = lines(
        spark,
        [json.dumps(o) for o in objects] + ["broken {", '{"a": 1'],
        "\n".join(json.dumps(o, indent=4) for o in objects + nested).split("\n"),
        json.dumps(objects, indent=2).split("\n"),
        [json.dumps(objects)],
    )
    kinds = {r["source_file"]: r["layout"] for r in json_layout(df).collect()}
    assert kinds == {"f0": "ndjson", "f1": "objects", "f2": "array", "f3": "array"}
    got = {r["source_file"]: r["count"] for r in json_objects(df).groupBy("source_file").count().collect()}
    assert got == {"f0": 6, "f1": 8, "f2": 6, "f3": 6}


def test_objects_over_block_borders(spark, monkeypatch):
    from tracehound.sources import json_layouts

    monkeypatch.setattr(json_layouts, "_BLOCK_LINES", 4)
    text = "\n".join(json.dumps(o, indent=4) for o in app_objects()).split("\n")
    rows = json_objects(lines(spark, text)).orderBy("line_number").collect()
    assert [json.loads(r["line"]) for r in rows] == app_objects()


def test_json_object_and_canonical(spark):
    texts = ['{"a": 1, "a": 2}', '{"a": 1', "[1]", "3", '{"x": {"y": [1, 2]}, "n": null}']
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(json_object(F.col("t"))).collect()]
    assert got == [{"a": "2"}, None, None, None, {"x": '{"y":[1,2]}', "n": None}]
    raw = '{ "a" : "x  y\\"  z", "b": "\\u003cb\\u003e \\/etc\\/ \\\\/ \\u0022" ,\n "c": 1 }'
    got = spark.createDataFrame([(raw,)], "t string").select(canonical_json(F.col("t"))).first()[0]
    assert got == '{"a":"x  y\\"  z","b":"<b> /etc/ \\\\/ \\u0022","c":1}'


def test_json_fields(spark):
    df = lines(spark, [
        '{"time": 1773522150000, "msg": "", "text": "t", "status": "404x", "verb": "get", "url": "/%61", "severity": "FATAL"}',
        '{"timestamp": "junk", "status": 0, "user_id": 7, "k": [1]}',
        '{"ip": "", "src_ip": "1.2.3.4"}',
    ])
    a, b, c = parse_json(df, now()).orderBy("event_seq").collect()
    assert str(a["ts"]) == "2026-03-14 21:02:30" and a["metadata"] == {"message": "t", "rawEndpoint": "/%61"}
    assert (a["status_code"], a["method"], a["endpoint"], a["log_level"]) == (404, "GET", "/a", "error")
    assert b["ts"] is None and b["status_code"] is None and b["user"] == "7" and b["metadata"]["k"] == "[1]"
    assert c["ip"] == "1.2.3.4" and str(c["ts"]) == "2026-12-01 00:00:00" and c["log_level"] == "info"


# ---- web and auth --------------------------------------------------------------------


def test_web_edges(spark):
    good = '1.1.1.1 - bob [5/Apr/2026:08:02:15 +0530] "GET /a%20b HTTP/1.1" 404 12 "http://r/" "UA" extra'
    unit = good.replace("bob", "b\x1fob")
    bad = ['1.1.1.1 - - [x] "GET /a b HTTP/1.1" 200 1 "-" "-"', "", "junk"]
    rows = parse_web_access(lines(spark, [good, unit, *bad])).orderBy("event_seq").collect()
    assert len(rows) == 2
    assert (rows[0]["user"], rows[0]["endpoint"], rows[0]["log_level"], str(rows[0]["ts"])) == ("bob", "/a b", "warn", "2026-04-05 02:32:15")
    assert rows[1]["user"] == "b\x1fob" and rows[1]["metadata"]["referer"] == "http://r/"


def test_auth_edges(spark):
    text = [
        "Dec  5 01:00:00 h sshd[1]: Failed password for bob from 1.1.1.1 port 2 ssh2",
        "Foo  5 01:00:00 h sshd: hello",
        "Nov 30 23:59:59 h cron: maximum authentication attempts exceeded for x from y port 1",
    ]
    a, b, c = parse_auth_syslog(lines(spark, text), now()).orderBy("event_seq").collect()
    assert str(a["ts"]) == "2025-12-05 01:00:00" and str(c["ts"]) == "2026-11-30 23:59:59"
    assert b["ts"] is None and b["metadata"]["rawMessage"] == "hello" and b["metadata"]["pid"] is None
    assert c["status_code"] == 429


# ---- formats -------------------------------------------------------------------------


def test_detection_scores(spark):
    web, auth = web_lines(), auth_lines()
    df = lines(spark, web[:5] + ["junk"] * 5, web[:4] + ["junk"] * 6, auth, [json.dumps(o) for o in app_objects()],
               ["{ not json"], ["junk"] * 10 + web)
    got = {r["source_file"]: (r["format"], r["confidence"]) for r in fo.detect_format(df).collect()}
    assert got == {"f0": ("nginx", 50), "f1": (None, 40), "f2": ("auth", 100), "f3": ("json", 80), "f4": (None, 10), "f5": (None, 0)}
    errors = {r["source_file"]: r["error"] for r in fo.detect_format(df).collect()}
    assert errors["f5"].startswith("Could not auto-detect log format. Best guess: none (confidence: 0%)")


def test_forced_and_unknown_format(spark):
    df = lines(spark, web_lines())
    assert fo.parse_auto(df, "auth").count() == 0
    with pytest.raises(ValueError, match="Unknown format"):
        fo.parse_as(df, "xml")


# ---- incidents -----------------------------------------------------------------------


def test_incident_round_trip(spark, tmp_path):
    folder = write_all(tmp_path / "logs")
    root = str(tmp_path / "store")
    opt = Options(parse={"auth": {"ref_now": now()}, "json": {"now": now()}})
    tables = analyze_files(spark, str(folder / "shop-access.log"), opt)
    at = lambda d: F.lit(f"2026-05-{d:02d} 00:00:00").cast("timestamp")
    inc.save_incident(tables, root, "one", at(1))
    inc.save_incident(tables, root, "20260502", at(2))
    inc.save_incident(tables, root, "one", at(3))
    listed = inc.incident_list(inc.read_table(spark, root)).collect()
    assert [r["incident_id"] for r in listed] == ["one", "20260502"]
    assert listed[0]["total_alerts"] == 4 and listed[0]["top_attacker_ip"] == PROBER
    row = inc.incident_get(spark, root, "one").first()
    assert [t["type"] for t in row["attack_types"]][:2] == ["SQL Injection", "Path Traversal"]
    assert inc.incident_get(spark, root, "one", "alerts").count() == 4
    assert inc.incident_get(spark, root, "nope").count() == 0
    assert inc.incident_count(inc.read_table(spark, root)).first()[0] == 2
    assert inc.incident_delete(spark, root, "one") is True
    assert inc.incident_delete(spark, root, "one") is False
    assert inc.incident_count(inc.read_table(spark, root)).first()[0] == 1


def test_a_failed_save_changes_nothing(spark, tmp_path):
    folder = write_all(tmp_path / "logs")
    root = str(tmp_path / "store")
    tables = analyze_files(spark, str(folder / "shop-access.log"), Options())
    inc.save_incident(tables, root, "a/b=c")
    rows = {t: inc.incident_get(spark, root, "a/b=c", t).count() for t in [*inc.DETAIL_TABLES, inc.INCIDENT_TABLE]}
    assert rows["alerts"] == 4 and rows["files"] == 1
    broken = {**tables, "chains": tables["events"].withColumn("x", F.raise_error(F.lit("full disk")))}
    with pytest.raises(Exception, match="full disk"):
        inc.save_incident(broken, root, "a/b=c")
    assert {t: inc.incident_get(spark, root, "a/b=c", t).count() for t in rows} == rows
    staged = spark.read.parquet(f"{root}/alerts").count()
    inc.incident_vacuum(spark, root)
    assert spark.read.parquet(f"{root}/alerts").count() == rows["alerts"] < staged
    inc.save_incident({**tables, "alerts": tables["alerts"].limit(1)}, root, "a/b=c")
    assert inc.incident_get(spark, root, "a/b=c", "alerts").count() == 1
    # rows just replaced stay for readers that have begun
    assert spark.read.parquet(f"{root}/alerts").count() == 1 + rows["alerts"]
    listed = inc.incident_list(inc.read_table(spark, root)).first()
    assert listed["alerts_by_severity"]["CRITICAL"] + listed["alerts_by_severity"]["HIGH"] > 0
    assert [t["type"] for t in listed["attack_types"]][:2] == ["SQL Injection", "Path Traversal"]


# ---- ordering ------------------------------------------------------------------------


def test_number_rows_with_ties(spark):
    df = spark.range(5000).selectExpr("id", "id % 3 as t").repartition(7)
    got = number_rows(df, "t", "id").orderBy("row_no").collect()
    assert [r["row_no"] for r in got] == list(range(1, 5001))
    assert [(r["t"], r["id"]) for r in got] == sorted((i % 3, i) for i in range(5000))


def test_deep_page_equals_top_k(spark):
    ev = spark.range(3000).selectExpr("id as event_seq", "timestamp_seconds((id * 7919) % 1000) as ts")
    for page in (1, 17, 30, 31):
        a = [(r["position"], r["event_seq"]) for r in tl.timeline_rows(ev, page, 100).collect()]
        b = [(r["position"], r["event_seq"]) for r in tl.timeline_rows(ev, page, 100, top_k_reach=0).collect()]
        assert sorted(a) == sorted(b) and len(a) == (100 if page <= 30 else 0)


# ---- addresses -----------------------------------------------------------------------


def test_private_ips(spark):
    cases = {"192.168.44.5": True, "127.0.0.1": True, "10.0.0.1": True, "8.8.8.8": False, "": True, "unknown": True,
             "172.15.0.1": False, "172.16.0.1": True, "172.31.9.9": True, "172.32.0.1": False, "0.0.0.0": True,
             "0.0.0.1": False, "1.2.3": True, "1.2.3.4.5": True, "a.b.c.d": False}
    df = spark.createDataFrame([(k,) for k in cases], "ip string")
    assert {r["ip"]: r["p"] for r in df.select("ip", is_private_ip(F.col("ip")).alias("p")).collect()} == cases


def test_enrich_ranges(spark):
    ips = spark.createDataFrame([("8.8.8.8",), ("8.9.0.1",), ("9.9.9.9",), ("10.0.0.1",), ("8.8.8.8",)], "ip string")
    wide, narrow = ("8.0.0.0", "8.255.255.255", "Wide"), ("8.8.0.0", "8.8.255.255", "")
    geo = spark.createDataFrame([wide, narrow], "a string, b string, country string").select(
        ip_to_long(F.col("a")).alias("start"), ip_to_long(F.col("b")).alias("end"), "country",
        *[F.lit(None).cast("string").alias(c) for c in ("city", "isp", "org", "as_name")],
        F.lit(1.5).alias("lat"), F.lit(None).cast("double").alias("lon"))
    got = {r["ip"]: (r["country"], r["lat"], r["lon"], r["enrichment_error"] is None) for r in enrich(ips, geo, by="range").collect()}
    assert got == {"8.8.8.8": ("Unknown", 1.5, 0.0, True), "8.9.0.1": ("Wide", 1.5, 0.0, True),
                   "9.9.9.9": ("Unavailable", 0.0, 0.0, False), "10.0.0.1": ("Private Network", 0.0, 0.0, True)}


# ---- streaming -----------------------------------------------------------------------


def test_live_feeds(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    web = web_lines()
    (src / "1.log").write_text("\n".join(web[:6]))
    (src / "2.log").write_text("what is this\n" * 5)
    (src / ".hidden.log").write_text("\n".join(web))

    def run():
        q = live.start_stream(spark, str(src), out, str(tmp_path / "ck"), available_now=True)
        q.awaitTermination()
        return live.read_feed(spark, out, "events"), live.read_feed(spark, out, "alerts")

    ev, al = run()
    assert ev.count() == 6 and [r["rule_id"] for r in al.collect()] == ["BRUTE_FORCE_LOGIN"]
    (src / "3.log").write_text("\n".join(web[6:12]))
    ev, al = run()
    assert ev.count() == 12 and al.count() == 4
    assert ev.select("event_seq").distinct().count() == 12
    batches, files = (live.read_feed(spark, out, feed) for feed in ("batches", "files"))
    last = live.stream_stats(batches, files).orderBy("epoch").collect()[-1]
    assert (last["files_watched"], last["events_processed"], last["alerts_generated"]) == (2, 12, 4)
    assert live.stream_latest(ev, 2).count() == 2


def test_stateful_threshold_across_batches(spark, tmp_path):
    schema = "event_seq long, ts timestamp, ip string, endpoint string, raw_line string, status_code int"
    src = tmp_path / "in"
    rows = [(0, "a"), (10, "b"), (70, "a"), (80, "a"), (90, "b"), (400, "a"), (410, "a"), (420, "a"), (430, "a"), (9000, "b"), (9001, "b")]
    df = spark.createDataFrame([(i, t, ip) for i, (t, ip) in enumerate(rows)], "event_seq long, t long, ip string").selectExpr(
        "event_seq", "timestamp_seconds(t) as ts", "ip", "'/login' as endpoint", "'' as raw_line", "401 as status_code")
    for part in range(3):
        df.where(F.col("event_seq").between(part * 4, part * 4 + 3)).coalesce(1).write.mode("append").parquet(str(src))
    # one file per batch, oldest first
    for i, f in enumerate(sorted((p for p in src.iterdir() if p.suffix == ".parquet"), key=os.path.getmtime)):
        os.utime(f, (1_000_000 + i * 10, 1_000_000 + i * 10))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src))
    rule = ThresholdRule("R", "c", "LOW", "d", failed_auth, 4, 340)
    got = stateful.stream_threshold(stream, rule, "10 seconds")
    q = (got.writeStream.format("parquet").option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "c"))
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    fired = {r["grp"]: r["event_seq"] for r in spark.read.parquet(str(tmp_path / "o")).collect()}
    # a: seconds 70, 80, 400, 410 are 340 apart, from two batches; b never has four
    assert fired == {"a": 6}


def test_stateful_threshold_with_late_events(spark, tmp_path):
    schema = "event_seq long, ts timestamp, ip string, endpoint string, raw_line string, status_code int"
    # a: the late event completes a crossing that ends on a remembered one; c: so does it, behind threshold - 1 newer ones
    batches = [[(0, "a"), (60, "a"), (120, "a"), (180, "a"), (0, "c"), (10, "c"), (20, "c"), (290, "c"), (590, "c")], [(90, "a"), (30, "c"), (15, "c"), (95, "b")], [(90_000, "z")]]
    rule = ThresholdRule("R", "c", "LOW", "d", failed_auth, 5, 200)
    source, got, seq = str(tmp_path / "in"), None, 0
    for batch in batches:
        rows = [(seq + i, t, ip) for i, (t, ip) in enumerate(batch)]
        seq += len(rows)
        spark.createDataFrame(rows, "event_seq long, t long, ip string").selectExpr(
            "event_seq", "timestamp_seconds(1000 + t) as ts", "ip", "'/login' as endpoint", "'' as raw_line", "401 as status_code").write.mode("append").parquet(source)
        got = stateful.stream_threshold(spark.readStream.schema(schema).parquet(source), rule, "10 minutes")
        (got.writeStream.format("parquet").option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "c"))
         .outputMode("append").trigger(availableNow=True).start().awaitTermination())
    fired = sorted((r["grp"], r["event_seq"]) for r in spark.read.schema(got.schema).parquet(str(tmp_path / "o")).collect())
    assert fired == [("a", 3), ("c", 10)]
