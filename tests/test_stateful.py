"""Stateful rules against the batch operators, for events in any order within the watermark."""

import random

import pytest
from pyspark.sql import functions as F

from tracehound.operators.chains import attack_chains
from tracehound.operators.detect import detect_threshold
from tracehound.operators.rules import ThresholdRule, failed_auth
from tracehound.schema import group_of
from tracehound.streaming import stateful

SCHEMA = "event_seq long, t long, ip string, status_code int"


def events_of(spark, rows):
    """(second, address, status) rows as events."""
    rows = [(i, t, ip, status) for i, (t, ip, status) in enumerate(rows)]
    return spark.createDataFrame(rows, SCHEMA).selectExpr(
        "event_seq", "timestamp_seconds(1000000 + t) as ts", "ip", "'/login' as endpoint", "'app' as source", "'' as raw_line", "status_code")


def run_in_batches(spark, folder, tables, make):
    """Land the parts of all tables batch by batch; run the same stream after each."""
    # every partition of state starts a worker in every batch
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        return _run_in_batches(spark, folder, tables, make)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def _run_in_batches(spark, folder, tables, make):
    result = None
    for part in range(len(tables[0])):
        for i, parts in enumerate(tables):
            parts[part].coalesce(1).write.mode("append").parquet(f"{folder}/in{i}")
        result = make(*[spark.readStream.schema(parts[0].schema).parquet(f"{folder}/in{i}") for i, parts in enumerate(tables)])
        query = (result.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/offsets")
                 .outputMode("append").trigger(availableNow=True).start())
        query.awaitTermination()
    return spark.read.schema(result.schema).parquet(f"{folder}/out")


def shuffled_parts(ev, rows, n, delay, seed, final):
    """Events by the batch they arrive in: up to ``delay`` seconds late; then the end marker."""
    r = random.Random(seed)
    arrival = [t + r.uniform(0, delay) for t, *_ in rows]
    size = max(t for t, *_ in rows) / n
    batch = [min(n - 1, int(a / size)) for a in arrival]
    parts = [ev.where(F.col("event_seq").isin([i for i, b in enumerate(batch) if b == part])) for part in range(n)]
    return [*parts, stateful.end_of_input(ev.sparkSession, ev.schema, final)]


@pytest.mark.parametrize("seed", [1, 2])
def test_threshold_equals_the_batch_rule_in_any_order(spark, tmp_path, seed):
    r = random.Random(seed)
    rows = sorted((r.randrange(3000), r.choice("abcdefg"), r.choice([401, 401, 200])) for _ in range(260))
    rule = ThresholdRule("R", "c", "LOW", "d", failed_auth, 5, 90)
    ev = events_of(spark, rows)
    want = sorted((x["ip"], x["event_seq"]) for x in detect_threshold(ev, rule).collect())
    parts = shuffled_parts(ev, rows, 5, 400, seed, "2030-01-01 00:00:00")
    got = run_in_batches(spark, str(tmp_path), [parts], lambda e: stateful.stream_threshold(e, rule, "450 seconds"))
    assert sorted((x["grp"], x["event_seq"]) for x in got.collect()) == want and want


def test_an_alert_waits_for_the_watermark(spark, tmp_path):
    """The batch rule would fire on event 7; the four before it arrive a batch later."""
    rule = ThresholdRule("R", "c", "LOW", "d", failed_auth, 3, 100)
    first = [(500, "a", 401), (510, "a", 401), (520, "a", 401)]
    second = [(100, "a", 401), (110, "a", 401), (120, "a", 401), (5000, "b", 200)]
    ev = events_of(spark, first + second)
    parts = [ev.where("event_seq < 3"), ev.where("event_seq >= 3")]
    got = run_in_batches(spark, str(tmp_path), [parts], lambda e: stateful.stream_threshold(e, rule, "1000 seconds"))
    assert [(x["grp"], x["event_seq"]) for x in got.collect()] == [("a", 5)]


def test_a_group_fires_once_or_again_after_a_while(spark, tmp_path):
    rule = ThresholdRule("R", "c", "LOW", "d", failed_auth, 2, 10)
    rows = [(0, "a", 401), (1, "a", 401), (50, "a", 401), (51, "a", 401), (5000, "a", 401), (5001, "a", 401)]
    ev = events_of(spark, rows)
    parts = lambda: [ev.where("event_seq < 2"), ev.where("event_seq in (2, 3)"), ev.where("event_seq > 3"), stateful.end_of_input(spark, ev.schema, "2030-01-01 00:00:00")]
    once = run_in_batches(spark, f"{tmp_path}/a", [parts()], lambda e: stateful.stream_threshold(e, rule, "1 second"))
    assert [x["event_seq"] for x in once.collect()] == [1]
    again = run_in_batches(spark, f"{tmp_path}/b", [parts()], lambda e: stateful.stream_threshold(e, rule, "1 second", rearm_seconds=1000))
    assert sorted(x["event_seq"] for x in again.collect()) == [1, 5]


def test_chains_equal_the_batch_chains(spark, tmp_path):
    """The alert of an address may come after its session; addresses without one give none."""
    r = random.Random(4)
    rows = sorted((r.randrange(4000), r.choice("abcd"), r.choice([401, 200, 200])) for _ in range(120))
    rows += [(4100, "a", 401), (4400, "a", 401), (4701, "a", 401)]  # exactly the window apart, then one second more
    ev = events_of(spark, rows)
    al = ev.where("event_seq in (100, 110) or (ip = 'a' and event_seq = 120)").where("ip <> 'd'").select(
        F.lit(0).alias("phase"), F.lit(1).alias("rule_ordinal"), F.col("event_seq").alias("ord_major"), F.lit(1).cast("long").alias("ord_minor"),
        F.lit("R").alias("rule_id"), F.lit("XSS").alias("category"), F.lit("LOW").alias("severity"), F.lit("").alias("description"), F.lit("").alias("matched_pattern"),
        "event_seq", "ts", "ip", group_of(F.col("ip")).alias("ip_group"), "endpoint", "source", "raw_line")
    want = sorted(map(tuple, attack_chains(ev, al, 300, 2).select("ip", "start_time", "end_time", "event_count").collect()))
    end = "2030-01-01 00:00:00"
    alerts = [al.where("event_seq < 0"), al.where("event_seq < 0"), al.where("event_seq < 0"), al, stateful.end_of_input(spark, al.schema, end)]
    parts = shuffled_parts(ev, rows, 4, 300, 4, end)
    got = run_in_batches(spark, str(tmp_path), [parts, alerts], lambda e, a: stateful.stream_chains(e, a, 300, 2, "2 hours", "3 hours"))
    assert sorted(map(tuple, got.collect())) == want and len(want) > 3
    assert {w[0] for w in want} <= set("abc")


def alerts_at(spark, rows):
    """(second, address, endpoint) rows as alerts."""
    rows = [(i, t, ip, endpoint) for i, (t, ip, endpoint) in enumerate(rows)]
    return spark.createDataFrame(rows, "event_seq long, t long, ip string, endpoint string").selectExpr(
        "event_seq", "timestamp_seconds(1000000 + t) as ts", "ip", "ip as ip_group", "endpoint", "'app' as source")


def test_a_rejected_event_needs_an_alert_within_the_horizon(spark, tmp_path):
    r = random.Random(9)
    rows = [(t, r.choice("ab"), 401) for t in range(0, 9000, 30)]
    about = [(r.randrange(9000), r.choice("ab"), "/other") for _ in range(9)]
    ev, al = events_of(spark, rows), alerts_at(spark, [*about, (rows[40][0] + 640, rows[40][1], "/other")])
    near = [*about, (rows[40][0] + 640, rows[40][1], "")]
    want = sorted((ip, t + 1000000) for t, ip, _ in rows if any(a == ip and abs(at - t) <= 640 for at, a, _ in near))
    end = "2030-01-01 00:00:00"
    parts = [ev.where("event_seq < 150"), ev.where("event_seq >= 150"), stateful.end_of_input(spark, ev.schema, end)]
    alerts = [al.where("ts < timestamp_seconds(1004500)"), al.where("ts >= timestamp_seconds(1004500)"), stateful.end_of_input(spark, al.schema, end)]
    got = run_in_batches(spark, str(tmp_path), [parts, alerts], lambda e, a: stateful.stream_chains(e, a, 1, 1, "1 minute", "640 seconds"))
    assert sorted((x["ip"], int(x["start_time"].timestamp())) for x in got.collect()) == want and 0 < len(want) < len(rows)


def test_alerts_of_a_busy_address_do_not_pile_up_in_the_joins(spark, tmp_path):
    """600 alerts at 30 times: a join that holds them all looks at each for each event."""
    ev = events_of(spark, [(t, "a", 401) for t in range(5)])
    al = alerts_at(spark, [(t, "a", "/login") for t in range(30)] * 20)
    for name, df in (("ev", ev), ("al", al)):
        df.coalesce(1).write.parquet(f"{tmp_path}/{name}")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        streams = [spark.readStream.schema(df.schema).parquet(f"{tmp_path}/{name}") for name, df in (("ev", ev), ("al", al))]
        query = (stateful.stream_chains(*streams, horizon="1 hour").writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/offsets")
                 .outputMode("append").trigger(availableNow=True).start())
        query.awaitTermination()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    held = [o["numRowsTotal"] for p in query.recentProgress for o in p["stateOperators"] if o["operatorName"] == "symmetricHashJoin"]
    assert held and max(held) <= 35
