"""Live feeds: growing files, numbers over batches, running totals, dropped rows."""

import json

from pyspark.sql import functions as F

from sample_logs import web_lines
from tracehound.operators.rules import ThresholdRule, failed_auth
from tracehound.plans.analyze import analyze_files
from tracehound.sources.lines import scan_log_lines
from tracehound.streaming import live, stateful
from test_stateful import events_of, run_in_batches

KEPT = ["ts", "ip", "method", "endpoint", "status_code", "raw_line", "line_number"]


def feed(spark, folder, out, **options):
    q = live.start_stream(spark, str(folder), f"{out}/feeds", f"{out}/ck", available_now=True, **options)
    q.awaitTermination()
    return lambda name: live.read_feed(spark, f"{out}/feeds", name)


def test_a_growing_file_equals_the_batch_read(spark, tmp_path):
    src = tmp_path / "in"
    (src / "sub").mkdir(parents=True)
    web = web_lines()
    old = src / "old.log"
    old.write_text("\n".join(web[:3]) + "\n")
    feed(spark, src, tmp_path, tail=True)  # existing content is passed over
    text = "\n".join(web) + "\n"
    grown = src / "sub" / "access.log"
    cuts = [0, text.index(web[5]) + 20, text.index(web[9]), len(text)]  # once in the middle of a line
    for a, b in zip(cuts, cuts[1:]):
        with open(grown, "a") as f:
            f.write(text[a:b])
        if a == 0:
            with open(old, "a") as f:
                f.write(web[3] + "\n")
        read = feed(spark, src, tmp_path, tail=True)
    events = read("events")
    want = analyze_files(spark, str(grown))["events"].select(*KEPT).collect()
    got = events.where(F.col("source_file").endswith("access.log")).select(*KEPT).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and len(got) == len(web)
    assert [r["raw_line"] for r in events.where(F.col("source_file").endswith("old.log")).collect()] == [web[3]]
    assert events.select("event_seq").distinct().count() == events.count() == len(web) + 1
    assert read("batches").agg(F.max("events_total")).first()[0] == len(web) + 1


def test_splits_share_no_line(spark, tmp_path):
    """Splits of a few bytes: every line belongs to the split it begins in."""
    (tmp_path / "in").mkdir()
    lines = ["", "x", "long line " * 9, "", "", "ünï", "end"]
    (tmp_path / "in" / "a.log").write_text("\n".join(lines * 5) + "\ncut")
    from tracehound.sources.tail import stream_tail

    for split in (1, 7, 64):
        text = stream_tail(spark, str(tmp_path / "in"), "read", split)
        q = (text.writeStream.format("parquet").option("path", f"{tmp_path}/o{split}").option("checkpointLocation", f"{tmp_path}/c{split}").trigger(availableNow=True).start())
        q.awaitTermination()
        rows = spark.read.parquet(f"{tmp_path}/o{split}").withColumn("at", F.monotonically_increasing_id()).orderBy("_block", "at").collect()
        assert [r["text"] for r in rows] == lines * 5


def test_many_short_files_are_one_task(tmp_path):
    from tracehound.sources.tail import TailReader

    for i in range(50):
        (tmp_path / f"{i:02}.log").write_text(f"a{i}\nb{i}\ncut")
    reader = TailReader(str(tmp_path), "read", 1 << 20)
    parts = reader.partitions(reader.initialOffset(), reader.latestOffset())
    assert len(parts) == 1
    rows = [r for batch in reader.read(parts[0]) for r in batch.to_pylist()]
    assert [r["value"] for r in rows] == [f"{c}{i}" for i in range(50) for c in "ab"]
    assert [r["source_file"][-6:] for r in rows[::2]] == [f"{i:02}.log" for i in range(50)] and {r["block_start"] for r in rows} == {0}


def test_a_file_that_shrinks_is_read_from_its_start(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    web = web_lines()
    (src / "a.log").write_text("\n".join(web[:8]) + "\n")
    feed(spark, src, tmp_path, tail=True, existing="read")
    (src / "a.log").write_text("\n".join(web[8:10]) + "\n")
    read = feed(spark, src, tmp_path, tail=True, existing="read")
    assert sorted(r["raw_line"] for r in read("events").collect()) == sorted(web[:10])


def test_array_elements_of_two_batches_have_numbers_of_their_own(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    for part in range(2):
        (src / f"{part}.json").write_text(json.dumps([{"timestamp": "2026-01-01T00:00:00Z", "ip": "1.2.3.4", "user": f"u{part}{i}"} for i in range(4)]))
        read = feed(spark, src, tmp_path)
    events = read("events")
    assert events.count() == 8 and events.select("event_seq").distinct().count() == 8
    assert sorted(r["user"] for r in live.stream_latest(events, 3).collect()) == ["u11", "u12", "u13"]


def test_totals_and_dropped_rows(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    web = web_lines()
    (src / "1.log").write_text("\n".join(web[:6]))
    (src / "2.log").write_text("what is this\n" * 5)
    feed(spark, src, tmp_path)
    (src / "3.log").write_text("\n".join(web[6:12]))
    read = feed(spark, src, tmp_path)
    log = live.ProgressLog(spark, f"{tmp_path}/progress")
    rule = ThresholdRule("R", "c", "LOW", "d", failed_auth, 3, 100)
    ev = events_of(spark, [(0, "a", 401), (5000, "a", 401), (10, "a", 401), (20, "a", 200), (4999, "b", 401)])
    spark.streams.addListener(log)
    try:
        run_in_batches(spark, f"{tmp_path}/s", [[ev.where("event_seq < 2"), ev.where("event_seq >= 2")]], lambda e: stateful.stream_threshold(e, rule, "1 minute"))
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    finally:
        spark.streams.removeListener(log)
    progress = spark.read.parquet(f"{tmp_path}/progress")
    assert progress.agg(F.sum("dropped_rows")).first()[0] == 1
    last = live.stream_stats(read("batches"), read("files"), progress).orderBy("epoch").collect()[-1]
    assert (last["files_watched"], last["events_processed"], last["alerts_generated"], last["rows_dropped"]) == (2, 12, 4, 1)


def test_numbers_need_no_shuffle_of_the_text(spark, tmp_path):
    (tmp_path / "a.log").write_text("\n".join(f"line {i}" for i in range(500)))
    plan = scan_log_lines(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning(source_file" not in plan
