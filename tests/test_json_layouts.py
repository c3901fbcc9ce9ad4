"""Layouts of JSON files end to end: lines, arrays, objects over lines, noise, long lines."""

import json
import pickle

import pyarrow as pa
import pytest

from test_hostile import lines_of
from tracehound.functions.json_scan import ObjectScan, State
from tracehound.sources import json_layouts
from tracehound.sources.json_layouts import EXTRA_BASE, json_layout, json_objects, scan_json_events

OBJECTS = [{"user": f"u{i}", "q": 'say "}{" \\', "deep": {"a": [1, {"b": "]["}]}} for i in range(9)]


def files():
    pretty = [json.dumps(o, indent=2) for o in OBJECTS]
    return {
        "lines.json": "\n".join(map(json.dumps, OBJECTS)),
        "banner.json": "[boot] service started\n" + "\n".join(pretty),
        "pairs.json": "\n".join(a + " " + b for a, b in zip(pretty[::2], pretty[1::2])) + "\n" + pretty[8],
        "touching.json": "".join(map(json.dumps, OBJECTS)),
        "array.json": json.dumps(OBJECTS, indent=1),
        "flat.json": json.dumps(OBJECTS),
        "cut.json": json.dumps(OBJECTS, indent=1)[:-3],
        "empty.json": "[ ]",
        "mixed.json": json.dumps([1, "x", *OBJECTS, [2], None]),
        "noise.json": "start {\n" + pretty[0] + "\n}} stop\n" + pretty[1],
    }


WANT = {
    "lines.json": ("ndjson", OBJECTS), "banner.json": ("objects", OBJECTS), "pairs.json": ("objects", OBJECTS),
    "touching.json": ("objects", OBJECTS), "array.json": ("array", OBJECTS), "flat.json": ("array", OBJECTS),
    "cut.json": ("objects", OBJECTS[:-1]), "empty.json": ("array", []), "mixed.json": ("array", OBJECTS), "noise.json": ("objects", OBJECTS[:2]),
}


def by_file(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r["event_seq"])):
        out.setdefault(r["source_file"].rsplit("/", 1)[-1], []).append(json.loads(r["line"]))
    return out


@pytest.mark.parametrize("block", [4096, 3])
def test_all_layouts_from_lines(spark, monkeypatch, block):
    monkeypatch.setattr(json_layouts, "_BLOCK_LINES", block)
    lines = lines_of(spark, files())
    assert {r["source_file"]: r["layout"] for r in json_layout(lines).collect()} == {f: k for f, (k, _) in WANT.items()}
    rows = json_objects(lines).collect()
    assert by_file(rows) == {f: o for f, (_, o) in WANT.items() if o}
    assert len({r["event_seq"] for r in rows}) == len(rows)
    extras = sorted(r["event_seq"] for r in rows if r["event_seq"] >= EXTRA_BASE)
    # numbers for everything that has no line of its own; non-objects of arrays use one up
    assert extras[0] == EXTRA_BASE + 0 and extras[-1] - extras[0] < len(extras) + 4
    starts = {r["line_number"] for r in rows if r["source_file"] == "banner.json"}
    assert min(starts) == 2 and len(starts) == len(OBJECTS)


@pytest.mark.parametrize("block_bytes, split_bytes", [(1 << 20, 128 << 20), (40, 100)])
def test_all_layouts_from_files(spark, monkeypatch, tmp_path, block_bytes, split_bytes):
    """Read up to each brace: an array on one line is many rows, blocks and tasks."""
    monkeypatch.setattr(json_layouts, "_BLOCK_BYTES", block_bytes)
    for name, text in files().items():
        (tmp_path / name).write_text(text + ("\n" if name < "d" else ""))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split_bytes))
    try:
        rows = scan_json_events(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert by_file(rows) == {f: o for f, (_, o) in WANT.items() if o}
    assert len({r["event_seq"] for r in rows}) == len(rows)
    starts = sorted(r["line_number"] for r in rows if r["source_file"].endswith("banner.json"))
    assert starts[0] == 2 and len(set(starts)) == len(OBJECTS)


def test_a_file_that_ends_without_a_brace_gets_none(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"a": 1}\n{"b": 2')
    (tmp_path / "b.json").write_text('{"a": 1}{"b": 2}')
    (tmp_path / "c.json").write_text("[]")
    (tmp_path / "d.json").write_text("")
    assert by_file(scan_json_events(spark, str(tmp_path)).collect()) == {"a.json": [{"a": 1}], "b.json": [{"a": 1}, {"b": 2}]}


def test_what_a_task_holds_does_not_grow_with_the_blocks_of_a_batch(monkeypatch):
    """Objects of a block leave the task before the last block of its batch is read."""
    monkeypatch.setattr(json_layouts, "_BLOCK_BYTES", 1000)
    text, n = json.dumps({"a": "x" * 90}) * 12, 20
    columns = [["f"] * n, list(range(n)), [text] * n, [None] * n, [None] * n, [pickle.dumps(State())] * n, [0] * n, [0] * n]
    names = ["source_file", "block", "text", "numbers", "seqs", "state", "lines_before", "end_depth"]
    kinds = (pa.string(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.int64(), pa.int32())
    batch = pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)
    found = [b.num_rows for b in json_layouts._cutter(ObjectScan)(iter([batch]))]
    assert sum(found) == 12 * n and max(found) == 12
