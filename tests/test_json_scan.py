"""Objects and array elements, cut into blocks anywhere a reader can cut them."""

import json
import random

import pytest

from tracehound.functions.json_scan import ArrayScan, ObjectScan, carry


def joined(scan, blocks):
    """Texts of all closed objects or elements in order, and the state at the end."""
    scans = [scan(i, t) for i, t in enumerate(blocks)]
    states, end = carry(scan, [s.effect() for s in scans])
    found, closed = {}, set()
    for s, (state, _) in zip(scans, states):
        for p in s.parts(state):
            found[p.opened] = found.get(p.opened, "") + p.text
            closed |= {p.opened} if p.ends else set()
    return [t for k, t in found.items() if k in closed], end


def cut(text, r, behind):
    places = [i for i in range(1, len(text)) if text[i - 1] in behind and r.random() < 0.5]
    return [text[a:b] for a, b in zip([0, *places], [*places, len(text)])]


def value(r, depth=0):
    kind = r.random()
    if depth > 3 or kind < 0.3:
        return r.choice([1, -2.5, None, True, "a", 'x}{"y', "\\", "[{", 'é\n,"', "", "}", "\\}"])
    if kind < 0.6:
        return [value(r, depth + 1) for _ in range(r.randrange(4))]
    return {r.choice('abc{}"') + str(i): value(r, depth + 1) for i in range(r.randrange(4))}


def test_objects_with_noise():
    for seed in range(300):
        r = random.Random(seed)
        objects = [{"k": value(r)} for _ in range(r.randrange(6))]
        between = r.choice(["\n", "  ", "\n\n", ", ", ""])
        noise = ["[boot] x {y\n", "", "", ' noise " quote\n'] if between.startswith("\n") else [""]
        text = between.join(r.choice(noise) + json.dumps(o, indent=r.choice([None, 2])) for o in objects)
        whole, _ = joined(ObjectScan, [text])
        assert [json.loads(t) for t in whole] == objects
        for behind in ("}", "\n", "}\n"):
            assert joined(ObjectScan, cut(text, r, behind))[0] == whole


def test_array_elements():
    for seed in range(300):
        r = random.Random(seed)
        elements = [value(r) for _ in range(r.randrange(6))]
        text = r.choice(["", " \n"]) + json.dumps(elements, indent=r.choice([None, 1])) + r.choice(["", "\n"])
        for behind in ("", "}", "\n", "}\n"):
            got, end = joined(ArrayScan, cut(text, r, behind))
            assert end.depth == 0
            assert [json.loads(t) for t in got if t.strip()] == elements


def test_an_unclosed_object_is_given_up_at_the_next_certain_start():
    text = '{"a": {"b": 1}\n{"c": 2}\n{"d": 3'
    for blocks in ([text], text.splitlines(keepends=True)):
        got, end = joined(ObjectScan, blocks)
        assert '{"c": 2}' in got and end.depth == 1


@pytest.mark.parametrize("text", ["[boot] started", "[1] [2]", "[1", "[1}", "x [1]", "[1] x", "[1],", "1"])
def test_what_is_no_array(text):
    scan = ArrayScan(0, text)
    (state, _), = carry(ArrayScan, [scan.effect()])[0]
    parts = scan.parts(state)
    end = carry(ArrayScan, [scan.effect()])[1]
    broken = any(p.opened[1] < 0 for p in parts) or end.depth != 0 or end.opened is None
    assert broken or text == "[boot] started"  # its element is not JSON


def test_broken_objects_are_cut_alike_in_any_blocks():
    """Braces, quotes and line ends at random: the cut of the file into blocks changes nothing."""
    for seed in range(300):
        r = random.Random(seed)
        text = "".join(r.choices('{}"\\\n ,a', k=r.randrange(60)))
        whole, end = joined(ObjectScan, [text])
        for behind in ("}", "\n", "}\n"):
            got, last = joined(ObjectScan, cut(text, r, behind))
            assert (got, last.depth, last.mode) == (whole, end.depth, end.mode)
