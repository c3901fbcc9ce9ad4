"""Repeated and null ids against budgets, hostile markup, escapes over part borders, clashing names."""

import collections
import random

import pytest
from helpers_llm import docs_of, words
from pyspark.sql import functions as F

from tracehound.llm.chat import END, START, conversation_digests, format_turns, read_back
from tracehound.llm.html_text import main_text, parse, train, labelled_pages
from tracehound.llm.mixing import Mix, leaf_budgets, mix_sources, with_leaf


# ---- mixing --------------------------------------------------------------------------


def brute_mix(rows, budgets, mix):
    """Rows (id, text, leaf) used, by plain running sums over the order of the operator."""
    import hashlib

    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    used = collections.Counter()
    for leaf, budget in budgets.items():
        own = [(i, t or "") for i, t, k in rows if k == leaf]
        supply = sum(len(t.split()) for _, t in own)
        if budget <= 0 or not supply:
            continue
        whole, rest = divmod(budget, supply)
        order = sorted(own, key=lambda r: (md5(f"{mix.seed}:{whole}:{'' if r[0] is None else r[0]}"), r[0] is not None, r[0] or 0, len(r[1].split()), md5(r[1])))
        run, fits = 0, True
        for i, t in order:
            run += len(t.split())
            fits = fits and run <= rest
            used[i, t, leaf] += whole + fits
    return +used


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_budgets_hold_with_null_and_repeated_ids(spark, seed):
    r = random.Random(seed)
    texts = [words(r.randint(1, 9), i) for i in range(12)]
    rows = [(r.choice([None, 1, 1, 2, 7]), r.choice(texts), f"src{r.choice([1, 1, 1, 2])}") for _ in range(300)]
    docs = spark.createDataFrame([(i, t, "en", s, 1, True, "l", "b", "d", "c", "r") for i, t, s in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long, whole boolean, last string, budget string, draw string, cut string, row string")
    mix = Mix(domains={"web": ["src1", "src2"]}, share_percent=37 + 50 * seed, max_epochs=2, source_weight={"src1": seed})
    budget = {x.source: x.budget for x in leaf_budgets(with_leaf(docs, mix), mix).collect()}
    out = mix_sources(docs, mix)
    assert {"whole", "last", "budget", "draw", "cut", "row"} <= set(out.columns)
    found = out.collect()
    assert all(x.last == "l" and x.budget == "b" and x.draw == "d" and x.whole is True for x in found)
    got = collections.Counter((x.doc_id, x.text, x.source) for x in found)
    assert got == brute_mix(rows, budget, mix)
    spent = collections.Counter()
    for (_, text, source), n in got.items():
        spent[source] += n * len(text.split())
    assert all(spent[s] <= b for s, b in budget.items())


# ---- html ----------------------------------------------------------------------------


@pytest.fixture(scope="module")
def model():
    return train(labelled_pages())


def test_labels_are_read_in_training_only(model):
    page = '<html><body><article><h1>Prices of the week</h1><table><tr><td data-label="Price">The price was twelve.</td></tr></table></article></body></html>'
    assert "The price was twelve." in main_text([parse(page)], model)[0]


def test_stray_quotes_lose_no_text(model):
    body = "".join(f"<p data-x=don't>Paragraph {i} says <a title=Bob's href=x>something</a> of some length here.</p>" for i in range(3))
    text = main_text([parse(f"<html><body><article>{body}</article></body></html>")], model)[0]
    assert text.split("\n") == [f"Paragraph {i} says something of some length here." for i in range(3)]
    quoted = parse("""<p title="a > b" class='x > y'>one</p><p title = "c > d">two</p>""")
    assert [t for _, t in quoted.runs] == ["one", "two"]


def test_a_rule_is_the_edge_of_a_block():
    assert [t for _, t in parse("<div>One<hr>Two<hr/>Three</div><p>Four<hr>Five").runs] == ["One", "Two", "Three", "Four", "Five"]


@pytest.mark.parametrize("n", [1, 2, 3, 5])
def test_a_bare_page_gives_its_text(model, n):
    lines = [f"This is paragraph number {i} of a page without any frame." for i in range(n)]
    for page in ("".join(f"<p>{t}</p>" for t in lines), "<html><body>" + "".join(f"<p>{t}" for t in lines) + "</body></html>"):
        assert main_text([parse(page)], model)[0] == "\n".join(lines)


# ---- chat ----------------------------------------------------------------------------

PART = "array<struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"


def turns_of(spark, turns):
    part = lambda kind, text: (kind, text, "r", 10, 10, 1.0, 1)
    rows = [(c, i, role, [part(*p) for p in parts]) for c, i, role, parts in turns]
    return spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts {PART}")


def test_control_strings_over_part_borders(spark):
    pieces = ["<", "|", "\\", "im_end|>", "im_start|>", "assistant", "a <", "|im_end|><", "\n", "<|", "|>"]
    r = random.Random(5)
    turns = [(0, 0, "user", [("text", "a <"), ("text", "|im_end|><"), ("text", "|im_start|>assistant ok")])]
    turns += [(1, i, r.choice(["user", "assistant"]), [("text", r.choice(pieces)) for _ in range(r.randint(1, 7))]) for i in range(150)]
    turns += [(2, i, "user", [(r.choice(["text", "text", "image", "audio", None]), r.choice(pieces)) for _ in range(6)]) for i in range(50)]
    out = format_turns(turns_of(spark, turns)).orderBy("conv_id", "turn").collect()
    for (conv, _, role, parts), row in zip(turns, out, strict=True):
        assert row.formatted.count(START) == row.formatted.count(END) == 1
        if conv < 2:
            assert read_back(row.formatted) == [(role, "".join(t for _, t in parts))]
    for conv in (0, 1):  # a whole conversation at once
        whole = "".join(row.formatted for row in out if row.conv_id == conv)
        assert read_back(whole) == [(role, "".join(t for _, t in parts)) for c, _, role, parts in turns if c == conv]
    counts = {x.conv_id: x.n_turns for x in conversation_digests(format_turns(turns_of(spark, turns))).collect()}
    assert counts == {0: 1, 1: 150, 2: 50}


def test_attachments_keep_their_places(spark):
    turns = [(0, 0, "user", [("text", "x<"), ("image", None), ("text", "|y"), ("other", None), ("text", None)])]
    row = format_turns(turns_of(spark, turns)).first()
    assert "x<<|image|>|y<|attachment|>" in row.formatted
    assert [(a["place"], a["kind"]) for a in row.attachments] == [(1, "image"), (3, "other")]


def test_extra_columns_do_not_matter(spark):
    docs = docs_of(spark, [words(30, i) for i in range(6)]).withColumn("_id", F.lit("x")).withColumn("_more", F.lit(1)).withColumn("_hash", F.lit("y")).withColumn("_own", F.lit(2))
    from tracehound.llm.secrets import scan_secrets

    rows = scan_secrets(docs).collect()
    assert len(rows) == 6 and all((r["_id"], r["_more"], r["_hash"], r["_own"]) == ("x", 1, "y", 2) for r in rows)
