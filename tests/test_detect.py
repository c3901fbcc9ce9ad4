"""Threshold, chain and regex semantics against small brute-force versions."""

import random
import re
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tracehound.operators.chains import attack_chains, chain_alerts, chain_events
from tracehound.operators.detect import (
    any_rule_guard,
    detect_all,
    detect_regex,
    first_crossings,
)
from tracehound.operators.rules import RULES, RegexRule, ThresholdRule, failed_auth, regex_rules

# One text per regex rule, and every rule it may trigger.
TEXTS = {
    "SQLI_UNION_SELECT": "/s?q=1 UNION/**/SELECT a",
    "SQLI_TAUTOLOGY": "/s?q=x' OR '1'='1",
    "SQLI_DROP_TABLE": "/s?q=drop  table t",
    "SQLI_INSERT_INTO": "/s?q=insert into t",
    "SQLI_DELETE_FROM": "/s?q=delete from t",
    "SQLI_COMMENT_BYPASS": "/s?q=admin' ; --",
    "SQLI_SLEEP_BENCHMARK": "/s?q=sleep (5)",
    "SQLI_INFORMATION_SCHEMA": "/s?q=information_schema.tables",
    "SQLI_CONCAT_HEX": "/s?q=unhex(1)",
    "BRUTE_FORCE_MAX_ATTEMPTS": "maximum authentication attempts exceeded for root",
    "PATH_TRAVERSAL_DOTDOT": "/..\\..\\x",
    "PATH_TRAVERSAL_ETC_PASSWD": "/f?p=/etc/group",
    "PATH_TRAVERSAL_PROC": "/proc/self/environ",
    "PATH_TRAVERSAL_WIN": "/windows\\system.ini",
    "PATH_TRAVERSAL_SENSITIVE_FILES": "/.git/config",
    "XSS_SCRIPT_TAG": "/q=< script src=x>",
    "XSS_EVENT_HANDLER": "/q=onclick =x",
    "XSS_JAVASCRIPT_URI": "/q=JavaScript :x",
    "XSS_IMG_TAG": "/q=<img src=x onfoo=1>",
    "XSS_SVG_TAG": "/q=<svg/onbar=1>",
    "XSS_DATA_URI": "/q=data:text/html,x",
    "CMDI_SEMICOLON": "/r?c=;  whoami",
    "CMDI_PIPE": "/r?c=a | sort",
    "CMDI_BACKTICK": "/r?c=`x`",
    "CMDI_DOLLAR_PAREN": "/r?c=$(x)",
    "CMDI_REVERSE_SHELL": "/r?c=nc -e",
}
EVENT = ("event_seq long, t long, source string, ip string, endpoint string, raw_line string, status_code int")


def events(spark, rows):
    return spark.createDataFrame(rows, EVENT).withColumn("ts", F.timestamp_seconds("t"))


def test_rule_counts():
    assert len(RULES) == 28
    assert len(regex_rules()) == 26


def test_one_hit_per_rule_text(spark):
    rows = [
        (i, i, "x", "1.1.1.1", "" if r == "BRUTE_FORCE_MAX_ATTEMPTS" else t, t if r == "BRUTE_FORCE_MAX_ATTEMPTS" else "", None)
        for i, (r, t) in enumerate(TEXTS.items())
    ]
    ev = events(spark, rows)
    got = {}
    for a in detect_regex(ev).collect():
        got.setdefault(a["event_seq"], []).append(a["rule_id"])
    assert got == {i: [r] for i, r in enumerate(TEXTS)}


def test_first_field_wins_and_guard(spark):
    ev = events(spark, [
        (1, 1, "x", "", "drop table a", "DROP  TABLE b", None),
        (2, 2, "x", "", "fine", "DROP  TABLE b", None),
        (3, 3, "x", "", "fine", "fine", None),
    ])
    got = {a["event_seq"]: (a["matched_pattern"], a["ip_group"]) for a in detect_regex(ev).collect()}
    assert got == {1: ("drop table", "unknown"), 2: ("DROP  TABLE", "unknown")}
    # a pattern with a back reference is tried on its own; the guard keeps all that match
    twice = RegexRule("TWICE", "c", "LOW", "d", r"(fi)ne|(\w)\2", fields=("endpoint",))
    assert {a["event_seq"] for a in detect_regex(ev, [twice]).collect()} == {2, 3}
    mixed = [twice, *[r for _, r in regex_rules()]]
    hits = {a["event_seq"] for a in detect_regex(ev, mixed).collect()}
    assert hits == {1, 2, 3} == {r["event_seq"] for r in ev.where(any_rule_guard(ev, mixed)).collect()}


def crossings(rows, n, w):
    """Two pointers over (group, second, seq) rows."""
    out, groups = {}, {}
    for g, t, s in rows:
        groups.setdefault(g, []).append((t, s))
    for g, items in groups.items():
        items.sort()
        start = 0
        for i, (t, s) in enumerate(items):
            while start < i and t - items[start][0] > w:
                start += 1
            if i - start + 1 >= n:
                out[g] = s
                break
    return out


@pytest.mark.parametrize("n,w,salts", [(5, 300, 8), (5, 300, 1), (1, 60, 4), (2, 0, 3), (10, 60, 8)])
def test_crossings_random(spark, n, w, salts):
    rnd = random.Random(n * 1000 + w + salts)
    rows = []
    for g in range(60):
        spread = rnd.choice([20, 200, 2000, 20000])
        for _ in range(rnd.randint(1, 40)):
            rows.append((f"g{g}", rnd.randint(0, spread), len(rows)))
    df = spark.createDataFrame(rows, "grp string, s long, event_seq long").withColumn("t", F.col("s") * 1_000_000)
    got = {r["grp"]: r["event_seq"] for r in first_crossings(df, n, w, salts).collect()}
    assert got == crossings(rows, n, w)


def test_hot_group_in_one_cell(spark):
    """A third of the rows in one group, all within one window."""
    hot = spark.range(20000).selectExpr("'hot' as grp", "id as event_seq", "(id % 100) * 1000000L as t")
    cold = spark.range(40000).selectExpr("concat('c', id % 5000) as grp", "id + 20000 as event_seq", "id * 60000000L as t")
    got = {r["grp"]: r["event_seq"] for r in first_crossings(hot.unionByName(cold), 5, 300).collect()}
    # equal times keep input order: rows 0, 100, 200, ... come first
    assert got == {"hot": 400}


def test_splits_follow_the_load(spark, monkeypatch):
    """One address with nine tenths of the rows in one cell: no task gets twice the median."""
    from tracehound.operators import detect

    monkeypatch.setattr(detect, "MIN_SPLIT_ROWS", 100)
    hot = spark.range(180_000).selectExpr("'hot' as grp", "id as event_seq", "0L as cell")
    cold = spark.range(20_000).selectExpr("concat('c', id % 5000) as grp", "id + 180000 as event_seq", "id % 50 as cell")
    salted = detect.with_salt(hot.unionByName(cold), ["grp", "cell"])
    dealt = salted.repartition(4, "grp", "cell", "salt").groupBy(F.spark_partition_id()).count().toPandas()["count"]
    assert dealt.sum() == 200_000 and len(dealt) == 4 and dealt.max() <= 2 * dealt.median()
    assert salted.where("grp <> 'hot'").agg(F.max("salt")).first()[0] == 0


@pytest.mark.parametrize("n,w", [(5, 300), (1, 60), (2, 0)])
def test_crossings_with_measured_splits(spark, monkeypatch, n, w):
    from tracehound.operators import detect

    monkeypatch.setattr(detect, "MIN_SPLIT_ROWS", 1)
    rnd = random.Random(n)
    rows = [(rnd.choice(["hot"] * 9 + ["a", "b"]), rnd.randint(0, 2000), i) for i in range(1500)]
    df = spark.createDataFrame(rows, "grp string, s long, event_seq long").withColumn("t", F.col("s") * 1_000_000)
    got = {r["grp"]: r["event_seq"] for r in first_crossings(df, n, w).collect()}
    assert got == crossings(rows, n, w)


def exchanged(df):
    """Columns of every shuffle in the plan."""
    text = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    return re.findall(r"\n\(\d+\) Exchange\s*\nInput[^:]*: \[([^\]]*)\]", text)


def test_full_events_are_never_shuffled(spark, monkeypatch):
    ev = spark.range(3000).selectExpr(
        "id as event_seq", "timestamp_seconds(id * 7) as ts", "concat('10.0.0.', id % 9) as ip", "'GET' as method",
        "if(id % 50 = 0, '/etc/passwd', '/login') as endpoint", "'app' as source", "if(id % 3 = 0, 401, 200) as status_code", "concat('line ', id) as raw_line")
    al = detect_all(ev)
    rows = sorted(map(repr, al.collect()))
    assert len(rows) > 60 and not any("raw_line" in columns for columns in exchanged(al))
    chains = exchanged(attack_chains(ev, al))
    assert chains and not any("raw_line" in columns for columns in chains)
    # the way that is not taken any more does show up
    assert any("raw_line" in columns for columns in exchanged(ev.join(al.select("event_seq").hint("merge"), "event_seq")))
    from tracehound.operators import detect

    # beyond the size that is broadcast: a Bloom filter and a join give the same rows
    monkeypatch.setattr(detect, "MAX_BROADCAST_FIRED", 0)
    assert sorted(map(repr, detect_all(ev).collect())) == rows


@pytest.mark.parametrize("bits", [1 << 26, 64])
def test_bloom_filter_loses_no_row(spark, monkeypatch, bits):
    """Also when it is far too small, with nulls, and with columns of other types."""
    from tracehound.operators import bloom

    monkeypatch.setattr(bloom, "MAX_BITS", bits)
    df = spark.range(5000).selectExpr("id", "if(id % 100 = 0, null, concat('k', id)) as k", "timestamp_seconds(id) as ts")
    keys = spark.range(0, 5000, 7).selectExpr("concat('k', id) as k", "cast(timestamp_seconds(id) as string) as ts")
    passed = bloom.where_maybe(df, keys, ["k", "ts"])
    wanted = {i for i in range(0, 5000, 7) if i % 100}
    found = {r["id"] for r in passed.collect()}
    assert passed.columns == ["id", "k", "ts"] and wanted <= found
    assert bits == 64 or len(found) < 1.1 * len(wanted) + 10
    assert bloom.where_maybe(df, keys.limit(0), ["k", "ts"]).count() == 0


def test_boundary_is_inclusive(spark):
    def run(last):
        ev = events(spark, [(i, t, "x", "a", "", "", 401) for i, t in enumerate([0, 75, 150, 225, last])])
        rule = ThresholdRule("R", "c", "LOW", "d", failed_auth, 5, 300)
        return [(r["event_seq"], r["description"]) for r in detect_all(ev, [rule]).collect()]

    assert run(300) == [(4, "d (5 events from a in 300s)")]
    assert run(301) == []


def test_scope_keeps_files_apart(spark):
    ev = events(spark, [(i, i, "x", "a", "", "", 401) for i in range(6)]).withColumn("f", F.col("event_seq") % 2)
    rule = ThresholdRule("R", "c", "LOW", "d", failed_auth, 3, 300)
    assert {r["event_seq"] for r in detect_all(ev, [rule], scope=("f",)).collect()} == {4, 5}


WEIGHT = {"CRITICAL": 25, "HIGH": 15, "MEDIUM": 8, "LOW": 3}


def chains_by_hand(rows, alerts, w, least):
    """Sequential version over all events of each address, with key multiplication."""
    out = []
    by_ip = {}
    for r in sorted(rows, key=lambda r: (r["ts"], r["event_seq"])):
        by_ip.setdefault(r["ip"] or "unknown", []).append(r)
    key = lambda r: (r["ts"], r["ip"], r["endpoint"], r["source"])
    for ip, evs in by_ip.items():
        mine = [a for a in alerts if (a["ip"] or "unknown") == ip]
        keys = {key(a) for a in mine}
        sus = [e for e in evs if key(e) in keys or e["status_code"] in (401, 403)]
        if not mine or not sus:
            continue
        groups = [[sus[0]]]
        for e in sus[1:]:
            if (e["ts"] - groups[-1][-1]["ts"]).total_seconds() <= w:
                groups[-1].append(e)
            else:
                groups.append([e])
        no = 0
        for g in groups:
            if len(g) < least:
                continue
            no += 1
            al = [a for e in g for a in mine if key(a) == key(e)]
            ok = sum(e["status_code"] == 200 and any(p in e["endpoint"] for p in ("../", "/etc/", "UNION")) for e in g)
            score = sum(WEIGHT.get(a["severity"], 3) for a in al) + 10 * (len({e["source"] for e in g}) - 1) + 15 * ok
            out.append((ip, no, g[0]["ts"], g[-1]["ts"], len(g), len(al), min(score, 100), list(dict.fromkeys(a["category"] for a in al))))
    return sorted(out)


def test_chains_random(spark):
    rnd = random.Random(7)
    texts = ["/login", "/about", "/../../etc/passwd", "/s?q=UNION SELECT 1", "/q=<script>"]
    rows = []
    for i in range(600):
        ip = rnd.choice(["a", "a", "a", "b", "c", ""])
        rows.append((i, rnd.randint(0, 200) * 30, rnd.choice(["nginx", "auth"]), ip, rnd.choice(texts),
                     rnd.choice(["", "", "drop table x"]), rnd.choice([200, 200, 401, 403, 500])))
    ev = events(spark, rows).cache()
    rules = [replace(r, window_seconds=120) if isinstance(r, ThresholdRule) else r for r in RULES]
    al = detect_all(ev, rules).cache()
    alerts = sorted(al.collect(), key=lambda a: (a["phase"], a["ord_major"], a["ord_minor"]))
    want = chains_by_hand(ev.collect(), alerts, 90, 2)
    got = sorted(
        (r["ip"], r["chain_no"], r["start_time"], r["end_time"], r["event_count"], r["alert_count"], r["threat_score"], r["categories"])
        for r in attack_chains(ev, al, 90, 2).collect()
    )
    assert len(want) > 5 and got == want
    assert chain_events(ev, al, 90, 2).count() == sum(c[4] for c in want)
    assert chain_alerts(ev, al, 90, 2).agg(F.sum("times")).first()[0] == sum(c[5] for c in want)


def test_chain_gap_is_inclusive(spark):
    def count(gap):
        ev = events(spark, [(1, 0, "x", "a", "/drop table", "drop table x", 401), (2, gap, "x", "a", "/", "", 401)])
        return attack_chains(ev, detect_all(ev), 300, 2).count()

    assert count(300) == 1
    assert count(301) == 0


def test_needed_words_are_necessary():
    """Whatever a pattern matches contains one of the word pairs that guard the rule."""
    import re

    rnd = random.Random(3)
    pieces = list(TEXTS.values()) + [" ", "=", "'", ";", "--", "or", "OR\t1=1", "nc\t-l", "bash  -i >", "WAITFOR DELAY(", "ſcript", "../", "..\\"]
    rules = [r for _, r in regex_rules() if r.needs]
    assert len(rules) == 25
    checked = 0
    for _ in range(20000):
        text = "".join(rnd.sample(pieces, 3))
        text = "".join(rnd.choice([c.upper(), c.lower()]) for c in text)
        lowered = text.lower()
        for r in rules:
            if re.search(r.pattern, text, re.ASCII | (re.IGNORECASE if r.ignore_case else 0)):
                checked += 1
                assert any(a in lowered and b in lowered for a, b in r.needs), (r.rule_id, text)
    assert checked > 1000
