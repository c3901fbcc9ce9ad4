"""The sample logs end to end; expected values checked by hand against rules and weights, graph resources taken from a run."""

import pytest
from pyspark.sql import functions as F

from sample_logs import CUSTOMER, GUESSER, PROBER, write_all
from tracehound.operators.report import report_recommendations
from tracehound.plans.analyze import Options, analyze_files

def now():
    return F.lit("2026-12-01 00:00:00").cast("timestamp")


FILES = {"app": ["shop-app.json"], "auth": ["gate-auth.log"], "web": ["shop-access.log"],
         "all": ["shop-app.json", "gate-auth.log", "shop-access.log"]}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    return write_all(tmp_path_factory.mktemp("logs"))


@pytest.fixture(scope="module")
def run(spark, folder):
    done = {}

    def get(name, tz="UTC"):
        if (name, tz) not in done:
            opt = Options(parse={"auth": {"ref_now": now(), "tz": tz}, "json": {"now": now()}})
            done[name, tz] = analyze_files(spark, [str(folder / f) for f in FILES[name]], opt)
        return done[name, tz]

    return get


def counts(df, col):
    return {r[col]: r["count"] for r in df.groupBy(col).count().collect()}


CATEGORIES = {"SQLi": "SQL Injection", "Path": "Path Traversal", "XSS": "XSS", "Cmd": "Command Injection", "Brute": "Brute Force"}


@pytest.mark.parametrize(
    "name,tz,events,severities,cats",
    [
        ("app", "UTC", 2, (1, 0, 0), dict(Cmd=1)),
        ("auth", "UTC", 6, (1, 0, 0), dict(Brute=1)),
        ("web", "UTC", 12, (2, 2, 0), dict(SQLi=1, Path=1, XSS=1, Brute=1)),
        # together ten login requests of the guesser fall into one minute
        ("all", "UTC", 20, (4, 2, 1), dict(SQLi=1, Path=1, XSS=1, Cmd=1, Brute=3)),
        # read in another zone, the gate's log is hours away from the shop's
        ("all", "+05:30", 20, (4, 2, 0), dict(SQLi=1, Path=1, XSS=1, Cmd=1, Brute=2)),
    ],
)
def test_alert_counts(run, name, tz, events, severities, cats):
    t = run(name, tz)
    assert t["events"].count() == events
    got = counts(t["alerts"], "severity")
    assert tuple(got.get(s, 0) for s in ("CRITICAL", "HIGH", "MEDIUM")) == severities
    assert counts(t["alerts"], "category") == {CATEGORIES[k]: v for k, v in cats.items()}


def test_alert_rows(run):
    rows = {(r["rule_id"], r["matched_pattern"], r["ip"], str(r["ts"])[11:]) for r in run("all")["alerts"].collect()}
    assert rows == {
        ("SQLI_UNION_SELECT", "UNION SELECT", PROBER, "21:40:00"),
        ("PATH_TRAVERSAL_DOTDOT", "../../", PROBER, "21:40:30"),
        ("XSS_SCRIPT_TAG", "<script>", PROBER, "21:41:00"),
        ("BRUTE_FORCE_MAX_ATTEMPTS", "maximum authentication attempts exceeded", PROBER, "21:42:00"),
        ("CMDI_DOLLAR_PAREN", "$(reboot)", PROBER, "21:43:00"),
        # failures at 0, 2, 10, 12, 20 seconds; the tenth login request at 50
        ("BRUTE_FORCE_LOGIN", "5 events in 300s window", GUESSER, "21:05:20"),
        ("BRUTE_FORCE_RAPID_REQUESTS", "10 events in 60s window", GUESSER, "21:05:50"),
    }
    fired = run("web")["alerts"].where("rule_id = 'BRUTE_FORCE_LOGIN'").first()
    assert (fired["event_seq"], fired["ip"]) == (6, GUESSER)


STUFFING, TRAVERSAL, EXFIL = "CORR_CREDENTIAL_STUFFING", "CORR_SUCCESSFUL_TRAVERSAL", "CORR_DATA_EXFILTRATION"


@pytest.mark.parametrize(
    "name,want",
    [
        # guesser: 15 for the alert, 25 for each pattern
        ("web", {GUESSER: (65, 7, 1, {STUFFING, EXFIL}, "21:05:00", "21:06:00", 2),
                 PROBER: (100, 3, 3, {TRAVERSAL}, "21:40:00", "21:41:00", 3)}),
        # and 8 for the second alert, 10 for two sources
        ("all", {GUESSER: (83, 11, 2, {STUFFING, EXFIL}, "21:05:00", "21:06:00", 3),
                 PROBER: (100, 5, 5, {TRAVERSAL}, "21:40:00", "21:43:00", 5)}),
    ],
)
def test_attackers(run, name, want):
    t = run(name)
    hits = {}
    for r in t["pattern_hits"].collect():
        hits.setdefault(r["ip"], set()).add(r["pattern_id"])
    attackers = t["attackers"].collect()
    got = {
        r["ip"]: (r["threat_score"], r["total_requests"], r["alert_count"], hits.get(r["ip"], set()),
                  str(r["first_seen"])[11:], str(r["last_seen"])[11:], r["endpoint_count"])
        for r in attackers
    }
    assert got == want
    assert not any(r["is_private"] for r in attackers)


@pytest.mark.parametrize(
    "name,want",
    [
        # prober: 25 + 25 + 15 for the alerts, 15 as one of them succeeded
        ("web", {(GUESSER, "21:05:00", "21:05:40", 5, 1, 15, "Attack chain: Brute Force"),
                 (PROBER, "21:40:00", "21:41:00", 3, 3, 80, "Attack chain: SQL Injection → Path Traversal → XSS")}),
        ("all", {(GUESSER, "21:05:00", "21:05:50", 10, 2, 33, "Attack chain: Brute Force"),
                 (PROBER, "21:40:00", "21:43:00", 5, 5, 100,
                  "Attack chain: SQL Injection → Path Traversal → XSS → Brute Force → Command Injection")}),
    ],
)
def test_chains(run, name, want):
    got = {
        (r["ip"], str(r["start_time"])[11:], str(r["end_time"])[11:], r["event_count"], r["alert_count"],
         r["threat_score"], r["description"])
        for r in run(name)["chains"].collect()
    }
    assert got == want


@pytest.mark.parametrize("name,want", [("web", (2, 5, 2, 7)), ("all", (2, 7, 2, 10))])
def test_graph(run, name, want):
    t = run(name)
    types = counts(t["graph_nodes"], "type")
    assert (types["attacker"], types["endpoint"], types["resource"], t["graph_edges"].count()) == want


def test_event_details(run):
    web = run("web")["events"].where("line_number = 10").first()
    assert web["endpoint"] == "/img/../../notes.txt" and web["metadata"]["rawEndpoint"] == "/img/..%2F..%2Fnotes.txt"
    assert (web["metadata"]["bodyBytes"], web["metadata"]["referer"]) == ("64", "")
    auth = {r["line_number"]: r for r in run("auth")["events"].collect()}
    assert (auth[1]["ip"], auth[1]["method"], auth[1]["status_code"], auth[1]["user"]) == (GUESSER, "AUTH", 401, "carol")
    assert auth[1]["metadata"]["port"] == "4022" and auth[1]["metadata"]["pid"] == "77"
    assert auth[5]["status_code"] == 429 and auth[5]["log_level"] == "error"
    app = {r["ip"]: r for r in run("app")["events"].collect()}
    assert app[PROBER]["metadata"] == {"service": "calc", "message": "odd input"}
    assert app[CUSTOMER]["metadata"]["items"] == "3" and app[CUSTOMER]["user"] == "erin"
    assert app[PROBER]["raw_line"].startswith('{"timestamp":"2026-03-14T21:43:00.000Z","level":"error"')


def test_files_and_summary(run):
    t = run("all")
    files = {r["filename"]: (r["format"], r["confidence"], r["events"], r["error"]) for r in t["files"].collect()}
    assert files == {
        "shop-app.json": ("json", 80, 2, None),
        "gate-auth.log": ("auth", 100, 6, None),
        "shop-access.log": ("nginx", 100, 12, None),
    }
    s = t["summary"].first()
    assert (s["total_events"], s["total_alerts"], s["threat_score"], s["top_attacker_ip"]) == (20, 7, 100, PROBER)
    assert s["alerts_by_severity"].asDict() == {"CRITICAL": 4, "HIGH": 2, "MEDIUM": 1, "LOW": 0}


def test_recommendations(run):
    t = run("all")
    rows = report_recommendations(t["attackers"], t["alerts"]).collect()
    assert sorted(r["subject"] for r in rows if r["section"] == 1) == sorted([GUESSER, PROBER])
    assert sum(r["section"] == 2 for r in rows) == 5


def test_benign(run, spark):
    from tracehound.operators.chains import benign_ips

    t = run("all")
    assert [r[0] for r in benign_ips(t["events"], t["alerts"]).collect()] == [CUSTOMER]
