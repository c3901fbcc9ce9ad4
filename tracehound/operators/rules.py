"""The detection rules as data."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class RegexRule:
    """A pattern looked for in the named fields, in order.

    ``needs`` makes the rule cheap on harmless text: pairs of lower-case words, one
    pair of which must be part of any text the pattern matches. A rule without it is
    always tried.
    """

    rule_id: str
    category: str
    severity: str
    description: str
    pattern: str
    ignore_case: bool = True
    fields: tuple[str, ...] = ("endpoint", "raw_line")
    needs: tuple[tuple[str, str], ...] = ()

    @property
    def regex(self) -> str:
        return f"(?i){self.pattern}" if self.ignore_case else self.pattern


@dataclass(frozen=True)
class ThresholdRule:
    """``threshold`` matching events of one group within ``window_seconds``."""

    rule_id: str
    category: str
    severity: str
    description: str
    predicate: Callable[[DataFrame], Column]
    threshold: int
    window_seconds: int
    group_by: str = "ip"


Rule = RegexRule | ThresholdRule


# Markers of login traffic.
FAILED_AUTH_STATUS = [401, 403]
FAILED_AUTH_RESULTS = ["failed", "pam_failure"]
LOGIN_ENDPOINTS = ["/login", "/admin/login", "/auth", "/signin", "/api/auth"]


def failed_auth(df: DataFrame) -> Column:
    """Rejected status, or an authentication log line that says so."""
    hit = F.col("status_code").isin(FAILED_AUTH_STATUS)
    if "metadata" in df.columns:
        hit = hit | F.col("metadata")["authResult"].isin(FAILED_AUTH_RESULTS)
    return F.coalesce(hit, F.lit(False))


def login_request(df: DataFrame) -> Column:
    # one pattern of plain texts: the endpoint may be an expression, so it is named once
    any_part = "|".join(re.escape(part) for part in LOGIN_ENDPOINTS)
    return F.coalesce(F.regexp_like(F.lower(F.col("endpoint")), F.lit(any_part)), F.lit(False))


def _all_of(*words: str, also: str = "") -> tuple[tuple[str, str], ...]:
    return tuple((w, also) for w in words)


_SPACES = (" ", "\t", "\n", "\x0b", "\f", "\r")

# Words without which a pattern cannot match; see ``RegexRule.needs``.
NEEDS: dict[str, tuple[tuple[str, str], ...]] = {
    "SQLI_UNION_SELECT": _all_of("union", also="select"),
    "SQLI_TAUTOLOGY": _all_of(*[f"or{s}" for s in _SPACES], also="="),
    "SQLI_DROP_TABLE": _all_of("drop", also="table"),
    "SQLI_INSERT_INTO": _all_of("insert", also="into"),
    "SQLI_DELETE_FROM": _all_of("delete", also="from"),
    "SQLI_COMMENT_BYPASS": _all_of(";", also="--"),
    "SQLI_SLEEP_BENCHMARK": _all_of("sleep", "benchmark", "waitfor", also="("),
    "SQLI_INFORMATION_SCHEMA": _all_of("information_schema"),
    "SQLI_CONCAT_HEX": _all_of("concat", "char", "hex", "load_file", also="("),
    "BRUTE_FORCE_MAX_ATTEMPTS": _all_of("maximum authentication attempts exceeded"),
    "PATH_TRAVERSAL_DOTDOT": _all_of("../", "..\\"),
    "PATH_TRAVERSAL_ETC_PASSWD": _all_of("/etc/"),
    "PATH_TRAVERSAL_PROC": _all_of("/proc/"),
    "PATH_TRAVERSAL_WIN": _all_of("boot.ini", "win.ini", "system32", "windows\\system"),
    "PATH_TRAVERSAL_SENSITIVE_FILES": _all_of(
        ".env", ".htaccess", ".htpasswd", ".git/config", ".ssh/", ".id_rsa", ".authorized_keys"
    ),
    "XSS_SCRIPT_TAG": _all_of("script", also="<"),
    "XSS_EVENT_HANDLER": _all_of(
        "onerror", "onload", "onclick", "onmouseover", "onfocus", "onblur", "onsubmit", "onchange", also="="
    ),
    "XSS_JAVASCRIPT_URI": _all_of("javascript", also=":"),
    "XSS_IMG_TAG": _all_of("img", also="<"),
    "XSS_SVG_TAG": _all_of("svg", also="<"),
    "XSS_DATA_URI": _all_of("text/html", also="data"),
    "CMDI_PIPE": _all_of("|"),
    "CMDI_BACKTICK": _all_of("`"),
    "CMDI_DOLLAR_PAREN": _all_of("$("),
    "CMDI_REVERSE_SHELL": (
        *_all_of("/dev/tcp/", "mkfifo"), ("bash", "-i"), ("/bin/sh", "-i"),
        *_all_of("-e", "-l", "-p", also="nc"),
    ),
}

SQLI, BRUTE, PATH, XSS, CMDI = (
    "SQL Injection", "Brute Force", "Path Traversal", "XSS", "Command Injection",
)

# Rule ids, categories, severities, texts and patterns, in rule order.
_RULES: list[Rule] = [
    RegexRule("SQLI_UNION_SELECT", SQLI, "CRITICAL",
              "UNION SELECT injection — attempts to extract data from other tables",
              r"\bUNION\b[\s/\*]+\bSELECT\b"),
    RegexRule("SQLI_TAUTOLOGY", SQLI, "CRITICAL",
              "Tautology-based SQL injection (OR 1=1, OR true)",
              r"""['"]?\s*\bOR\b\s+['"]?\d+['"]?\s*=\s*['"]?\d+['"]?"""),
    RegexRule("SQLI_DROP_TABLE", SQLI, "CRITICAL",
              "DROP TABLE attempt — destructive SQL command",
              r"\bDROP\b\s+\bTABLE\b"),
    RegexRule("SQLI_INSERT_INTO", SQLI, "HIGH",
              "INSERT INTO attempt — data manipulation via injection",
              r"\bINSERT\b\s+\bINTO\b"),
    RegexRule("SQLI_DELETE_FROM", SQLI, "CRITICAL",
              "DELETE FROM attempt — destructive data operation",
              r"\bDELETE\b\s+\bFROM\b"),
    RegexRule("SQLI_COMMENT_BYPASS", SQLI, "HIGH",
              "SQL comment injection — used to bypass query logic",
              r"""('|")\s*;\s*--""", ignore_case=False),
    RegexRule("SQLI_SLEEP_BENCHMARK", SQLI, "HIGH",
              "Time-based blind SQL injection (SLEEP/BENCHMARK)",
              r"\b(SLEEP|BENCHMARK|WAITFOR\s+DELAY)\s*\("),
    RegexRule("SQLI_INFORMATION_SCHEMA", SQLI, "CRITICAL",
              "Information schema access — database enumeration attempt",
              r"\bINFORMATION_SCHEMA\b"),
    RegexRule("SQLI_CONCAT_HEX", SQLI, "HIGH",
              "CONCAT/HEX function injection — data exfiltration technique",
              r"\b(CONCAT|CHAR|HEX|UNHEX|LOAD_FILE)\s*\("),
    ThresholdRule("BRUTE_FORCE_LOGIN", BRUTE, "HIGH",
                  "Multiple failed login attempts from the same IP — possible brute force attack",
                  failed_auth, threshold=5, window_seconds=300),
    RegexRule("BRUTE_FORCE_MAX_ATTEMPTS", BRUTE, "CRITICAL",
              "Maximum authentication attempts exceeded — confirmed brute force",
              r"maximum authentication attempts exceeded", fields=("raw_line",)),
    ThresholdRule("BRUTE_FORCE_RAPID_REQUESTS", BRUTE, "MEDIUM",
                  "Rapid sequential requests to the same endpoint from a single IP",
                  login_request, threshold=10, window_seconds=60),
    RegexRule("PATH_TRAVERSAL_DOTDOT", PATH, "CRITICAL",
              "Directory traversal using ../ sequences — attempts to access files outside web root",
              r"(\.\.\/|\.\.\\){2,}", ignore_case=False),
    RegexRule("PATH_TRAVERSAL_ETC_PASSWD", PATH, "CRITICAL",
              "Attempt to access /etc/passwd — system user enumeration",
              r"\/etc\/(passwd|shadow|hosts|group)"),
    RegexRule("PATH_TRAVERSAL_PROC", PATH, "HIGH",
              "Attempt to access /proc filesystem — system information disclosure",
              r"\/proc\/(self|version|cpuinfo|meminfo|net)"),
    RegexRule("PATH_TRAVERSAL_WIN", PATH, "HIGH",
              "Windows path traversal — boot.ini, win.ini access attempt",
              r"(boot\.ini|win\.ini|system32|windows\\system)"),
    RegexRule("PATH_TRAVERSAL_SENSITIVE_FILES", PATH, "HIGH",
              "Attempt to access sensitive application files",
              r"\.(env|htaccess|htpasswd|git\/config|ssh\/|id_rsa|authorized_keys)"),
    RegexRule("XSS_SCRIPT_TAG", XSS, "HIGH",
              "Script tag injection — classic XSS attack vector",
              r"<\s*script[^>]*>"),
    RegexRule("XSS_EVENT_HANDLER", XSS, "HIGH",
              "HTML event handler injection (onerror, onload, onclick)",
              r"\bon(error|load|click|mouseover|focus|blur|submit|change)\s*="),
    RegexRule("XSS_JAVASCRIPT_URI", XSS, "HIGH",
              "JavaScript URI injection (javascript:)",
              r"javascript\s*:"),
    RegexRule("XSS_IMG_TAG", XSS, "MEDIUM",
              "IMG tag with event handler — image-based XSS",
              r"<\s*img[^>]+on\w+\s*="),
    RegexRule("XSS_SVG_TAG", XSS, "MEDIUM",
              "SVG tag injection — vector for XSS via embedded scripts",
              r"<\s*svg[^>]*on\w+\s*="),
    RegexRule("XSS_DATA_URI", XSS, "MEDIUM",
              "Data URI injection — can embed executable content",
              r"data\s*:\s*text\/html"),
    RegexRule("CMDI_SEMICOLON", CMDI, "CRITICAL",
              "Command chaining via semicolon — attempts to execute additional commands",
              r";\s*(ls|cat|id|whoami|uname|pwd|wget|curl|nc|bash|sh|python|perl|ruby|php)\b"),
    RegexRule("CMDI_PIPE", CMDI, "CRITICAL",
              "Command piping — redirecting output to another command",
              r"\|\s*(cat|head|tail|less|more|grep|awk|sed|sort|bash|sh)\b"),
    RegexRule("CMDI_BACKTICK", CMDI, "CRITICAL",
              "Backtick command execution — subshell command injection",
              r"`[^`]+`", ignore_case=False),
    RegexRule("CMDI_DOLLAR_PAREN", CMDI, "CRITICAL",
              "$() command substitution — subshell injection",
              r"\$\([^)]+\)", ignore_case=False),
    RegexRule("CMDI_REVERSE_SHELL", CMDI, "CRITICAL",
              "Reverse shell attempt — connecting back to attacker",
              r"(\/dev\/tcp\/|nc\s+-[elp]|bash\s+-i\s+>|mkfifo|\/bin\/sh\s+-i)"),
]


RULES: list[Rule] = [
    replace(r, needs=NEEDS.get(r.rule_id, ())) if isinstance(r, RegexRule) else r for r in _RULES
]


def regex_rules(rules: Sequence[Rule] = RULES) -> list[tuple[int, RegexRule]]:
    return [(i, r) for i, r in enumerate(rules, 1) if isinstance(r, RegexRule)]


def threshold_rules(rules: Sequence[Rule] = RULES) -> list[tuple[int, ThresholdRule]]:
    return [(i, r) for i, r in enumerate(rules, 1) if isinstance(r, ThresholdRule)]


def rule_table(spark: SparkSession, rules: Sequence[Rule] = RULES) -> DataFrame:
    """One row per rule: the dimension table behind counts and texts."""
    rows = [
        (i, r.rule_id, r.category, r.severity, r.description,
         "regex" if isinstance(r, RegexRule) else "threshold")
        for i, r in enumerate(rules, 1)
    ]
    return spark.createDataFrame(
        rows,
        "rule_ordinal int, rule_id string, category string, severity string, "
        "description string, kind string",
    )


def rule_stats(spark: SparkSession, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Per category: rules, regex rules, threshold rules; the totals are their sums."""
    return rule_table(spark, rules).groupBy("category").agg(
        F.count(F.lit(1)).alias("total_rules"),
        F.count_if(F.col("kind") == "regex").alias("regex_rules"),
        F.count_if(F.col("kind") == "threshold").alias("threshold_rules"),
    )
