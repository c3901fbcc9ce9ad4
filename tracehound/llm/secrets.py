"""Secret scan: fixed patterns plus a battery of randomness tests.

Fixed patterns find assignments, access keys and hexadecimal runs. The battery then looks at
every long token that mixes digits with letters. Its encoding is inferred from its
characters, which gives the alphabet; under "the token is random over that alphabet" three
tests give a p-value each:

* chi-squared: are the alphabet's characters used evenly;
* runs: how often the token crosses the middle of the alphabet;
* serial correlation: does a character foretell the next one.

Their smallest value times three is the token's p-value. Benjamini-Hochberg control, apart
for each encoding and length class, decides which tokens are *not* random (names, paths,
numbered words): among those discarded, at most a share ``alpha`` are truly random. What is
not discarded is a secret. p-values are rounded up to tenths of a decade, so the control
needs only counts per class and step, and stays exact for the rounded values.

All of it is Spark functions; positions come from splitting a text at the matches. Null text
is the empty text; repeated rows each keep their own result row; extra columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracehound.llm.common import query, table, text_key, text_of, unused
from tracehound.runtime import materialize

# The patterns of the base kinds, in the order of their spans at one place.
ASSIGN = r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"  # as AKIA[A-Z0-9]+ of 18 characters or more
HEX = r"[0-9a-f]{16,}"
ASSIGN_VALUE = 12
KINDS = ("assign", "access", "hex", "random")

TOKEN = r"[A-Za-z0-9+/_-]{20,}={0,2}"
ALPHA = 0.05
STEPS = 120  # p-values down to 1e-12

_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# Encodings, the narrowest first, with their alphabets.
ENCODINGS = {
    "hex": ("^[0-9a-f]+$", _DIGITS + "abcdef"),
    "hex_upper": ("^[0-9A-F]+$", _DIGITS + "ABCDEF"),
    "base32": ("^[A-Z2-7]+$", _UPPER + "234567"),
    "base36": ("^[0-9a-z]+$", _DIGITS + _LOWER),
    "base36_upper": ("^[0-9A-Z]+$", _DIGITS + _UPPER),
    "base62": ("^[0-9A-Za-z]+$", _UPPER + _LOWER + _DIGITS),
    "base64": ("", _UPPER + _LOWER + _DIGITS + "+/"),
}
SPAN = "array<struct<start:bigint,ord:int,kind:string,end:bigint>>"


def match_spans(text: Column, pattern: str, kind: str, keep=None) -> Column:
    """Spans (code points, end exclusive) of the leftmost non-overlapping matches that ``keep`` accepts."""
    ord_ = KINDS.index(kind)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(SPAN).alias("spans"))

    def step(state, pair):
        begin = state["at"] + F.length(pair["between"])
        end = begin + F.length(pair["found"])
        span = F.struct(begin.alias("start"), F.lit(ord_).alias("ord"), F.lit(kind).alias("kind"), end.alias("end"))
        taken = F.array_append(state["spans"], span)
        if keep is not None:
            taken = F.when(keep(pair["found"]), taken).otherwise(state["spans"])
        return F.struct(end.alias("at"), taken.alias("spans"))

    # the last piece has no match behind it
    pairs = F.arrays_zip(F.slice(between, 1, F.size(found)).alias("between"), found.alias("found"))
    spans = F.aggregate(pairs, start, step, lambda s: s["spans"])
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast(SPAN))


def base_spans(text: Column) -> Column:
    """All spans of the fixed patterns, by start, then kind."""
    value = lambda m: F.length(F.regexp_extract(m, ASSIGN, 1)) >= ASSIGN_VALUE
    return F.array_sort(F.concat(
        match_spans(text, ASSIGN, "assign", value),
        F.when(text.contains("AKIA"), match_spans(text, ACCESS, "access")).otherwise(F.array().cast(SPAN)),
        match_spans(text, HEX, "hex"),
    ))


def _upper_tail(z: Column) -> Column:
    """P(N > z) of a standard normal, for z >= 0 (a rational approximation, 1e-7 off at most)."""
    t = 1 / (1 + 0.2316419 * z)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.exp(-z * z / 2) / math.sqrt(2 * math.pi) * poly


def with_p_value(tokens: DataFrame, token: str = "token") -> DataFrame:
    """Adds ``encoding`` and ``p``, the battery's p-value under randomness."""
    plain = F.regexp_replace(F.translate(F.col(token), "-_", "+/"), "=+$", "")
    encoding, alphabet = F.lit("base64"), F.lit(ENCODINGS["base64"][1])
    for name, (pattern, letters) in reversed(list(ENCODINGS.items())[:-1]):
        encoding = F.when(F.col("_plain").rlike(pattern), name).otherwise(encoding)
        alphabet = F.when(F.col("_plain").rlike(pattern), letters).otherwise(alphabet)
    out = tokens.withColumn("_plain", plain).withColumn("encoding", encoding).withColumn("_alphabet", alphabet)
    out = (
        out.withColumn("_k", F.length("_alphabet").cast("double"))
        .withColumn("_n", F.length("_plain").cast("double"))
        .withColumn("_x", F.expr("transform(split(_plain, ''), c -> cast(locate(c, _alphabet) - 1 as double))"))
        .withColumn("_squares", F.expr("aggregate(array_distinct(split(_plain, '')), 0D, (s, c) -> s + power(_n - length(replace(_plain, c, '')), 2))"))
        .withColumn("_chi", (F.col("_squares") * F.col("_k") / F.col("_n") - F.col("_n") - (F.col("_k") - 1)) / F.sqrt(2 * (F.col("_k") - 1) * (F.col("_n") - 1) / F.col("_n")))
        .withColumn("_high", F.expr("transform(_x, x -> cast(x >= _k / 2 as int))"))
        .withColumn("_n1", F.expr("aggregate(_high, 0D, (s, h) -> s + h)"))
        .withColumn("_runs", F.expr("aggregate(zip_with(slice(_high, 2, size(_high)), slice(_high, 1, size(_high) - 1), (a, b) -> abs(a - b)), 1D, (s, h) -> s + h)"))
        .withColumn("_mu", 1 + 2 * F.col("_n1") * (F.col("_n") - F.col("_n1")) / F.col("_n"))
        .withColumn("_var", (F.col("_mu") - 1) * (F.col("_mu") - 2) / (F.col("_n") - 1))
        .withColumn("_mean", F.expr("aggregate(_x, 0D, (s, x) -> s + x) / _n"))
        .withColumn("_spread", F.expr("aggregate(_x, 0D, (s, x) -> s + power(x - _mean, 2))"))
        .withColumn("_lag", F.expr("aggregate(zip_with(slice(_x, 2, size(_x)), slice(_x, 1, size(_x) - 1), (a, b) -> (a - _mean) * (b - _mean)), 0D, (s, x) -> s + x)"))
    )
    none = F.lit(10.0 ** (-STEPS / 10))
    chi = F.when(F.col("_chi") > 0, _upper_tail(F.col("_chi"))).otherwise(0.5)
    runs = F.when(F.col("_var") > 0, 2 * _upper_tail(F.abs(F.col("_runs") - F.col("_mu")) / F.sqrt("_var"))).otherwise(none)
    lag = F.when(F.col("_spread") > 0, 2 * _upper_tail(F.abs(F.col("_lag") / F.col("_spread") + 1 / F.col("_n")) * F.sqrt("_n"))).otherwise(none)
    out = out.withColumn("p", F.least(F.lit(1.0), F.greatest(none, 3 * F.least(chi, runs, lag))))
    return out.drop(*[c for c in out.columns if c.startswith("_") and c not in tokens.columns])


def discarded_steps(tokens: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """Per encoding and length class: the first step of p-values that the control calls not random.

    At most ``STEPS`` + 1 counts per class are ordered, whatever the number of tokens.
    """
    counts = tokens.groupBy("encoding", "length_class", "step").count()
    by = Window.partitionBy("encoding", "length_class")
    smaller = by.orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.withColumn("_rank", F.sum("count").over(smaller)).withColumn("_m", F.sum("count").over(by))
    passed = F.pow(F.lit(10.0), -F.col("step") / 10) <= alpha * F.col("_rank") / F.col("_m")
    return counts.where(passed).groupBy("encoding", "length_class").agg(F.min("step").alias("from_step"))


def random_tokens(docs: DataFrame, keys: list[Column], alpha: float = ALPHA, text: str = "text") -> DataFrame:
    """One row per token that stays a secret: keys, start, end, encoding, p."""
    spans = match_spans(F.col("_text"), TOKEN, "random", lambda m: m.rlike("[0-9]") & m.rlike("[A-Za-z]"))
    tokens = (
        docs.select(*keys, text_of(text).alias("_text"))
        .withColumn("_span", F.explode(spans))
        .withColumn("start", F.col("_span.start"))
        .withColumn("end", F.col("_span.end"))
        .withColumn("token", F.expr("substring(_text, int(start) + 1, int(end - start))"))
        .drop("_text", "_span")
    )
    tokens = with_p_value(tokens).withColumn("length_class", F.floor(F.log2(F.col("end") - F.col("start"))))
    tokens = materialize(tokens.withColumn("step", F.floor(-10 * F.log10("p")).cast("int")).drop("token"))
    # encodings times length classes: a row for each power of two
    limits = F.broadcast(discarded_steps(tokens, alpha))
    kept = tokens.join(limits, ["encoding", "length_class"], "left")
    return kept.where(F.col("from_step").isNull() | (F.col("step") < F.col("from_step"))).drop("from_step", "step", "length_class")


def scan_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", alpha: float = ALPHA) -> DataFrame:
    """One row per input row: its columns, ``base_spans`` and ``spans`` (arrays ordered by start, then kind).

    A random token that touches a base span is part of it and gets no span of its own.
    """
    row_id, row_hash, own, found = unused(docs, "_id", "_hash", "_own", "_more")
    keys = [F.col(doc_id).alias("_id"), text_key(text_of(text)).alias("_hash")]
    span = F.struct(F.col("start"), F.lit(3).alias("ord"), F.lit("random").alias("kind"), F.col("end"))
    more = random_tokens(docs, keys, alpha, text).distinct().groupBy(F.col("_id").alias(row_id), F.col("_hash").alias(row_hash)).agg(F.collect_list(span).alias(found))
    base = docs.withColumn(own, text_key(text_of(text))).withColumn("base_spans", base_spans(text_of(text)))
    joined = base.join(more, base[doc_id].eqNullSafe(more[row_id]) & (base[own] == more[row_hash]), "left")
    alone = F.filter(found, lambda r: ~F.exists("base_spans", lambda b: (b["start"] < r["end"]) & (r["start"] < b["end"])))
    spans = F.array_sort(F.concat(F.col("base_spans"), F.coalesce(alone, F.array().cast(SPAN))))
    return joined.withColumn("spans", spans).drop(own, row_id, row_hash, found)


def redact(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """The text with each maximal run of spans replaced by ``mark``."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(state, span):
        fresh = span["start"] >= state["at"]
        before = F.when(fresh, F.concat(text.substr((state["at"] + 1).cast("int"), (span["start"] - state["at"]).cast("int")), F.lit(mark))).otherwise(F.lit(""))
        return F.struct(F.greatest(state["at"], span["end"]).alias("at"), F.concat(state["out"], before).alias("out"))

    done = lambda s: F.concat(s["out"], text.substr((s["at"] + 1).cast("int"), F.length(text)))
    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(spans, start, step, done))


@query("op9_secrets")
def op9_secrets(spark, sf_dir: str) -> DataFrame:
    out = scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long")
    return out.select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in KINDS[:3]),
        F.sha2(said("base_spans"), 256).alias("base_sha256"),
        said("spans").alias("spans"),
    )
