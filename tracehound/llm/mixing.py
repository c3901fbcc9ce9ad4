"""Mixing sources to target weights, from a tree of domains, languages and sources.

Budgets go down the tree. Every node's supply is the tokens below it times ``max_epochs``.
A budget is shared among siblings by weight; a sibling that cannot use its share takes its
supply, and the rest goes to the others by weight (water filling). As a parent never gets
more than its supply, a shortage is met by siblings first, and only what they cannot use
reaches the next level up. Budgets are whole tokens, rounded down at each level.

A leaf reads its rows in seeded epochs: epoch e in the order of a hash of seed, e and id. It
takes the longest prefix whose tokens fit its budget, so whole epochs first, then part of
one. Rows are ordered by hash, id, tokens and a hash of their text; of equal rows as many are
taken as fit, so a budget is never passed. Running sums are built from sums of hash buckets,
so no task holds a leaf; per leaf one cut remains, and texts are filtered against it where
they are read.

A token is a white-space separated word unless ``tokens`` names a column. Null text has
none; null language or source is the empty name; an unknown source belongs to the domain
``other``; missing weights are 1. A leaf without budget gives no rows. Extra columns of the
input are kept, except that ``domain``, ``tokens`` and ``epoch`` are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracehound.llm.common import SPACED_WORD, query, table, text_of
from tracehound.runtime import materialize, number_rows

LEVELS = ("domain", "lang", "source")
MAX_BROADCAST_LEAVES = 100_000
BUCKET_DIGITS = 3


@dataclass(frozen=True)
class Mix:
    """Whole-number weights: by domain, by (domain, language) and by source."""

    domains: dict[str, list[str]]
    domain_weight: dict[str, int] = field(default_factory=dict)
    lang_weight: dict[tuple[str, str], int] = field(default_factory=dict)
    source_weight: dict[str, int] = field(default_factory=dict)
    share_percent: int = 60  # of all tokens of the corpus
    max_epochs: int = 2
    seed: int = 17


MIX = Mix(
    domains={
        "crawl": ["src0"],
        "web": [f"src{i}" for i in range(1, 10)],
        "books": [f"src{i}" for i in range(10, 20)],
    },
    domain_weight={"crawl": 1, "web": 2, "books": 4, "other": 1},
    lang_weight={("web", "en"): 3, ("books", "en"): 2, ("books", "de"): 2},
)


def _lookup(column: Column, values: dict[str, int]) -> Column:
    out = F.lit(1).cast("long")
    for key, value in sorted(values.items()):
        out = F.when(column == key, F.lit(value).cast("long")).otherwise(out)
    return out


def _weight(level: str, mix: Mix) -> Column:
    if level == "domain":
        return _lookup(F.col("domain"), mix.domain_weight)
    if level == "lang":
        return _lookup(F.concat_ws("\n", "domain", "lang"), {"\n".join(k): v for k, v in mix.lang_weight.items()})
    return _lookup(F.col("source"), mix.source_weight)


def with_leaf(docs: DataFrame, mix: Mix, text: str = "text", tokens: str | None = None) -> DataFrame:
    """Adds domain and tokens; language and source lose their nulls."""
    domain = F.lit("other")
    for name, sources in sorted(mix.domains.items()):
        domain = F.when(F.col("source").isin(sources), name).otherwise(domain)
    counted = F.regexp_count(text_of(text), F.lit(SPACED_WORD)) if tokens is None else F.coalesce(F.col(tokens), F.lit(0))
    return docs.withColumns({c: F.coalesce(c, F.lit("")) for c in ("lang", "source")}).withColumns({"domain": domain, "tokens": counted.cast("long")})


def leaf_budgets(rows: DataFrame, mix: Mix) -> DataFrame:
    """domain, lang, source, supply (tokens of one epoch) and budget of every leaf."""
    leaves = rows.groupBy(*LEVELS).agg(F.sum("tokens").alias("supply"))
    leaves = leaves.withColumn("_cap_source", F.col("supply") * mix.max_epochs)
    for level, wider in (("lang", 2), ("domain", 1)):
        leaves = leaves.withColumn(f"_cap_{level}", F.sum("_cap_source").over(Window.partitionBy(*LEVELS[:wider])))
    # a row per leaf stands for its ancestors; only the first of each group counts as the node
    total = leaves.groupBy().agg((F.floor(F.sum("supply") * mix.share_percent / 100)).alias("_all"))
    leaves = leaves.crossJoin(F.broadcast(total))  # one row
    above = "_all"
    for depth, level in enumerate(LEVELS):
        group, node = list(LEVELS[:depth]), list(LEVELS[: depth + 1])
        nodes = leaves.groupBy(*node).agg(F.first(f"_cap_{level}").alias("cap"), F.first(above).alias("given")).withColumn("w", _weight(level, mix))
        family = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
        full = F.when(F.col("w") > 0, F.col("cap") / F.col("w")).otherwise(F.lit(float("inf")))
        order = family.orderBy("_full", level)
        nodes = (
            nodes.withColumn("_full", full)
            .withColumn("_before", F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
            .withColumn("_left", F.sum("w").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
            .withColumn("_rate", F.when(F.col("_left") > 0, (F.col("given") - F.col("_before")) / F.col("_left")).otherwise(0.0))
            .withColumn("_sat", (F.col("w") > 0) & (F.col("_full") <= F.col("_rate")))
            .withColumn("_even", F.max(F.when(~F.col("_sat"), F.col("_rate"))).over(family))
            .withColumn(f"_got_{level}", F.when(F.col("_sat"), F.col("cap")).otherwise(F.floor(F.col("w") * F.col("_even"))).cast("long"))
        )
        leaves = leaves.join(nodes.select(*node, f"_got_{level}"), node)
        above = f"_got_{level}"
    return leaves.select(*LEVELS, "supply", F.col(above).alias("budget"))


def _draw(mix: Mix, whole: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(mix.seed)), F.col(whole).cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


_PLACE = ("draw", "doc_id", "tokens", "text_key")


def leaf_cuts(rows: DataFrame, mix: Mix) -> DataFrame:
    """Per leaf with budget, ``cut``: whole epochs; of the epoch after them the last place that
    fits with all its rows, and of the place behind it how many rows fit.

    ``rows``: doc_id, domain, lang, source, tokens and text_key.
    """
    budgets = leaf_budgets(rows, mix).where(F.col("budget") > 0)
    budgets = materialize(budgets.withColumn("whole", F.floor(F.col("budget") / F.col("supply"))).withColumn("rest", F.col("budget") % F.col("supply")))
    few = budgets.count() <= MAX_BROADCAST_LEAVES
    drawn = rows.join(F.broadcast(budgets) if few else budgets, list(LEVELS)).withColumn("draw", _draw(mix, "whole"))
    # equal rows are one place with a count
    drawn = drawn.groupBy(*LEVELS, "rest", *_PLACE).agg(F.count(F.lit(1)).alias("_n")).withColumn("_sum", F.col("tokens") * F.col("_n"))
    drawn = drawn.withColumn("_bucket", F.substring("draw", 1, BUCKET_DIGITS))
    sums = drawn.groupBy(*LEVELS, "_bucket").agg(F.sum("_sum").alias("_all"))
    ahead = Window.partitionBy(*LEVELS).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_before", F.coalesce(F.sum("_all").over(ahead), F.lit(0))).drop("_all")
    inside = Window.partitionBy(*LEVELS, "_bucket").orderBy(*_PLACE).rowsBetween(Window.unboundedPreceding, 0)
    run = drawn.withColumn("_run", F.sum("_sum").over(inside)).join(sums, [*LEVELS, "_bucket"]).withColumn("_run", F.col("_before") + F.col("_run"))
    place, fits = F.struct(*_PLACE), F.col("_run") <= F.col("rest")
    take = F.floor((F.col("rest") - F.col("_run") + F.col("_sum")) / F.greatest("tokens", F.lit(1)))
    behind = F.struct(*_PLACE, take.alias("take"))
    cut = run.groupBy(*LEVELS).agg(F.max(F.when(fits, place)).alias("last"), F.min(F.when(~fits, behind)).alias("next"))
    return budgets.join(cut, list(LEVELS), "left").select(*LEVELS, F.struct("whole", "last", "next", "budget").alias("cut"))


def mix_sources(docs: DataFrame, mix: Mix = MIX, text: str = "text", tokens: str | None = None) -> DataFrame:
    """Rows of ``docs`` with domain, tokens and epoch: one row for each time a row is used."""
    key = F.md5(text_of(text))
    rows = materialize(with_leaf(docs, mix, text, tokens).select("doc_id", *LEVELS, "tokens", key.alias("text_key")))
    cuts = materialize(leaf_cuts(rows, mix))
    few = cuts.count() <= MAX_BROADCAST_LEAVES
    # columns of the input stay apart from those of the cut, whatever their names
    read = with_leaf(docs.drop("epoch"), mix, text, tokens)
    kept = [c for c in read.columns if c not in LEVELS]
    used = read.select(F.struct(*kept).alias("row"), *LEVELS, "doc_id", "tokens", key.alias("text_key"))
    used = used.join(F.broadcast(cuts) if few else cuts, list(LEVELS)).withColumn("whole", F.col("cut.whole")).withColumn("draw", _draw(mix, "whole"))
    place, behind = F.struct(*_PLACE), F.struct(*[F.col(f"cut.next.{c}") for c in _PLACE])
    tied = F.coalesce((F.col("cut.next.take") > 0) & place.eqNullSafe(behind), F.lit(False))
    part = F.coalesce(place <= F.col("cut.last"), F.lit(False))
    out = used.withColumn("part", part)
    if not cuts.where("cut.next.take > 0").isEmpty():
        # equal rows of which only some fit: numbered, without gathering them
        equal = number_rows(used.where(tied).withColumn("_at", F.monotonically_increasing_id()), *LEVELS, "_at", name="_no")
        first = equal.groupBy(*LEVELS).agg(F.min("_no").alias("_first"))
        equal = equal.join(F.broadcast(first) if few else first, list(LEVELS))  # one row per leaf
        equal = equal.withColumn("part", F.col("_no") - F.col("_first") < F.col("cut.next.take")).drop("_at", "_no", "_first")
        out = out.where(~tied).unionByName(equal)
    epochs = F.expr("sequence(0, int(whole))")
    epochs = F.when(F.col("part"), epochs).otherwise(F.slice(epochs, 1, F.col("whole").cast("int")))
    out = out.withColumn("epoch", F.explode(epochs))
    return out.select(*[F.col(c) if c in LEVELS else F.col("row")[c].alias(c) for c in read.columns], "epoch")


def _sql() -> str:
    m = MIX
    domain = " ".join(f"WHEN source IN ({', '.join(repr(s) for s in v)}) THEN '{k}'" for k, v in m.domains.items())
    weight = {
        "domain": "CASE domain " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in m.domain_weight.items()) + " ELSE 1 END",
        "lang": "CASE " + " ".join(f"WHEN domain = '{d}' AND lang = '{g}' THEN {v}" for (d, g), v in m.lang_weight.items()) + " ELSE 1 END",
        "source": "1",
    }
    parts, above = [], "total"
    for depth, level in enumerate(LEVELS):
        node, group = ", ".join(LEVELS[: depth + 1]), ", ".join(LEVELS[:depth])
        by = f"PARTITION BY {group}" if group else ""
        given = "any_value((SELECT b FROM total))" if depth == 0 else "any_value(g.got)"
        join = "" if depth == 0 else f"JOIN {above} g USING ({group})"
        parts.append(f"""
n_{level} AS (
  SELECT {node}, sum(supply) * {m.max_epochs} AS cap, {given} AS given, {weight[level]} AS w FROM leaf {join} GROUP BY {node}),
o_{level} AS (
  SELECT *, cap / w AS f, coalesce(sum(cap) OVER ({by} ORDER BY cap / w, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         sum(w) OVER ({by} ORDER BY cap / w, {level} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rem FROM n_{level}),
r_{level} AS (SELECT *, (given - before) / rem AS rate FROM o_{level}),
g_{level} AS (
  SELECT {node}, CASE WHEN f <= rate THEN cap ELSE floor(w * max(CASE WHEN f > rate THEN rate END) OVER ({by})) END::BIGINT AS got FROM r_{level})""")
        above = f"g_{level}"
    return rf"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, CASE {domain} ELSE 'other' END AS domain,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS tokens, md5(coalesce(text, '')) AS key FROM documents),
leaf AS (SELECT domain, lang, source, sum(tokens)::BIGINT AS supply FROM d GROUP BY ALL),
total AS (SELECT floor(sum(supply) * {m.share_percent} / 100)::BIGINT AS b FROM leaf),
{','.join(parts)},
b AS (SELECT leaf.*, got, got // supply AS whole, got % supply AS rest FROM leaf JOIN g_source USING (domain, lang, source) WHERE got > 0),
e AS (SELECT d.*, whole, rest, md5(concat_ws(':', '{m.seed}', whole::VARCHAR, coalesce(doc_id::VARCHAR, ''))) AS draw FROM d JOIN b USING (domain, lang, source)),
c AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY draw, doc_id NULLS FIRST, tokens, key ROWS UNBOUNDED PRECEDING) AS run FROM e),
used AS (
  SELECT doc_id, domain, lang, source, tokens, unnest(range(whole + CASE WHEN run <= rest THEN 1 ELSE 0 END)) AS epoch FROM c)
SELECT doc_id, domain, lang, source, tokens, epoch::INTEGER AS epoch FROM used
"""


@query("op3_mixing", _sql())
def op3_mixing(spark, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "domain", "lang", "source", "tokens", "epoch")
