"""A corpus from raw documents: five stages, each written as Parquet and read by the next.

Toxic documents go; one document of each group of near duplicates stays; documents that
repeat a benchmark item go; secrets are replaced in the texts; sources are mixed to their
target weights. Every stage works on all rows that the one before it kept. All but the last
return the columns of ``documents``; the last adds domain, tokens and epoch, with one row for
each time a document is used. Rows are told apart by id and text, ids may be null; of equal
rows the near-duplicate stage keeps one. An empty table passes through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracehound.llm.chosen_path import jaccard_classes
from tracehound.llm.common import table, text_key, text_of
from tracehound.llm.decontaminate import contaminated
from tracehound.llm.mixing import mix_sources
from tracehound.llm.secrets import redact, scan_secrets
from tracehound.llm.toxicity import CUTOFF, fit, with_score
from tracehound.runtime import scratch_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _same_row(docs: DataFrame, found: DataFrame) -> Column:
    return docs["doc_id"].eqNullSafe(found["_id"]) & (docs["_key"] == found["_text_key"])


def _keys(found: DataFrame) -> DataFrame:
    return found.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_text_key")).distinct()


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the cut-off."""
    model = fit(docs, table(spark, sf_dir, "labels"))
    return with_score(docs.select(*COLUMNS), model).where(F.col("score") < CUTOFF).drop("score")


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document that stands for its class."""
    classes = jaccard_classes(docs)
    docs = docs.select(*COLUMNS).withColumn("_key", text_key(text_of("text")))
    standing = _keys(classes.where("stands"))
    kept = docs.join(standing, _same_row(docs, standing), "left_semi")
    # equal rows share their keys: number them where there are any
    if not docs.groupBy("doc_id", "_key").count().where("count > 1").isEmpty():
        same = Window.partitionBy("doc_id", "_key").orderBy("lang", "source", "n_chars")
        kept = kept.withColumn("_no", F.row_number().over(same)).where("_no = 1")
    return kept.select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item was found."""
    found = _keys(contaminated(docs, table(spark, sf_dir, "benchmark")))
    docs = docs.select(*COLUMNS).withColumn("_key", text_key(text_of("text")))
    return docs.join(found, _same_row(docs, found), "left_anti").drop("_key")


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with its secrets replaced."""
    found = scan_secrets(docs.select(*COLUMNS))
    changed = F.size("spans") > 0
    out = found.withColumn("text", redact(F.col("text"), F.col("spans")))
    return out.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by the target weights of their sources."""
    return mix_sources(docs.select(*COLUMNS)).select(*COLUMNS, "domain", "tokens", "epoch")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", keep_one_of_near_copies),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("mixing", mix),
]

ORACLE_SQL = None  # a trained classifier decides first; tests compare with plain Python


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
