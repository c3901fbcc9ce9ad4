"""Bloom filters as columns: rows that cannot match are dropped where they are scanned.

The filter is an array of 64-bit words in one row. Its bits are set in parallel and put
together by word; its size follows the number of keys up to ``MAX_BITS``, beyond which more
rows pass, and none is lost. What passes is decided by an exact join behind it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS_PER_KEY = 12
HASHES = 5
MAX_BITS = 1 << 26  # eight megabytes


def _positions(columns: Sequence[str], bits: Column) -> list[Column]:
    """Bit numbers of a key: two hashes, combined."""
    one, two = F.xxhash64(*columns), F.xxhash64(F.lit(17), *columns)
    mask = F.lit((1 << 62) - 1)
    return [F.pmod(one.bitwiseAND(mask) + F.shiftright(two, 8) * i, bits) for i in range(HASHES)]


def bloom_filter(keys: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: ``_bits`` and ``_words`` of the distinct values of some columns."""
    n = keys.agg(F.approx_count_distinct(F.xxhash64(*columns))).first()[0]
    bits = min(MAX_BITS, max(64, -(-n * BITS_PER_KEY // 64) * 64))
    size = F.lit(bits).cast("long")
    at = keys.select(F.explode(F.array(*_positions(columns, size))).alias("at"))
    # 1L: a bit beyond the 32nd does not fit an int
    bit = F.expr("shiftleft(1L, cast(at % 64 as int))")
    words = at.groupBy(F.floor(F.col("at") / 64).alias("word")).agg(F.bit_or(bit).alias("set"))
    every = keys.sparkSession.range(bits // 64).join(words, F.col("id") == F.col("word"), "left")
    ordered = F.array_sort(F.collect_list(F.struct("id", F.coalesce("set", F.lit(0).cast("long")).alias("set"))))
    # at most MAX_BITS / 64 words
    return every.agg(F.transform(ordered, lambda w: w["set"]).alias("_words")).select("_words", size.alias("_bits"))


def might_contain(columns: Sequence[str]) -> Column:
    """Whether a row beside the columns of ``bloom_filter`` can have one of its keys."""
    hit = F.lit(True)
    for p in _positions(columns, F.col("_bits")):
        word = F.get(F.col("_words"), F.floor(p / 64).cast("int"))
        hit = hit & (F.getbit(word, (p % 64).cast("int")) == 1)
    return hit


def where_maybe(df: DataFrame, keys: DataFrame, columns: Sequence[str], otherwise: Column | None = None) -> DataFrame:
    """Rows that can match ``keys`` on ``columns`` (named alike in both), or meet ``otherwise``."""
    # equal values of unlike types would have unlike hashes
    alike = keys.select(*[F.col(c).cast(df.schema[c].dataType).alias(c) for c in columns])
    beside = df.join(F.broadcast(bloom_filter(alike, columns)))  # one row, at most MAX_BITS
    keep = might_contain(columns) if otherwise is None else otherwise | might_contain(columns)
    return beside.where(keep).drop("_words", "_bits")
