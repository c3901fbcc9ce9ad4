"""License scan: exact containment join of text blocks with license templates.

A block is one line of a text, or as many words in a row as the template has, wherever lines
end (so notices wrapped over lines count, comment marks between them not being words), seen as
its set of words. It matches a template when it holds at least ``threshold`` of the template's
distinct words. The join is exact and runs in Spark's own operators:

* global order: template words are ordered by the number of documents that hold them,
  rarest first (counted over all documents; the vocabulary is that of the templates);
* prefix filter: a block that holds t of T's words holds one of T's first |T| - t + 1;
* length filter: the block must hold t template words at all;
* positional filter: from the place of a shared word in both orders, the rest of either
  side must still reach t.

Survivors are verified by intersecting the two sets. For windows, whole texts are joined in
the same way, and of a pair that survives every window that starts with a template word is
verified; other windows hold no more. The templates are a parameter; the
index built from them is broadcast only up to ``MAX_INDEX`` rows and shuffled beyond.

Null text counts as empty: no words, no labels, score 0. Repeated rows each keep their own
result row. Extra columns are ignored.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracehound.llm.common import PLAIN_WORD, ascii_lower, query, table, text_key, text_of

# Phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Customary license notices, one line each, with their labels.
TEMPLATES = [
    ("gpl", "This work is licensed under the GNU General Public License"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("apache", "This work is licensed under the Apache License"),
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("mit", "This work is licensed under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("cc-by", "This work is licensed under CC BY"),
    ("cc-by-nc", "Licensed under CC BY-NC"),
    ("cc-by-sa", "Licensed under CC BY-SA"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
]

THRESHOLD = 0.9
MAX_INDEX = 100_000


def template_words(text: str) -> list[str]:
    """Distinct words of a template."""
    lower = "".join(c.lower() if c.isascii() else c for c in text)
    return list(dict.fromkeys(re.findall(PLAIN_WORD, lower)))


def template_length(text: str) -> int:
    """Words of a template, repeated ones included."""
    return len(re.findall(PLAIN_WORD, "".join(c.lower() if c.isascii() else c for c in text)))


def needed(size: int, threshold: float) -> int:
    """Words a block must share with a template of that many words."""
    return max(1, math.ceil(threshold * size - 1e-9))


# ASCII characters that are no part of a word once letters are lower-cased.
_BETWEEN = "".join(map(chr, (*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80))))
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words_of(text: Column) -> Column:
    """Lower-cased words: one pass puts blanks between them, which is far cheaper to split at than a pattern."""
    spaced = F.translate(text, _UPPER + _BETWEEN, _UPPER.lower() + " " * len(_BETWEEN))
    return F.array_remove(F.split(spaced, " ", -1), "")


def global_order(docs: DataFrame, vocabulary: list[str], text: str = "text") -> list[str]:
    """The vocabulary, words of the fewest documents first; ties in code point order.

    The result is as long as the vocabulary, whatever the size of ``docs``.
    """
    held = F.array_intersect(F.lit(sorted(vocabulary)), words_of(text_of(text)))
    counts = docs.select(F.explode(held).alias("word")).groupBy("word").count()
    found = {r["word"]: r["count"] for r in counts.collect()}
    return sorted(vocabulary, key=lambda w: (found.get(w, 0), w))


def _index(docs: DataFrame, templates: list[tuple[str, str]], threshold: float, text: str) -> tuple[DataFrame, DataFrame, list[str], int]:
    """Rows of the prefix index; ``docs`` whose text holds a prefix word; the global order; the fewest words of a match."""
    sets = [template_words(t) for _, t in templates]
    order = global_order(docs, sorted({w for s in sets for w in s}), text)
    rank = {w: i for i, w in enumerate(order)}
    index = []
    for no, (label, wording) in enumerate(templates):
        words = sorted(sets[no], key=rank.__getitem__)
        t = needed(len(words), threshold)
        for i in range(len(words) - t + 1 if words else 0):
            index.append((words[i], no, label, i, len(words), t, words, template_length(wording)))
    schema = "word string, template int, label string, i int, size int, t int, wanted array<string>, length int"
    prefixes = docs.sparkSession.createDataFrame(index, schema)
    if len(index) <= MAX_INDEX:
        prefixes = F.broadcast(prefixes)
    first_words = sorted({row[0] for row in index}) or [""]
    guard = "(?:^|[^0-9a-z\\x{80}-\\x{10FFFF}])(?:" + "|".join(first_words) + ")(?:$|[^0-9a-z\\x{80}-\\x{10FFFF}])"
    # the prefix filter for a text as a whole
    return prefixes, docs.where(ascii_lower(text_of(text)).rlike(guard)), order, min([row[5] for row in index], default=1)


def _pairs(blocks: DataFrame, prefixes: DataFrame, least: int) -> DataFrame:
    """Pairs of blocks (``_held``: their template words in order) and templates; adds ``_both``, the words they share."""
    return (
        blocks.where(F.size("_held") >= least)
        .select("*", F.posexplode("_held").alias("_j", "word"))
        .join(prefixes, "word")
        .where((F.size("_held") >= F.col("t")) & (F.least(F.col("size") - F.col("i"), F.size("_held") - F.col("_j")) >= F.col("t")))
        .withColumn("_both", F.array_intersect("_held", "wanted"))
        # a pair meets once for each shared prefix word; the first of them speaks for it
        .where((F.size("_both") >= F.col("t")) & (F.element_at("_both", 1) == F.col("word")))
    )


def license_matches(
    docs: DataFrame,
    keys: list[Column],
    templates: list[tuple[str, str]] = TEMPLATES,
    threshold: float = THRESHOLD,
    text: str = "text",
) -> DataFrame:
    """One row per matching (block, template): keys, block number, block, template number, label, containment.

    Windows are blocks without a number; of a text's windows the best one for a template is given.
    """
    prefixes, maybe, order, least = _index(docs, templates, threshold, text)
    held = lambda words: F.array_intersect(F.lit(order), words)
    texts = maybe.select(*keys, text_of(text).alias("_text"))
    names = [c for c in texts.columns if c != "_text"]
    blocks = (
        texts.select("*", F.posexplode(F.split("_text", "\n", -1)).alias("block_no", "block"))
        .drop("_text")
        .withColumn("_held", held(words_of(F.col("block"))))
    )
    lines = _pairs(blocks, prefixes, least).select(*names, "block_no", "block", "template", "label", (F.size("_both") / F.col("size")).alias("containment"))

    whole = texts.where(F.col("_text").contains("\n")).withColumn("_words", words_of(F.col("_text"))).drop("_text")
    near = _pairs(whole.withColumn("_held", held(F.col("_words"))), prefixes, least)
    starts = F.filter(F.sequence(F.lit(1), F.size("_words")), lambda k: F.array_contains("wanted", F.element_at("_words", k)))
    window = lambda k: F.slice("_words", k, F.col("length"))
    # the later of two equal windows is taken
    best = F.array_max(F.transform(starts, lambda k: F.struct(F.size(F.array_intersect(window(k), "wanted")).alias("n"), k.alias("at"))))
    windows = (
        near.withColumn("_best", best)
        .where(F.col("_best.n") >= F.col("t"))
        .select(
            *names, F.lit(None).cast("int").alias("block_no"), F.array_join(window(F.col("_best.at")), " ").alias("block"),
            "template", "label", (F.col("_best.n") / F.col("size")).alias("containment"),
        )
    )
    return lines.unionByName(windows)


def phrase_places(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, n_base, first_word, last_word and base_labels (array) to ``docs``."""
    out = docs.withColumn("_words", words_of(text_of(text)))
    out = out.withColumn("n_words", F.size("_words").cast("long"))
    # words between single spaces, with a space at both ends: positions are counts of spaces
    out = out.withColumn("_line", F.concat(F.lit(" "), F.array_join("_words", " "), F.lit(" "))).drop("_words")
    out = out.withColumn("_maybe", F.col("_line").contains(" license ") | F.col("_line").contains(" cc by "))
    hits = []
    for phrase, label in PHRASES.items():
        pieces = F.split("_line", f"(?<= ){phrase}(?= )", -1)
        spaces = lambda piece: F.length(piece) - F.length(F.replace(piece, F.lit(" "), F.lit("")))
        hits.append(F.struct(
            F.lit(label).alias("label"),
            (F.size(pieces) - 1).alias("n"),
            (spaces(F.element_at(pieces, 1)) - 1).cast("long").alias("first"),
            (F.col("n_words") - (spaces(F.element_at(pieces, -1)) - 1) - len(phrase.split())).cast("long").alias("last"),
        ))
    out = out.withColumn("_hits", F.when(F.col("_maybe"), F.filter(F.array(*hits), lambda h: h["n"] > 0)).otherwise(F.array().cast("array<struct<label:string,n:int,first:bigint,last:bigint>>")))
    return (
        out.withColumn("n_base", F.aggregate("_hits", F.lit(0).cast("long"), lambda s, h: s + h["n"]))
        .withColumn("first_word", F.array_min(F.transform("_hits", lambda h: h["first"])))
        .withColumn("last_word", F.array_max(F.transform("_hits", lambda h: h["last"])))
        .withColumn("base_labels", F.array_sort(F.array_distinct(F.transform("_hits", lambda h: h["label"]))))
        .drop("_line", "_maybe", "_hits")
    )


def scan_licenses(
    docs: DataFrame,
    templates: list[tuple[str, str]] = TEMPLATES,
    threshold: float = THRESHOLD,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row per input row: phrase places, all labels (arrays) and the best score."""
    key = [F.col(doc_id).alias("_id"), text_key(text_of(text)).alias("_hash")]
    found = (
        license_matches(docs, key, templates, threshold, text)
        .groupBy("_id", "_hash")
        .agg(F.collect_set("label").alias("_labels"), F.max("containment").alias("_best"))
    )
    base = phrase_places(docs.select(F.col(doc_id).alias("doc_id"), text_key(text_of(text)).alias("_own"), F.col(text).alias("text")), "text").drop("text")
    joined = base.join(found, base["doc_id"].eqNullSafe(found["_id"]) & (base["_own"] == found["_hash"]), "left")
    none = F.array().cast("array<string>")
    return joined.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels",
        F.array_sort(F.array_union("base_labels", F.coalesce("_labels", none))).alias("labels"),
        F.greatest(F.coalesce("_best", F.lit(0.0)), F.when(F.col("n_base") > 0, 1.0).otherwise(0.0)).alias("score"),
    )


def _sql() -> str:
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    values = ", ".join(
        f"({no}, '{label}', [{', '.join(repr(w) for w in template_words(t))}], {needed(len(template_words(t)), THRESHOLD)})"
        for no, (label, t) in enumerate(TEMPLATES)
    )
    phrases = ", ".join(f"('{p}', '{label}', {len(p.split())})" for p, label in PHRASES.items())
    return rf"""
WITH t(no, label, words, need) AS (VALUES {values}),
p(phrase, label, size) AS (VALUES {phrases}),
d AS (
  SELECT row_number() OVER () AS r, doc_id,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM documents),
w AS (SELECT r, doc_id, low, regexp_extract_all(low, '{word}') AS ws FROM d),
spot AS (SELECT r, ws, unnest(range(len(ws))) AS i FROM w WHERE contains(low, 'license') OR contains(low, 'cc')),
hit AS (
  SELECT spot.r, spot.i, p.label FROM spot JOIN p
  ON spot.ws[spot.i + 1] = split_part(p.phrase, ' ', 1) AND array_to_string(spot.ws[spot.i + 1:spot.i + p.size], ' ') = p.phrase),
base AS (
  SELECT r, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word,
         list_sort(list(DISTINCT label)) AS labels FROM hit GROUP BY r),
b AS (SELECT r, list_distinct(regexp_extract_all(block, '{word}')) AS s
      FROM (SELECT r, unnest(string_split(low, chr(10))) AS block FROM d)),
m AS (SELECT b.r, t.label, len(list_intersect(t.words, b.s)) / len(t.words) AS c
      FROM b JOIN t ON len(list_intersect(t.words, b.s)) >= t.need),
more AS (SELECT r, list(DISTINCT label) AS labels, max(c) AS best FROM m GROUP BY r)
SELECT w.doc_id, len(w.ws) AS n_words, coalesce(base.n_base, 0) AS n_base, base.first_word, base.last_word,
       coalesce(array_to_string(base.labels, ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(more.labels, [])))), ','), '') AS labels,
       greatest(coalesce(more.best, 0.0), CASE WHEN base.n_base > 0 THEN 1.0 ELSE 0.0 END)::DOUBLE AS score
FROM w LEFT JOIN base USING (r) LEFT JOIN more USING (r)
"""


@query("op10_licenses", _sql())
def op10_licenses(spark, sf_dir: str) -> DataFrame:
    out = scan_licenses(table(spark, sf_dir, "documents"))
    return out.withColumns({c: F.array_join(c, ",") for c in ("base_labels", "labels")})
