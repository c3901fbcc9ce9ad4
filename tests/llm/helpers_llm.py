"""Small tables with awkward rows for the training-data operators."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, spans string, tokens int"


def docs_of(spark, texts, schema=DOCS):
    """One row per text; extra columns clash with names the operators use themselves."""
    rows = [(i, t, "en" if i % 3 else None, f"src{i % 4}" if i % 5 else None, len(t or ""), 0.5, "x", None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, schema)


def awkward(base):
    return [None, "", " \n\t ", *base, base[0], base[0], "word", "long " * 30_000]


def words(n, seed=0, alphabet="abcdefghijklmnop"):
    import random

    r = random.Random(seed)
    return " ".join("".join(r.choices(alphabet, k=r.randint(2, 9))) for _ in range(n))
