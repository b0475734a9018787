"""Fixtures shared by the operator tests."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(n, seed, vocabulary=4000):
    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


def docs(spark, rows, extra=False):
    """A documents table of (doc_id, text[, source]) rows; ``extra`` adds columns whose names operators use inside."""
    rows = [(r[0], r[1], None if i % 3 == 0 else "en", r[2] if len(r) > 2 else f"s{i % 3}", None) for i, r in enumerate(rows)]
    df = spark.createDataFrame(rows, DOCS)
    if extra:
        for c in ("node", "key", "size", "fp", "row", "task", "batch", "group", "kept", "rank", "_id", "_sha", "_text", "copies"):
            from pyspark.sql import functions as F

            df = df.withColumn(c, F.lit("clash"))
    return df


#: Null and empty fields, white space, repeated rows, a very long text, ties.
ODD = [(1, None), (2, ""), (None, "no id here at all"), (3, " \t\n "), (4, "same text"), (4, "same text"), (5, "same text"), (6, "x" * 300_000), (7, " ".join(words(60_000, 1))), (8, "é\u0000ü 𝒳 �"), (None, None)]


def rows_of(df):
    return [tuple(r) for r in df.collect()]
