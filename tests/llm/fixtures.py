"""Small tables with the awkward rows that every operator must take."""

from __future__ import annotations

import os

DOCS = "doc_id long, text string, lang string, source string, n_chars int"
#: Columns whose names the operators use inside.
CLASHING = "key long, row string, at long, fp long, score double, kept string, text_key string, host string, n long, label int"


def read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parquet(sf_dir, name):
    path = f"{sf_dir}/{name}.parquet"
    return f"{path}/*.parquet" if os.path.isdir(path) else path


def documents(spark, texts):
    rows = [(i, t, "en", "s", len(t) if t is not None else None) for i, t in texts]
    return spark.createDataFrame(rows, DOCS)


def awkward(spark):
    """NULL keys and texts, empty and blank texts, a long text, repeated rows, equal texts."""
    long = " ".join(f"word{i % 97} lorem ipsum" for i in range(20_000))
    texts = [
        (1, None), (2, ""), (3, " \t\n "), (4, "One two three four"), (5, "one TWO three four"), (5, "one TWO three four"),
        (None, "one two three four"), (None, None), (6, long), (7, "é ü 日本語   x"), (8, "a\n\n\nb\n"), (9, "solo"),
    ]
    return documents(spark, texts)


def clashing(docs):
    from pyspark.sql import functions as F

    for part in CLASHING.split(", "):
        name, kind = part.split(" ")
        docs = docs.withColumn(name, F.lit(None).cast(kind))
    return docs
