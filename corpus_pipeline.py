"""Cleaning and packing a corpus for training, stage by stage.

Each stage gets the documents that the one before kept, written as Parquet and
read again. All but the last return the columns of the documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliospark.llm import line_dedup, packing, simhash, toxicity
from heliospark.llm.common import stage, table
from heliospark.llm.queries import learned_labels
from heliospark.session import ship_package


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the rejection threshold; the model learns from the labels it may learn from."""
    ship_package(spark)
    model = toxicity.fit(docs, learned_labels(spark, sf_dir))
    return toxicity.scored(docs, model).where(F.col("score") < toxicity.REJECT).select("row.*")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that ten of them or more hold; n_chars follows the text.

    A document that loses all its lines stays with an empty text.
    """
    ship_package(spark)
    kept = line_dedup.drop_lines(docs)
    columns = {c: F.col(f"row.`{c}`") for c in docs.columns}
    columns["text"] = F.when((F.col("n_dropped") == 0) & F.col("row.text").isNull(), F.lit(None)).otherwise(F.col("kept"))
    if "n_chars" in columns:
        changed = F.char_length("kept").cast(docs.schema["n_chars"].dataType)
        columns["n_chars"] = F.when(F.col("n_dropped") > 0, changed).otherwise(F.col("row.n_chars"))
    return kept.select(*[column.alias(name) for name, column in columns.items()])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, Jaccard 0.8 or more), that of the smallest doc_id."""
    ship_package(spark)
    return simhash.keep_one(docs, words=5, similarity=0.8)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bucket, batch and place in the batch of each document."""
    ship_package(spark)
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("simhash near-dedup", drop_near_duplicates),
    ("packing", pack),
]

#: The toxicity stage is no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, apply in STAGES[:-1]:
        docs = stage(apply(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
