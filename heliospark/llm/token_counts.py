"""Documents of flat token files that have no index, by a scan for separators.

A file is a run of token ids; an end-of-document id closes each document. Each
block is searched on its own (one vectorised comparison). Documents that span
blocks are stitched by a prefix scan over the blocks' summaries, in two
levels, so that no file's blocks are ordered in one task as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heliospark.llm.bpe import load, tokenizer
from heliospark.llm.common import stage
from heliospark.session import new_folder

#: Tokens of a block, and blocks that one task of the scan's lower level orders.
BLOCK, GROUP = 1 << 16, 1 << 12


def write_token_files(docs: DataFrame, tokenizer_path: str, separator: int, key: str = "doc_id", text: str = "text", dtype: str = "<u2", block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(blocks, owners): flat token files made from ``docs``, and the key of each file's documents in order.

    Blocks (file, block, data) are the files cut at fixed sizes, wherever
    documents end. A text that spells the separator is ordinary text. NULL and
    empty texts give documents of no tokens.
    """
    spark = docs.sparkSession
    shared = load(spark, tokenizer_path)
    narrow = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    schema = f"kind string, file int, no long, data binary, key {dict(narrow.dtypes)['key']}"
    key_type = narrow.schema["key"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        file, table, arrow_key = TaskContext.get().partitionId(), tokenizer(shared.value), to_arrow_type(key_type)
        written = documents = 0
        rest = np.zeros(0, dtype=dtype)

        def rows(kind: str, first: int, data: list, keys: pa.Array | None) -> pa.RecordBatch:
            n = len(data) if keys is None else len(keys)
            return pa.RecordBatch.from_arrays(
                [pa.array([kind] * n), pa.array([file] * n, pa.int32()), pa.array(range(first, first + n), pa.int64()), pa.array(data if keys is None else [None] * n, pa.binary()), pa.nulls(n, arrow_key) if keys is None else keys.cast(arrow_key)],
                ["kind", "file", "no", "data", "key"],
            )

        for batch in batches:
            yield rows("document", documents, [], batch["key"])
            documents += batch.num_rows
            ends = np.array([separator], dtype=dtype)
            parts = [rest]
            for ids in table.encode(batch["text"].to_pylist(), specials=False):
                parts += [np.array(ids, dtype=dtype), ends]
            flat = np.concatenate(parts)
            whole = len(flat) // block * block
            rest = flat[whole:]
            for at in range(0, whole, 64 * block):
                cut = [flat[i : i + block].tobytes() for i in range(at, min(whole, at + 64 * block), block)]
                yield rows("block", written, cut, None)
                written += len(cut)
        if len(rest):
            yield rows("block", written, [rest.tobytes()], None)

    path = new_folder(spark, "tokens")
    narrow.mapInArrow(run, schema).write.partitionBy("kind").option("compression", "zstd").parquet(path)
    stored = spark.read.schema(schema).parquet(path)
    return (
        stored.where("kind = 'block'").select("file", F.col("no").alias("block"), "data"),
        stored.where("kind = 'document'").select("file", F.col("no").alias("ordinal"), "key"),
    )


def read_token_files(spark: SparkSession, path: str, width: int = 2, block: int = BLOCK) -> DataFrame:
    """(file, block, data) of plain binary files; Spark reads a file of 2 GB at most as one row."""
    files = spark.read.format("binaryFile").load(path)
    cuts = F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / (block * width))))
    return files.select(F.col("path").alias("file"), "content", F.explode(cuts).alias("block")).select(
        "file", "block", F.substring("content", (F.col("block") * block * width + 1).cast("int"), F.lit(block * width)).alias("data")
    )


def _found(separator: int, dtype: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks = [np.frombuffer(d or b"", dtype=dtype) for d in batch["data"].to_pylist()]
            ends = [np.flatnonzero(b == separator) for b in blocks]
            offsets = pa.array(np.cumsum([0, *map(len, ends)], dtype=np.int32))
            found = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([np.zeros(0, np.int64), *ends])))
            yield pa.RecordBatch.from_arrays([batch["file"], batch["block"], pa.array(list(map(len, blocks)), pa.int64()), found], ["file", "block", "size", "ends"])

    return run


def count_documents(blocks: DataFrame, separator: int, dtype: str = "<u2") -> DataFrame:
    """(file, ordinal, start, n_tokens, closed) of each document in ``blocks`` (file, block, data).

    start is the document's first token in its file; the separator isn't
    counted. Tokens behind a file's last separator are a document that isn't
    closed. A file without tokens has no documents.
    """
    kind = dict(blocks.dtypes)["file"]
    scanned = stage(blocks.select("file", "block", "data").mapInArrow(_found(separator, dtype), f"file {kind}, block long, size long, ends array<long>"), "separators")
    summed = scanned.select("file", "block", (F.col("block") / GROUP).cast("long").alias("group"), "size", "ends", F.size("ends").cast("long").alias("n"))

    def before(window, what: str):
        return F.coalesce(F.sum(what).over(window), F.lit(0))

    groups = summed.groupBy("file", "group").agg(F.sum("size").alias("size"), F.sum("n").alias("n"))
    above = Window.partitionBy("file").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    heads = groups.select("file", "group", before(above, "size").alias("size0"), before(above, "n").alias("n0"))
    inside = Window.partitionBy("file", "group").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    placed = summed.select("file", "group", "block", "size", "ends", "n", before(inside, "size").alias("size1"), before(inside, "n").alias("n1")).join(heads, ["file", "group"])
    at = placed.select("file", "group", "block", "size", (F.col("size0") + F.col("size1")).alias("first"), (F.col("n0") + F.col("n1")).alias("ordinal0"), "ends", "n")
    # Where the document that is open at the block's start began: behind the last separator before it.
    behind = at.select("*", F.when(F.col("n") > 0, F.col("first") + F.element_at("ends", -1) + 1).alias("last"))
    open_groups = behind.groupBy("file", "group").agg(F.max("last").alias("last"))
    open_heads = open_groups.select("file", "group", F.max("last").over(above).alias("open0"))
    opened = behind.select("*", F.max("last").over(inside).alias("open1")).join(open_heads, ["file", "group"])
    begun = opened.withColumn("open", F.coalesce("open1", "open0", F.lit(0).cast("long")))

    each = begun.select("file", "first", "ordinal0", "open", "ends", F.posexplode("ends").alias("i", "end"))
    start = F.when(F.col("i") == 0, F.col("open")).otherwise(F.col("first") + F.try_element_at("ends", F.col("i")) + 1)
    closed = each.select("file", (F.col("ordinal0") + F.col("i")).alias("ordinal"), start.alias("start"), (F.col("first") + F.col("end") - start).alias("n_tokens"), F.lit(True).alias("closed"))
    tails = begun.groupBy("file").agg(F.sum("size").alias("total"), F.sum("n").alias("ordinal"), F.coalesce(F.max("last"), F.lit(0)).alias("start"))
    rest = tails.where("total > start").select("file", "ordinal", "start", (F.col("total") - F.col("start")).alias("n_tokens"), F.lit(False).alias("closed"))
    return closed.unionByName(rest)
