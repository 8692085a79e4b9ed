"""Lines that many documents share, dropped everywhere; incremental and reversible.

A store keeps two tables in a folder: the exact reference counts (line key,
number of documents that hold it) and one cuckoo filter for each shard of the
keys that reach the threshold. Adding documents adds to the counts, removing
them subtracts; keys that cross the threshold enter or leave their shard's
filter. Dropping lines asks the filters first, so that only lines that are
probably frequent are joined with the exact counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heliospark.llm.common import BLANKS, ascii_lower, stage
from heliospark.llm.cuckoo import CuckooFilter
from heliospark.session import new_folder

#: Each shard's filter is sent to as many places, so that a frequent line is spread over them.
SALTS = 16
_FILTERS = "shard int, filter binary"


def line_keys(text: Column, min_chars: int = 1) -> Column:
    """The MD5 digests (hex) of the text's line keys in order; NULL for keys that are too short.

    The key is the line without white space at both ends and with A-Z in lower
    case. Keys of different lines meet with a probability of 2^-128 a pair.
    """
    lines = F.split(ascii_lower(F.coalesce(text, F.lit(""))), "\n", -1)

    def key(line: Column) -> Column:
        bare = F.btrim(line, F.lit(BLANKS))
        return F.when(F.char_length(bare) >= min_chars, F.md5(bare.cast("binary")))

    return F.transform(lines, key)


def _shard(shards: int) -> Column:
    return F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int")


class LineStore:
    """Counts and filters under ``folder``; each change writes a new version.

    Rows of ``docs`` count as one document each, also where they repeat an id.
    NULL and empty texts hold one empty line, which has no key of one character
    or more. Removing documents that were never added is an error of the
    caller; counts below one leave the table.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, threshold: int = 10, min_chars: int = 1, shards: int = 64) -> None:
        self.spark, self.folder = spark, folder or new_folder(spark, "lines")
        self.threshold, self.min_chars, self.shards = threshold, min_chars, shards
        self.version = 0

    def _path(self, what: str) -> str:
        return f"{self.folder}/{what}-{self.version:06d}"

    def references(self) -> DataFrame:
        schema = "key string, n_docs long, was long, shard int"
        return self.spark.read.schema(schema).parquet(self._path("refs")) if self.version else self.spark.createDataFrame([], schema)

    def filters(self) -> DataFrame:
        return self.spark.read.schema(_FILTERS).parquet(self._path("filters")) if self.version else self.spark.createDataFrame([], _FILTERS)

    def insert(self, keys: DataFrame) -> None:
        """``keys``: one row for each document, its line keys in the column keys."""
        self._change(keys, 1)

    def delete(self, keys: DataFrame) -> None:
        self._change(keys, -1)

    def _change(self, keys: DataFrame, sign: int) -> None:
        held = keys.select(F.explode(F.array_distinct("keys")).alias("key")).where(F.col("key").isNotNull())
        delta = held.groupBy("key").agg(F.count(F.lit(1)).alias("by"))
        if self.version:
            old = self.references().select("key", F.col("n_docs").alias("was"))
            both = old.join(delta, "key", "full_outer")
            counts = both.select("key", (F.coalesce("was", F.lit(0)) + sign * F.coalesce("by", F.lit(0))).alias("n_docs"), F.coalesce("was", F.lit(0)).alias("was"))
        else:
            counts = delta.select("key", (sign * F.col("by")).alias("n_docs"), F.lit(0).cast("long").alias("was"))
        filters = self.filters()
        self.version += 1
        counts.withColumn("shard", _shard(self.shards)).where((F.col("n_docs") > 0) | (F.col("was") > 0)).write.parquet(self._path("refs"))
        self._refilter(filters).write.parquet(self._path("filters"))

    def _refilter(self, old: DataFrame) -> DataFrame:
        """Each shard's filter after the keys that crossed the threshold."""
        refs, least = self.references(), self.threshold
        crossed = (F.col("n_docs") >= least) != (F.col("was") >= least)
        digest = F.unhex("key").alias("digest")
        if self.version == 1:
            moved = refs.where(crossed).select("shard", digest)
            return moved.groupBy("shard").applyInArrow(_built, _FILTERS)
        # Shards that a filter leaves too full are built anew from the counts.
        moved = refs.where(crossed).select("shard", digest, (F.col("n_docs") >= least).alias("enters"))
        changed = stage(old.groupBy("shard").cogroup(moved.groupBy("shard")).applyInArrow(_updated, "shard int, filter binary, full boolean"), "filters")
        full = changed.where("full").select("shard")
        anew = refs.where(F.col("n_docs") >= least).join(full, "shard", "left_semi").select("shard", digest)
        return changed.where("not full").select("shard", "filter").unionByName(anew.groupBy("shard").applyInArrow(_built, _FILTERS))

    def frequent_lines(self, keys: DataFrame, text_key: str) -> DataFrame:
        """(``text_key``, line): the lines of ``keys`` to drop, lines numbered from 0."""
        # Copies of a text ask once.
        texts = keys.groupBy(text_key).agg(F.any_value("keys").alias("keys"))
        lines = texts.select(text_key, F.posexplode("keys").alias("line", "key")).where(F.col("key").isNotNull())
        routed = lines.select(
            (_shard(self.shards) * SALTS + F.pmod(F.xxhash64(text_key), F.lit(SALTS)).cast("int")).alias("route"),
            F.col(text_key).alias("owner"),
            "line",
            F.unhex("key").alias("body"),
        )
        everywhere = self.filters().withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        sent = everywhere.select(
            (F.col("shard") * SALTS + F.col("salt")).cast("int").alias("route"),
            F.lit(None).cast(dict(keys.dtypes)[text_key]).alias("owner"),
            F.lit(-1).alias("line"),
            F.col("filter").alias("body"),
        )
        # Line -1 is the filter: it comes before the lines that it is asked for.
        in_order = routed.unionByName(sent).repartition("route").sortWithinPartitions("route", "line")
        likely = in_order.mapInArrow(_probed, in_order.schema).select(F.col("owner").alias(text_key), "line", F.lower(F.hex("body")).alias("key"))
        frequent = self.references().where(F.col("n_docs") >= self.threshold).select("key")
        return likely.join(frequent, "key", "left_semi").select(text_key, "line")


def _built(group: pa.Table) -> pa.Table:
    made = CuckooFilter.build(group["digest"].to_pylist())
    return pa.table({"shard": group["shard"][:1].cast(pa.int32()), "filter": pa.array([made.to_bytes()], pa.binary())})


def _updated(old: pa.Table, moved: pa.Table) -> pa.Table:
    shard = (old if old.num_rows else moved)["shard"][0].as_py()
    held = CuckooFilter.from_bytes(old["filter"][0].as_py()) if old.num_rows else CuckooFilter()
    digests, enters = moved["digest"].to_pylist(), moved["enters"].to_pylist()
    held.delete([d for d, up in zip(digests, enters, strict=True) if not up])
    full = not held.insert([d for d, up in zip(digests, enters, strict=True) if up])
    return pa.table({"shard": pa.array([shard], pa.int32()), "filter": pa.array([held.to_bytes()], pa.binary()), "full": pa.array([full])})


def _probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines that their route's filter holds."""
    route, held = None, None
    for batch in batches:
        routes = batch["route"].to_numpy()
        lines = batch["line"].to_numpy()
        keep = np.zeros(batch.num_rows, dtype=bool)
        starts = np.flatnonzero(np.diff(routes, prepend=routes[:1] - 1)) if batch.num_rows else []
        for start, end in zip(starts, [*starts[1:], batch.num_rows], strict=True):
            if routes[start] != route:
                route, held = routes[start], None
            if lines[start] < 0:
                held = CuckooFilter.from_bytes(batch["body"][int(start)].as_py())
                start += 1
            if held is not None and end > start:
                keep[start:end] = held.contains(batch["body"][int(start) : int(end)].to_pylist())
        if keep.any():
            yield batch.filter(pa.array(keep))


def drop_lines(docs: DataFrame, text: str = "text", threshold: int = 10, min_chars: int = 1, shards: int = 64) -> DataFrame:
    """For each row of ``docs``: row (a struct of its columns), kept (its text), n_lines, n_dropped.

    Lines whose key has ``min_chars`` code points or more and is in at least
    ``threshold`` documents go, in every document; the others stay, joined by a
    line feed. NULL and empty texts have one line and keep the empty text. Equal
    texts lose equal lines, so decisions are made for each text once.
    """
    spark = docs.sparkSession
    body = F.coalesce(F.col(text), F.lit(""))
    digest = F.md5(body.cast("binary"))
    keys = stage(docs.select(digest.alias("text_key"), line_keys(F.col(text), min_chars).alias("keys")), "line-keys")
    store = LineStore(spark, threshold=threshold, min_chars=min_chars, shards=shards)
    store.insert(keys)
    # Stored, so that the join below is Spark's own to divide where many rows hold one text.
    drops = stage(store.frequent_lines(keys, "text_key").groupBy("text_key").agg(F.sort_array(F.collect_set("line")).alias("gone")), "drops")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), body.alias("body"), digest.alias("text_key"))
    joined = rows.join(drops, "text_key", "left")
    lines = F.split("body", "\n", -1)
    kept = F.filter(lines, lambda _, i: ~F.array_contains("gone", i))
    return joined.select(
        "row",
        F.when(F.col("gone").isNull(), F.col("body")).otherwise(F.array_join(kept, "\n")).alias("kept"),
        F.size(lines).cast("long").alias("n_lines"),
        F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_dropped"),
    )
