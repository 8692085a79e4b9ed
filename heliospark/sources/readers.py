"""Readers for export files, the homogenised dataset and stored stages."""

from __future__ import annotations

import datetime as dt
import json
import re
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heliospark.schema import (
    CORRUPT,
    DEFAULT_PLANT,
    END,
    FECHA,
    GENERATION_FILE,
    PLANT,
    RAW_SCALARS,
    RAW_SERIES,
    SLOT,
    WEATHER,
    WEATHER_FILE,
)
from heliospark.session import shared_root

SOURCE_COLUMNS = ["_path", "_mtime"]


def _read_json(spark, path, schema, plant_id, multi_line) -> DataFrame:
    def read(files, whole: bool, base: str | None = None) -> DataFrame:
        reader = spark.read if base is None else spark.read.option("basePath", base)
        raw = (
            reader.schema(schema)
            .option("multiLine", whole)
            .option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", CORRUPT)
            .json(files)
        )
        return with_source(raw, plant_id)

    if multi_line is not None:
        return read(path, multi_line)
    kinds = file_kinds(spark, path)
    by_line, whole = ([f for f, k in kinds if k == kind] for kind in ("lines", "document"))
    if not by_line or not whole:
        return read(path, not by_line)
    base = path if isinstance(path, str) else None
    return read(whole, True, base).unionByName(read(by_line, False, base))


#: Bytes of a file's head that are looked at; a document that long on one line is a document.
HEAD_BYTES = 1 << 20


def file_kinds(spark: SparkSession, path: str | list[str]) -> list[tuple[str, str]]:
    """(file, kind) of each JSON file: ``lines`` if its first line is a whole document and others follow, else ``document``.

    Tasks read the files' heads; the driver, which lists the files for Spark
    anyway, gets a word for each.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = [_kind_of(f, n) for f, n in zip(batch["path"].to_pylist(), batch["length"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch["path"], pa.array(kinds, pa.string())], ["path", "kind"])

    tasks = spark.sparkContext.defaultParallelism
    return [tuple(r) for r in files.repartition(tasks).mapInArrow(run, "path string, kind string").collect()]


def _kind_of(uri: str, length: int) -> str:
    local = uri.startswith("file:")
    try:
        files, name = (
            (pafs.LocalFileSystem(), unquote(re.sub("^file:/+", "/", uri))) if local else pafs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", uri))
        )
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError):
        # A store that only Spark reads: whole documents are right for every file.
        return "document"
    with files.open_input_stream(name) as stream:
        head = stream.read(HEAD_BYTES)
    first, mark, rest = head.lstrip().partition(b"\n")
    if not mark or not rest.strip():
        return "document"
    try:
        return "lines" if isinstance(json.loads(first), dict) else "document"
    except ValueError:
        return "document"


def with_source(raw: DataFrame, plant_id: str) -> DataFrame:
    """Add plant, file path and file time to raw documents."""
    # A folder laid out as plant_id=<id>/ names its own plants.
    if PLANT not in raw.columns:
        raw = raw.withColumn(PLANT, F.lit(plant_id))
    return raw.withColumns(
        {
            PLANT: F.col(PLANT).cast("string"),
            "_path": F.col("_metadata.file_path"),
            "_mtime": F.col("_metadata.file_modification_time"),
        }
    )


def read_generation(
    spark: SparkSession,
    path: str | list[str],
    plant_id: str = DEFAULT_PLANT,
    multi_line: bool | None = True,
) -> DataFrame:
    """Generation exports, one row per document, the series still raw JSON.

    ``multi_line=False`` reads compacted files of one document per line, which
    Spark can split; ``None`` decides it by each file's head (``file_kinds``).
    """
    return _read_json(spark, path, GENERATION_FILE, plant_id, multi_line)


def read_weather(
    spark: SparkSession,
    path: str | list[str],
    plant_id: str = DEFAULT_PLANT,
    multi_line: bool | None = True,
) -> DataFrame:
    """Weather observations; numbers may be quoted, bad ones become NULL."""
    raw = _read_json(spark, path, WEATHER_FILE, plant_id, multi_line)
    return raw.withColumns({c: F.col(c).try_cast("double") for c in WEATHER})


def good_rows(df: DataFrame) -> DataFrame:
    return df.where(F.col(CORRUPT).isNull()).drop(CORRUPT)


def corrupt_rows(df: DataFrame) -> DataFrame:
    """Text of documents that are no JSON, with the file they came from.

    ``fields`` counts what was read before the fault; it also makes the reader
    parse those fields, without which it could not tell a fault.
    """
    fields = [c for c in df.columns if c not in (PLANT, CORRUPT, *SOURCE_COLUMNS)]
    read = sum((F.col(c).isNotNull().cast("int") for c in fields), F.lit(0))
    return df.where(F.col(CORRUPT).isNotNull()).select(
        PLANT, *SOURCE_COLUMNS, CORRUPT, read.alias("fields")
    )


def document_quality(df: DataFrame, source: str) -> DataFrame:
    """Documents of each plant, those that are no JSON or hold no field, and those whose series cannot be read.

    (source, plant_id, variable, check, n); a check without findings has n = 0.
    """
    if RAW_SERIES in df.columns:
        empty = F.coalesce(F.size(_entries(F.col(RAW_SERIES))) < 1, F.lit(True))
    else:
        empty = F.lit(False)
    fields = [c for c in df.columns if c not in (PLANT, CORRUPT, *SOURCE_COLUMNS)]
    blank = F.coalesce(*[F.col(c).cast("string") for c in fields]).isNull()
    whole = F.col(CORRUPT).isNull()
    counts = df.groupBy(PLANT).agg(
        F.count(F.lit(1)).alias("documents"),
        F.count_if(~whole).alias("corrupt"),
        F.count_if(whole & empty).alias("series unreadable"),
        F.count_if(whole & blank).alias("without fields"),
    )
    checks = F.array(*[F.struct(F.lit(c).alias("check"), F.col(c).alias("n")) for c in ("documents", "corrupt", "without fields", "series unreadable")])
    return counts.select(F.lit(source).alias("source"), PLANT, F.lit(None).cast("string").alias("variable"), F.inline(checks))


def _entries(series: Column) -> Column:
    """Either shape of the series as an array of (time, pac)."""
    pairs = F.from_json(series, "array<struct<time:string,pac:string>>")
    keyed = F.transform(
        F.map_entries(F.from_json(series, "map<string,string>")),
        lambda e: F.struct(e["key"].alias("time"), e["value"].alias("pac")),
    )
    return F.when(series.rlike(r"^\s*\["), pairs).otherwise(keyed)


def explode_series(df: DataFrame, carry: list[str] | None = None, keep_empty: bool = False) -> DataFrame:
    """One row per record of the nested series: ``time``, ``pac``, ``pos``.

    ``carry`` lists the document columns to keep; by default all but the series.
    ``keep_empty`` keeps documents without records as one row of NULLs.
    """
    if carry is None:
        carry = [c for c in df.columns if c not in (RAW_SERIES, CORRUPT)]
    entries = _entries(F.col(RAW_SERIES))
    if keep_empty:
        generated = F.posexplode_outer(entries)
    else:
        generated = F.posexplode(entries)
    rows = df.select(*[F.col(c) for c in carry], generated.alias("pos", "_record"))
    return rows.select(
        *carry,
        "pos",
        F.col("_record.time").alias("time"),
        F.col("_record.pac").try_cast("double").alias("pac"),
    )


def with_scalars(df: DataFrame, keep_empty: bool = False) -> DataFrame:
    """Series rows that carry the document's scalars as numbers."""
    numbers = df.withColumns({c: F.col(c).try_cast("double") for c in RAW_SCALARS})
    return explode_series(numbers, keep_empty=keep_empty)


def load_dataset(spark: SparkSession, path: str) -> DataFrame:
    """The homogenised dataset, its calendar features stored beside it."""
    return spark.read.parquet(path)


def load_ends(
    spark: SparkSession, path: str, as_of: dt.datetime | None = None, ts: str = SLOT
) -> DataFrame:
    """The latest slot of each series stored at ``path``, as ``views.series_ends`` gives it.

    Read from the table that each write keeps beside the rows, a row a series
    and day; of a day written more than once the latest write counts. With
    ``as_of``, later slots don't count; only that one day of the rows themselves
    is looked at.
    """
    daily = spark.read.parquet(f"{path.rstrip('/')}_ends")
    daily = daily.join(daily.groupBy(FECHA).agg(F.max("version").alias("version")), [FECHA, "version"])
    if as_of is not None:
        day = F.lit(as_of.date())
        rows = spark.read.parquet(path).where((F.col(FECHA) == day) & (F.col(ts) <= F.lit(as_of.isoformat(sep=" ")).cast("timestamp_ntz")))
        daily = daily.where(F.col(FECHA) < day).select(PLANT, ts).unionByName(rows.select(PLANT, ts))
    return daily.groupBy(PLANT).agg(F.max(ts).alias(END))


def stage_path(spark: SparkSession, name: str, root: str | None = None) -> str:
    return f"{root or shared_root(spark)}/stages/{name}"


def read_stage(spark: SparkSession, name: str, root: str | None = None) -> DataFrame:
    return spark.read.parquet(stage_path(spark, name, root))
