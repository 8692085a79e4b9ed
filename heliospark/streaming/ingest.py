"""Continuous reading of new export files into an append-only store of rows.

Parsing needs no state, so nothing waits for a watermark and no late file is
lost: every file is read once, its rows are appended with the file's time, and
readers keep the latest row of a slot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from heliospark.functions.calendar import with_fecha
from heliospark.operators import clean
from heliospark.schema import (
    CORRUPT,
    DEFAULT_PLANT,
    FECHA,
    GENERATION_FILE,
    PLANT,
    RAW_PERIOD_END,
    WEATHER,
    WEATHER_FILE,
)
from heliospark.sources import readers


def _stream(spark, path, schema, plant_id, multi_line, max_files) -> DataFrame:
    reader = (
        spark.readStream.schema(schema)
        .option("multiLine", multi_line)
        .option("columnNameOfCorruptRecord", CORRUPT)
    )
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return readers.with_source(reader.json(path), plant_id)


def stream_generation(
    spark: SparkSession,
    path: str,
    site_tz: str | None = None,
    plant_id: str = DEFAULT_PLANT,
    multi_line: bool = True,
    max_files: int | None = None,
) -> DataFrame:
    raw = _stream(spark, path, GENERATION_FILE, plant_id, multi_line, max_files)
    return _timed(readers.with_scalars(readers.good_rows(raw)), "time", site_tz)


def stream_weather(
    spark: SparkSession,
    path: str,
    site_tz: str | None = None,
    plant_id: str = DEFAULT_PLANT,
    multi_line: bool = True,
    max_files: int | None = None,
) -> DataFrame:
    raw = _stream(spark, path, WEATHER_FILE, plant_id, multi_line, max_files)
    rows = readers.good_rows(raw).withColumns({c: F.col(c).try_cast("double") for c in WEATHER})
    return _timed(rows, RAW_PERIOD_END, site_tz)


def _timed(rows: DataFrame, text: str, site_tz: str | None) -> DataFrame:
    """Wall-clock times, and as in batch the offset that tells the instants of a repeated hour apart."""
    timed = clean.with_offset(clean.clean(clean.parse_time(rows, text, site_tz)), text, site_tz)
    return with_fecha(timed, "ts").drop(text)


def append_rows(rows: DataFrame, out: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Append by day; files and checkpoint make each input file count once.

    ``once`` takes what has arrived and stops, for runs on a schedule.
    """
    writer = (
        rows.writeStream.format("parquet")
        .partitionBy(FECHA)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
    )
    if once:
        writer = writer.trigger(availableNow=True)
    return writer.start(out)


def latest_rows(spark: SparkSession, out: str) -> DataFrame:
    """The store with one row per plant and instant, the latest file's.

    Both readings of an hour that a clock change repeats stay, with the same
    wall-clock time; rows stored without an offset count by wall clock.
    """
    rows = spark.read.option("mergeSchema", "true").parquet(out).drop(FECHA)
    instant = [PLANT, "ts", *(["_offset"] if "_offset" in rows.columns else [])]
    order = ["_mtime", "_path", *(["pos"] if "pos" in rows.columns else [])]
    return clean.dedupe(rows, instant, order).drop(*order, "_offset")
