"""Writers for the dataset, stages, results and CSV exports."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliospark.functions.calendar import features_all, with_fecha
from heliospark.schema import FECHA, PLANT, SLOT
from heliospark.session import is_whole, new_folder
from heliospark.sources.readers import stage_path


def write_dataset(
    df: DataFrame,
    path: str,
    mode: str = "overwrite",
    hemisphere: str = "north",
    touched_days_only: bool = False,
) -> None:
    """Store the homogenised rows by day, and beside them where each series ends (``ends_path``).

    ``touched_days_only`` merges ``df`` into the days that it touches and leaves
    all others, so that a late file costs its days. Rows of a touched day that
    ``df`` does not hold stay; of a slot that both hold, the new row wins, as the
    latest file does. The merged days are stored whole before any is replaced.

    Rebalancing by day keeps a day in few files and lets adaptive execution
    split a day that outgrows the advisory size. Rows are sorted inside a file
    so that row-group statistics prune by plant and slot, and the calendar
    columns are stored so that an hour filter reaches the scan.
    """
    rows = with_fecha(features_all(df, hemisphere=hemisphere))
    if touched_days_only and is_whole(df.sparkSession, path):
        _merge_days(rows, path)
    else:
        _write_by_day(rows, path, mode)


def ends_path(path: str) -> str:
    """Where the ends of the series of the rows stored at ``path`` lie."""
    return f"{path.rstrip('/')}_ends"


def _merge_days(rows: DataFrame, path: str) -> None:
    spark = rows.sparkSession
    work = new_folder(spark, "late")
    rows.write.parquet(f"{work}/new")
    new = spark.read.parquet(f"{work}/new")
    # As many values as the batch has days.
    days = [r[0] for r in new.select(FECHA).distinct().collect()]
    if not days:
        return
    old = spark.read.parquet(path).where(F.col(FECHA).isin(days))
    keys = [c for c in (PLANT, SLOT) if c in new.columns]
    kept = old.join(new.select(*keys), keys, "left_anti")
    kept.unionByName(new, allowMissingColumns=True).write.parquet(f"{work}/merged")
    merged = spark.read.parquet(f"{work}/merged")
    _write_by_day(merged, path, "overwrite", touched_days_only=True)


def _write_by_day(df: DataFrame, path: str, mode: str, touched_days_only: bool = False) -> None:
    dated = with_fecha(df)
    order = [c for c in (FECHA, PLANT, SLOT) if c in dated.columns]
    (
        dated.hint("rebalance", FECHA)
        .sortWithinPartitions(*order)
        .write.mode(mode)
        .option("partitionOverwriteMode", "dynamic" if touched_days_only else "static")
        .partitionBy(FECHA)
        .parquet(path)
    )
    if PLANT in dated.columns and SLOT in dated.columns:
        # A row a series and day: of what was merged, or of all that is stored, which reads two columns.
        whole = dated if touched_days_only else dated.sparkSession.read.parquet(path)
        ends = whole.groupBy(PLANT, FECHA).agg(F.max(SLOT).alias(SLOT))
        # Days written again are told apart by the time of the write; the latest one counts.
        ends = ends.withColumn("version", F.lit(time.time_ns()))
        ends.hint("rebalance").write.mode("append" if touched_days_only else "overwrite").parquet(ends_path(path))


def write_stage(
    df: DataFrame, name: str, root: str | None = None, by_day: bool = False, in_time: bool = False
) -> str:
    """Store a stage's rows, which also ends their lineage.

    ``by_day`` suits stages of which later jobs read a time range each.
    ``in_time`` does so too where days are small: rows lie in order of time, so
    that the files' statistics prune, and files follow the size of the rows, not
    the number of days.
    """
    path = stage_path(df.sparkSession, name, root)
    if by_day:
        _write_by_day(df, path, "overwrite")
    elif in_time:
        dated = with_fecha(df)
        order = [c for c in (FECHA, PLANT, SLOT) if c in dated.columns]
        dated.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").parquet(path)
    else:
        df.write.mode("overwrite").parquet(path)
    return path


def export_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV part files with a header, in the order of ``df``."""
    (
        df.write.mode(mode)
        .option("header", True)
        .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss")
        .csv(path)
    )


def write_metrics(df: DataFrame, path: str, mode: str = "append") -> None:
    """Results of an experiment run, stamped with the time they were stored."""
    df.withColumn("stored_at", F.current_timestamp()).write.mode(mode).parquet(path)
