"""Cleaning: times, casts, selection, duplicates, names and quality counts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliospark.functions.timegrid import local_time, utc_offset
from heliospark.schema import E_TODAY, E_TOTAL, KEYS, POWER, SLOT


def parse_time(df: DataFrame, col: str, site_tz: str | None = None, out: str = "ts") -> DataFrame:
    return df.withColumn(out, local_time(col, site_tz))


def with_offset(df: DataFrame, col: str, site_tz: str | None = None, ts: str = "ts") -> DataFrame:
    """Add ``_offset``, which with the wall-clock time makes an instant: the key of copies."""
    return df.withColumn("_offset", utc_offset(ts, col, site_tz))


def clean(df: DataFrame, time_col: str = "ts", numeric: Sequence[str] = ()) -> DataFrame:
    """Drop rows without a time and turn text into numbers, bad text into NULL."""
    rows = df.dropna(subset=[time_col])
    return rows.withColumns({c: F.col(c).try_cast("double") for c in numeric})


def select_vars(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = (*KEYS, SLOT)) -> DataFrame:
    return df.select(*keys, *[c for c in cols if c not in keys])


def dedupe(
    df: DataFrame,
    keys: Sequence[str] = (*KEYS, SLOT),
    order: Sequence[str] = ("_mtime", "_path"),
) -> DataFrame:
    """One row per key, the one that comes last in ``order``.

    An aggregate rather than a ranked window: copies of a key are folded
    before the shuffle, so a key with very many copies is no hot partition.
    The other columns close the order, which makes the choice unique.
    """
    rest = [c for c in df.columns if c not in keys]
    rank = [*order, *[c for c in rest if c not in order]]
    latest = df.groupBy(*keys).agg(F.max(F.struct(*rank)).alias("_latest"))
    return latest.select(*keys, *[F.col("_latest")[c].alias(c) for c in rest])


def to_model_names(df: DataFrame, power_factor: float = 1.0) -> DataFrame:
    """File names to dataset names; ``power_factor`` brings the series to kW."""
    named = df.withColumnsRenamed({"eToday": E_TODAY, "eTotal": E_TOTAL, "pac": POWER})
    if power_factor != 1.0 and POWER in named.columns:
        named = named.withColumn(POWER, F.col(POWER) * F.lit(power_factor))
    return named


def quality_counts(
    df: DataFrame, bounds: Mapping[str, tuple[float, float]], keys: Sequence[str] = KEYS
) -> DataFrame:
    """Rows, missing and out-of-range values per key and variable.

    Values are counted, never altered.
    """
    counts = [F.count(F.lit(1)).alias("rows")]
    for name, (low, high) in bounds.items():
        counts.append(F.count_if(F.col(name).isNull()).alias(f"{name}|missing"))
        counts.append(F.count_if(~F.col(name).between(low, high)).alias(f"{name}|outside"))
    wide = df.groupBy(*keys).agg(*counts)
    lines = F.array(
        *[
            F.struct(
                F.lit(name).alias("variable"),
                F.col(f"{name}|missing").alias("missing"),
                F.col(f"{name}|outside").alias("outside"),
            )
            for name in bounds
        ]
    )
    return wide.select(*keys, "rows", F.inline(lines))
