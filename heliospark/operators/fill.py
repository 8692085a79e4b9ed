"""Missing model inputs, filled alike in training and in serving."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliospark.functions.calendar import minute_of_day
from heliospark.functions.timegrid import circular_mean
from heliospark.schema import CIRCULAR, ENERGY, KEYS, WEATHER


def mean_of(column: str) -> Column:
    return circular_mean(column) if column in CIRCULAR else F.avg(column)


def usual_day(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = KEYS) -> DataFrame:
    """Mean of each column by series and time of day (``_minute``)."""
    return df.groupBy(*keys, minute_of_day().alias("_minute")).agg(*[mean_of(c).alias(c) for c in columns])


def fill_inputs(
    rows: DataFrame,
    known: DataFrame,
    keys: Sequence[str] = KEYS,
    by_time: Sequence[str] = WEATHER,
) -> DataFrame:
    """``rows`` with missing inputs replaced from ``known`` readings.

    Columns of ``by_time`` take the series' mean at that time of day, then, as
    the others do, its mean over all readings. What a series never measured
    stays missing.
    """
    names = [*ENERGY, *WEATHER]
    usual = usual_day(known, by_time, keys).withColumnsRenamed({c: f"_usual_{c}" for c in by_time})
    means = known.groupBy(*keys).agg(*[mean_of(c).alias(f"_mean_{c}") for c in names])
    joined = (
        rows.withColumn("_minute", minute_of_day())
        .join(usual, [*keys, "_minute"], "left")
        .join(means, list(keys), "left")
    )
    filled = {
        c: F.coalesce(c, *([f"_usual_{c}"] if c in by_time else []), f"_mean_{c}") for c in names
    }
    return joined.withColumns(filled).select(*rows.columns)
