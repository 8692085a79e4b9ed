"""Values of the same series at an earlier time."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heliospark.functions.calendar import minute_of_day
from heliospark.functions.timegrid import days_after
from heliospark.schema import KEYS, SLOT


def lag_days(
    df: DataFrame, columns: Mapping[str, str], days: int, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Add each column's value at the same time of day, exactly ``days`` earlier.

    ``columns`` maps source to new name. Rows are grouped by time of day and
    ranged over by day number, so gaps give NULL, one shuffle serves all
    columns and a group holds one row per day, whatever the plant's size.
    """
    if days <= 0:
        raise ValueError("days must be positive")
    numbered = df.withColumns(
        {"_minute": minute_of_day(), "_day": F.unix_date(F.to_date(SLOT))}
    )
    same_time = (
        Window.partitionBy(*keys, "_minute").orderBy("_day").rangeBetween(-days, -days)
    )
    lagged = numbered.withColumns(
        {new: F.max(old).over(same_time) for old, new in columns.items()}
    )
    return lagged.drop("_minute", "_day")


def shift_days(df: DataFrame, days: int) -> DataFrame:
    """The same rows, dated ``days`` later: the lookup side of a lag join."""
    return df.withColumn(SLOT, days_after(F.col(SLOT), days))


def halo_blocks(
    df: DataFrame,
    index: str,
    block: int,
    halo: int,
) -> DataFrame:
    """Cut a long series into blocks that windows can be partitioned by.

    Adds ``_block`` and ``_halo``. The last ``halo`` index values before a
    block are copied into it, flagged, so that lags reach across the edge; a
    series of any length is then spread over many tasks.
    """
    if not 0 <= halo <= block:
        raise ValueError("halo must not exceed block")
    home = F.floor(F.col(index) / block)
    reaches_next = F.pmod(F.col(index), F.lit(block)) >= block - halo
    copies = F.when(
        reaches_next,
        F.array(
            F.struct(home.alias("_block"), F.lit(False).alias("_halo")),
            F.struct((home + 1).alias("_block"), F.lit(True).alias("_halo")),
        ),
    ).otherwise(F.array(F.struct(home.alias("_block"), F.lit(False).alias("_halo"))))
    return df.select("*", F.inline(copies))
