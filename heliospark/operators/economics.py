"""Value of generated energy at a tariff; auxiliary to the main views."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliospark.schema import FECHA, KEYS

_PERIODS = ("day", "week", "month", "quarter", "year")


def economics(daily: DataFrame, tariff: float | DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """``valor`` of each day's kWh.

    ``tariff`` is one price, or a table of the keys and ``tarifa``; its join is
    an equi-join whose strategy Spark picks from the table's measured size.
    """
    if isinstance(tariff, DataFrame):
        priced = daily.join(tariff.select(*keys, "tarifa"), list(keys), "left")
    else:
        priced = daily.withColumn("tarifa", F.lit(float(tariff)))
    return priced.withColumn("valor", F.col("kwh") * F.col("tarifa"))


def cost_by_period(
    daily: DataFrame,
    tariff: float | DataFrame,
    period: str = "month",
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    if period not in _PERIODS:
        raise ValueError(f"period must be one of {_PERIODS}")
    start = F.to_date(F.date_trunc(period, F.col(FECHA)))
    return (
        economics(daily, tariff, keys)
        .groupBy(*keys, start.alias("periodo"))
        .agg(F.sum("kwh").alias("kwh"), F.sum("valor").alias("valor"))
    )
