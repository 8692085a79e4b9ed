"""Reads the given tables as generation and weather readings.

The tables hold no photovoltaic data; ``events`` stands in. A purchase is a
power reading, the other event types are weather readings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heliospark.functions.calendar import with_fecha
from heliospark.functions.timegrid import seconds_of
from heliospark.operators.align import align_generation, align_weather, homogenise
from heliospark.schema import (
    E_TODAY,
    E_TOTAL,
    FECHA,
    PLANT,
    POWER,
    SLOT,
    STEP,
)

NOMINAL_POWER = 500.0

# Which event type stands for which weather variable.
_WEATHER_SOURCE = {
    "air_temp": ("click", "value"),
    "relative_humidity": ("error", "value"),
    "ghi": ("view", "value"),
    "dni": ("view", "k"),
    "gti": ("signup", "value"),
    "wind_speed_10m": ("click", "k"),
    "wind_direction_10m": ("error", "k_degrees"),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _plant(many: bool, owner: str = "user_id") -> Column:
    """Four plants or one, told from the owner in both cases: a constant key
    would be folded away and leave joins on it without a condition."""
    return F.concat(F.lit("P"), (F.col(owner) % (4 if many else 1)).cast("string"))


def power_readings(spark: SparkSession, sf_dir: str, many: bool = True) -> DataFrame:
    events = table(spark, sf_dir, "events").where(F.col("event_type") == "purchase")
    return events.select(_plant(many).alias(PLANT), "ts", F.col("value").alias(POWER))


def weather_readings(spark: SparkSession, sf_dir: str, many: bool = True) -> DataFrame:
    events = table(spark, sf_dir, "events").where(F.col("event_type") != "purchase")
    k = F.get_json_object("props", "$.k").cast("double")
    values = {"value": F.col("value"), "k": k, "k_degrees": k * 3.6}
    columns = [
        F.when(F.col("event_type") == kind, values[value]).alias(name)
        for name, (kind, value) in _WEATHER_SOURCE.items()
    ]
    return events.select(_plant(many).alias(PLANT), "ts", *columns)


def power(spark: SparkSession, sf_dir: str, many: bool = True, step: str = STEP) -> DataFrame:
    return align_generation(power_readings(spark, sf_dir, many), step)


def generation(spark: SparkSession, sf_dir: str, many: bool = True, step: str = STEP) -> DataFrame:
    """Aligned power with the energy counters a plant would report."""
    rows = with_fecha(power(spark, sf_dir, many, step))
    hours = seconds_of(step) / 3600
    days = rows.groupBy(PLANT, FECHA).agg((F.sum(POWER) * F.lit(hours)).alias(E_TODAY))
    # One row per plant and day.
    running = Window.partitionBy(PLANT).orderBy(FECHA).rowsBetween(Window.unboundedPreceding, 0)
    days = days.withColumn(E_TOTAL, F.sum(E_TODAY).over(running))
    return rows.join(days, [PLANT, FECHA]).select(
        PLANT, SLOT, F.lit(NOMINAL_POWER).alias("nominalPower"), E_TODAY, E_TOTAL, POWER
    )


def weather(spark: SparkSession, sf_dir: str, many: bool = True, step: str = STEP) -> DataFrame:
    return align_weather(weather_readings(spark, sf_dir, many), step)


def homogenised(spark: SparkSession, sf_dir: str, many: bool = False, step: str = STEP) -> DataFrame:
    return homogenise(
        generation(spark, sf_dir, many, step), weather(spark, sf_dir, many, step)
    ).drop("nominalPower")


def order_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as readings over several years: plant, time, value in thousands."""
    orders = table(spark, sf_dir, "orders")
    return orders.select(
        _plant(True, "o_custkey").alias(PLANT),
        F.col("o_orderkey"),
        F.col("o_orderdate").alias(SLOT),
        (F.col("o_totalprice") / 1000).alias(POWER),
    )
