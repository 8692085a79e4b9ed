"""Data whose answers are known, made with Spark alone."""

import math

from pyspark.sql import functions as F

from heliospark.functions.calendar import features_all

START = "2023-01-02 00:00:00"


def grid(spark, days, step_minutes=5, plants=1):
    per_day = 1440 // step_minutes
    index = spark.range(days * per_day * plants)
    n = F.col("id") % (days * per_day)
    slot = F.lit(START).cast("timestamp_ntz") + F.make_dt_interval(mins=(n * step_minutes).cast("int"))
    plant = F.concat(F.lit("P"), F.floor(F.col("id") / (days * per_day)).cast("string"))
    return index.select(plant.alias("plant_id"), slot.alias("slot"), n.alias("n"))


def _hour():
    return F.hour("slot") + F.minute("slot") / 60


def clear_power():
    return 5 * F.greatest(F.lit(0.0), F.sin((_hour() - 6) * math.pi / 12))


def pv_clear(spark, days=120, plants=1, step_minutes=5):
    rows = grid(spark, days, step_minutes, plants)
    return rows.select("plant_id", "slot", clear_power().alias("power (kW)"))


def pv_weather(spark, days=40, step_minutes=60, plants=1, noise=0.05):
    """Power is linear in irradiance, which varies from day to day."""
    rows = grid(spark, days, step_minutes, plants)
    cloud = 0.6 + 0.4 * F.sin(F.floor(F.col("n") / (1440 // step_minutes)) * 1.7)
    ghi = 180 * clear_power() * cloud
    day = F.to_date("slot")
    rows = rows.withColumns(
        {
            "ghi": ghi,
            "power (kW)": ghi * 0.005 + F.randn(5) * noise,
            "dni": ghi * 0.8,
            "gti": ghi * 1.1,
            "air_temp": 15 + 8 * F.sin((_hour() - 9) * math.pi / 12),
            "relative_humidity": 50 - 20 * F.sin((_hour() - 9) * math.pi / 12),
            "wind_speed_10m": 3 + F.rand(6),
            "wind_direction_10m": F.rand(7) * 360,
            "eToday (kWh)": F.hour("slot") * 1.0,
            "eTotal (kWh)": F.datediff(day, F.lit("2023-01-01")) * 24.0 + F.hour("slot"),
        }
    )
    return features_all(rows.drop("n"))


def arma_11(spark, n=40_000, phi=0.6, theta=0.4, plants=2, sigma=1.0):
    """ARMA(1,1) as the sum of its decaying shocks, cut off where they vanish."""
    span = 60
    shocks = spark.range(n * plants).select(
        F.floor(F.col("id") / n).alias("p"), (F.col("id") % n).alias("i"), (F.randn(11) * sigma).alias("e")
    )
    psi = [1.0] + [(phi + theta) * phi ** (k - 1) for k in range(1, span)]
    spread = shocks.select(
        "p", "e", "i", F.posexplode(F.array(*[F.lit(v) for v in psi])).alias("k", "w")
    )
    y = spread.select("p", (F.col("i") + F.col("k")).alias("t"), (F.col("e") * F.col("w")).alias("v"))
    y = y.groupBy("p", "t").agg(F.sum("v").alias("y")).where((F.col("t") >= span) & (F.col("t") < n))
    slot = F.timestamp_seconds(F.lit(1_672_617_600) + F.col("t") * 300).cast("timestamp_ntz")
    return y.select(
        F.concat(F.lit("P"), F.col("p").cast("string")).alias("plant_id"),
        slot.alias("slot"),
        F.col("y").alias("power (kW)"),
    )
