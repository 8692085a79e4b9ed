"""

    python tools/large_readings.py FOLDER [ROWS]

A third of the rows belong to one plant, and half of those have one time
stamp; the rest is spread over 200 plants and 60 days.
"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from heliospark.operators import clean  # noqa: E402
from heliospark.operators.align import align_generation, align_weather, homogenise  # noqa: E402
from heliospark.operators.views import energy_view  # noqa: E402
from heliospark.schema import WEATHER  # noqa: E402
from heliospark.session import build_session  # noqa: E402
from heliospark.sources import writers  # noqa: E402


def readings(spark, rows: int):
    n = F.col("id")
    hot = n % 3 == 0
    noise = F.pmod(F.xxhash64("id"), F.lit(1 << 30)).cast("double") / (1 << 30)
    plant = F.when(hot, "P0").otherwise(F.concat(F.lit("P"), (1 + F.pmod(F.xxhash64("id", F.lit(1)), F.lit(200))).cast("string")))
    second = F.when(hot & (n % 2 == 0), 0).otherwise(F.pmod(F.xxhash64("id", F.lit(2)), F.lit(60 * 86400)))
    ts = F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=second.cast("decimal(18,6)"))
    return spark.range(rows).select(
        plant.alias("plant_id"), ts.alias("ts"), (noise * 5).alias("power (kW)"), *[(noise * (i + 10)).alias(c) for i, c in enumerate(WEATHER)], n.alias("_mtime"), F.lit("f").alias("_path")
    )


def main() -> None:
    folder, rows = sys.argv[1], int(sys.argv[2]) if len(sys.argv) > 2 else 15_000_000
    spark = build_session("large", "local[8]", spark__sql__shuffle__partitions="32", spark__ui__enabled="false", spark__driver__memory="8g", spark__checkpoint__dir=folder)
    spark.sparkContext.setLogLevel("ERROR")
    raw = f"{folder}/raw"
    readings(spark, rows).write.parquet(raw)
    table = spark.read.parquet(raw)
    power, weather = table.select("plant_id", "ts", "power (kW)"), table.select("plant_id", "ts", *WEATHER)
    both = homogenise(align_generation(power), align_weather(weather))

    def run(df):
        df.write.format("noop").mode("overwrite").save()

    jobs = {
        "scan of all columns": lambda: run(table),
        "align generation": lambda: run(align_generation(power)),
        "align weather (seven variables)": lambda: run(align_weather(weather)),
        "latest row per plant and time": lambda: run(clean.dedupe(table, ("plant_id", "ts"))),
        "align both and join": lambda: run(both),
        "the same, stored by day": lambda: writers.write_dataset(both, f"{folder}/dataset"),
        "daily mean of the stored slots": lambda: run(energy_view(spark.read.parquet(f"{folder}/dataset"), "daily_mean")),
        "last 7 days of each plant": lambda: run(energy_view(spark.read.parquet(f"{folder}/dataset"), "last7")),
    }
    for name, job in jobs.items():
        start = time.perf_counter()
        job()
        print(f"{name}: {time.perf_counter() - start:.1f} s", flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
