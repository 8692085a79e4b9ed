"""What the registered queries' plans must show."""

import datetime as dt
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as registry
from heliospark.models import linear
from heliospark.operators import views
from heliospark.sources import readers, writers
from tests.conftest import plan


@pytest.mark.parametrize("name", ["filter_dates", "filter_dates_climate", "history_table", "climate_table"])
def test_date_ranges_prune_days(spark, sf_dir, name):
    text = plan(registry.queries()[name](spark, sf_dir))
    assert re.search(r"PartitionFilters: \[[^\n]*fecha", text)


@pytest.mark.parametrize("name", ["forecast_fallback", "forecast_table", "forecast_daily", "history_vs_forecast", "view_last7", "view_last30"])
def test_no_raw_table_is_read_again(spark, sf_dir, name):
    assert f"{sf_dir}/events.parquet" not in plan(registry.queries()[name](spark, sf_dir))


def test_metrics_only_read_stored_answers(spark, sf_dir):
    text = plan(registry.queries()["eval_metrics"](spark, sf_dir))
    assert "Window" not in text and "events.parquet" not in text and "/predictions" in text


@pytest.mark.parametrize("name", ["view_last7", "view_last30", "history_days", "forecast_fallback"])
def test_trailing_views_find_their_end_without_a_scan_of_the_rows(spark, sf_dir, name):
    """Ends come from the table beside the rows, and spans of days as literals reach the scan."""
    text = plan(registry.queries()[name](spark, sf_dir))
    scans = re.findall(r"Location: [^\n]*\[([^\]]*)\][^\n]*\n(?:PartitionFilters: ([^\n]*)\n)?", text)
    rows = [(p, f) for p, f in scans if not p.rstrip().endswith("_ends") and "_ends" not in p]
    assert any("_ends" in p for p, _ in scans) and rows
    assert all(re.search(r"fecha[^\n]*(>=|<=)", f) and "Subquery" not in f for _, f in rows)


def test_a_silent_series_opens_its_own_days_only(spark, tmp_path):
    """One plant fell silent weeks before the others: its last days and theirs are asked for, none between."""
    path = str(tmp_path / "silent")
    rows = spark.range(0, 60 * 24).select(
        F.lit("P0").alias("plant_id"),
        (F.timestamp_seconds(F.lit(1_640_995_200) + F.col("id") * 3600)).cast("timestamp_ntz").alias("slot"),
        F.col("id").cast("double").alias("power (kW)"),
    )
    silent = rows.where("id < 480").withColumn("plant_id", F.lit("P1"))
    writers.write_dataset(rows.unionByName(silent), path)
    stored, ends = readers.load_dataset(spark, path), readers.load_ends(spark, path)
    assert len(ends.inputFiles()) <= 8
    days = [(dt.date(2022, 1, 13), dt.date(2022, 1, 20)), (dt.date(2022, 2, 22), dt.date(2022, 3, 1))]
    assert views.day_spans(ends, 7) == days
    week = views.energy_view(stored, "last7", ends=ends)
    filters = re.search(r"PartitionFilters: \[([^\n]*)\]", plan(week))[1]
    assert all(str((d - dt.date(1970, 1, 1)).days) in filters or str(d) in filters for span in days for d in span)
    assert {(r.plant_id, r["count"]) for r in week.groupBy("plant_id").count().collect()} == {("P0", 168), ("P1", 168)}
    # Ends that lie near each other share one span.
    assert len(views.day_spans(ends, 41)) == 1


def test_hours_of_stored_rows_reach_the_row_groups(spark, sf_dir):
    assert re.search(r"PushedFilters: \[[^\n]*hora", plan(registry.queries()["filter_hours"](spark, sf_dir)))


def test_a_task_passes_on_one_matrix_a_series(spark):
    """5,000 series, interleaved."""
    n = 5000
    rows = spark.range(0, 40_000, numPartitions=4).select((F.col("id") % n).alias("k"), F.rand(1).alias("x"), F.rand(2).alias("y"))
    sums = linear.moments(rows, ["k"], F.array(F.lit(1.0), "x", "y"), 3)
    got = sums.collect()
    assert len(got) == n and {r.n for r in got} == {8}
    one = rows.where("k = 17").collect()
    z = np.array([[1.0, r.x, r.y] for r in one])
    full = z.T @ z
    assert np.allclose(next(r.products for r in got if r.k == 17), full[np.triu_indices(3)])
