"""Alignment, views, splits and metrics on data with known answers."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from heliospark.functions import calendar
from heliospark.functions.timegrid import circular_mean
from heliospark.models import forest
from heliospark.operators import aggregates, clean, economics, evaluate, splits, views
from heliospark.operators.align import align_generation, align_weather, homogenise
from heliospark.operators.lags import halo_blocks, lag_days
from heliospark.schema import FEATURES
from heliospark.sources import readers, writers
from tests.conftest import plan
from tests.planted import pv_clear, pv_weather

P = "power (kW)"


def readings(spark, rows, schema):
    return spark.createDataFrame(rows, schema).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def test_alignment_counts_gaps_and_copies(spark):
    df = pv_clear(spark, days=2)
    kept = df.where(~F.hour("slot").isin(3, 4))
    ragged = kept.withColumn("ts", F.col("slot") + F.expr("interval 90 seconds")).drop("slot")
    twice = ragged.unionByName(ragged)
    out = align_generation(twice)
    assert out.count() == 2 * (288 - 24)
    assert out.join(df.withColumnRenamed(P, "p"), ["plant_id", "slot"]).where(
        F.abs(F.col(P) - F.col("p")) > 1e-12
    ).isEmpty()


def test_circular_mean(spark):
    rows = [("a", 350.0), ("a", 10.0), ("a", 20.0), ("b", 90.0), ("b", 270.0), ("c", 360.0), ("d", None)]
    df = spark.createDataFrame(rows, "g string, d double")
    got = {r["g"]: r["m"] for r in df.groupBy("g").agg(circular_mean("d").alias("m")).collect()}
    assert abs(got["a"] - 6.7) < 0.05
    assert got["b"] is None and got["d"] is None
    assert got["c"] == 0.0


def test_weather_label_side(spark):
    df = readings(spark, [("P0", "2024-01-01 10:05:00", 1.0)], "plant_id string, ts string, ghi double")
    assert align_weather(df, label="end").first()["slot"] == dt.datetime(2024, 1, 1, 10, 0)
    assert align_weather(df, label="start").first()["slot"] == dt.datetime(2024, 1, 1, 10, 5)


def test_homogenised_slots_are_unique(spark):
    rows = pv_weather(spark, days=3, plants=2).withColumn("ts", F.col("slot"))
    doubled = rows.unionByName(rows).drop("slot")
    out = homogenise(align_generation(doubled), align_weather(doubled))
    assert out.count() == out.select("plant_id", "slot").distinct().count() == 144
    text = plan(out)
    assert "NestedLoop" not in text and "CartesianProduct" not in text


def test_join_needs_no_shuffle_of_its_own(spark):
    rows = pv_weather(spark, days=3).withColumn("ts", F.col("slot")).drop("slot")
    out = homogenise(align_generation(rows), align_weather(rows))
    previous = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(homogenise(align_generation(rows), align_weather(rows)))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", previous)
    nodes = [line for line in text.splitlines() if line.startswith("(") and "Exchange" in line]
    assert len(nodes) == 2
    assert out.count() == 72


def test_dedupe_folds_hot_keys_before_the_shuffle(spark):
    copies = spark.range(30_000).select(
        F.lit("P0").alias("plant_id"),
        F.when(F.col("id") % 3 == 0, F.lit("2024-01-01 00:00:00"))
        .otherwise(F.date_format(F.timestamp_seconds(1_704_067_200 + F.col("id") * 300), "yyyy-MM-dd HH:mm:ss"))
        .cast("timestamp_ntz")
        .alias("slot"),
        F.col("id").alias("_mtime"),
        F.lit("f").alias("_path"),
        F.col("id").cast("double").alias(P),
    )
    out = clean.dedupe(copies)
    assert out.count() == 20_001
    hot = out.where(F.col("slot") == F.lit("2024-01-01").cast("timestamp_ntz")).first()
    assert hot[P] == 29_997.0
    text = plan(out)
    assert "partial_max" in text and "Window" not in text


def test_dates_and_hours(spark):
    df = pv_clear(spark, days=5, step_minutes=60)
    assert views.filter_dates(df, "2023-01-03", "2023-01-04").count() == 48
    assert views.filter_dates(df, dt.date(2023, 1, 3), dt.date(2023, 1, 3)).count() == 24
    noon = dt.datetime(2023, 1, 3, 12)
    assert views.filter_dates(df, noon, noon).count() == 24
    assert views.filter_hours(df, 6, 8).count() == 15
    assert views.history_table(df).count() == 120
    assert views.history_table(df, "2023-01-03", "2023-01-04", (6, 8)).count() == 6
    with pytest.raises(ValueError):
        views.history_table(df, start="2023-01-03")
    with pytest.raises(ValueError):
        views.filter_dates(df, "2023-01-04", "2023-01-03")
    with pytest.raises(ValueError):
        views.filter_hours(df, 9, 8)
    with pytest.raises(ValueError):
        views.climate_series(df, "slot")
    with pytest.raises(ValueError):
        views.energy_view(df, "weekly")


def test_closed_form_days(spark):
    df = pv_clear(spark, days=4)
    # Sum of a half sine sampled at 144 steps.
    total = 5 * sum(math.sin(i * math.pi / 144) for i in range(144))
    for row in views.energy_view(df, "daily_mean").collect():
        assert row[P] == pytest.approx(total / 288)
    assert {r[P] for r in views.energy_view(df, "daily_max").collect()} == {5.0}
    for row in aggregates.daily_generation(df).collect():
        assert row["kwh"] == pytest.approx(total / 12)


def test_recent_is_anchored_on_unfiltered_data(spark):
    df = pv_clear(spark, days=12, step_minutes=60)
    assert views.energy_view(df, "last7").count() == 168
    early = views.filter_dates(df, "2023-01-02", "2023-01-08")
    assert views.energy_view(early, "last7", of=df).count() == 48
    assert views.energy_view(early, "last7").count() == 168
    slots = [r["slot"] for r in views.energy_view(df, "full").collect()]
    assert slots == sorted(slots)


def test_a_given_anchor_gives_the_same_rows(spark):
    df = pv_clear(spark, days=12, step_minutes=60, plants=2)
    at = views.read_latest(df)
    assert at == dt.datetime(2023, 1, 13, 23)
    dated = calendar.with_fecha(df)
    for days in (1, 7, 30):
        lazy, given = views.recent(dated, days), views.recent(dated, days, at=at)
        assert lazy.exceptAll(given).isEmpty() and given.exceptAll(lazy).isEmpty()


def test_summary_is_one_pass(spark):
    df = pv_clear(spark, days=2)
    row = views.summary(df).first()
    assert row["total_registros"] == 576 and row["valor_maximo"] == 5.0
    assert row["fecha_inicial"] == dt.datetime(2023, 1, 2)
    assert row["fecha_final"] == dt.datetime(2023, 1, 3, 23, 55)


def test_seasons(spark):
    df = spark.createDataFrame([(f"2023-{m:02d}-15",) for m in range(1, 13)], "d string")
    rows = df.select(
        F.month("d").alias("m"), calendar.estacion("d").alias("n"), calendar.estacion("d", "south").alias("s")
    ).collect()
    north = {1: 0, 2: 0, 3: 1, 4: 1, 5: 1, 6: 2, 7: 2, 8: 2, 9: 3, 10: 3, 11: 3, 12: 0}
    assert {r["m"]: r["n"] for r in rows} == north
    assert {r["m"]: r["s"] for r in rows} == {m: (e + 2) % 4 for m, e in north.items()}


def test_lag_is_exact_across_gaps(spark):
    df = pv_clear(spark, days=5, step_minutes=60).withColumn(
        "v", F.unix_seconds(F.col("slot").cast("timestamp"))
    )
    holed = df.where(F.to_date("slot") != F.lit("2023-01-04"))
    out = lag_days(holed, {"v": "before"}, 1).collect()
    for row in out:
        if row["slot"].date() in (dt.date(2023, 1, 2), dt.date(2023, 1, 5)):
            assert row["before"] is None
        else:
            assert row["before"] == row["v"] - 86400


@pytest.mark.parametrize("horizon_days", [1, 2, 3])
def test_energy_inputs_never_look_ahead(spark, horizon_days):
    """Every energy input of a slot is a value of ``horizon_days`` before it."""
    stamp = F.unix_seconds(F.col("slot").cast("timestamp")).cast("double")
    df = pv_weather(spark, days=6).withColumns(
        {c: stamp for c in ("eToday (kWh)", "eTotal (kWh)", P)}
    )
    rows = forest.model_inputs(df, horizon_days)
    assert rows.columns == ["plant_id", "slot", *FEATURES, "objetivo"]
    age = F.col("objetivo") - F.greatest("eToday (kWh)", "eTotal (kWh)", P)
    ages = {r[0] for r in rows.select(age).dropna().distinct().collect()}
    assert ages == {horizon_days * 86400.0}
    # The imitation of contemporaneous inputs is what the check above catches.
    leaky = forest.model_inputs(df, horizon_days, "same_row")
    assert {r[0] for r in leaky.select(age).distinct().collect()} == {0.0}


@pytest.mark.parametrize("k,h,window", [(1, 3, 5), (3, 2, 4), (4, 1, 2)])
@pytest.mark.parametrize("mode", ["expanding", "sliding"])
def test_folds_never_overlap_in_time(spark, k, h, window, mode):
    df = pv_clear(spark, days=14, step_minutes=60)
    out = splits.folds(df, k, h, mode, window)
    spans = {
        (r["fold"], r["rol"]): r
        for r in out.groupBy("fold", "rol").agg(
            F.min("slot").alias("a"), F.max("slot").alias("b"), F.count("*").alias("n"), F.max("origin").alias("o")
        ).collect()
    }
    for fold in range(1, k + 1):
        train, test = spans[fold, "train"], spans[fold, "test"]
        assert train["b"] == train["o"] < test["a"]
        assert test["n"] == 24 * h
        if mode == "sliding":
            assert train["n"] == min(window, 14 - h * (k - fold + 1)) * 24
        if fold > 1:
            assert spans[fold - 1, "test"]["b"] < test["a"]
    table = splits.fold_table(views.series_ends(df), k, h, (mode,), window)
    for fold in splits.read_folds(table):
        kept = out.where(F.col("fold") == fold.number)
        for role, rows in (("train", fold.train(df)), ("test", fold.test(df))):
            same = kept.where(F.col("rol") == role).select(df.columns)
            assert same.exceptAll(rows).isEmpty() and rows.exceptAll(same).isEmpty()


@pytest.mark.parametrize("mode", ["expanding", "sliding"])
@pytest.mark.parametrize("stored", [False, True])
def test_one_wrong_clock_changes_no_fold(spark, tmp_path, mode, stored):
    """Two plants, one of which ended ten days earlier, and a row of 2099: folds are those without it."""
    df = pv_clear(spark, days=30, plants=2, step_minutes=60)
    df = df.where((F.col("plant_id") == "P0") | (F.col("slot") < "2023-01-22"))
    wrong = df.where("plant_id = 'P1'").limit(1).withColumn("slot", F.lit("2099-01-01 00:00:00").cast("timestamp_ntz"))

    def counts(rows):
        out = splits.folds(rows, 3, 4, mode, 6).groupBy("plant_id", "fold", "origin", "rol").count()
        return sorted(map(tuple, out.collect()))

    clean, dirty = df, df.unionByName(wrong)
    if stored:
        for name, rows in (("clean", clean), ("dirty", dirty)):
            writers.write_stage(rows, name, str(tmp_path), by_day=True)
        clean, dirty = (readers.read_stage(spark, name, str(tmp_path)) for name in ("clean", "dirty"))
    assert counts(dirty) == counts(clean)
    tests = {(p, f): (o, n) for p, f, o, r, n in counts(dirty) if r == "test"}
    assert len(tests) == 6 and {n for _, n in tests.values()} == {96}
    assert tests["P0", 3][0] - tests["P1", 3][0] == dt.timedelta(days=10)
    ends = views.series_ends(dirty, as_of=dt.datetime(2030, 1, 1))
    for fold in splits.read_folds(splits.fold_table(ends, 3, 4, (mode,), 6)):
        assert fold.test(dirty).count() == 192
        assert fold.train(dirty).count() == sum(n for _, f, _, r, n in counts(clean) if f == fold.number and r == "train")
        assert fold.test_day < dt.date(2023, 3, 1)
    # An earlier as-of bound moves the origins back.
    early = splits.folds(df, 1, 1, as_of=dt.datetime(2023, 1, 10, 23)).where("rol = 'test'")
    assert early.agg(F.max("slot")).first()[0] == dt.datetime(2023, 1, 10, 23)


def test_holdout(spark):
    df = pv_clear(spark, days=4, step_minutes=60)
    train, test = splits.split_time(df, "2023-01-04 12:00:00")
    assert (train.count(), test.count()) == (60, 36)


def test_metrics(spark):
    rows = [("m", 1, 1.0, 2.0), ("m", 1, 3.0, 3.0), ("m", 1, 5.0, 3.0), ("m", 1, None, 9.0), ("c", 1, 2.0, 2.5), ("c", 1, 2.0, None)]
    df = spark.createDataFrame(rows, "model string, fold int, actual double, prediction double")
    got = {r["model"]: r for r in evaluate.metrics(df).collect()}
    m = got["m"]
    assert m["n"] == 3 and m["mae"] == pytest.approx(1.0)
    assert m["rmse"] == pytest.approx(math.sqrt(5 / 3))
    assert m["r2"] == pytest.approx(1 - 5 / 8) and m["bias"] == pytest.approx(-1 / 3)
    assert got["c"]["n"] == 1 and got["c"]["r2"] is None


def test_final_choice_prefers_the_steadier_of_equals(spark):
    rows = [("a", "s", 1.0, 0.5, 1.0), ("b", "s", 1.0, 0.1, 1.0), ("c", "s", 1.0, None, 1.0), ("d", "s", 2.0, 0.0, 1.0)]
    df = spark.createDataFrame(rows, "model string, strategy string, rmse double, rmse_std double, mae double")
    assert evaluate.select_final(df).first()["model"] == "b"
    assert "TakeOrderedAndProject" in plan(evaluate.select_final(df))


def test_blocks_cover_a_series_once(spark):
    df = spark.range(1000).select(F.lit("P0").alias("plant_id"), F.col("id").alias("_i"))
    out = halo_blocks(df, "_i", 64, 5)
    assert out.where("not _halo").count() == 1000
    sizes = [r["count"] for r in out.groupBy("_block").count().collect()]
    assert max(sizes) == 69
    assert {r["_i"] % 64 for r in out.where("_halo").collect()} == set(range(59, 64))


def test_economics(spark):
    daily = spark.createDataFrame(
        [("A", "2023-01-01", 2.0), ("A", "2023-02-01", 3.0), ("B", "2023-01-05", 4.0)],
        "plant_id string, fecha string, kwh double",
    ).withColumn("fecha", F.to_date("fecha"))
    assert [r["valor"] for r in economics.economics(daily, 2).orderBy("plant_id", "fecha").collect()] == [4.0, 6.0, 8.0]
    prices = spark.createDataFrame([("A", 1.0), ("B", 10.0)], "plant_id string, tarifa double")
    months = economics.cost_by_period(daily, prices, "month").orderBy("plant_id", "periodo").collect()
    assert [r["valor"] for r in months] == [2.0, 3.0, 40.0]
    with pytest.raises(ValueError):
        economics.cost_by_period(daily, 1.0, "fortnight")


def test_quality_counts_do_not_alter(spark):
    df = pv_weather(spark, days=2).withColumn("ghi", F.when(F.hour("slot") == 1, -5.0).when(F.hour("slot") != 2, F.col("ghi")))
    row = clean.quality_counts(df, {"ghi": (0.0, 1500.0)}).first()
    assert (row["rows"], row["missing"], row["outside"]) == (48, 2, 2)
