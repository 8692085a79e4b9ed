"""Models on planted series, and forecasts with and without a model."""

import datetime as dt
import math
import os
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from heliospark.models import additive, arima, forest, linear
from heliospark.operators import evaluate, views
from heliospark.operators import forecast as fc
from heliospark.operators.fill import fill_inputs
from heliospark.plans import pipeline
from heliospark.session import new_folder
from heliospark.sources import readers, writers
from tests.conftest import plan
from tests.planted import arma_11, clear_power, grid, pv_clear, pv_weather

P = "power (kW)"
REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SMALL = {"numTrees": 10, "maxDepth": 6}


@pytest.fixture(scope="module")
def arma(spark):
    writers.write_stage(arma_11(spark), "arma")
    return readers.read_stage(spark, "arma")


@pytest.fixture(scope="module")
def weather(spark):
    writers.write_stage(pv_weather(spark, days=30, plants=2), "weather_rows")
    return readers.read_stage(spark, "weather_rows")


def test_arima_recovers_arma(arma):
    rows = arima.fit_arima(arma, 1, 0, 1).collect()
    assert len(rows) == 2
    for row in rows:
        assert row["phi"][0] == pytest.approx(0.6, abs=0.05)
        assert row["theta"][0] == pytest.approx(0.4, abs=0.05)


def test_arima_does_not_depend_on_the_blocks(arma):
    def coefficients(slots):
        rows = arima.fit_arima(arma, 2, 1, 1, long_ar=8, block_slots=slots).orderBy("plant_id").collect()
        return [(r["n"], r["const"], *r["phi"], *r["theta"], *r["ar"]) for r in rows]

    whole, cut = coefficients(1 << 20), coefficients(500)
    np.testing.assert_allclose(whole, cut, rtol=1e-6, atol=1e-9)


def test_arima_against_a_plain_regression(arma):
    """Brute force: both regressions on explicit lag matrices."""
    one = arma.where("plant_id = 'P0'")
    y = np.array([r[P] for r in one.orderBy("slot").collect()])
    m, p, q = 5, 2, 1
    lags = np.lib.stride_tricks.sliding_window_view(y, m + q + 1)[:, ::-1]
    target, ones = lags[:, 0], np.ones((len(lags), 1))
    ar = np.linalg.lstsq(np.hstack([ones, lags[:, 1 : m + 1]]), target, rcond=None)[0]
    e1 = lags[:, 1] - ar[0] - lags[:, 2 : m + 2] @ ar[1:]
    x = np.column_stack([ones, lags[:, 1 : p + 1], e1])
    beta = np.linalg.lstsq(x, target, rcond=None)[0]
    row = arima.fit_arima(one, p, 0, q, long_ar=m, block_slots=777).first()
    assert row["n"] == len(lags)
    np.testing.assert_allclose([row["const"], *row["phi"], *row["theta"]], beta, rtol=1e-6, atol=1e-8)
    np.testing.assert_allclose(row["ar"], ar, rtol=1e-6, atol=1e-8)


def test_arima_leaves_out_rows_next_to_gaps(arma):
    one = arma.where("plant_id = 'P0'")
    total = one.count()
    middle = one.agg(F.min("slot") + F.expr("interval 500 minutes")).first()[0]
    holed = one.where(F.col("slot") != F.lit(str(middle)).cast("timestamp_ntz"))
    # The slot itself, and the two whose lags it was.
    assert arima.fit_arima(holed, 2, 0, 0).first()["n"] == total - 2 - 3


@pytest.mark.parametrize("d", [0, 1])
def test_arima_forecast_of_a_known_recursion(spark, d):
    """A noise-free series goes on as its own rule says."""
    n = 400
    w = [1.0, 0.5]
    for _ in range(n - 2):
        w.append(0.2 + 0.9 * w[-1] - 0.5 * w[-2])
    full = np.cumsum(w) if d else np.array(w)
    keep = 60
    rows = [("P0", i, float(v)) for i, v in enumerate(full[:keep])]
    slot = F.timestamp_seconds(F.col("i") * 300).cast("timestamp_ntz")
    df = spark.createDataFrame(rows, "plant_id string, i long, v double").select(
        "plant_id", slot.alias("slot"), F.col("v").alias(P)
    )
    model = arima.fit_arima(df, 2, d, 0)
    out = arima.forecast_arima(df, model, arima.ArimaOrder(2, d, 0), 20).orderBy("slot").collect()
    np.testing.assert_allclose([r["prediccion"] for r in out], full[keep : keep + 20], rtol=1e-6)
    assert out[0]["slot"] == dt.datetime(1970, 1, 1) + dt.timedelta(minutes=5 * keep)


def test_a_noise_free_series_has_one_defined_fit(spark):
    """A pure sine: the lags leave the coefficients open. Noise of 1e-9 doesn't sway them, and the forecast goes on."""
    rows = grid(spark, 30, 60)
    wave = F.sin(F.col("n") * 2 * math.pi / 24)
    fits = []
    for noise in (0.0, 1e-9):
        df = rows.withColumn(P, wave + F.randn(3) * noise)
        model = arima.fit_arima(df, 2, 0, 1, long_ar=12, step="1 hour")
        row = model.first()
        assert not row["unique"] or noise
        fits.append([*row["phi"], *row["theta"]])
        path = arima.forecast_arima(df, model, arima.ArimaOrder(2, 0, 1, 12, "1 hour"), steps=24).orderBy("slot").collect()
        want = [math.sin((720 + i) * 2 * math.pi / 24) for i in range(24)]
        assert [r["prediccion"] for r in path] == pytest.approx(want, abs=0.05)
    assert fits[0][:2] == pytest.approx(fits[1][:2], abs=1e-3)


def test_an_unstable_series_is_marked_and_its_forecast_stays_bounded(spark):
    """A series that grows by a tenth a slot, and one that is stable."""
    rows = grid(spark, 4, 60, plants=2)
    growing = F.pow(F.lit(1.1), F.col("n")) * (1 + 0.01 * F.sin(F.col("n") * 1.7))
    df = rows.withColumn(P, F.when(F.col("plant_id") == "P0", growing).otherwise(F.randn(5)))
    model = arima.fit_arima(df, 1, 0, 0, long_ar=1, step="1 hour")
    found = {r["plant_id"]: r for r in model.collect()}
    assert found["P0"]["stable"] is False and found["P1"]["stable"] is True
    assert arima.largest_root(np.array(found["P0"]["phi"])) == pytest.approx(arima.STABLE_ROOT)
    top = df.where("plant_id = 'P0'").agg(F.max(P)).first()[0]
    path = arima.forecast_arima(df, model, arima.ArimaOrder(1, 0, 0, 1, "1 hour"), steps=500)
    assert path.where("plant_id = 'P0'").agg(F.max("prediccion")).first()[0] <= top * 1.001
    assert arima.largest_root(np.array([0.5, 0.3])) < 1 < arima.largest_root(np.array([0.5, 0.6]))


def test_arima_order_is_checked():
    for bad in ({"p": 0, "d": 0, "q": 0}, {"p": 1, "d": -1, "q": 0}, {"p": 3, "d": 0, "q": 1, "long_ar": 2}):
        with pytest.raises(ValueError):
            arima.ArimaOrder(**bad)


def bounded(rows):
    """With the bounds of each series' time, as a fit works them out."""
    ends = rows.groupBy("plant_id").agg(F.min("slot").alias(additive.START), F.max("slot").alias(additive.END))
    return rows.join(ends, "plant_id")


def test_additive_recovers_its_terms(spark):
    rows = grid(spark, 20, 60, plants=2)
    spec = additive.AdditiveSpec({"day": 2}, 1, ("x",), 0.0)
    rows = bounded(rows.withColumn("x", F.rand(3)))
    terms = spec.terms()
    truth = {"const": 3.0, "trend": 2.0, "bend_1": -1.5, "day_sin_1": 0.7, "day_cos_1": -0.4,
             "day_sin_2": 0.2, "day_cos_2": 0.1, "x": 5.0}
    assert list(terms) == list(truth)
    y = sum((terms[k] * v for k, v in truth.items()), F.lit(0.0))
    rows = rows.withColumn(P, y).drop(additive.START, additive.END)
    model = additive.fit_additive(rows, spec)
    for row in additive.named_coefficients(model, spec).collect():
        assert row["n"] == 480
        for name, value in truth.items():
            assert row[name] == pytest.approx(value, abs=1e-6)
    fitted = additive.predict_additive(rows, model, spec)
    assert fitted.where(F.abs(F.col("prediccion") - F.col(P)) > 1e-6).isEmpty()


def test_a_series_that_starts_late_is_fitted_as_if_alone(spark):
    rows = grid(spark, 30, 60, plants=2).withColumn(P, clear_power() + F.col("n") * 0.01 + F.rand(4))
    late = rows.where((F.col("plant_id") == "P0") | (F.col("n") >= 480))
    spec = additive.AdditiveSpec({"day": 2}, 3)
    both = {r["plant_id"]: r for r in additive.fit_additive(late, spec).collect()}
    alone = additive.fit_additive(late.where("plant_id = 'P1'"), spec).first()
    assert both["P1"]["n"] == alone["n"] == 240 and both["P1"]["coef"] == pytest.approx(alone["coef"], rel=1e-9)
    assert both["P1"][additive.START] == alone[additive.START] != both["P0"][additive.START]


def test_matrices_are_added_in_two_steps(spark):
    """As many matrices of one series as tasks: no group gets more than its share of them."""
    n, fan = 300, 8
    parts = spark.range(0, n, numPartitions=n).select(
        F.lit("a").alias("k"), F.lit(1).cast("long").alias("n"), F.array(F.col("id").cast("double"), F.lit(1.0)).alias("products")
    )
    row = linear.combine(parts, ["k"], fan).first()
    assert row["n"] == n and row["products"] == [n * (n - 1) / 2, float(n)]
    text = plan(linear.combine(parts, ["k"], fan))
    assert text.count("FlatMapGroupsInArrow") >= 2 and "_share" in text


def test_additive_follows_a_clipped_day(spark):
    df = pv_clear(spark, days=20, step_minutes=30)
    spec = additive.AdditiveSpec()
    out = additive.predict_additive(df, additive.fit_additive(df, spec), spec)
    scored = out.select(F.lit("a").alias("model"), F.lit(1).alias("fold"), F.col(P).alias("actual"), F.col("prediccion").alias("prediction"))
    assert evaluate.metrics(scored).first()["r2"] > 0.99


def test_forest_beats_the_mean_and_survives_storage(spark, weather):
    rows = forest.model_inputs(weather, 1)
    train = rows.where(F.col("slot") < F.lit("2023-01-25").cast("timestamp_ntz"))
    test = rows.where(F.col("slot") >= F.lit("2023-01-25").cast("timestamp_ntz")).dropna()
    model = forest.fit_rf(train, params=SMALL)
    path = forest.save_model(model, new_folder(spark, "model"), lag_days=1)
    loaded = forest.load_model(path)

    def scored(m):
        out = m.transform(test)
        return out.select(F.lit("rf").alias("model"), F.lit(1).alias("fold"), F.col("objetivo").alias("actual"), F.col("prediccion").alias("prediction"))

    assert evaluate.metrics(scored(model)).first()["r2"] > 0.8
    assert scored(loaded).exceptAll(scored(model)).isEmpty()


def test_forest_needs_rows(spark, weather):
    with pytest.raises(ValueError):
        forest.fit_rf(forest.model_inputs(weather.withColumn("ghi", F.lit(None).cast("double")), 1))


@pytest.fixture(scope="module")
def model_path(spark, weather):
    return pipeline.train_final(weather, new_folder(spark, "model"), 1, params=SMALL)


def test_horizon(spark):
    df = pv_clear(spark, days=2, plants=2)
    out = fc.horizon(df, 3)
    assert out.count() == 2 * 3 * 288
    row = out.agg(F.min("slot"), F.max("slot")).first()
    assert row[0] == dt.datetime(2023, 1, 4) and row[1] == dt.datetime(2023, 1, 6, 23, 55)
    with pytest.raises(ValueError):
        fc.horizon(df, 0)


def test_provisional_repeats_the_pattern(spark):
    df = pv_clear(spark, days=9)
    out = fc.provisional(df, fc.horizon(df, 2)).withColumn("truth", clear_power())
    assert out.count() == 576
    assert out.where(F.abs(F.col("prediccion") - F.col("truth")) > 1e-9).isEmpty()


def test_forecast_with_a_model(spark, weather, model_path):
    result = fc.forecast_safe(weather, model_path, 1, "1 hour")
    assert (result.mode, result.reason) == ("modelo", None)
    rows = result.predictions.collect()
    assert len(rows) == 48 and {r["modo"] for r in rows} == {"modelo"}
    assert min(r["slot"] for r in rows) == dt.datetime(2023, 2, 1)
    status = result.status().collect()
    assert [(r["modo"], r["motivo"], r["slots"]) for r in status] == [("modelo", None, 48)]


def test_forecast_takes_given_weather(spark, weather, model_path):
    future = fc.horizon(weather, 1, "1 hour")
    noon = future.where(F.hour("slot") == 12)
    given = noon.select("plant_id", "slot", *[F.lit(7.0).alias(c) for c in
        ("air_temp", "relative_humidity", "ghi", "dni", "gti", "wind_speed_10m", "wind_direction_10m")])
    rows = fc.inputs(weather, future, 1, given).collect()
    assert len(rows) == 48
    assert {r["ghi"] for r in rows if r["hora"] == 12} == {7.0}
    assert all(r["ghi"] is not None and r["ghi"] != 7.0 for r in rows if r["hora"] == 13)


def test_inference_inputs_match_training_inputs(spark, weather):
    """Energy and calendar inputs of a later day, built either way, are equal."""
    cut = F.lit("2023-01-30").cast("timestamp_ntz")
    past, day = weather.where(F.col("slot") < cut), F.lit("2023-01-31").cast("timestamp_ntz")
    served = fc.inputs(past, fc.horizon(past, 1, "1 hour"), 1)
    trained = forest.model_inputs(weather, 1).where((F.col("slot") >= cut) & (F.col("slot") < day))
    same = ["plant_id", "slot", "eToday (kWh)", "eTotal (kWh)", P, "hora", "dia_semana", "es_fin_semana", "mes", "estacion"]
    assert served.count() == 48
    assert served.select(same).exceptAll(trained.select(same)).isEmpty()


def test_missing_model_falls_back(spark, weather):
    result = fc.forecast_safe(weather, "/nonexistent/model", 1, "1 hour")
    assert result.mode == "provisional" and "AnalysisException" in result.reason
    assert result.predictions.count() == 48
    assert result.predictions.where("prediccion is null").isEmpty()


def test_failing_inference_falls_back(spark, weather, tmp_path):
    """A stored pipeline that wants a column the inputs lack."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import SQLTransformer

    broken = Pipeline(stages=[SQLTransformer(statement="SELECT *, raise_error('boom') AS prediccion FROM __THIS__")])
    path = forest.save_model(broken.fit(weather), str(tmp_path / "broken"), lag_days=1)
    result = fc.forecast_safe(weather, path, 1, "1 hour")
    assert result.mode == "provisional" and result.reason.startswith("inference failed")
    assert result.predictions.count() == 48


def test_one_silent_series_does_not_take_the_others_along(spark, weather, model_path):
    mute = weather.withColumn("ghi", F.when(F.col("plant_id") == "P0", F.col("ghi")))
    result = fc.forecast_safe(mute, model_path, 1, "1 hour")
    got = {(r["plant_id"], r["modo"]): r["n"] for r in
           result.predictions.groupBy("plant_id", "modo").agg(F.count("prediccion").alias("n")).collect()}
    assert got == {("P0", "modelo"): 24, ("P1", "provisional"): 24}
    assert {r["modo"]: r["motivo"] for r in result.status().collect()} == {
        "modelo": None, "provisional": "model answered for 1 of 2 series"}


def _silent_since(weather, plant, day):
    return weather.where((F.col("plant_id") != plant) | (F.col("slot") < F.lit(day).cast("timestamp_ntz")))


def test_a_plant_silent_for_weeks_is_forecast_too(spark, weather, model_path):
    silent = _silent_since(weather, "P1", "2023-01-12")
    result = fc.forecast_safe(silent, model_path, 1, "1 hour")
    rows = result.predictions.groupBy("plant_id").agg(F.count("prediccion").alias("n"), F.min("slot").alias("first")).collect()
    assert {(r["plant_id"], r["n"], r["first"].day) for r in rows} == {("P0", 24, 1), ("P1", 24, 12)}
    result.close()
    together = fc.forecast_safe(silent, model_path, 1, "1 hour", origin=dt.datetime(2023, 1, 31, 23))
    assert {r["slot"].date() for r in together.predictions.collect()} == {dt.date(2023, 2, 1)}
    together.close()


def test_a_model_is_not_asked_beyond_its_horizon(spark, weather, model_path):
    result = fc.forecast_safe(weather, model_path, 5, "1 hour")
    assert (result.mode, result.reason) == ("provisional", "model trained for 1 days, asked for 5")
    assert result.predictions.count() == 2 * 5 * 24
    assert forest.load_contract(spark, model_path).lag_days == 1


def test_training_loses_no_row_with_a_target(spark, weather):
    holes = weather.withColumn("ghi", F.when(F.hour("slot") % 5 != 0, F.col("ghi")))
    rows = forest.model_inputs(holes, 1)
    filled = fill_inputs(rows, holes)
    assert filled.count() == rows.count() and filled.columns == rows.columns
    assert filled.dropna().count() == rows.where(F.col(forest.TARGET).isNotNull()).count()


def test_one_wrong_clock_empties_no_other_series(spark, weather):
    late = weather.where("plant_id = 'P1'").limit(1).withColumn("slot", F.lit("2099-01-01").cast("timestamp_ntz"))
    dirty = weather.unionByName(late)
    week = views.energy_view(dirty, "last7").groupBy("plant_id").count().collect()
    assert {r["plant_id"]: r["count"] for r in week} == {"P0": 168, "P1": 1}
    clean = views.recent_each(dirty, 7, as_of=dt.datetime(2023, 2, 1))
    assert {r["plant_id"]: r["count"] for r in clean.groupBy("plant_id").count().collect()} == {"P0": 168, "P1": 168}


def test_arima_answers_from_the_origin_for_series_that_ended_before(spark):
    df = pv_clear(spark, days=12, plants=2, step_minutes=60)
    cut = _silent_since(df, "P1", "2023-01-11")
    model = arima.fit_arima(cut, 2, 0, 0, long_ar=2, step="1 hour")
    until = dt.datetime(2023, 1, 15)
    out = arima.forecast_arima(cut, model, arima.ArimaOrder(2, 0, 0, 2, "1 hour"), until=until)
    ends = {r["plant_id"]: (r["n"], r["last"]) for r in out.groupBy("plant_id").agg(F.count("slot").alias("n"), F.max("slot").alias("last")).collect()}
    assert {v[1] for v in ends.values()} == {until} and ends["P1"][0] > ends["P0"][0]


def test_short_series_have_a_row_without_coefficients(spark):
    df = pv_clear(spark, days=3, plants=2, step_minutes=60)
    short = _silent_since(df, "P1", "2023-01-02 03:00:00")
    rows = {r["plant_id"]: r for r in arima.fit_arima(short, 2, 0, 0, long_ar=2, step="1 hour").collect()}
    assert rows["P0"]["const"] is not None and set(rows) == {"P0", "P1"} and rows["P1"]["const"] is None


def test_models_are_compared_on_the_same_slots(spark, weather):
    holes = weather.withColumn("ghi", F.when((F.col("plant_id") == "P0") | ~F.hour("slot").between(9, 15), F.col("ghi")))
    out = pipeline.evaluate_candidates(
        holes, 3, k=1, step="1 hour", strategies=("holdout",), forest_params=SMALL,
        arima_options={"p": 2, "d": 0, "q": 1, "long_ar": 24},
        additive_options={"fourier": {"day": 3}, "changepoints": 1, "regressors": ("ghi",)},
    )
    predictions = spark.read.parquet(out)
    counts = pipeline.answered(predictions).collect()
    assert {r["slots"] for r in counts} == {144} and len(counts) == 3
    shared = pipeline.common_slots(pipeline.under(predictions, "reciente"))
    assert len({r["count"] for r in shared.groupBy("model").count().collect()}) == 1


def test_workers_elsewhere_can_import_the_package(tmp_path):
    """No PYTHONPATH, another folder: the session ships the package."""
    code = f"""
import sys
sys.path.insert(0, {REPO!r})
from heliospark.session import build_session
sys.path.pop(0)
spark = build_session("elsewhere", "local[2]", spark__ui__enabled="false", spark__sql__shuffle__partitions="2")
from heliospark.models import arima
df = spark.sql("select 'P0' plant_id, timestamp_ntz'2023-01-01' + make_dt_interval(0, cast(id as int)) slot, sin(id) `power (kW)` from range(200)")
print("ROWS", arima.fit_arima(df, 1, 0, 1, long_ar=3, step="1 hour").count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=180)
    assert "ROWS 1" in done.stdout, done.stderr[-2000:]


def test_daily_forecast_and_comparison(spark):
    df = pv_clear(spark, days=9)
    predictions = fc.provisional(df, fc.horizon(df, 2))
    total = aggregates_total = views.daily(df, (F.sum(P) / 12).alias("kwh")).first()["kwh"]
    for row in fc.forecast_daily(predictions).collect():
        assert row["kwh"] == pytest.approx(aggregates_total) and row["maximo"] == pytest.approx(5.0)
        assert row["media"] == pytest.approx(total / 24)
    series = views.history_vs_forecast(df, predictions, 3).groupBy("serie").count().collect()
    assert {r["serie"]: r["count"] for r in series} == {"historico": 864, "prediccion": 576}


def test_candidates_are_compared_and_one_is_chosen(spark, weather):
    out = pipeline.evaluate_candidates(
        weather, 3, k=2, window_days=12, step="1 hour", forest_params=SMALL, parallelism=4,
        arima_options={"p": 2, "d": 0, "q": 1, "long_ar": 24},
        additive_options={"fourier": {"day": 3}, "changepoints": 1, "regressors": ("ghi",)},
    )
    predictions = spark.read.parquet(out)
    table = {
        (r["model"], r["strategy"]): r for r in pipeline.comparison(predictions, "observado").collect()
    }
    assert set(table) == {(m, s) for m in pipeline.MODELS for s in pipeline.STRATEGIES}
    assert {s: table["arima", s]["folds"] for s in pipeline.STRATEGIES} == {"holdout": 1, "expanding": 2, "sliding": 2}
    # Power follows the observed irradiance, which only two of the models see.
    for strategy in pipeline.STRATEGIES:
        assert table["arima", strategy]["rmse"] > table["random_forest", strategy]["rmse"]
    assert pipeline.choose(predictions, "observado").first()["model"] in ("additive", "random_forest")
    # Days differ in irradiance, so guessed weather costs accuracy.
    guessed = {(r["model"], r["strategy"]): r for r in pipeline.comparison(predictions).collect()}
    assert set(guessed) == set(table)
    assert guessed["additive", "expanding"]["rmse"] > table["additive", "expanding"]["rmse"]
    counts = {r["clima"]: r["count"] for r in predictions.groupBy("clima").count().collect()}
    assert counts["observado"] == counts["reciente"] == 2 * counts["ninguno"]
    leads = pipeline.decay(predictions).where("model = 'additive'").collect()
    assert sorted(r["lead_day"] for r in leads) == [1, 2, 3]
    assert predictions.where("slot <= origin").isEmpty()


def _fit_times(out):
    import pathlib

    return {str(p.relative_to(out)): p.stat().st_mtime_ns for p in pathlib.Path(out).rglob("_SUCCESS")}


def test_an_evaluation_is_resumed_by_fit(spark, weather, tmp_path):
    """What is there whole is kept; a fit whose mark is gone is made again, with the same answers."""
    import os as _os

    options = dict(
        k=1, step="1 hour", strategies=("holdout",), models=("arima", "additive"),
        arima_options={"p": 1, "d": 0, "q": 0, "long_ar": 1}, additive_options={"fourier": {"day": 1}, "changepoints": 0, "regressors": ("ghi",)},
    )
    path = str(tmp_path / "data")
    writers.write_dataset(weather, path)
    data, store = spark.read.parquet(path), str(tmp_path / "store")
    out = pipeline.evaluate_candidates(data, 3, store=store, **options)
    first, answers = _fit_times(out), sorted(map(str, spark.read.parquet(out).collect()))
    assert len(first) == 2
    again = pipeline.evaluate_candidates(data, 3, store=store, **options)
    assert again == out and _fit_times(out) == first
    gone = next(k for k in first if "additive" in k)
    _os.remove(f"{out}/{gone}")
    pipeline.evaluate_candidates(data, 3, store=store, **options)
    now = _fit_times(out)
    assert now.keys() == first.keys() and [k for k in now if now[k] != first[k]] == [gone]
    assert sorted(map(str, spark.read.parquet(out).collect())) == answers
    assert pipeline.evaluate_candidates(data, 2, store=store, **options) != out


def test_scores_against_plain_sums(spark):
    """Errors of each fit on the slots that all answered, recomputed row by row."""
    rows = []
    for i in range(60):
        for model, offset in (("arima", 1.0), ("additive", -0.5), ("random_forest", 0.1 * (i % 7))):
            fold = 1 + i // 30
            given = None if (model == "arima" and i % 10 == 3) else float(i) + offset
            clima = "ninguno" if model == "arima" else "reciente"
            rows.append((model, "expanding", fold, clima, "P0", dt.datetime(2023, 1, 1 + fold) + dt.timedelta(hours=i % 30), dt.datetime(2023, 1, 1 + fold), float(i), given))
    df = spark.createDataFrame(rows, "model string, strategy string, fold int, clima string, plant_id string, slot timestamp_ntz, origin timestamp_ntz, actual double, prediction double")
    for r in pipeline.scores(df).collect():
        own = [x for x in rows if x[0] == r["model"] and x[2] == r["fold"]]
        shared = [x for x in own if int(x[7]) % 10 != 3]
        errors = [x[8] - x[7] for x in shared]
        assert (r["slots"], r["n"], r["answered"]) == (30, 27, 27 if r["model"] == "arima" else 30)
        assert r["mae"] == pytest.approx(sum(map(abs, errors)) / 27) and r["bias"] == pytest.approx(sum(errors) / 27)
        assert r["rmse"] == pytest.approx((sum(e * e for e in errors) / 27) ** 0.5)
    chosen = pipeline.choose(df).first()
    assert chosen["model"] == min(("arima", 1.0), ("additive", 0.5), ("random_forest", (sum((0.1 * (i % 7)) ** 2 for i in range(60)) / 60) ** 0.5), key=lambda x: x[1])[0]
    assert pipeline.decay(df).where("model = 'arima'").agg(F.sum("slots")).first()[0] == 60


def test_an_evaluation_stores_files_by_size_not_by_day(spark, tmp_path):
    """Small days share files, whose statistics still bound a fold's scan."""
    rows = pv_weather(spark, days=60, plants=1, step_minutes=360).repartition(3)
    work = str(tmp_path / "work")
    pipeline.evaluate_candidates(rows, 2, k=1, step="6 hours", strategies=("sliding",), models=("additive",), work=work, additive_options={"fourier": {"day": 1}, "changepoints": 0})
    for name in ("observed", "inputs"):
        files = [str(p) for p in (tmp_path / "work" / "stages" / name).rglob("*.parquet")]
        assert 0 < len(files) <= 8
    stored = readers.read_stage(spark, "observed", work)
    assert stored.count() == rows.count() and "fecha" in stored.columns
    spans = [tuple(map(str, spark.read.parquet(f).agg(F.min("slot"), F.max("slot")).first())) for f in files]
    assert all(a[1] <= b[0] for a, b in zip(sorted(spans), sorted(spans)[1:]))
