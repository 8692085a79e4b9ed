"""The jobs end to end: build the dataset, train, compare and answer."""

from __future__ import annotations

import datetime as dt
import hashlib
import json
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliospark.functions.calendar import minute_of_day
from heliospark.models import additive, arima, forest
from heliospark.operators import clean
from heliospark.operators.align import align_generation, align_weather, homogenise
from heliospark.operators.evaluate import (
    compare_models,
    horizon_decay,
    lead_day,
    metrics,
    select_final,
)
from heliospark.operators.fill import fill_inputs
from heliospark.operators.forecast import slot_pattern
from heliospark.operators.splits import STRATEGIES, Fold, fold_table, now, read_folds
from heliospark.operators.views import read_latest, recent, series_ends
from heliospark.schema import DEFAULT_PLANT, ENERGY, KEYS, PLANT, POWER, RAW_PERIOD_END, SLOT, STEP, WEATHER
from heliospark.session import is_whole, new_folder
from heliospark.sources import readers, writers

MODELS = ("arima", "additive", "random_forest")


def generation_rows(
    documents: DataFrame, site_tz: str | None = None, power_factor: float = 1.0
) -> DataFrame:
    """Series records of the documents, timed, cleaned and free of copies."""
    series = readers.with_scalars(readers.good_rows(documents))
    timed = clean.clean(_timed(series, "time", site_tz))
    once = clean.dedupe(timed, (PLANT, "ts", "_offset"), ("_mtime", "_path", "pos"))
    return clean.to_model_names(once.drop("_mtime", "_path", "pos", "_offset"), power_factor)


def weather_rows(documents: DataFrame, site_tz: str | None = None) -> DataFrame:
    rows = readers.good_rows(documents)
    timed = clean.clean(_timed(rows, RAW_PERIOD_END, site_tz))
    once = clean.dedupe(timed, (PLANT, "ts", "_offset"), ("_mtime", "_path"))
    return once.drop("_mtime", "_path", "_offset")


def _timed(rows: DataFrame, text: str, site_tz: str | None) -> DataFrame:
    """Wall-clock times, and the offset that tells the instants of a repeated hour apart."""
    return clean.with_offset(clean.parse_time(rows, text, site_tz), text, site_tz).drop(text)


#: Values that a variable of the dataset can have; others are counted, never altered.
BOUNDS = {
    POWER: (0.0, 1e6),
    "air_temp": (-60.0, 70.0),
    "relative_humidity": (0.0, 100.0),
    "ghi": (0.0, 1500.0),
    "dni": (0.0, 1500.0),
    "gti": (0.0, 1500.0),
    "wind_speed_10m": (0.0, 100.0),
    "wind_direction_10m": (0.0, 360.0),
}


def quality_path(out: str) -> str:
    """Where the quality table of the dataset at ``out`` lies."""
    return f"{out.rstrip('/')}_quality"


def quality_table(
    generation: DataFrame, weather: DataFrame, dataset: DataFrame, as_of: dt.datetime | None = None
) -> DataFrame:
    """(source, plant_id, variable, check, n) of the documents and the rows made from them.

    Slots after ``as_of`` are those of a wrong clock.
    """
    values = clean.quality_counts(dataset, BOUNDS)
    checks = F.array(
        *[F.struct(F.lit(c).alias("check"), F.col(c).alias("n")) for c in ("rows", "missing", "outside")]
    )
    counted = values.select(F.lit("dataset").alias("source"), PLANT, "variable", F.inline(checks))
    parts = readers.document_quality(generation, "generation").unionByName(
        readers.document_quality(weather, "weather")
    ).unionByName(counted)
    if as_of is None:
        return parts
    late = F.col(SLOT) > F.lit(as_of.isoformat(sep=" ")).cast("timestamp_ntz")
    future = dataset.groupBy(PLANT).agg(F.count_if(late).alias("n"))
    return parts.unionByName(
        future.select(
            F.lit("dataset").alias("source"), PLANT, F.lit(SLOT).alias("variable"), F.lit("future").alias("check"), "n"
        )
    )


def build_dataset(
    spark: SparkSession,
    generation_path: str | list[str],
    weather_path: str | list[str],
    out: str,
    site_tz: str | None = None,
    power_factor: float = 1.0,
    how: str = "inner",
    step: str = STEP,
    plant_id: str = DEFAULT_PLANT,
    multi_line: bool = True,
    hemisphere: str = "north",
    as_of: dt.datetime | None = None,
) -> DataFrame:
    """Files to the stored homogenised dataset, its quality table beside it (``quality_path``)."""
    exports = readers.read_generation(spark, generation_path, plant_id, multi_line)
    reports = readers.read_weather(spark, weather_path, plant_id, multi_line)
    generation = generation_rows(exports, site_tz, power_factor)
    observed = weather_rows(reports, site_tz)
    joined = homogenise(
        align_generation(generation, step), align_weather(observed, step, label="end"), how
    )
    writers.write_dataset(joined, out, hemisphere=hemisphere)
    stored = readers.load_dataset(spark, out)
    quality_table(exports, reports, stored, as_of).write.mode("overwrite").parquet(quality_path(out))
    return stored


def train_final(
    dataset: DataFrame,
    model_path: str,
    horizon_days: int,
    window_days: int = 60,
    params: Mapping[str, object] | None = None,
    seed: int = 42,
    work: str | None = None,
    keys: Sequence[str] = KEYS,
    as_of: dt.datetime | None = None,
    hemisphere: str = "north",
) -> str:
    """Fit the forest on the last ``window_days`` and store it with its horizon.

    ``as_of`` leaves out later slots, which a wrong clock may have written.
    """
    work = work or new_folder(dataset.sparkSession, "training")
    # Lagged inputs of the first day reach back before the window.
    if as_of is not None:
        dataset = dataset.where(F.col(SLOT) <= F.lit(as_of.isoformat(sep=" ")).cast("timestamp_ntz"))
    at = read_latest(dataset)
    if at is None:
        raise ValueError("there is no dataset to train on")
    reach = recent(dataset, window_days + horizon_days, at=at)
    lagged = forest.model_inputs(reach, horizon_days, keys=keys, hemisphere=hemisphere)
    rows = recent(lagged, window_days, at=at)
    # Missing inputs are filled as in serving, so no row with a target is lost.
    writers.write_stage(fill_inputs(rows, reach, keys), "inputs", work)
    model = forest.fit_rf(
        readers.read_stage(dataset.sparkSession, "inputs", work), seed=seed, params=params
    )
    return forest.save_model(model, model_path, horizon_days, None, window_days, hemisphere)


def _arima_predictions(train, tests: DataFrame, fold: Fold, step, keys, options) -> DataFrame:
    order = arima.ArimaOrder(step=step, **options)
    model = arima.fit_arima(train, keys=keys, step=step, **options)
    until = fold.bounds.select(*keys, F.col("test_to").alias("until"))
    path = arima.forecast_arima(train, model, order, until=until, keys=keys)
    return tests.select(*keys, SLOT).distinct().join(path, [*keys, SLOT])


def _additive_predictions(train, tests: DataFrame, keys, options) -> DataFrame:
    spec = additive.AdditiveSpec(**options)
    model = additive.fit_additive(train, spec, keys=keys)
    out = additive.predict_additive(fill_inputs(tests, train, keys), model, spec, keys)
    return out.select(*keys, SLOT, "clima", "prediccion")


def _forest_predictions(train, tests: DataFrame, known, keys, params, seed) -> DataFrame:
    model = forest.fit_rf(fill_inputs(train, known, keys), seed=seed, params=params)
    out = model.transform(fill_inputs(tests, known, keys))
    return out.select(*keys, SLOT, "clima", "prediccion")


def _both_weathers(test: DataFrame, train: DataFrame, keys) -> DataFrame:
    """The test rows twice: with the weather that came, and with the recent
    mean at that time of day, which is all that a forecast has."""
    usual = slot_pattern(train, WEATHER, keys=keys)
    kept = [c for c in test.columns if c not in WEATHER]
    guessed = test.select(*kept, minute_of_day().alias("_minute")).join(
        usual, [*keys, "_minute"], "left"
    )
    return test.withColumn("clima", F.lit("observado")).unionByName(
        guessed.drop("_minute").withColumn("clima", F.lit("reciente"))
    )


def evaluation_folder(
    dataset: DataFrame, store: str, options: Mapping[str, object], keys: Sequence[str] = KEYS
) -> str:
    """The folder under ``store`` of an evaluation of these rows with these options.

    The rows are known by their number and the sum of their hashes, in one pass;
    the options by their values. What is asked again finds what was stored,
    what differs in any way does not.
    """
    read = F.xxhash64(*keys, SLOT, *ENERGY, *WEATHER).cast("decimal(38,0)")
    known = dataset.agg(F.count(F.lit(1)).alias("n"), F.sum(read).alias("hash")).first()
    text = json.dumps({"rows": known["n"], "hash": str(known["hash"]), **options}, sort_keys=True, default=str)
    return f"{store.rstrip('/')}/evaluation-{hashlib.sha256(text.encode()).hexdigest()[:20]}"


def evaluate_candidates(
    dataset: DataFrame,
    horizon_days: int,
    k: int = 3,
    window_days: int = 60,
    step: str = STEP,
    strategies: Sequence[str] = STRATEGIES,
    models: Sequence[str] = MODELS,
    arima_options: Mapping[str, object] | None = None,
    additive_options: Mapping[str, object] | None = None,
    forest_params: Mapping[str, object] | None = None,
    seed: int = 42,
    work: str | None = None,
    keys: Sequence[str] = KEYS,
    parallelism: int = 1,
    as_of: dt.datetime | None = None,
    store: str | None = None,
) -> str:
    """Fit every model on every fold and store the predictions of the test slots.

    Inputs are stored once; each fold then reads its own time range of them.
    Folds count back from each series' own end (:func:`splits.fold_table`), so
    that series that ended earlier are judged on their own last days and a slot
    beyond ``as_of`` (now, if not given) moves none. Fits are Spark jobs that
    the driver submits, ``parallelism`` at a time, so that small ones can share
    a large cluster. Models that use weather answer twice, told apart by
    ``clima``: ``observado`` bounds what they could do, ``reciente`` is what a
    forecast would get. Returns the folder of the predictions.

    With a ``store`` (or a ``work`` folder used before) the evaluation is
    resumed: inputs and fits that are there whole are kept, the others are made.
    The folder under ``store`` is named after the rows and all options.
    """
    unknown = set(models) - set(MODELS)
    if unknown:
        raise ValueError(f"unknown models {sorted(unknown)}")
    spark = dataset.sparkSession
    arima_options = dict(arima_options or {"p": 2, "d": 0, "q": 1})
    additive_options = dict(additive_options or {"regressors": tuple(WEATHER[:-1])})
    if store is not None:
        options = {
            "horizon_days": horizon_days, "k": k, "window_days": window_days, "step": step,
            "strategies": list(strategies), "keys": list(keys), "arima": arima_options,
            "additive": additive_options, "forest": dict(forest_params or {}), "seed": seed, "as_of": as_of,
        }
        work = evaluation_folder(dataset, store, options, keys)
    work = work or new_folder(spark, "evaluation")

    def stored(name: str, rows: Callable[[], DataFrame], in_time: bool = False) -> DataFrame:
        if not is_whole(spark, readers.stage_path(spark, name, work)):
            writers.write_stage(rows(), name, work, in_time=in_time)
        return readers.read_stage(spark, name, work)

    observed = stored("observed", lambda: dataset.select(*keys, SLOT, *ENERGY, *WEATHER), True)
    inputs = stored("inputs", lambda: forest.model_inputs(dataset, horizon_days, keys=keys), True)
    ends = stored("ends", lambda: series_ends(observed, keys=keys, as_of=as_of or now()))
    table = stored("folds", lambda: fold_table(ends, k, horizon_days, strategies, window_days, keys))
    out = f"{work}/predictions"

    def run(name: str, fold: Fold) -> None:
        # A folder for each fit: one that is repeated replaces its own rows only.
        folder = f"{out}/model={name}/strategy={fold.strategy}/fold={fold.number}"
        if is_whole(spark, folder):
            return
        train, test = fold.train(observed), fold.test(observed)
        asked = test.select(*keys, SLOT, F.col(POWER).alias("actual"))
        if name == "arima":
            asked = asked.withColumn("clima", F.lit("ninguno"))
            rows = _arima_predictions(train, test, fold, step, keys, arima_options)
            rows = rows.withColumn("clima", F.lit("ninguno"))
        else:
            weathers = F.array(F.lit("observado"), F.lit("reciente"))
            asked = asked.withColumn("clima", F.explode(weathers))
            if name == "additive":
                tests = _both_weathers(test, train, keys)
                rows = _additive_predictions(train, tests, keys, additive_options)
            else:
                tests = _both_weathers(fold.test(inputs), train, keys)
                rows = _forest_predictions(fold.train(inputs), tests, train, keys, forest_params, seed)
        # Every test slot has a row for each model, answered or not.
        rows = asked.join(rows, [*keys, SLOT, "clima"], "left")
        rows.join(fold.bounds.select(*keys, "origin"), [*keys]).select(
            "clima", "origin", *keys, SLOT, "actual", F.col("prediccion").alias("prediction")
        ).write.mode("overwrite").parquet(folder)

    fits = [(name, fold) for fold in read_folds(table, keys) for name in models]
    with ThreadPoolExecutor(max_workers=parallelism) as pool:
        for done in [pool.submit(run, name, fold) for name, fold in fits]:
            done.result()
    return out


def under(predictions: DataFrame, clima: str) -> DataFrame:
    """Predictions under one kind of weather, with the models that use none."""
    return predictions.where(F.col("clima").isin(clima, "ninguno"))


def common_slots(predictions: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """The predictions of slots that every model of that strategy and fold answered."""
    slot = ["strategy", "fold", *keys, SLOT]
    models = predictions.groupBy("strategy", "fold").agg(F.count_distinct("model").alias("_models"))
    answers = predictions.groupBy(*slot).agg(F.count("prediction").alias("_answers"))
    shared = answers.join(models, ["strategy", "fold"]).where("_answers = _models").select(*slot)
    return predictions.join(shared, slot, "left_semi")


def answered(predictions: DataFrame, clima: str = "reciente") -> DataFrame:
    """Test slots and answers of each model, strategy and fold."""
    return under(predictions, clima).groupBy("model", "strategy", "fold").agg(
        F.count(F.lit(1)).alias("slots"), F.count("prediction").alias("answered")
    )


def scores(predictions: DataFrame, clima: str = "reciente") -> DataFrame:
    """Error of each model, strategy and fold on the slots that all models answered (``n``), beside its
    test slots (``slots``) and those it answered itself (``answered``).

    A model that shares no slot with the others has its counts and NULL errors.
    """
    fit = ["model", "strategy", "fold"]
    judged = metrics(common_slots(under(predictions, clima)), fit)
    joined = answered(predictions, clima).join(judged, fit, "left")
    return joined.withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def comparison(predictions: DataFrame, clima: str = "reciente") -> DataFrame:
    """Models compared on the slots that all of them answered."""
    counts = scores(predictions, clima)
    slots = counts.groupBy("model", "strategy").agg(
        F.sum("n").alias("n"), F.sum("slots").alias("slots"), F.sum("answered").alias("answered")
    )
    return compare_models(counts.where("n > 0")).join(slots, ["model", "strategy"])


def choose(predictions: DataFrame, clima: str = "reciente") -> DataFrame:
    return select_final(comparison(predictions, clima))


def decay(predictions: DataFrame, clima: str = "reciente") -> DataFrame:
    """Errors against the lead in days, beside the test slots of that lead and the answers."""
    asked = lead_day(under(predictions, clima))
    by = ["model", "lead_day"]
    counts = asked.groupBy(*by).agg(F.count(F.lit(1)).alias("slots"), F.count("prediction").alias("answered"))
    return counts.join(horizon_decay(lead_day(common_slots(under(predictions, clima)))), by, "left").withColumn(
        "n", F.coalesce("n", F.lit(0).cast("long"))
    )
