"""One query per operator, bound to the given tables."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heliospark.driver import tables as t
from heliospark.driver.present import present
from heliospark.functions import calendar
from heliospark.models import additive, arima, forest
from heliospark.operators import aggregates, clean, economics, evaluate, splits, views
from heliospark.operators import forecast as fc
from heliospark.operators.fill import fill_inputs
from heliospark.operators.align import align_generation, align_weather, homogenise
from heliospark.plans import pipeline
from heliospark.schema import (
    CALENDAR,
    E_TODAY,
    E_TOTAL,
    FEATURES,
    FECHA,
    PLANT,
    POWER,
    RAW_SCALARS,
    RAW_SERIES,
    SLOT,
    WEATHER,
)
from heliospark.session import new_folder
from heliospark.sources import readers, writers

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

HOUR = "1 hour"
START, END = "2024-01-08", "2024-01-21"
TARIFF = 2.5
RF_PARAMS = {"numTrees": 20, "maxDepth": 6}
HOLDOUT_DAYS = 6
#: Grid and horizon on which the three forecasters are compared.
EVALUATED, HORIZON_DAYS = "6 hours", 2


def query(name: str):
    def register(fn: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: present(fn(spark, sf_dir))
        return fn

    return register


# Files that later queries read again, by session, tables and name.
_stored: dict[tuple[str, str, str], str] = {}
_stored_lock = threading.RLock()


def _once(spark: SparkSession, sf_dir: str, name: str, write: Callable[[str], object]) -> str:
    """Path of files written once per session and tables."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    with _stored_lock:
        if key not in _stored:
            path = new_folder(spark, name)
            write(path)
            _stored[key] = path
        return _stored[key]


def _label(name: str, options: dict) -> str:
    return "-".join([name, *(str(v).replace(" ", "-") for v in options.values())])


def _by_day(spark: SparkSession, sf_dir: str, name: str, rows: Callable[..., DataFrame], **options) -> DataFrame:
    """Aligned readings as the library stores them: by day, so that ranges of time prune the scan."""

    def write(path: str) -> None:
        writers.write_stage(rows(spark, sf_dir, **options), "rows", path, by_day=True)

    return readers.read_stage(spark, "rows", _once(spark, sf_dir, _label(name, options), write))


def _power(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return _by_day(spark, sf_dir, "power", t.power, **options)


def _power_ends(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    """Where each series of the stored power ends, as the write has kept it."""
    folder = _once(spark, sf_dir, _label("power", options), lambda path: None)
    return readers.load_ends(spark, readers.stage_path(spark, "rows", folder))


# --- Sources. Files are first written from the tables, then read back. ---


def _generation_files(spark: SparkSession, sf_dir: str) -> str:
    """One export per plant and day, each a file of its own."""
    rows = calendar.with_fecha(t.generation(spark, sf_dir))
    record = F.struct(
        F.date_format(SLOT, "yyyy-MM-dd HH:mm").alias("key"), F.col(POWER).alias("value")
    )
    # A plant's day holds at most 288 records.
    documents = rows.groupBy(PLANT, FECHA).agg(
        F.max("nominalPower").cast("string").alias("nominalPower"),
        F.max(E_TODAY).cast("string").alias("eToday"),
        F.max(E_TOTAL).alias("eTotal"),
        F.map_from_entries(F.collect_list(record)).alias(RAW_SERIES),
    )
    text = F.to_json(F.struct(*RAW_SCALARS, RAW_SERIES)).alias("value")
    # Spread over tasks: a task writes its files one after another.
    lines = documents.select(PLANT, text).repartition(spark.sparkContext.defaultParallelism)
    writer = lines.write.partitionBy(PLANT).option("maxRecordsPerFile", 1)
    return _once(spark, sf_dir, "generation", writer.text)


def _weather_files(spark: SparkSession, sf_dir: str) -> str:
    """Observations, one a line, labelled with the end of their interval."""
    rows = t.weather(spark, sf_dir)
    end = F.date_format(F.col(SLOT) + F.expr("interval 5 minutes"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    document = F.to_json(F.struct(end.alias("period_end"), *WEATHER))
    writer = rows.select(PLANT, document.alias("value")).write.partitionBy(PLANT)
    return _once(spark, sf_dir, "weather", writer.text)


def _mixed_files(spark: SparkSession, sf_dir: str) -> str:
    """The exports of two plants as a file for each document, those of the others as files of many lines."""
    documents = readers.good_rows(readers.read_generation(spark, _generation_files(spark, sf_dir)))
    text = F.to_json(F.struct(*RAW_SCALARS, F.from_json(RAW_SERIES, "map<string,double>").alias(RAW_SERIES))).alias("value")
    alone = F.col(PLANT).isin("P0", "P1")

    def write(path: str) -> None:
        rows = documents.select(PLANT, text).repartition(4, PLANT)
        rows.where(alone).write.partitionBy(PLANT).option("maxRecordsPerFile", 1).text(path)
        rows.where(~alone).write.mode("append").partitionBy(PLANT).text(path)

    return _once(spark, sf_dir, "mixed", write)


@query("src_generation_json")
def src_generation_json(spark, sf_dir):
    """Documents of both kinds of files, scalars and series."""
    raw = readers.read_generation(spark, _mixed_files(spark, sf_dir), multi_line=None)
    series = F.from_json(RAW_SERIES, "map<string,double>")
    return readers.good_rows(raw).select(
        PLANT,
        *[F.col(c).try_cast("double").alias(c) for c in RAW_SCALARS],
        F.size(series).alias("records"),
        F.array_join(F.array_sort(F.map_keys(series)), ",").alias("times"),
        F.aggregate(F.map_values(series), F.lit(0.0), lambda a, b: a + b).alias("total"),
    )


@query("src_weather_json")
def src_weather_json(spark, sf_dir):
    raw = readers.read_weather(spark, _weather_files(spark, sf_dir), multi_line=False)
    return readers.good_rows(raw).select(PLANT, "period_end", *WEATHER)


@query("src_explode_series")
def src_explode_series(spark, sf_dir):
    raw = readers.read_generation(spark, _generation_files(spark, sf_dir))
    return readers.explode_series(raw, carry=[PLANT]).select(PLANT, "time", "pac")


@query("src_broadcast_scalars")
def src_broadcast_scalars(spark, sf_dir):
    raw = readers.read_generation(spark, _generation_files(spark, sf_dir))
    return readers.with_scalars(raw).select(PLANT, "time", "pac", *RAW_SCALARS)


@query("src_homogenised")
def src_homogenised(spark, sf_dir):
    rows = t.homogenised(spark, sf_dir)
    path = _once(spark, sf_dir, "dataset", lambda out: writers.write_dataset(rows, out))
    stored = readers.load_dataset(spark, path)
    return stored.select(PLANT, SLOT, *FEATURES)


@query("src_intermediate")
def src_intermediate(spark, sf_dir):
    root = new_folder(spark, "work")
    writers.write_stage(t.weather(spark, sf_dir), "weather", root)
    return readers.read_stage(spark, "weather", root)


# --- Sinks ---


@query("sink_homogenised")
def sink_homogenised(spark, sf_dir):
    """Every row and column of the stored dataset, read back."""
    path = new_folder(spark, "dataset")
    writers.write_dataset(t.homogenised(spark, sf_dir, many=True), path)
    return readers.load_dataset(spark, path).select(PLANT, FECHA, SLOT, *FEATURES)


@query("sink_intermediate")
def sink_intermediate(spark, sf_dir):
    root = new_folder(spark, "work")
    writers.write_stage(t.generation(spark, sf_dir), "generation", root)
    return readers.read_stage(spark, "generation", root)


def _through_csv(df: DataFrame) -> DataFrame:
    spark = df.sparkSession
    path = new_folder(spark, "export")
    writers.export_csv(df, path)
    return (
        spark.read.schema(df.schema)
        .option("header", True)
        .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss")
        .csv(path)
    )


@query("export_history_csv")
def export_history_csv(spark, sf_dir):
    return _through_csv(
        views.history_table(
            _by_day(spark, sf_dir, "counters", t.generation), START, END, (6, 18), [POWER, E_TODAY, E_TOTAL]
        )
    )


@query("export_climate_csv")
def export_climate_csv(spark, sf_dir):
    return _through_csv(views.climate_table(_by_day(spark, sf_dir, "readings", t.weather), "gti", START, END))


def _provisional(spark: SparkSession, sf_dir: str, days: int = 3) -> DataFrame:
    history = _power(spark, sf_dir, step=HOUR)
    ends = _power_ends(spark, sf_dir, step=HOUR)
    return fc.provisional(history, fc.horizon(history, days, HOUR, ends=ends), ends=ends)


@query("export_forecast_csv")
def export_forecast_csv(spark, sf_dir):
    return _through_csv(views.forecast_table(_provisional(spark, sf_dir)))


@query("sink_results")
def sink_results(spark, sf_dir):
    path = new_folder(spark, "results")
    writers.write_metrics(pipeline.scores(_predictions(spark, sf_dir)), path)
    return _checkable(spark.read.parquet(path).drop("stored_at"))


# --- Cleaning ---


def _as_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with times and values as text: with an offset, without, or broken."""
    row = F.col("event_id")
    time = (
        F.when(row % 17 == 0, F.lit("no time"))
        .when(row % 2 == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    )
    value = F.when(row % 13 == 0, F.lit("n/a")).otherwise(F.col("value").cast("string"))
    return t.table(spark, sf_dir, "events").select(
        "event_id", time.alias("period_end"), value.alias("lectura")
    )


@query("parse_timestamps")
def parse_timestamps(spark, sf_dir):
    parsed = clean.parse_time(_as_text(spark, sf_dir), "period_end", "America/Monterrey")
    return parsed.select("event_id", "ts")


@query("clean_rows")
def clean_rows(spark, sf_dir):
    parsed = clean.parse_time(_as_text(spark, sf_dir), "period_end", "UTC")
    return clean.clean(parsed, numeric=["lectura"]).select("event_id", "ts", "lectura")


@query("select_variables")
def select_variables(spark, sf_dir):
    return clean.select_vars(t.homogenised(spark, sf_dir), ["ghi", "air_temp", POWER])


@query("dedupe_slots")
def dedupe_slots(spark, sf_dir):
    events = t.table(spark, sf_dir, "events")
    copies = events.select(
        F.concat(F.lit("P"), (F.col("user_id") % 4).cast("string")).alias(PLANT),
        F.window("ts", "5 minutes").start.alias(SLOT),
        F.col("value").alias(POWER),
        F.col("ts").alias("_mtime"),
        F.col("event_type").alias("_path"),
    )
    return clean.dedupe(copies).select(PLANT, SLOT, POWER)


@query("rename_units")
def rename_units(spark, sf_dir):
    raw = readers.read_generation(spark, _generation_files(spark, sf_dir))
    named = clean.to_model_names(readers.with_scalars(raw), power_factor=0.001)
    return named.select(PLANT, "time", E_TODAY, E_TOTAL, POWER)


# --- Filters, tables, views ---


@query("filter_dates")
def filter_dates(spark, sf_dir):
    return views.filter_dates(_power(spark, sf_dir), START, END).drop(FECHA)


@query("filter_hours")
def filter_hours(spark, sf_dir):
    """Of stored slots, whose hour is a column that reaches the scan."""
    rows = _by_day(spark, sf_dir, "hours", lambda *at: calendar.feat_hora(t.power(*at)))
    return views.filter_hours(rows, 6, 18).select(PLANT, SLOT, POWER)


@query("filter_dates_climate")
def filter_dates_climate(spark, sf_dir):
    return views.filter_dates(_by_day(spark, sf_dir, "readings", t.weather), START, END).drop(FECHA)


@query("climate_variable")
def climate_variable(spark, sf_dir):
    return views.climate_series(t.weather(spark, sf_dir), "ghi")


@query("history_table")
def history_table(spark, sf_dir):
    return views.history_table(
        _by_day(spark, sf_dir, "counters", t.generation), START, END, (8, 17), [POWER, E_TODAY, E_TOTAL]
    )


@query("climate_table")
def climate_table(spark, sf_dir):
    return views.climate_table(_by_day(spark, sf_dir, "readings", t.weather), "wind_direction_10m", START, END)


@query("forecast_table")
def forecast_table(spark, sf_dir):
    return views.forecast_table(_provisional(spark, sf_dir))


@query("view_full")
def view_full(spark, sf_dir):
    return views.energy_view(t.power(spark, sf_dir), "full")


@query("view_last7")
def view_last7(spark, sf_dir):
    return views.energy_view(_power(spark, sf_dir), "last7", ends=_power_ends(spark, sf_dir))


@query("view_last30")
def view_last30(spark, sf_dir):
    return views.energy_view(_power(spark, sf_dir), "last30", ends=_power_ends(spark, sf_dir))


@query("history_days")
def history_days(spark, sf_dir):
    return views.recent_each(_power(spark, sf_dir), 3, ends=_power_ends(spark, sf_dir)).drop(FECHA)


# --- Alignment and join ---


@query("align_generation")
def align_generation_query(spark, sf_dir):
    return align_generation(t.power_readings(spark, sf_dir))


@query("align_weather")
def align_weather_query(spark, sf_dir):
    return align_weather(t.weather_readings(spark, sf_dir))


@query("homogenise")
def homogenise_query(spark, sf_dir):
    return homogenise(t.power(spark, sf_dir), t.weather(spark, sf_dir))


@query("history_vs_forecast")
def history_vs_forecast(spark, sf_dir):
    history = _power(spark, sf_dir, step=HOUR)
    return views.history_vs_forecast(history, _provisional(spark, sf_dir), 7, ends=_power_ends(spark, sf_dir, step=HOUR))


# --- Calendar features ---


def _events(spark, sf_dir):
    return t.table(spark, sf_dir, "events").select("event_id", "ts")


@query("feat_hora")
def feat_hora(spark, sf_dir):
    return calendar.feat_hora(_events(spark, sf_dir), "ts")


@query("feat_dia_semana")
def feat_dia_semana(spark, sf_dir):
    return calendar.feat_dia_semana(_events(spark, sf_dir), "ts")


@query("feat_es_fin_semana")
def feat_es_fin_semana(spark, sf_dir):
    return calendar.feat_es_fin_semana(_events(spark, sf_dir), "ts")


@query("feat_mes")
def feat_mes(spark, sf_dir):
    return calendar.feat_mes(t.order_days(spark, sf_dir)).select("o_orderkey", SLOT, "mes")


@query("feat_estacion")
def feat_estacion(spark, sf_dir):
    return calendar.feat_estacion(t.order_days(spark, sf_dir)).select(
        "o_orderkey", SLOT, "estacion"
    )


@query("features_all")
def features_all(spark, sf_dir):
    return calendar.features_all(t.order_days(spark, sf_dir)).select(
        "o_orderkey", SLOT, *CALENDAR
    )


@query("model_input_schema")
def model_input_schema(spark, sf_dir):
    return forest.model_inputs(t.homogenised(spark, sf_dir, step=HOUR), horizon_days=1)


# --- Aggregations ---


def _summary(spark, sf_dir, column):
    return views.summary(t.power(spark, sf_dir)).select(column)


for _name, _column in {
    "summary_count": "total_registros",
    "summary_first_date": "fecha_inicial",
    "summary_last_date": "fecha_final",
    "summary_max": "valor_maximo",
}.items():
    query(_name)(lambda spark, sf_dir, column=_column: _summary(spark, sf_dir, column))


@query("daily_mean")
def daily_mean(spark, sf_dir):
    return views.energy_view(t.power(spark, sf_dir), "daily_mean")


@query("daily_max")
def daily_max(spark, sf_dir):
    return views.energy_view(t.power(spark, sf_dir), "daily_max")


@query("daily_generation")
def daily_generation(spark, sf_dir):
    return aggregates.daily_generation(t.generation(spark, sf_dir))


@query("forecast_daily")
def forecast_daily(spark, sf_dir):
    return fc.forecast_daily(_provisional(spark, sf_dir), step_minutes=60)


@query("profile_hourly")
def profile_hourly(spark, sf_dir):
    return aggregates.profile(t.power(spark, sf_dir), "hora")


@query("profile_monthly")
def profile_monthly(spark, sf_dir):
    return aggregates.profile(t.order_days(spark, sf_dir), "mes")


# --- Modelling and evaluation ---


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored hourly dataset of four plants that training and forecasts start from."""
    rows = t.homogenised(spark, sf_dir, many=True, step=HOUR)
    path = _once(spark, sf_dir, "hourly", lambda out: writers.write_dataset(rows, out))
    return readers.load_dataset(spark, path)


def _history_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each series of ``_history`` ends; ask for the history first."""
    return readers.load_ends(spark, _once(spark, sf_dir, "hourly", lambda out: None))


def _saved_model(spark: SparkSession, sf_dir: str) -> str:
    """Path of a forest trained on these tables."""
    history = _history(spark, sf_dir)
    return _once(
        spark,
        sf_dir,
        "model",
        lambda out: pipeline.train_final(history, out, horizon_days=1, params=RF_PARAMS),
    )


def _facts(predicted: DataFrame, train: DataFrame, actual: str) -> DataFrame:
    """What can be told of a forest's answers without the forest: that there is one, and
    that it lies among the training targets, as a mean of leaves must."""
    bounds = train.agg(F.min(forest.TARGET).alias("_low"), F.max(forest.TARGET).alias("_high"))
    # A tie of rounding in the mean of equal leaves is no way out of the bounds.
    inside = F.col("prediccion").between(F.col("_low") - 1e-9, F.col("_high") + 1e-9)
    return predicted.join(F.broadcast(bounds), F.lit(True)).select(
        PLANT,
        SLOT,
        *([F.col(actual).alias("actual")] if actual else []),
        F.col("prediccion").isNotNull().cast("int").alias("answered"),
        F.coalesce(inside, F.lit(False)).cast("int").alias("inside"),
    )


def _training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model inputs of all stored slots, filled as in serving, as a stage."""

    def write(path: str) -> None:
        history = _history(spark, sf_dir)
        fill_inputs(forest.model_inputs(history, horizon_days=1), history).write.parquet(path)

    return spark.read.parquet(_once(spark, sf_dir, "inputs", write))


@query("fit_random_forest")
def fit_random_forest(spark, sf_dir):
    """Answers for the last days by a forest that never saw them; the same seed gives the same ones."""
    rows = _training_rows(spark, sf_dir)
    table = splits.fold_table(views.series_ends(rows), 1, HOLDOUT_DAYS, ("holdout",))
    fold = splits.read_folds(table)[0]
    train, test = fold.train(rows), fold.test(rows)
    first, second = (forest.fit_rf(train, params=RF_PARAMS) for _ in range(2))
    again = second.transform(test).select(PLANT, SLOT, F.col("prediccion").alias("_again"))
    predicted = test.select(PLANT, SLOT, forest.TARGET).join(
        first.transform(test).select(PLANT, SLOT, "prediccion"), [PLANT, SLOT], "left"
    )
    facts = _facts(predicted, train, forest.TARGET)
    same = predicted.join(again, [PLANT, SLOT], "left").select(
        PLANT, SLOT, F.col("prediccion").eqNullSafe(F.col("_again")).cast("int").alias("same_seed")
    )
    return facts.join(same, [PLANT, SLOT])


@query("fit_arima")
def fit_arima(spark, sf_dir):
    step = "3 hours"
    model = arima.fit_arima(
        t.power(spark, sf_dir, step=step), p=1, d=0, q=1, long_ar=3, step=step
    )
    return model.select(
        PLANT,
        "n",
        "const",
        F.col("phi")[0].alias("phi_1"),
        F.col("theta")[0].alias("theta_1"),
        *[F.col("ar")[i].alias(f"ar_{i}") for i in range(4)],
    )


@query("fit_additive")
def fit_additive(spark, sf_dir):
    rows = homogenise(
        t.power(spark, sf_dir, step=HOUR), t.weather(spark, sf_dir, step=HOUR).select(PLANT, SLOT, "ghi")
    )
    spec = additive.AdditiveSpec(fourier={"day": 1}, changepoints=1, regressors=["ghi"], ridge=0.01)
    return additive.named_coefficients(additive.fit_additive(rows, spec), spec)


@query("split_holdout")
def split_holdout(spark, sf_dir):
    train, test = splits.split_time(t.power(spark, sf_dir), "2024-01-24 00:00:00")
    return train.withColumn("rol", F.lit("train")).unionByName(
        test.withColumn("rol", F.lit("test"))
    )


@query("split_expanding")
def split_expanding(spark, sf_dir):
    return splits.folds(t.power(spark, sf_dir), 3, 4, "expanding")


@query("split_sliding")
def split_sliding(spark, sf_dir):
    return splits.folds(t.power(spark, sf_dir), 3, 4, "sliding", window_days=10)


def _predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of the three forecasters, with the library's defaults, on a grid of six hours.

    Several queries read them; they are made once for each session and tables.
    """
    rows = t.homogenised(spark, sf_dir, many=True, step=EVALUATED)
    path = _once(spark, sf_dir, "evaluated", lambda out: writers.write_stage(rows, "rows", out, in_time=True))
    store = _once(spark, sf_dir, "evaluations", lambda out: None)
    dataset = readers.read_stage(spark, "rows", path)
    with _stored_lock:
        return spark.read.parquet(
            pipeline.evaluate_candidates(dataset, HORIZON_DAYS, step=EVALUATED, parallelism=4, store=store)
        )


def _checkable(table: DataFrame) -> DataFrame:
    """The errors as far as SQL can follow: a forest's are NULL (``candidate_scores`` has them).

    ``sound``: no bias above the mean error, no mean error above the root of
    the mean square, no R2 above one.
    """
    errors = ["mae", "rmse", "rmse_std", "r2", "bias"]
    sound = (F.abs("bias") <= F.col("mae") + 1e-9) & (F.col("mae") <= F.col("rmse") + 1e-9) & (F.coalesce("r2", F.lit(0.0)) <= 1)
    hidden = {c: F.when(F.col("model") != "random_forest", F.col(c)) for c in errors if c in table.columns}
    return table.withColumn("sound", F.coalesce(sound, F.lit(False)).cast("int")).withColumns(hidden)


@query("eval_metrics")
def eval_metrics(spark, sf_dir):
    return _checkable(pipeline.scores(_predictions(spark, sf_dir)))


@query("compare_models")
def compare_models(spark, sf_dir):
    return _checkable(pipeline.comparison(_predictions(spark, sf_dir)))


@query("horizon_decay")
def horizon_decay(spark, sf_dir):
    return _checkable(pipeline.decay(_predictions(spark, sf_dir)))


@query("select_final")
def select_final(spark, sf_dir):
    """The better of the two that SQL can follow, and whether the choice among all three is no worse."""
    table = pipeline.comparison(_predictions(spark, sf_dir))
    chosen = evaluate.select_final(table).select(F.col("rmse").alias("_rmse"), F.col("model").alias("_model"))
    followed = evaluate.select_final(table.where("model <> 'random_forest'"))
    no_worse = (F.col("_rmse") <= F.col("rmse")) & ((F.col("_model") == F.col("model")) | (F.col("_model") == "random_forest"))
    # One row each.
    return followed.crossJoin(chosen).select("model", "rmse", "rmse_std", "mae", no_worse.cast("int").alias("final_no_worse"))


@query("candidate_scores")
def candidate_scores(spark, sf_dir):
    """All errors of all three forecasters, the forest's too."""
    return pipeline.scores(_predictions(spark, sf_dir))


@query("candidate_choice")
def candidate_choice(spark, sf_dir):
    """The final model among the three."""
    return pipeline.choose(_predictions(spark, sf_dir))


@query("compare_candidates")
def compare_candidates(spark, sf_dir):
    """The three forecasters over all strategies: test slots of each fit, and whether every
    model is scored on the same ones."""
    judged = pipeline.scores(_predictions(spark, sf_dir))
    least = judged.groupBy("strategy", "fold").agg(F.min("n").alias("_least"), F.max("n").alias("_most"))
    same = judged.join(least, ["strategy", "fold"])
    return same.select(
        "model", "strategy", "fold", "slots", ((F.col("_least") == F.col("_most")) & (F.col("n") > 0)).cast("int").alias("same_slots")
    )


@query("model_save")
def model_save(spark, sf_dir):
    """Whether a forest answers every row alike before it is stored and after it is read."""
    rows = _training_rows(spark, sf_dir)
    model = forest.fit_rf(rows, params=RF_PARAMS)
    path = forest.save_model(model, new_folder(spark, "model"), lag_days=1, step=HOUR)
    loaded, contract = forest.load_model(path), forest.load_contract(spark, path)
    after = loaded.transform(rows).select(PLANT, SLOT, F.col("prediccion").alias("_after"))
    before = model.transform(rows).select(PLANT, SLOT, "prediccion")
    both = rows.select(PLANT, SLOT).join(before, [PLANT, SLOT], "left").join(after, [PLANT, SLOT], "left")
    return both.select(
        PLANT,
        SLOT,
        F.coalesce(F.col("prediccion") == F.col("_after"), F.lit(False)).cast("int").alias("agrees"),
        F.lit(contract.lag_days).alias("lag_days"),
    )


@query("model_load")
def model_load(spark, sf_dir):
    """The loaded model answers every stored row."""
    rows = _training_rows(spark, sf_dir)
    model = forest.load_model(_saved_model(spark, sf_dir))
    answers = model.transform(rows).select(PLANT, SLOT, "prediccion")
    predicted = rows.select(PLANT, SLOT, forest.TARGET).join(answers, [PLANT, SLOT], "left")
    return _facts(predicted, rows, forest.TARGET)


# --- Forecast and economics ---


@query("future_horizon")
def future_horizon(spark, sf_dir):
    return fc.horizon(t.power(spark, sf_dir), 2)


@query("inference_inputs")
def inference_inputs(spark, sf_dir):
    history = _history(spark, sf_dir)
    ends = _history_ends(spark, sf_dir)
    return fc.inputs(history, fc.slots_after(ends, 2, HOUR), 2, ends=ends)


@query("forecast")
def forecast(spark, sf_dir):
    """Every slot of every plant's next day has an answer among the training targets."""
    history = _history(spark, sf_dir)
    model = forest.load_model(_saved_model(spark, sf_dir))
    ends = _history_ends(spark, sf_dir)
    answers = fc.forecast(history, model, 1, HOUR, ends=ends).drop("modo")
    asked = fc.horizon(history, 1, HOUR, ends=ends).join(answers, [PLANT, SLOT], "left")
    return _facts(asked, _training_rows(spark, sf_dir), "")


@query("forecast_fallback")
def forecast_fallback(spark, sf_dir):
    return _provisional(spark, sf_dir)


@query("forecast_or_fallback")
def forecast_or_fallback(spark, sf_dir):
    """One plant's irradiance was never measured, so the recent pattern answers for it, the model for the others.

    The model's answers are told as lying among the training targets or not.
    """
    history = _history(spark, sf_dir)
    blind = history.withColumn("ghi", F.when(F.col(PLANT) != "P3", F.col("ghi")))
    ends = _history_ends(spark, sf_dir)
    answers = fc.forecast_safe(blind, _saved_model(spark, sf_dir), 1, HOUR, ends=ends).predictions
    facts = _facts(answers, _training_rows(spark, sf_dir), "").drop("answered")
    told = F.when(F.col("modo") == fc.PROVISIONAL_MODE, F.col("prediccion")).alias("prediccion")
    return answers.select(PLANT, SLOT, "modo", told).join(facts, [PLANT, SLOT])


@query("model_status")
def model_status(spark, sf_dir):
    """The outcomes: a stored model, a path without one, and a horizon beyond the model's."""
    history = _history(spark, sf_dir)
    stored, none = _saved_model(spark, sf_dir), new_folder(spark, "no-model")
    ends = _history_ends(spark, sf_dir)
    good, bad, far = (fc.forecast_safe(history, *asked, HOUR, ends=ends).status() for asked in ((stored, 1), (none, 1), (stored, 3)))
    return good.unionByName(bad).unionByName(far)


@query("economic_estimate")
def economic_estimate(spark, sf_dir):
    daily = aggregates.daily_generation(t.power(spark, sf_dir))
    return economics.economics(daily, TARIFF)


@query("consumption_cost")
def consumption_cost(spark, sf_dir):
    """Priced per plant from a tariff table, over the years of the orders."""
    rows = t.order_days(spark, sf_dir)
    daily = aggregates.daily_generation(rows, step_minutes=60)
    tariffs = rows.groupBy(PLANT).agg(
        (1 + F.max(F.substring(PLANT, 2, 1).cast("int")) * 0.5).alias("tarifa")
    )
    return economics.cost_by_period(daily, tariffs, "month")


def prepare(spark: SparkSession, sf_dir: str) -> dict[str, float]:
    """Writes what several queries read, once for each session and tables; seconds by name."""
    steps = {
        "generation files": lambda: _generation_files(spark, sf_dir),
        "weather files": lambda: _weather_files(spark, sf_dir),
        "power by day": lambda: _power(spark, sf_dir),
        "hourly power by day": lambda: _power(spark, sf_dir, step=HOUR),
        "counters by day": lambda: _by_day(spark, sf_dir, "counters", t.generation),
        "readings by day": lambda: _by_day(spark, sf_dir, "readings", t.weather),
        "hourly dataset": lambda: _history(spark, sf_dir),
        "model inputs": lambda: _training_rows(spark, sf_dir),
        "model": lambda: _saved_model(spark, sf_dir),
        "evaluation of three forecasters": lambda: _predictions(spark, sf_dir),
    }
    seconds = {}
    for name, step in steps.items():
        start = time.perf_counter()
        step()
        seconds[name] = round(time.perf_counter() - start, 3)
    return seconds
