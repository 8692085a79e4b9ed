"""Future horizon, inference inputs, forecast and the provisional mode."""

from __future__ import annotations

import datetime as dt
import logging
from collections.abc import Sequence
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliospark.functions.calendar import features_all, minute_of_day
from heliospark.models.forest import load_contract, load_model
from heliospark.operators.fill import fill_inputs, usual_day
from heliospark.operators.lags import shift_days
from heliospark.operators.views import recent_each, series_ends
from heliospark.schema import END, ENERGY, FEATURES, FECHA, KEYS, POWER, SLOT, STEP, WEATHER
from heliospark.session import new_folder

log = logging.getLogger(__name__)

MODEL_MODE = "modelo"
PROVISIONAL_MODE = "provisional"
PATTERN_DAYS = 7


def horizon(
    df: DataFrame,
    days: int,
    step: str = STEP,
    keys: Sequence[str] = KEYS,
    ends: DataFrame | None = None,
) -> DataFrame:
    """The slots of the next ``days`` days, after each series' latest slot."""
    return slots_after(series_ends(df, keys=keys) if ends is None else ends, days, step, keys)


def slots_after(
    ends: DataFrame,
    days: int,
    step: str = STEP,
    keys: Sequence[str] = KEYS,
    origin: dt.datetime | None = None,
) -> DataFrame:
    """The slots of ``days`` days for every series, after its end or after a common ``origin``."""
    if days <= 0:
        raise ValueError("days must be positive")
    start = F.col(END) if origin is None else F.lit(origin.isoformat(sep=" ")).cast("timestamp_ntz")
    times = F.sequence(
        start + F.expr(f"interval {step}"),
        start + F.expr(f"interval {int(days)} days"),
        F.expr(f"interval {step}"),
    )
    return ends.select(*keys, F.explode(times).alias(SLOT))


def slot_pattern(
    df: DataFrame,
    columns: Sequence[str],
    days: int = PATTERN_DAYS,
    keys: Sequence[str] = KEYS,
    ends: DataFrame | None = None,
) -> DataFrame:
    """Mean of each column by time of day over each series' own last days."""
    return usual_day(recent_each(df, days, keys=keys, ends=ends), columns, keys)


def inputs(
    history: DataFrame,
    future: DataFrame,
    lag_days: int,
    weather: DataFrame | None = None,
    keys: Sequence[str] = KEYS,
    ends: DataFrame | None = None,
    hemisphere: str = "north",
) -> DataFrame:
    """Model inputs for the slots of ``future``, one row for each.

    Energy comes from ``lag_days`` earlier, as the model was trained. Weather is
    what the caller forecasts, and where that is missing the recent mean at
    that time of day.
    """
    known = recent_each(history, lag_days + PATTERN_DAYS, keys=keys, ends=ends)
    energy = shift_days(known.select(*keys, SLOT, *ENERGY), lag_days)
    pattern = slot_pattern(history, WEATHER, keys=keys, ends=ends)
    rows = features_all(future, hemisphere=hemisphere).withColumn("_minute", minute_of_day())
    rows = rows.join(energy, [*keys, SLOT], "left")
    if weather is None:
        rows = rows.join(pattern, [*keys, "_minute"], "left")
    else:
        usual = pattern.withColumnsRenamed({c: f"_usual_{c}" for c in WEATHER})
        given = weather.select(*keys, SLOT, *WEATHER)
        rows = rows.join(given, [*keys, SLOT], "left").join(usual, [*keys, "_minute"], "left")
        rows = rows.withColumns({c: F.coalesce(c, f"_usual_{c}") for c in WEATHER})
    return rows.select(*keys, SLOT, *FEATURES)


def forecast(
    history: DataFrame,
    model: PipelineModel,
    days: int,
    step: str = STEP,
    weather: DataFrame | None = None,
    keys: Sequence[str] = KEYS,
    ends: DataFrame | None = None,
    lag_days: int | None = None,
    origin: dt.datetime | None = None,
    hemisphere: str = "north",
) -> DataFrame:
    """The model's prediction for every slot of the horizon of every series.

    ``lag_days`` is the lag that the model was trained with, ``days`` if not given.
    """
    ends = series_ends(history, keys=keys) if ends is None else ends
    future = slots_after(ends, days, step, keys, origin)
    asked = inputs(history, future, lag_days or days, weather, keys, ends, hemisphere)
    rows = fill_inputs(asked, recent_each(history, PATTERN_DAYS, keys=keys, ends=ends), keys)
    return model.transform(rows).select(
        *keys, SLOT, F.col("prediccion"), F.lit(MODEL_MODE).alias("modo")
    )


def provisional(
    history: DataFrame,
    future: DataFrame,
    target: str = POWER,
    days: int = PATTERN_DAYS,
    keys: Sequence[str] = KEYS,
    ends: DataFrame | None = None,
) -> DataFrame:
    """Recent mean at that time of day; NULL where the pattern has no such time."""
    pattern = slot_pattern(history, [target], days, keys, ends).withColumnRenamed(target, "prediccion")
    rows = future.withColumn("_minute", minute_of_day()).join(pattern, [*keys, "_minute"], "left")
    return rows.select(*keys, SLOT, "prediccion", F.lit(PROVISIONAL_MODE).alias("modo"))


@dataclass(frozen=True)
class ForecastResult:
    """``mode`` is the model's as soon as it answers for any series."""

    predictions: DataFrame
    mode: str
    reason: str | None
    kept: DataFrame | None = None

    def close(self) -> None:
        """Releases the forecast that the call kept; ``predictions`` then run anew where read."""
        if self.kept is not None:
            self.kept.unpersist()

    def status(self) -> DataFrame:
        """A row per mode that answered: how many slots, and why not the model."""
        reason = F.when(F.col("modo") == PROVISIONAL_MODE, F.lit(self.reason))
        return self.predictions.groupBy("modo", reason.cast("string").alias("motivo")).agg(
            F.count(F.lit(1)).alias("slots"),
            F.min(SLOT).alias("desde"),
            F.max(SLOT).alias("hasta"),
        )


def forecast_safe(
    history: DataFrame,
    model_path: str,
    days: int,
    step: str = STEP,
    weather: DataFrame | None = None,
    target: str = POWER,
    keys: Sequence[str] = KEYS,
    as_of: dt.datetime | None = None,
    origin: dt.datetime | None = None,
    ends: DataFrame | None = None,
) -> ForecastResult:
    """The model's forecast, or the provisional one where it cannot be had.

    Every series of the history gets a row for each slot, however long it has
    been silent: after its own end, or after ``origin``. Slots after ``as_of``
    are not looked at; ``ends`` spares the search for the ends where they are
    stored (``readers.load_ends``). Inference fails only once it runs, so the forecast is
    kept and counted by one action inside the guard. A series with fewer
    answers than slots gets the provisional forecast whole; the others keep the
    model's. A model answers no further ahead than the lag it was trained with.
    """
    spark = history.sparkSession
    # One row a series, stored: every range below starts from it.
    folder = new_folder(spark, "ends")
    found = series_ends(history, keys=keys, as_of=as_of) if ends is None else ends
    found.write.parquet(folder)
    ends = spark.read.parquet(folder)
    if ends.isEmpty():
        raise ValueError("there is no history to forecast from")
    future = slots_after(ends, days, step, keys, origin)
    pattern = provisional(history, future, target, keys=keys, ends=ends)
    try:
        contract = load_contract(spark, model_path)
    except (PySparkException, Py4JJavaError) as error:
        return _all_provisional(pattern, f"model not usable: {type(error).__name__}")
    if days > contract.lag_days:
        return _all_provisional(pattern, f"model trained for {contract.lag_days} days, asked for {days}")
    if list(contract.inputs) != list(FEATURES):
        return _all_provisional(pattern, "model trained on other inputs")
    try:
        model = load_model(model_path)
        predictions = forecast(
            history, model, days, step, weather, keys, ends, contract.lag_days, origin,
            contract.hemisphere,
        ).persist()
    except (PySparkException, Py4JJavaError) as error:
        return _all_provisional(pattern, f"model not usable: {type(error).__name__}")
    answered = future.join(predictions, [*keys, SLOT], "left").groupBy(*keys).agg(
        (F.count("prediccion") == F.count(F.lit(1))).alias("_whole")
    )
    try:
        got = answered.agg(
            F.count_if("_whole").alias("whole"), F.count(F.lit(1)).alias("series")
        ).first()
    except (PySparkException, Py4JJavaError) as error:
        predictions.unpersist()
        return _all_provisional(pattern, f"inference failed: {type(error).__name__}")
    if got["series"] and got["whole"] == got["series"]:
        return ForecastResult(predictions, MODEL_MODE, None, predictions)
    reason = f"model answered for {got['whole']} of {got['series']} series"
    if not got["whole"]:
        predictions.unpersist()
        return _all_provisional(pattern, reason)
    log.warning("partly provisional forecast: %s", reason)
    whole = answered.where("_whole").select(*keys)
    mixed = predictions.join(whole, list(keys), "left_semi").unionByName(
        pattern.join(whole, list(keys), "left_anti")
    )
    return ForecastResult(mixed, MODEL_MODE, reason, predictions)


def _all_provisional(pattern: DataFrame, reason: str) -> ForecastResult:
    log.warning("provisional forecast: %s", reason)
    return ForecastResult(pattern, PROVISIONAL_MODE, reason)


def forecast_daily(predictions: DataFrame, step_minutes: int = 5, keys: Sequence[str] = KEYS) -> DataFrame:
    """Mean, highest value and energy of each forecast day."""
    return predictions.groupBy(*keys, F.to_date(SLOT).alias(FECHA)).agg(
        F.avg("prediccion").alias("media"),
        F.max("prediccion").alias("maximo"),
        (F.sum("prediccion") * F.lit(step_minutes / 60)).alias("kwh"),
    )
