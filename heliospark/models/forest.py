"""Random forest on MLlib, its input table, storage and loading."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from heliospark.functions.calendar import features_all
from heliospark.operators.lags import lag_days
from heliospark.schema import CALENDAR, ENERGY, FEATURES, KEYS, POWER, SLOT

TARGET = "objetivo"
CONTRACT = "lag_days int, step string, window_days int, hemisphere string, inputs array<string>"
ENERGY_INPUTS = ("lagged", "same_row")


def model_inputs(
    df: DataFrame,
    horizon_days: int,
    energy_inputs: str = "lagged",
    target: str = POWER,
    keys: Sequence[str] = KEYS,
    hemisphere: str = "north",
) -> DataFrame:
    """The declared inputs in their fixed order, and the target beside them.

    Energy inputs are those of the same time ``horizon_days`` earlier: what a
    forecast that far ahead can know. ``same_row`` takes those of the row
    itself, target included, and only serves to imitate such a model.
    """
    if energy_inputs not in ENERGY_INPUTS:
        raise ValueError(f"energy_inputs must be one of {ENERGY_INPUTS}")
    rows = df.withColumn(TARGET, F.col(target))
    if energy_inputs == "lagged":
        rows = lag_days(rows, {c: c for c in ENERGY}, horizon_days, keys)
    if not set(CALENDAR) <= set(rows.columns):
        rows = features_all(rows, hemisphere=hemisphere)
    return rows.select(*keys, SLOT, *FEATURES, TARGET)


def assembler(features: Sequence[str] = FEATURES, handle_invalid: str = "skip") -> VectorAssembler:
    return VectorAssembler(
        inputCols=list(features), outputCol="features", handleInvalid=handle_invalid
    )


def fit_rf(
    df: DataFrame,
    target: str = TARGET,
    features: Sequence[str] = FEATURES,
    seed: int = 42,
    params: Mapping[str, object] | None = None,
) -> PipelineModel:
    """Fit the final regressor; rows lacking an input or the target are skipped.

    Give it stored rows (a stage): the forest passes over them once per level,
    and a refit on the same files yields the same trees.
    """
    rows = df.select(*features, target).dropna()
    if rows.isEmpty():
        raise ValueError("no row has all inputs and the target")
    options = {"numTrees": 60, "maxDepth": 10, "minInstancesPerNode": 2, "maxBins": 64}
    forest = RandomForestRegressor(
        featuresCol="features",
        labelCol=target,
        predictionCol="prediccion",
        seed=seed,
        **(options | dict(params or {})),
    )
    return Pipeline(stages=[assembler(features), forest]).fit(rows)


def save_model(
    model: PipelineModel,
    path: str,
    lag_days: int,
    step: str | None = None,
    window_days: int | None = None,
    hemisphere: str = "north",
) -> str:
    """Stores the model and, beside it, what it was trained for."""
    model.write().overwrite().save(path)
    contract = [(lag_days, step, window_days, hemisphere, list(FEATURES))]
    model_spark().createDataFrame(contract, CONTRACT).coalesce(1).write.mode("overwrite").json(f"{path}/contract")
    return path


def model_spark() -> SparkSession:
    return SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()


def load_contract(spark: SparkSession, path: str) -> Row:
    """lag_days, step, window_days and inputs of a stored model."""
    return spark.read.schema(CONTRACT).json(f"{path}/contract").first()


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
