"""Error metrics, model comparison and the choice of the final model."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliospark.functions.timegrid import wall_seconds


def metrics(
    predictions: DataFrame,
    by: Sequence[str] = ("model", "fold"),
    actual: str = "actual",
    predicted: str = "prediction",
) -> DataFrame:
    """MAE, RMSE, R2 and bias per group; rows lacking either value are left out.

    Every term is an aggregate with a partial step, so groups of any size are
    reduced before the shuffle. R2 is NULL where the actual values never vary.
    """
    y, error = F.col(actual), F.col(predicted) - F.col(actual)
    pairs = predictions.where(y.isNotNull() & F.col(predicted).isNotNull())
    sums = pairs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.abs(error)).alias("mae"),
        F.avg(error * error).alias("_mse"),
        F.avg(error).alias("bias"),
        F.var_pop(y).alias("_var"),
    )
    return sums.select(
        *by,
        "n",
        "mae",
        F.sqrt("_mse").alias("rmse"),
        F.when(F.col("_var") > 0, 1 - F.col("_mse") / F.col("_var")).alias("r2"),
        "bias",
    )


def compare_models(results: DataFrame) -> DataFrame:
    """Mean error and its spread over folds, per model and strategy."""
    return results.groupBy("model", "strategy").agg(
        F.count(F.lit(1)).alias("folds"),
        F.avg("mae").alias("mae"),
        F.avg("rmse").alias("rmse"),
        F.stddev("rmse").alias("rmse_std"),
        F.avg("r2").alias("r2"),
        F.avg("bias").alias("bias"),
    )


def lead_day(predictions: DataFrame, origin: str = "origin", ts: str = "slot") -> DataFrame:
    """Add the day of the forecast, counted from 1 after the origin."""
    seconds = wall_seconds(ts) - wall_seconds(origin)
    return predictions.withColumn("lead_day", F.ceil(seconds / 86400).cast("int"))


def horizon_decay(predictions: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """The metrics against the forecast's lead in days."""
    return metrics(predictions, (*by, "lead_day"))


def select_final(table: DataFrame) -> DataFrame:
    """The row with the lowest error over its strategies, steadier ones first.

    Models are ranked by mean RMSE, then by its spread; a model without a
    spread (one fold) comes after those with one, and names break ties.
    """
    overall = table.groupBy("model").agg(
        F.avg("rmse").alias("rmse"), F.avg("rmse_std").alias("rmse_std"), F.avg("mae").alias("mae")
    )
    return overall.orderBy("rmse", F.col("rmse_std").asc_nulls_last(), "model").limit(1)
