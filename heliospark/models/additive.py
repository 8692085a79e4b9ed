"""Additive model: piecewise trend, Fourier seasons and external regressors.

The design is a list of column expressions, fitted per series by ridge
regression on summed products and applied by the same expressions.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliospark.functions.timegrid import wall_seconds
from heliospark.models.linear import dot, least_squares
from heliospark.schema import KEYS, POWER, SLOT

PERIOD_DAYS = {"day": 1.0, "week": 7.0, "year": 365.25}
#: Bounds of a series' training time.
START, END = "_train_start", "_train_end"


@dataclass(frozen=True)
class AdditiveSpec:
    """What the design holds. Trend and knots are scaled to each series' own training time."""

    fourier: Mapping[str, int] = field(default_factory=lambda: {"day": 4})
    changepoints: int = 5
    regressors: Sequence[str] = ()
    ridge: float = 1e-6

    def __post_init__(self):
        unknown = set(self.fourier) - set(PERIOD_DAYS)
        if unknown:
            raise ValueError(f"unknown seasons {sorted(unknown)}")

    def terms(self, ts: str = SLOT) -> dict[str, Column]:
        """Name to expression over a row and its series' bounds, the intercept first."""
        seconds = wall_seconds(ts) - wall_seconds(START)
        length = wall_seconds(END) - wall_seconds(START)
        # A series of one instant has no trend.
        trend = F.when(length > 0, seconds / length).otherwise(F.lit(0.0))
        out = {"const": F.lit(1.0), "trend": trend}
        for j in range(1, self.changepoints + 1):
            knot = j / (self.changepoints + 1)
            out[f"bend_{j}"] = F.greatest(trend - F.lit(knot), F.lit(0.0))
        lead = wall_seconds(START) - wall_seconds(F.to_date(START))
        for season, harmonics in self.fourier.items():
            phase = (seconds + lead) * F.lit(2 * math.pi / (PERIOD_DAYS[season] * 86400))
            for k in range(1, harmonics + 1):
                out[f"{season}_sin_{k}"] = F.sin(phase * k)
                out[f"{season}_cos_{k}"] = F.cos(phase * k)
        for name in self.regressors:
            out[name] = F.col(name)
        return out


def fit_additive(
    df: DataFrame,
    spec: AdditiveSpec,
    target: str = POWER,
    keys: Sequence[str] = KEYS,
    ts: str = SLOT,
) -> DataFrame:
    """One row per series: ``n``, ``coef`` in the order of the terms, ``sigma2``, and the bounds of its training time.

    The bounds are those of the rows that have the target and all regressors, so
    that a series that starts late is fitted as if it were alone.
    """
    rows = df.dropna(subset=[target, *spec.regressors])
    bounds = rows.groupBy(*keys).agg(F.min(ts).alias(START), F.max(ts).alias(END))
    xs = list(spec.terms(ts).values())
    penalty = [0.0] + [spec.ridge] * (len(xs) - 1)
    fitted = least_squares(rows.join(bounds, list(keys)), keys, xs, F.col(target), penalty)
    return fitted.join(bounds, list(keys))


def named_coefficients(model: DataFrame, spec: AdditiveSpec, keys: Sequence[str] = KEYS) -> DataFrame:
    columns = [F.col("coef")[i].alias(name) for i, name in enumerate(spec.terms())]
    return model.select(*keys, "n", *columns)


def predict_additive(
    df: DataFrame,
    model: DataFrame,
    spec: AdditiveSpec,
    keys: Sequence[str] = KEYS,
    ts: str = SLOT,
) -> DataFrame:
    """Add ``prediccion``; the model holds one row per series, others get NULL."""
    xs = list(spec.terms(ts).values())
    joined = df.join(model.select(*keys, "coef", START, END), list(keys), "left")
    return joined.withColumn("prediccion", dot(F.col("coef"), xs)).drop("coef", START, END)
