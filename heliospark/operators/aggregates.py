"""Daily energy and exploratory profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliospark.functions import calendar
from heliospark.schema import E_TODAY, FECHA, KEYS, POWER, SLOT, STEP_MINUTES

_PROFILES = {
    "hora": calendar.hora,
    "dia_semana": calendar.dia_semana,
    "mes": calendar.mes,
    "estacion": calendar.estacion,
}


def daily_generation(
    df: DataFrame, step_minutes: int = STEP_MINUTES, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Energy of each day from mean power, beside the counter's own reading."""
    day = F.col(FECHA) if FECHA in df.columns else F.to_date(SLOT).alias(FECHA)
    aggs = [(F.sum(POWER) * F.lit(step_minutes / 60)).alias("kwh")]
    if E_TODAY in df.columns:
        aggs.append(F.max(E_TODAY).alias(E_TODAY))
    return df.groupBy(*keys, day).agg(*aggs)


def profile(
    df: DataFrame,
    by: str,
    target: str = POWER,
    ts: str = SLOT,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Mean and spread of the target by hour, weekday, month or season."""
    if by not in _PROFILES:
        raise ValueError(f"by must be one of {sorted(_PROFILES)}")
    period = F.col(by) if by in df.columns else _PROFILES[by](ts).alias(by)
    return df.groupBy(*keys, period).agg(
        F.count(target).alias("n"),
        F.avg(target).alias("media"),
        F.stddev(target).alias("desviacion"),
    )
