"""Alignment on the common grid and the join into one dataset."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliospark.functions.timegrid import circular_mean, grid_slot
from heliospark.schema import CIRCULAR, E_TODAY, E_TOTAL, KEYS, POWER, SLOT, STEP, WEATHER


def align(
    df: DataFrame,
    aggs: Mapping[str, Column],
    step: str = STEP,
    ts: str = "ts",
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """One row per key and slot.

    The slot is a column of its own before grouping, so the result is hashed
    by (keys, slot) and a join on the same columns needs no further shuffle.
    """
    slotted = df.withColumn(SLOT, grid_slot(ts, step))
    return slotted.groupBy(*keys, SLOT).agg(*[agg.alias(name) for name, agg in aggs.items()])


def align_generation(
    df: DataFrame, step: str = STEP, ts: str = "ts", keys: Sequence[str] = KEYS
) -> DataFrame:
    """Mean power of a slot; counters take their highest reading."""
    aggs = {POWER: F.avg(POWER)}
    aggs |= {c: F.max(c) for c in ("nominalPower", E_TODAY, E_TOTAL) if c in df.columns}
    return align(df, aggs, step, ts, keys)


def align_weather(
    df: DataFrame,
    step: str = STEP,
    ts: str = "ts",
    keys: Sequence[str] = KEYS,
    label: str = "start",
) -> DataFrame:
    """Mean of each variable; directions are averaged on the circle.

    ``label="end"`` reads ``ts`` as the end of its interval, as ``period_end``
    is named: an observation then belongs to the slot that ends at it.
    """
    if label not in ("start", "end"):
        raise ValueError("label must be 'start' or 'end'")
    if label == "end":
        df = df.withColumn(ts, F.col(ts) - F.expr(f"interval {step}"))
    aggs = {
        c: circular_mean(c) if c in CIRCULAR else F.avg(c) for c in WEATHER if c in df.columns
    }
    return align(df, aggs, step, ts, keys)


def homogenise(
    generation: DataFrame,
    weather: DataFrame,
    how: str = "inner",
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Generation and weather of the same slot in one row.

    Both sides hold a slot once, so no key of this join can be hot.
    """
    if how not in ("inner", "left"):
        raise ValueError("how must be 'inner' or 'left'")
    return generation.join(weather, [*keys, SLOT], how)
