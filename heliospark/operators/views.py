"""Filters, energy views, recent days, tables and the dataset summary."""

from __future__ import annotations

import datetime as dt
import functools
import operator
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliospark.functions.timegrid import days_before
from heliospark.schema import END, FECHA, KEYS, POWER, SLOT, WEATHER

ENERGY_VIEWS = ("full", "daily_mean", "daily_max", "last7", "last30")


def _day(value: str | dt.date) -> dt.date:
    if isinstance(value, str):
        return dt.date.fromisoformat(value)
    return value.date() if isinstance(value, dt.datetime) else value


def _midnight(day: dt.date) -> Column:
    return F.lit(day.isoformat()).cast("timestamp_ntz")


def filter_dates(
    df: DataFrame, start: str | dt.date, end: str | dt.date, ts: str = SLOT
) -> DataFrame:
    """Slots of the days from ``start`` to ``end``, both included.

    Where the data is stored by day, the same range is stated on the partition
    column, since Spark does not derive one from the other.
    """
    first, last = _day(start), _day(end)
    if first > last:
        raise ValueError(f"start {first} is after end {last}")
    after = last + dt.timedelta(days=1)
    rows = df.where((F.col(ts) >= _midnight(first)) & (F.col(ts) < _midnight(after)))
    if FECHA in df.columns:
        rows = rows.where(F.col(FECHA).between(F.lit(first), F.lit(last)))
    return rows


def filter_hours(df: DataFrame, first: int, last: int, ts: str = SLOT) -> DataFrame:
    """Slots whose hour lies between the two, both included."""
    if not 0 <= first <= last <= 23:
        raise ValueError("hours must satisfy 0 <= first <= last <= 23")
    hour = F.col("hora") if "hora" in df.columns else F.hour(ts)
    return df.where(hour.between(first, last))


def latest_slot(df: DataFrame, ts: str = SLOT) -> DataFrame:
    """One row, one column ``latest``; data stored by day scans its last day only."""
    if FECHA in df.columns:
        df = df.where(F.col(FECHA) == df.agg(F.max(FECHA)).scalar())
    return df.agg(F.max(ts).alias("latest"))


def read_latest(df: DataFrame, ts: str = SLOT) -> dt.datetime | None:
    """The latest slot as a value; reads it with one action."""
    return latest_slot(df, ts).first()["latest"]


def recent(
    df: DataFrame,
    days: int,
    ts: str = SLOT,
    of: DataFrame | None = None,
    at: dt.datetime | None = None,
) -> DataFrame:
    """Rows of the last ``days`` days, counted back from the latest slot of ``of``.

    ``of`` is the unfiltered data where ``df`` is already filtered. The anchor
    is a scalar subquery: nothing is joined, and on stored data it also bounds
    the day partitions that the scan opens. Jobs that ask for several trailing
    ranges of the same data pass the anchor as ``at`` and spare the subqueries.
    """
    if days <= 0:
        raise ValueError("days must be positive")
    if at is not None:
        start = at - dt.timedelta(days=days)
        bound = F.lit(start.isoformat(sep=" ")).cast("timestamp_ntz")
        first = F.lit(start.date())
    else:
        anchor = latest_slot(df if of is None else of, ts)
        bound = anchor.select(days_before(F.col("latest"), days)).scalar()
        first = anchor.select(F.to_date(days_before(F.col("latest"), days))).scalar()
    rows = df.where(F.col(ts) > bound)
    return rows.where(F.col(FECHA) >= first) if FECHA in df.columns else rows


def series_ends(
    df: DataFrame, ts: str = SLOT, keys: Sequence[str] = KEYS, as_of: dt.datetime | None = None
) -> DataFrame:
    """The latest slot of each series; slots after ``as_of`` are a wrong clock's and don't count."""
    if as_of is not None:
        df = df.where(F.col(ts) <= F.lit(as_of.isoformat(sep=" ")).cast("timestamp_ntz"))
    return df.groupBy(*keys).agg(F.max(ts).alias(END))


def day_spans(ends: DataFrame, days: int) -> list[tuple[dt.date, dt.date]]:
    """The days that trailing views of ``days`` days open, as spans that don't touch; reads the ends with one action.

    There are no more spans than days on which some series ended.
    """
    last = sorted(r[0] for r in ends.select(F.to_date(END)).distinct().collect() if r[0] is not None)
    spans: list[tuple[dt.date, dt.date]] = []
    for end in last:
        first = end - dt.timedelta(days=days)
        if spans and first <= spans[-1][1] + dt.timedelta(days=1):
            spans[-1] = (spans[-1][0], end)
        else:
            spans.append((first, end))
    return spans


def recent_each(
    df: DataFrame,
    days: int,
    ts: str = SLOT,
    keys: Sequence[str] = KEYS,
    ends: DataFrame | None = None,
    as_of: dt.datetime | None = None,
) -> DataFrame:
    """Rows of each series' own last ``days`` days.

    One series' wrong clock cannot empty the others, and a series that fell
    silent keeps its last days. ``ends`` (one row a series) may be given where
    several ranges of the same data are asked for, or where they are stored
    (``readers.load_ends``). On data stored by day, given ends bound the scan to
    the days that some series asks for, so that one that has been silent for
    years opens its own last days and not those between; ends that must be found
    first bound it by the earliest.
    """
    if days <= 0:
        raise ValueError("days must be positive")
    given, ends = ends is not None, series_ends(df, ts, keys, as_of) if ends is None else ends
    if FECHA in df.columns and given:
        asked = [F.col(FECHA).between(F.lit(a), F.lit(b)) for a, b in day_spans(ends, days)]
        df = df.where(functools.reduce(operator.or_, asked, F.lit(False)))
    elif FECHA in df.columns:
        first = ends.agg(F.to_date(days_before(F.min(END), days)).alias("first")).scalar()
        df = df.where(F.col(FECHA) >= first)
    kept = df.join(ends, list(keys)).where(
        (F.col(ts) > days_before(F.col(END), days)) & (F.col(ts) <= F.col(END))
    )
    return kept.select(*df.columns)


def daily(df: DataFrame, agg: Column, ts: str = SLOT, keys: Sequence[str] = KEYS) -> DataFrame:
    day = F.col(FECHA) if FECHA in df.columns else F.to_date(ts).alias(FECHA)
    return df.groupBy(*keys, day).agg(agg)


def energy_view(
    df: DataFrame,
    view: str,
    target: str = POWER,
    keys: Sequence[str] = KEYS,
    of: DataFrame | None = None,
    ends: DataFrame | None = None,
) -> DataFrame:
    """One of the five views of the energy history, in time order.

    Trailing views count back from ``ends``, or from those of ``of``, or of ``df`` itself.
    """
    if ends is None and of is not None and view in ("last7", "last30"):
        ends = series_ends(of, keys=keys)
    if view == "daily_mean":
        return daily(df, F.avg(target).alias(target), keys=keys).orderBy(FECHA, *keys)
    if view == "daily_max":
        return daily(df, F.max(target).alias(target), keys=keys).orderBy(FECHA, *keys)
    if view == "last7":
        df = recent_each(df, 7, keys=keys, ends=ends)
    elif view == "last30":
        df = recent_each(df, 30, keys=keys, ends=ends)
    elif view != "full":
        raise ValueError(f"view must be one of {ENERGY_VIEWS}")
    return df.select(*keys, SLOT, target).orderBy(SLOT, *keys)


def history_table(
    df: DataFrame,
    start: str | dt.date | None = None,
    end: str | dt.date | None = None,
    hours: tuple[int, int] | None = None,
    columns: Sequence[str] = (POWER,),
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """Filtered history in time order; give both ends of the dates or neither."""
    if (start is None) != (end is None):
        raise ValueError("give both start and end, or neither")
    rows = df if start is None else filter_dates(df, start, end)
    if hours is not None:
        rows = filter_hours(rows, *hours)
    return rows.select(*keys, SLOT, *columns).orderBy(SLOT, *keys)


def climate_series(df: DataFrame, variable: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """One weather variable as ``valor``."""
    if variable not in WEATHER or variable not in df.columns:
        raise ValueError(f"{variable!r} is no weather variable of this data")
    return df.select(*keys, SLOT, F.col(variable).alias("valor"))


def climate_table(
    df: DataFrame,
    variable: str,
    start: str | dt.date,
    end: str | dt.date,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    return climate_series(filter_dates(df, start, end), variable, keys).orderBy(SLOT, *keys)


def forecast_table(forecast: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return forecast.select(*keys, SLOT, "prediccion", "modo").orderBy(SLOT, *keys)


def history_vs_forecast(
    history: DataFrame,
    forecast: DataFrame,
    days: int,
    target: str = POWER,
    keys: Sequence[str] = KEYS,
    ends: DataFrame | None = None,
) -> DataFrame:
    """Recent history and forecast as one long series, told apart by ``serie``."""
    past = recent_each(history, days, keys=keys, ends=ends).select(
        *keys, SLOT, F.col(target).alias("valor"), F.lit("historico").alias("serie")
    )
    future = forecast.select(
        *keys, SLOT, F.col("prediccion").alias("valor"), F.lit("prediccion").alias("serie")
    )
    return past.unionByName(future)


def summary(df: DataFrame, target: str = POWER, ts: str = SLOT) -> DataFrame:
    """Records, first and last time and highest value, in one pass."""
    return df.agg(
        F.count(F.lit(1)).alias("total_registros"),
        F.min(ts).alias("fecha_inicial"),
        F.max(ts).alias("fecha_final"),
        F.max(target).alias("valor_maximo"),
    )
