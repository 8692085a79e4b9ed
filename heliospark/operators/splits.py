"""Time-ordered validation: holdout, expanding and sliding origin."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliospark.functions.timegrid import days_after, days_before, wall_seconds
from heliospark.operators.views import series_ends
from heliospark.schema import END, FECHA, KEYS, SLOT

STRATEGIES = ("holdout", "expanding", "sliding")

_DAY = 86400


def _time(value: str | dt.datetime):
    text = value if isinstance(value, str) else value.isoformat(sep=" ")
    return F.lit(text).cast("timestamp_ntz")


def now() -> dt.datetime:
    """The present, beyond which no reading can lie."""
    return dt.datetime.now().replace(microsecond=0)


def split_time(df: DataFrame, cutoff: str | dt.datetime, ts: str = SLOT) -> tuple[DataFrame, DataFrame]:
    """Rows before the cutoff, and the rest."""
    bound = _time(cutoff)
    before, after = df.where(F.col(ts) < bound), df.where(F.col(ts) >= bound)
    if FECHA in df.columns:
        before = before.where(F.col(FECHA) <= F.to_date(bound))
        after = after.where(F.col(FECHA) >= F.to_date(bound))
    return before, after


def folds(
    df: DataFrame,
    k: int,
    h: int,
    mode: str = "expanding",
    window_days: int = 60,
    ts: str = SLOT,
    keys: Sequence[str] = KEYS,
    ends: DataFrame | None = None,
    as_of: dt.datetime | None = None,
) -> DataFrame:
    """Each row once per fold it serves, with ``fold``, ``origin`` and ``rol``.

    The last ``k`` blocks of ``h`` days of each series, counted back from its own
    end, are the test sets of folds 1 to k. What lies up to a fold's origin
    trains it: all of it when expanding, the last ``window_days`` when sliding.
    The end of a series is its latest slot up to ``as_of`` (now, if not given):
    rows beyond it, which a wrong clock wrote, serve no fold. Membership is
    arithmetic on the row's age; what is joined is one row a series (``ends``,
    if at hand), and a row yields at most ``k`` rows.
    """
    if mode not in ("expanding", "sliding"):
        raise ValueError("mode must be 'expanding' or 'sliding'")
    if k < 1 or h < 1:
        raise ValueError("k and h must be positive")
    ends = series_ends(df, ts, keys, as_of or now()) if ends is None else ends
    if FECHA in df.columns:
        # One series' days bound the scan for all; the join tells them apart.
        df = df.where(F.col(FECHA) <= ends.agg(F.to_date(F.max(END))).scalar())
        if mode == "sliding":
            back = ends.agg(F.to_date(days_before(F.min(END), k * h + window_days))).scalar()
            df = df.where(F.col(FECHA) >= back)
    dated = df.join(ends, list(keys)).where(F.col(ts) <= F.col(END))
    age = wall_seconds(END) - wall_seconds(ts)
    own = F.lit(k) - F.floor(age / (h * _DAY))
    served = F.sequence(F.greatest(own, F.lit(1)).cast("int"), F.lit(k))
    rows = dated.select("*", own.alias("_own"), F.explode(served).alias("fold"))
    back = F.make_dt_interval(days=(F.lit(k) - F.col("fold") + 1) * h)
    rows = rows.withColumn("origin", F.col(END) - back)
    is_test = F.col("fold") == F.col("_own")
    if mode == "sliding":
        start = F.col("origin") - F.expr(f"interval {int(window_days)} days")
        rows = rows.where(is_test | (F.col(ts) > start))
    return rows.withColumn("rol", F.when(is_test, "test").otherwise("train")).select(
        *df.columns, "fold", "origin", "rol"
    )


def fold_table(
    ends: DataFrame,
    k: int,
    h: int,
    strategies: Sequence[str] = STRATEGIES,
    window_days: int = 60,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """The bounds of :func:`folds` as rows: one for each series, strategy and fold.

    (keys, strategy, fold, train_from, origin, test_to); training is
    (train_from, origin], or up to the origin where train_from is NULL, and test
    is (origin, test_to]. The holdout has one fold, the last.
    """
    unknown = set(strategies) - set(STRATEGIES)
    if unknown:
        raise ValueError(f"unknown strategies {sorted(unknown)}")
    if k < 1 or h < 1:
        raise ValueError("k and h must be positive")
    plan = [
        F.struct(
            F.lit(s).alias("strategy"),
            F.lit(number).alias("fold"),
            F.lit(h * ((1 if s == "holdout" else k) - number + 1)).alias("_back"),
            F.lit(s == "sliding").alias("_window"),
        )
        for s in strategies
        for number in range(1, (1 if s == "holdout" else k) + 1)
    ]
    rows = ends.select(*keys, END, F.inline(F.array(*plan)))
    origin = F.col(END) - F.make_dt_interval(days=F.col("_back"))
    return rows.select(
        *keys,
        "strategy",
        "fold",
        F.when(F.col("_window"), days_before(origin, window_days)).alias("train_from"),
        origin.alias("origin"),
        days_after(origin, h).alias("test_to"),
    )


@dataclass(frozen=True)
class Fold:
    """One fold: its bounds in each series (rows of a fold table), and the days that they span."""

    strategy: str
    number: int
    bounds: DataFrame
    train_day: dt.date | None
    origin_days: tuple[dt.date, dt.date]
    test_day: dt.date
    keys: tuple[str, ...] = KEYS

    def train(self, df: DataFrame, ts: str = SLOT) -> DataFrame:
        """Rows that train it. The days' bounds reach the scan of data stored by day."""
        if FECHA in df.columns:
            df = df.where(F.col(FECHA) <= F.lit(self.origin_days[1]))
            if self.train_day is not None:
                df = df.where(F.col(FECHA) >= F.lit(self.train_day))
        inside = (F.col(ts) <= F.col("origin")) & (
            F.col("train_from").isNull() | (F.col(ts) > F.col("train_from"))
        )
        return self._own(df).where(inside).select(*df.columns)

    def test(self, df: DataFrame, ts: str = SLOT) -> DataFrame:
        if FECHA in df.columns:
            df = df.where(F.col(FECHA).between(F.lit(self.origin_days[0]), F.lit(self.test_day)))
        inside = (F.col(ts) > F.col("origin")) & (F.col(ts) <= F.col("test_to"))
        return self._own(df).where(inside).select(*df.columns)

    def _own(self, df: DataFrame) -> DataFrame:
        return df.join(self.bounds.select(*self.keys, "train_from", "origin", "test_to"), [*self.keys])


def read_folds(table: DataFrame, keys: Sequence[str] = KEYS) -> list[Fold]:
    """The folds of a stored fold table; reads the days they span with one action."""
    spans = table.groupBy("strategy", "fold").agg(
        F.min(F.to_date("train_from")).alias("train_day"),
        F.min(F.to_date("origin")).alias("first"),
        F.max(F.to_date("origin")).alias("last"),
        F.max(F.to_date("test_to")).alias("test_day"),
    )
    out = []
    # One row for each strategy and fold.
    for r in spans.orderBy("strategy", "fold").collect():
        own = table.where((F.col("strategy") == r["strategy"]) & (F.col("fold") == r["fold"]))
        out.append(
            Fold(r["strategy"], r["fold"], own, r["train_day"], (r["first"], r["last"]), r["test_day"], tuple(keys))
        )
    return out
