"""ARIMA(p, d, q) over many series, by two-stage regression.

A long autoregression gives the innovations, a second regression on lagged
values and lagged innovations gives the model (Hannan and Rissanen, 1982).
Innovations are linear in the lags, so the products of all lags, summed in one
pass over the data, serve both regressions. Series are cut into blocks with
copied edges: tasks reduce blocks of bounded size, however long a series is.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heliospark.functions.timegrid import from_epoch, seconds_of, wall_seconds
from heliospark.models.linear import combine, products_schema, solve_normal
from heliospark.operators.lags import halo_blocks
from heliospark.operators.views import recent_each
from heliospark.schema import KEYS, POWER, SLOT, STEP

BLOCK_SLOTS = 4096
#: Modulus up to which a root of the autoregression counts as stable.
STABLE_ROOT = 0.999


@dataclass(frozen=True)
class ArimaOrder:
    p: int
    d: int
    q: int
    long_ar: int = 20
    step: str = STEP

    def __post_init__(self):
        if min(self.p, self.d, self.q) < 0 or self.p + self.q == 0:
            raise ValueError("orders must be non-negative and p + q positive")
        if self.q and self.long_ar < max(self.p, self.q):
            raise ValueError("long_ar must be at least max(p, q)")

    @property
    def lags(self) -> int:
        return self.q + self.long_ar if self.q else self.p

    @property
    def memory(self) -> int:
        """Slots before a row that its regression row reaches back to."""
        return self.d + self.lags


def _indexed(df: DataFrame, target: str, order: ArimaOrder, keys: Sequence[str]) -> DataFrame:
    seconds = seconds_of(order.step)
    index = F.floor(wall_seconds() / seconds)
    return df.select(*keys, index.alias("_i"), F.col(target).cast("double").alias("_y")).dropna()


def _block_products(keys: Sequence[str], order: ArimaOrder, block_slots: int):
    """Reduce a block to the products of (1, w, w one slot before, and so on)."""
    lags = order.lags

    def reduce(group: pd.DataFrame) -> pd.DataFrame:
        index = group["_i"].to_numpy()
        first = index.min()
        w = np.full(index.max() - first + 1, np.nan)
        w[index - first] = group["_y"].to_numpy()
        for _ in range(order.d):
            w = np.diff(w)
            first += 1
        start = int(group["_block"].iloc[0]) * block_slots
        products = np.zeros((lags + 2, lags + 2))
        rows = 0
        if len(w) > lags:
            windows = np.lib.stride_tricks.sliding_window_view(w, lags + 1)
            whole = ~np.isnan(windows).any(axis=1)
            # Rows of the copied edge belong to the block before.
            whole &= np.arange(len(windows)) + first + lags >= start
            x = windows[whole][:, ::-1]
            rows = len(x)
            x = np.hstack([np.ones((rows, 1)), x])
            products = x.T @ x
        out = {k: [group[k].iloc[0]] for k in keys}
        return pd.DataFrame({**out, "n": [rows], "products": [products.ravel().tolist()]})

    return reduce


def _two_stages(products: np.ndarray, order: ArimaOrder) -> tuple[np.ndarray, np.ndarray, bool]:
    """The long autoregression and the model, from one series' products, and whether both are the only ones."""
    size = len(products)
    unit = np.eye(size)
    # Variable 0 is the constant, 1 + k the value k slots before.
    ar, unique = np.empty(0), True
    innovations = []
    if order.q:
        past = [0, *range(2, 2 + order.long_ar)]
        ar, unique = solve_normal(products[np.ix_(past, past)], products[past, 1])
        for j in range(1, order.q + 1):
            e = unit[1 + j] - ar[0] * unit[0]
            for k in range(1, order.long_ar + 1):
                e = e - ar[k] * unit[1 + j + k]
            innovations.append(e)
    terms = np.array([unit[0], *[unit[1 + k] for k in range(1, order.p + 1)], *innovations])
    coef, only = solve_normal(terms @ products @ terms.T, terms @ products[:, 1])
    return ar, coef, unique and only


def largest_root(phi: np.ndarray) -> float:
    """Modulus of the largest root of the autoregression: below one if what is forecast dies down."""
    if not len(phi):
        return 0.0
    companion = np.eye(len(phi), k=-1)
    companion[0] = phi
    return float(np.abs(np.linalg.eigvals(companion)).max())


def _settled(coef: np.ndarray, p: int, mean: float) -> tuple[np.ndarray, bool]:
    """The coefficients with all roots within ``STABLE_ROOT``, and whether they were so.

    Roots are drawn in by one factor; the constant is set anew, so that the
    forecast tends to the series' mean.
    """
    root = largest_root(coef[1 : 1 + p])
    if root <= STABLE_ROOT:
        return coef, True
    settled = coef.copy()
    settled[1 : 1 + p] *= (STABLE_ROOT / root) ** np.arange(1, p + 1)
    settled[0] = mean * (1 - settled[1 : 1 + p].sum())
    return settled, False


def fit_arima(
    df: DataFrame,
    p: int,
    d: int,
    q: int,
    target: str = POWER,
    keys: Sequence[str] = KEYS,
    long_ar: int = 20,
    step: str = STEP,
    block_slots: int = BLOCK_SLOTS,
) -> DataFrame:
    """One row per series: ``n``, ``const``, ``phi``, ``theta``, ``ar``, ``unique`` and ``stable``.

    ``ar`` holds the long autoregression, constant first; it is empty when q is
    0. Slots next to a gap, which lack a full set of lags, are left out. A series
    that has fewer such slots than coefficients has NULL coefficients.

    Where the lags don't determine the coefficients (a noise-free series), they
    are the smallest ones that fit, and ``unique`` is false. A fit whose forecast
    would grow or never die down (a unit root) has ``stable`` false; its ``phi``
    is drawn in to roots of ``STABLE_ROOT``, so that forecasts stay bounded and
    tend to the series' mean.
    """
    order = ArimaOrder(p, d, q, long_ar, step)
    block_slots = max(block_slots, order.memory)
    blocks = halo_blocks(_indexed(df, target, order, keys), "_i", block_slots, order.memory)
    reduced = (
        blocks.select(*keys, "_block", "_i", "_y")
        .groupBy(*keys, "_block")
        .applyInPandas(
            _block_products([*keys], order, block_slots), products_schema(blocks, keys)
        )
    )
    series = combine(reduced, keys)

    @F.pandas_udf("ar array<double>, coef array<double>, unique boolean, stable boolean")
    def fit(products: pd.Series) -> pd.DataFrame:
        side = order.lags + 2
        out = []
        for m in products:
            sums = np.asarray(m).reshape(side, side)
            ar, coef, unique = _two_stages(sums, order)
            coef, stable = _settled(coef, order.p, sums[0, 1] / sums[0, 0])
            out.append((ar.tolist(), coef.tolist(), unique, stable))
        return pd.DataFrame(out, columns=["ar", "coef", "unique", "stable"])

    enough = series.where(F.col("n") > order.lags + 1).withColumn("_fit", fit("products"))
    fitted = enough.select(*keys, "_fit")
    every = df.select(*keys).distinct().join(series.select(*keys, "n"), list(keys), "left")
    return every.join(fitted, list(keys), "left").select(
        *keys,
        F.coalesce("n", F.lit(0.0)).cast(series.schema["n"].dataType).alias("n"),
        F.col("_fit.coef")[0].alias("const"),
        F.slice("_fit.coef", 2, p).alias("phi"),
        F.slice("_fit.coef", 2 + p, q).alias("theta"),
        "_fit.ar",
        "_fit.unique",
        "_fit.stable",
    )


def _tail(df: DataFrame, target: str, order: ArimaOrder, keys: Sequence[str]) -> DataFrame:
    """The last slots of each series, as many as the recursion starts from."""
    needed = order.memory + 1
    days = 1 + -(-needed * seconds_of(order.step) // 86400)
    rows = _indexed(recent_each(df, days, keys=keys), target, order, keys)
    last = rows.groupBy(*keys).agg(F.max("_i").alias("_last"))
    return rows.join(last, list(keys)).where(F.col("_i") > F.col("_last") - needed)


def _recursion(tail: pd.DataFrame, order: ArimaOrder, steps: int) -> np.ndarray:
    """Forecast of one series from its last values."""
    first = tail.iloc[0]
    span = np.arange(int(tail["_i"].min()), int(first["_last"]) + 1)
    # A slot missing from the tail takes the value before it.
    y = tail.set_index("_i")["_y"].reindex(span).ffill().to_numpy()
    levels = [y]
    for _ in range(order.d):
        levels.append(np.diff(levels[-1]))
    w = list(levels[-1])
    phi, theta, ar = (np.asarray(first[c], dtype=float) for c in ("phi", "theta", "ar"))
    innovations = [0.0] * order.q
    if order.q and len(w) >= order.long_ar:
        for t in range(order.long_ar, len(w)):
            past = np.asarray(w[t - order.long_ar : t])[::-1]
            innovations.append(w[t] - ar[0] - ar[1:] @ past)
    w = [0.0] * max(order.p - len(w), 0) + w
    out = []
    for _ in range(steps):
        value = first["const"]
        for k in range(order.p):
            value += phi[k] * w[-1 - k]
        for k in range(order.q):
            value += theta[k] * innovations[-1 - k]
        w.append(value)
        innovations.append(0.0)
        out.append(value)
    path = np.asarray(out)
    for level in reversed(levels[:-1]):
        path = level[-1] + np.cumsum(path)
    return path


def forecast_arima(
    history: DataFrame,
    model: DataFrame,
    order: ArimaOrder,
    steps: int | None = None,
    target: str = POWER,
    keys: Sequence[str] = KEYS,
    until: dt.datetime | DataFrame | None = None,
) -> DataFrame:
    """The next slots of each series as ``prediccion``: ``steps`` of them, or all up to ``until``.

    ``until`` is one time, or a table of keys and ``until`` with one for each
    series. Series without coefficients have no rows.
    """
    if (steps is None) == (until is None):
        raise ValueError("give either steps or until")
    seconds = seconds_of(order.step)
    keyed = _tail(history, target, order, keys).join(
        model.where(F.col("const").isNotNull()).select(*keys, "const", "phi", "theta", "ar"), list(keys)
    )
    if isinstance(until, DataFrame):
        stop = until.select(*keys, F.floor(wall_seconds("until") / seconds).alias("_stop"))
        keyed = keyed.join(stop, list(keys))
    elif until is not None:
        keyed = keyed.withColumn("_stop", F.lit(int((until - dt.datetime(1970, 1, 1)).total_seconds()) // seconds))
    fields = [keyed.schema[k] for k in keys]
    schema = T.StructType(
        [*fields, T.StructField("_i", T.LongType()), T.StructField("prediccion", T.DoubleType())]
    )

    until_given = until is not None

    def extend(group: pd.DataFrame) -> pd.DataFrame:
        ordered = group.sort_values("_i")
        first = ordered.iloc[0]
        ahead = max(0, int(first["_stop"]) - int(first["_last"])) if until_given else steps
        path = _recursion(ordered, order, ahead)
        out = pd.DataFrame({"_i": int(first["_last"]) + 1 + np.arange(ahead), "prediccion": path})
        for k in keys:
            out[k] = first[k]
        return out

    paths = keyed.groupBy(*keys).applyInPandas(extend, schema)
    slot = from_epoch(F.col("_i") * seconds)
    return paths.select(*keys, slot.alias(SLOT), "prediccion")
