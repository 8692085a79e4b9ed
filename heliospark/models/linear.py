"""Least squares per series from summed products.

Each task sorts its own rows by series, sums the products of every pair of
terms in Arrow batches, and passes on one small matrix per series: rows are
never shuffled, however long a series is. The remaining systems, one per series, are solved in
Arrow batches too.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Shares into which the matrices of a series are added up first.
FAN = 64
#: Share of the greatest eigenvalue below which a direction counts as not observed.
RANK_TOLERANCE = 1e-12


def products_schema(rows: DataFrame, keys: Sequence[str]) -> T.StructType:
    return T.StructType(
        [
            *[rows.schema[k] for k in keys],
            T.StructField("n", T.LongType()),
            T.StructField("products", T.ArrayType(T.DoubleType())),
        ]
    )


def moments(rows: DataFrame, keys: Sequence[str], terms: Column, size: int) -> DataFrame:
    """Per key: ``n`` and ``products``, the upper triangle of the terms' products, row by row.

    ``terms`` is an array of ``size`` values, the explained one last; rows
    where one is NULL are left out whole.
    """
    z = rows.select(*keys, terms.alias("_z"))
    total = F.col("_z")[0]
    for i in range(1, size):
        total = total + F.col("_z")[i]
    # A sum is NULL as soon as one of its terms is.
    whole = z.where(total.isNotNull())
    names = [*keys]

    upper = np.triu_indices(size)

    def matrix_of(key: tuple, n: int, sums: np.ndarray, types: list[pa.DataType]) -> pa.RecordBatch:
        columns = [pa.array([k], kind) for k, kind in zip(key, types)]
        columns += [pa.array([n], pa.int64()), pa.array([sums[upper]], pa.list_(pa.float64()))]
        return pa.RecordBatch.from_arrays(columns, [*names, "n", "products"])

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A task's rows come series by series, so that one matrix is held at a time."""
        key, n, sums, types = None, 0, None, []
        for batch in batches:
            types = [batch.schema.field(k).type for k in names]
            matrix = batch.column("_z").flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
            ids = batch.select(names).to_pandas()
            new = np.ones(len(ids), dtype=bool)
            new[1:] = ~((ids == ids.shift()) | (ids.isna() & ids.shift().isna())).all(axis=1).to_numpy()[1:]
            starts = np.flatnonzero(new).tolist()
            for start, end in zip(starts, [*starts[1:], len(ids)]):
                here = tuple(batch.column(k)[start].as_py() for k in names)
                if here != key:
                    if n:
                        yield matrix_of(key, n, sums, types)
                    key, n, sums = here, 0, np.zeros((size, size))
                part = matrix[start:end]
                n, sums = n + len(part), sums + part.T @ part
        if n:
            yield matrix_of(key, n, sums, types)

    # Rows come in any order, too; one order of theirs gives one sum.
    in_order = whole.withColumn("_total", total).sortWithinPartitions(*names, "_total").drop("_total")
    return combine(in_order.mapInArrow(reduce, products_schema(rows, keys)), keys)


def combine(partial: DataFrame, keys: Sequence[str], fan: int = FAN) -> DataFrame:
    """Add up matrices of the same series, of which there may be one for each task or block.

    First within ``fan`` shares of the tasks that made them, then over the
    shares, so that no group receives a matrix from every task.
    """

    def add(group: pa.Table) -> pa.Table:
        flat = group["products"].combine_chunks().flatten().to_numpy()
        # Matrices come in any order; sums of sorted numbers are the same whatever it is.
        total = np.sort(flat.reshape(group.num_rows, -1), axis=0).sum(axis=0)
        columns = [group[k].slice(0, 1) for k in keys]
        columns += [pa.array([sum(group["n"].to_pylist())], pa.int64()), pa.array([total], group.schema.field("products").type)]
        return pa.table(columns, names=[*keys, "n", "products"])

    ordered = partial.select(*keys, "n", "products")
    share = F.pmod(F.spark_partition_id(), F.lit(fan)).alias("_share")
    first = ordered.select("*", share).groupBy(*keys, "_share").applyInArrow(lambda g: add(g.drop_columns(["_share"])), ordered.schema)
    return first.groupBy(*keys).applyInArrow(add, ordered.schema)


def solve_normal(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, bool]:
    """Solution of normal equations, and whether it is the only one.

    The rank is that of the matrix scaled to a unit diagonal: eigenvalues below
    ``RANK_TOLERANCE`` of the greatest count as zero. Without full rank, the
    solution is the smallest one in the scaled terms, which no rounding sways.
    """
    scale = np.sqrt(np.where(np.diag(a) > 0, np.diag(a), 1.0))
    values, vectors = np.linalg.eigh(a / np.outer(scale, scale))
    kept = values > RANK_TOLERANCE * max(values[-1], 0.0)
    if len(values) and kept.all():
        return np.linalg.solve(a, b), True
    basis = vectors[:, kept]
    return (basis @ ((basis.T @ (b / scale)) / values[kept])) / scale, False


def solve(sums: DataFrame, keys: Sequence[str], size: int, ridge: Sequence[float] | None = None) -> DataFrame:
    """Per key: ``n``, ``coef`` of the first ``size`` terms, and ``sigma2``.

    ``ridge`` adds n times its value to each diagonal entry. A system without a
    unique solution gets the smallest one.
    """
    penalty = np.zeros(size) if ridge is None else np.asarray(ridge, dtype=float)

    @F.pandas_udf("coef array<double>, sigma2 double")
    def fit(n: pd.Series, products: pd.Series) -> pd.DataFrame:
        coefs, variances = [], []
        for count, flat in zip(n, products):
            full = np.zeros((size + 1, size + 1))
            full[np.triu_indices(size + 1)] = flat
            full = np.triu(full) + np.triu(full, 1).T
            a = full[:size, :size] + np.diag(penalty * count)
            b = full[:size, size]
            beta, _ = solve_normal(a, b)
            sse = full[size, size] - 2 * beta @ b + beta @ full[:size, :size] @ beta
            coefs.append(beta.tolist())
            variances.append(max(sse, 0.0) / max(count - size, 1))
        return pd.DataFrame({"coef": coefs, "sigma2": variances})

    fitted = sums.withColumn("_fit", fit("n", "products"))
    return fitted.select(*keys, "n", "_fit.coef", "_fit.sigma2")


def least_squares(
    rows: DataFrame,
    keys: Sequence[str],
    xs: Sequence[Column],
    y: Column,
    ridge: Sequence[float] | None = None,
) -> DataFrame:
    sums = moments(rows, keys, F.array(*xs, y), len(xs) + 1)
    return solve(sums, keys, len(xs), ridge)


def dot(coef: Column, xs: Sequence[Column]) -> Column:
    """Sum of coefficient times term, as one expression."""
    total = coef[0] * xs[0]
    for i, x in enumerate(xs[1:], start=1):
        total = total + coef[i] * x
    return total
