"""Exact top-k by no-random-access aggregation over sorted lists.

Candidates are dealt into groups and, inside a task, into blocks. A block has
one list for each dimension, sorted by component. For a positive query
component its list is read from the top, for a negative one from the bottom.
All lists are read in step, run by run, for a block of queries at once: what
has been read gives each candidate a lower bound (what is unread is as bad as
the list's far end) and an upper bound (as good as the list's frontier), each
a product of two matrices. Candidates whose upper bound falls below the k-th
best lower bound, of this or of earlier blocks, cannot qualify. Reading stops
when few are left, and only their scores are resolved.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Candidates of a block, queries of a block, and candidates of a group at most on average.
BLOCK, QUERIES, GROUP = 4096, 512, 1 << 16
#: Shares of each list that have been read after each run; and how few candidates a query may leave to resolve.
RUNS = (0.5, 0.8, 0.95, 1.0)
FEW = 4


def integer_components(vector: Column, factor: int) -> Column:
    """floor(factor * x) of each component; NULL for vectors that are NULL or hold NULL, NaN or infinity."""
    sound = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    return F.when(sound, F.transform(vector, lambda x: F.floor(F.lit(float(factor)) * x.cast("double"))))


class _Block:
    """Sorted lists of up to BLOCK candidates."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray) -> None:
        self.ids, self.rows = ids, rows
        self.order = np.argsort(rows, axis=0, kind="stable")
        self.values = np.take_along_axis(rows, self.order, axis=0)

    def bounds(self, queries: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of all scores after reading that share of every list."""
        n = len(self.ids)
        depth = min(n, int(np.ceil(share * n)))
        high, low = np.maximum(queries, 0), np.minimum(queries, 0)
        known_up, known_down = self.rows, self.rows
        worst_up, worst_down = self.values[0], self.values[-1]
        if depth == n:
            exact = queries @ self.rows.T
            return exact, exact
        front_up, front_down = self.values[n - depth], self.values[depth - 1]
        # Unread entries lie between the frontier and the far end of their list.
        best_up, best_down = np.maximum(known_up, front_up), np.minimum(known_down, front_down)
        least_up = np.where(known_up >= front_up, known_up, worst_up)
        least_down = np.where(known_down <= front_down, known_down, worst_down)
        return high @ least_up.T + low @ least_down.T, high @ best_up.T + low @ best_down.T

    def best(self, query_ids: np.ndarray, queries: np.ndarray, k: int, floor: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each query: candidates that may be among its k best, and their exact scores.

        ``floor``: a score that k candidates of earlier blocks reach.
        """
        own = query_ids[:, None] == self.ids[None, :]
        for share in RUNS:
            low, high = self.bounds(queries, share)
            low = np.where(own, -np.inf, low)
            if len(self.ids) > k:
                floor = np.maximum(floor, -np.partition(-low, k - 1, axis=1)[:, k - 1])
            left = (high >= floor[:, None]) & ~own
            if share == 1.0 or left.sum() <= FEW * k * len(queries):
                break
        for i in range(len(queries)):
            who = np.flatnonzero(left[i])
            yield i, self.ids[who], self.rows[who] @ queries[i]


def _merge(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    keep = np.lexsort((ids, -scores))[:k]
    return ids[keep], scores[keep]


def _searched(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by (part, kind): a part's candidates, then its queries."""
        part, blocks, ids, rows, asked, asked_rows = None, [], [], [], [], []
        out: list[pa.RecordBatch] = []

        def shut() -> None:
            if ids:
                blocks.append(_Block(np.array(ids, dtype=np.int64), _matrix(rows)))
                ids.clear()
                rows.clear()

        def answer() -> None:
            if asked and blocks:
                out.extend(_answers(np.array(asked, dtype=np.int64), asked_rows, blocks, k))
            asked.clear()
            asked_rows.clear()

        for batch in batches:
            for p, kind, i, row in zip(*(batch[c].to_pylist() for c in ("part", "kind", "id")), batch["ints"].to_pylist(), strict=True):
                if p != part:
                    answer()
                    part, blocks = p, []
                    ids.clear()
                    rows.clear()
                if kind == 0:
                    ids.append(i)
                    rows.append(row)
                    if len(ids) == BLOCK:
                        shut()
                else:
                    shut()
                    asked.append(i)
                    asked_rows.append(row)
                    if len(asked) == QUERIES:
                        answer()
            yield from out
            out.clear()
        answer()
        yield from out

    return run


def _matrix(rows: list[list[int]], width: int | None = None) -> np.ndarray:
    """Rows of equal or unequal length as a matrix; missing components are zero."""
    width = max(map(len, rows)) if width is None else width
    if all(len(r) == width for r in rows):
        return np.array(rows, dtype=np.float64).reshape(len(rows), width)
    full = np.zeros((len(rows), width))
    for at, row in enumerate(rows):
        full[at, : len(row)] = row[:width]
    return full


def _answers(asked: np.ndarray, asked_rows: list[list[int]], blocks: list[_Block], k: int) -> Iterator[pa.RecordBatch]:
    found = [(np.zeros(0, np.int64), np.zeros(0))] * len(asked)
    floor = np.full(len(asked), -np.inf)
    for block in blocks:
        queries = _matrix(asked_rows, block.rows.shape[1])
        biggest = np.abs(queries).max(initial=0) * np.abs(block.rows).max(initial=0) * max(1, queries.shape[1])
        if biggest >= 2**53:
            raise ValueError("components are too large for exact scores in double precision")
        for i, ids, scores in block.best(asked, queries, k, floor):
            found[i] = _merge(np.concatenate([found[i][0], ids]), np.concatenate([found[i][1], scores]), k)
            if len(found[i][0]) == k:
                floor[i] = found[i][1][-1]
    sizes = [len(f[0]) for f in found]
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.repeat(asked, sizes)), pa.array(np.concatenate([f[0] for f in found]).astype(np.int64)), pa.array(np.concatenate([f[1] for f in found]).astype(np.int64))],
        ["query_id", "vec_id", "score"],
    )


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding", factor: int = 64, group: int = GROUP) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates of each query, all others being candidates.

    Scores are inner products of floor(factor * component), exact below 2^53
    (beyond that an error). Ties go to the smaller key. Rows without a key and
    vectors that are NULL or hold NULL or non-finite components take no part;
    of rows that repeat a key the greatest vector counts; vectors of unequal
    length are taken as zero beyond their end. ``is_query`` is an expression on
    the key. Each group of candidates sees all queries in blocks: what is
    shuffled is the candidates once and the queries once for each group.
    """
    ints = vectors.select(F.col(key).cast("long").alias("id"), integer_components(F.col(vector), factor).alias("ints")).where("id is not null and ints is not null")
    rows = ints.groupBy("id").agg(F.max("ints").alias("ints"))
    spark = vectors.sparkSession
    parts = max(2 * spark.sparkContext.defaultParallelism, -(-vectors.count() // group))
    part = F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")
    candidates = rows.select(part.alias("part"), F.lit(0).alias("kind"), "id", "ints")
    asked = rows.where(is_query)
    queries = asked.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(1).alias("kind"), "id", "ints")
    dealt = candidates.unionByName(queries).repartition(parts, "part").sortWithinPartitions("part", "kind")
    found = dealt.mapInArrow(_searched(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
