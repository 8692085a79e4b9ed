"""Connected components of a graph of long ids, by alternating large and small stars.

Kiveris et al., "Connected Components in MapReduce and Beyond" (SoCC 2014).
Each round is a table in the shared folder: lineage stays short and lost
executors cost a re-read. Neither edges nor components reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliospark.llm.common import stage

#: Edges of a file that a round writes; a round's files follow its edges, not the number of partitions.
EDGES = 1 << 18


def _to_least(nodes: DataFrame) -> DataFrame:
    """(u, v) with the least id m of u and its v."""
    least = nodes.groupBy("u").agg(F.min("v").alias("m"))
    return nodes.join(least.select("u", F.least("u", "m").alias("m")), "u")


def _large(edges: DataFrame) -> DataFrame:
    """Each node ties its larger neighbours to the least node around it."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    tied = _to_least(both).where("v > u")
    return tied.select(F.col("v").alias("a"), F.col("m").alias("b"))


def _small(edges: DataFrame) -> DataFrame:
    """Each node ties itself and its smaller neighbours to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    tied = _to_least(down)
    return tied.select(F.explode(F.array(F.struct(F.col("u").alias("a"), F.col("m").alias("b")), F.struct(F.col("v").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")


def _round(edges: DataFrame, n: int) -> DataFrame:
    """The next round of ``n`` edges, which gives twice as many at most."""
    done = _small(_large(edges).where("a <> b").distinct())
    return stage(done.where("a <> b").distinct().coalesce(1 + n // EDGES), "star")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of ``edges`` (a, b) that isn't its own root; root is the least id.

    Loops and repeated edges do no harm; edges with NULL are left out.
    """

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    edges = edges.where("a <> b").select(F.col("a").cast("long"), F.col("b").cast("long")).distinct()
    now = stage(edges, "star")
    seen = mark(now)
    while seen[0]:
        now = _round(now, seen[0])
        was, seen = seen, mark(now)
        if was == seen:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
