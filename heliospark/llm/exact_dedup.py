"""Exact duplicates by a heavy-hitter split, with DataFrame and SQL functions only.

A Misra-Gries type sketch (Spark's ``approx_top_k``, merged over partitions)
names the digests that may be frequent. Their exact counts and winners come
from one aggregate with a partial step; these few rows are broadcast, so that
no copy of a frequent text is shuffled. The other digests are shuffled as
usual: none of them is frequent enough to fill a task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heliospark.llm.common import ascii_lower, stage

#: Digests that may be broadcast at most: 1,024 rows of about 100 bytes.
HEAVY_ITEMS = 1024
#: Counters of the sketch; a digest with over rows / 2,340 copies is always found.
TRACKED = 8192


def mark_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", heavy: int = HEAVY_ITEMS, tracked: int = TRACKED) -> DataFrame:
    """One row for each row of ``docs``: key, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; NULL counts as empty.
    The row with the largest key stays; of rows that repeat it exactly one
    (any, they are alike), and a NULL key loses to all others. If all keys of a
    group are NULL, one row stays and keep_id is NULL. An empty table gives an
    empty result. Other columns of ``docs`` are not read.
    """
    digest = F.sha2(ascii_lower(F.coalesce(F.col(text), F.lit(""))).cast("binary"), 256)
    # Stored, so that the text is read once and row numbers stay the same.
    rows = stage(docs.select(F.col(key).alias("key"), digest.alias("digest"), F.monotonically_increasing_id().alias("row")), "digests")

    best = F.max(F.struct("key", "row"))
    frequent = rows.agg(F.expr(f"approx_top_k(digest, {heavy}, {tracked})").alias("top")).select(F.explode("top.item").alias("digest"))
    # At most `heavy` rows: the sketch returns no more.
    verified = rows.join(F.broadcast(frequent), "digest", "left_semi").groupBy("digest").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size"))
    winners = stage(verified.where(F.col("group_size") > 1), "heavy-digests")

    hot = rows.join(F.broadcast(winners), "digest")
    group = Window.partitionBy("digest")
    rest = rows.join(F.broadcast(winners.select("digest")), "digest", "left_anti").select(
        "digest", "key", "row", best.over(group).alias("best"), F.count(F.lit(1)).over(group).alias("group_size")
    )
    return hot.select(*rest.columns).unionByName(rest).select(
        F.col("key").alias(key),
        F.col("best.key").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("best.row")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )
