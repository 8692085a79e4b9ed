"""Length buckets of least padding, and batches of a token budget inside each.

The global histogram of lengths (one aggregate; as many rows as there are
different lengths, which does not grow with the number of documents) goes to
the driver, where dynamic programming places the bucket boundaries. Batches
are cut from global positions: each bucket is ordered by 4,096 fixed shards of
the key, whose counts (a table of 4,096 rows a bucket at most) give each shard
its first position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heliospark.llm.common import WORD, stage

BUCKETS = 8
#: Padded tokens of a batch at most; a longer document is a batch of its own.
BUDGET = 65_536
_SHARD_DIGITS = 3  # hexadecimal: 16^3 shards


def boundaries(lengths: list[int], counts: list[int], buckets: int) -> list[int]:
    """The longest length of each bucket, ascending, such that the padding is least.

    ``lengths`` ascend. As many buckets as asked for, or as there are lengths.
    Of equally good boundaries the smaller wins, from the last bucket down.
    cost(i, j) = L_j (N_j - N_i) - (S_j - S_i) is a line in L_j for each i, so
    the best i for ascending j comes from a lower envelope: time buckets x lengths.
    """
    m = len(lengths)
    k = min(buckets, m)
    n, s = [0], [0]
    for length, count in zip(lengths, counts, strict=True):
        n.append(n[-1] + count)
        s.append(s[-1] + length * count)
    before: list[int | None] = [0] + [None] * m
    choices = []
    for t in range(1, k + 1):
        now: list[int | None] = [None] * (m + 1)
        choice = [0] * (m + 1)
        lines: list[tuple[int, int, int]] = []  # slope, intercept, i
        at = 0
        for j in range(t, m + 1):
            if before[j - 1] is not None:
                new = (-n[j - 1], before[j - 1] + s[j - 1], j - 1)
                while len(lines) - at >= 2 and _never_least(lines[-2], lines[-1], new):
                    lines.pop()
                lines.append(new)
            x = lengths[j - 1]
            while at + 1 < len(lines) and lines[at + 1][0] * x + lines[at + 1][1] < lines[at][0] * x + lines[at][1]:
                at += 1
            slope, intercept, i = lines[at]
            now[j] = slope * x + intercept + x * n[j] - s[j]
            choice[j] = i
        choices.append(choice)
        before = now
    ends, j = [], m
    for choice in reversed(choices):
        ends.append(lengths[j - 1])
        j = choice[j]
    return ends[::-1]


def _never_least(a: tuple[int, int, int], b: tuple[int, int, int], c: tuple[int, int, int]) -> bool:
    """Whether b lies above a or c everywhere; lines that meet in a point stay."""
    return (c[1] - a[1]) * (a[0] - b[0]) < (b[1] - a[1]) * (a[0] - c[0])


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", buckets: int = BUCKETS, budget: int = BUDGET, length: Column | None = None) -> DataFrame:
    """One row for each row of ``docs``: key, n_tokens, bucket, bucket_len, batch, slot.

    ``length`` (tokens of a row) defaults to the number of words; NULL and empty
    texts have none. bucket counts from 0; bucket_len is the padded length;
    batch counts from 0 within the bucket and holds budget / bucket_len
    documents, one at least; slot is the place in the batch. Rows without a key
    are spread by their text. An empty table gives an empty result.
    """
    tokens = word_count(F.col(text)) if length is None else F.coalesce(length, F.lit(0)).cast("long")
    spread = F.coalesce(F.col(key).cast("string"), F.col(text).cast("string"), F.lit(""))
    rows = stage(docs.select(F.col(key).alias("key"), tokens.alias("n"), F.substring(F.md5(spread.cast("binary")), 1, _SHARD_DIGITS).alias("shard")), "lengths")
    histogram = rows.groupBy("n").agg(F.count(F.lit(1)).alias("c")).orderBy("n").collect()
    ends = boundaries([r.n for r in histogram], [r.c for r in histogram], buckets) or [0]
    bucket = sum(((F.col("n") > end).cast("int") for end in ends[:-1]), F.lit(0))
    placed = rows.withColumn("bucket", bucket).withColumn("bucket_len", F.array(*[F.lit(e).cast("long") for e in ends])[F.col("bucket")])

    # 4,096 rows for each bucket at most, whatever the number of documents.
    counts = placed.groupBy("bucket", "shard").agg(F.count(F.lit(1)).alias("c")).toPandas().sort_values(["bucket", "shard"])
    counts["first"] = counts.groupby("bucket")["c"].cumsum() - counts["c"]
    offsets = docs.sparkSession.createDataFrame(counts[["bucket", "shard", "first"]], "bucket int, shard string, first long")
    within = Window.partitionBy("bucket", "shard").orderBy("key", "n")
    ranked = placed.withColumn("rank", F.row_number().over(within))
    position = F.col("first") + F.col("rank") - 1
    room = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(budget) / F.greatest("bucket_len", F.lit(1))).cast("long"))
    return ranked.join(F.broadcast(offsets), ["bucket", "shard"]).select(
        F.col("key").alias(key),
        F.col("n").alias("n_tokens"),
        "bucket",
        "bucket_len",
        F.floor(position / room).cast("long").alias("batch"),
        (position % room).cast("long").alias("slot"),
    )


def pack_sql(documents: str, buckets: int = BUCKETS, budget: int = BUDGET) -> str:
    """The same in DuckDB's SQL, with the dynamic programming over all pairs of boundaries."""
    steps = ["d0 AS (SELECT 0 AS j, 0::HUGEINT AS cost, 0::HUGEINT AS i)"]
    for t in range(1, buckets + 1):
        steps.append(
            f"""c{t} AS (SELECT b.j, min((a.cost + b.l::HUGEINT * (b.n - coalesce(p.n, 0)) - (b.s - coalesce(p.s, 0))) * 16777216 + a.j) AS best
  FROM d{t - 1} a JOIN h b ON a.j < b.j LEFT JOIN h p ON p.j = a.j GROUP BY b.j),
d{t} AS (SELECT j, best // 16777216 AS cost, best % 16777216 AS i FROM c{t})"""
        )
    steps.append(f"e{buckets + 1} AS (SELECT max(j)::HUGEINT AS j, least({buckets}, max(j)) AS k FROM h)")
    for t in range(buckets, 0, -1):
        steps.append(f"e{t} AS (SELECT CASE WHEN e.k >= {t} THEN d.i ELSE e.j END AS j, e.k, CASE WHEN e.k >= {t} THEN e.j END AS e_nd FROM e{t + 1} e LEFT JOIN d{t} d ON d.j = e.j)")
    ends = " UNION ALL ".join(f"SELECT e_nd AS j FROM e{t} WHERE e_nd IS NOT NULL" for t in range(1, buckets + 1))
    return f"""
WITH docs AS (SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS n, substr(md5(doc_id::VARCHAR), 1, {_SHARD_DIGITS}) AS shard FROM {documents}),
lens AS (SELECT n AS l, count(*) AS c FROM docs GROUP BY n),
h AS MATERIALIZED (SELECT l, row_number() OVER (ORDER BY l) AS j, sum(c) OVER (ORDER BY l) AS n, sum(l * c) OVER (ORDER BY l) AS s FROM lens),
{', '.join(x.replace('AS (', 'AS MATERIALIZED (', 1) for x in steps)},
b AS (SELECT row_number() OVER (ORDER BY l) - 1 AS bucket, l AS bucket_len, lag(l, 1, -1) OVER (ORDER BY l) AS above FROM h WHERE j IN ({ends})),
placed AS (SELECT d.doc_id, d.n AS n_tokens, b.bucket, b.bucket_len, row_number() OVER (PARTITION BY b.bucket ORDER BY d.shard, d.doc_id) - 1 AS p, greatest(1, {budget} // greatest(1, b.bucket_len)) AS room
  FROM docs d JOIN b ON d.n > b.above AND d.n <= b.bucket_len)
SELECT doc_id, n_tokens, bucket::INTEGER AS bucket, bucket_len, p // room AS batch, p % room AS slot FROM placed
"""
