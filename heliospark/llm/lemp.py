"""Ranked lexical search over norm buckets of impact vectors.

Teflioudi et al., "LEMP: Fast Retrieval of Large Entries in a Matrix Product"
(SIGMOD 2015). A document is a sparse vector of integer impacts on the terms
that the items hold, an item the vector of its terms' integer weights; scores
are inner products. Documents are laid out by the length of their vectors and
read in buckets, longest first. For each item:

- Cauchy-Schwarz on the bucket's greatest length drops whole buckets;
- inside, coordinates are read in order of what they can add. Once those unread
  can't reach the threshold, by the bucket's greatest coordinates or by the
  lengths of the rest, documents met so far are all candidates; the same
  bounds, now for each document, filter them;
- what survives is scored anew from its whole vector, in 64-bit integers.

The threshold is the k-th best score so far. Tasks start from that of the
longest vectors, which are searched first.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heliospark.llm.common import ascii_lower, stage

#: Documents of a bucket, and of the buckets that are searched first, about.
BUCKET, FIRST = 8192, 32_768
#: Terms of all items of a block; the items are answered block by block, each reading the corpus once.
ENTRIES = 1 << 18
#: Bytes of a text that are cut into terms at a time.
CHUNK = 4 << 20
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Bounds are in floating point; a bound counts as reached within this share.
SLACK = 1 + 1e-9
#: Letters and digits of ASCII in lower case, all other ASCII as space; bytes of other characters as they are.
_FOLD = bytes(b if b >= 128 else ord(chr(b).lower()) if chr(b).isalnum() else 32 for b in range(256))


def counted_terms(text: bytes, wanted: dict[bytes, int]) -> tuple[int, Counter]:
    """Number of terms of the text in UTF-8, with repeats, and how often each wanted one occurs (by its number)."""
    folded, at, n, found = text.translate(_FOLD), 0, 0, Counter()
    while at < len(folded):
        end = folded.find(b" ", at + CHUNK)
        end = len(folded) if end < 0 else end
        terms = folded[at:end].split()
        n += len(terms)
        found.update(map(wanted.__getitem__, filter(wanted.__contains__, terms)))
        at = end
    return n, found


def weight(rows: int, holding: int) -> int:
    """A term's weight, given the documents that hold terms and those that hold it."""
    return math.floor(1000 * math.log((2 * rows + 2) / (2 * holding + 1)))


class Queries:
    """The items of a block as vectors of integer weights."""

    def __init__(self, terms: list[np.ndarray], weights: np.ndarray) -> None:
        self.weights = weights
        used = [t[weights[t] > 0] for t in terms]
        self.terms = used
        self.norms = np.array([math.sqrt(float((weights[t].astype(np.float64) ** 2).sum())) for t in used])


class Bucket:
    """Documents in order of length, by row and by coordinate."""

    def __init__(self, ids: np.ndarray, norms: np.ndarray, sizes: np.ndarray, terms: np.ndarray, impacts: np.ndarray) -> None:
        self.ids, self.norms, self.terms, self.impacts = ids, norms, terms, impacts
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        order = np.argsort(terms, kind="stable")
        self.rows, self.values = np.repeat(np.arange(len(ids)), sizes)[order], impacts[order]
        self.coordinates, self.first = np.unique(terms[order], return_index=True)
        self.last = np.append(self.first[1:], len(terms))
        self.most = np.maximum.reduceat(self.values, self.first)

    def survivors(self, terms: np.ndarray, weights: np.ndarray, floor: float) -> np.ndarray:
        """Rows whose score may reach ``floor``; all with a score above zero if that is no bound."""
        at = np.searchsorted(self.coordinates, terms)
        held = at < len(self.coordinates)
        held[held] = self.coordinates[at[held]] == terms[held]
        at, w = at[held], weights[held].astype(np.float64)
        order = np.argsort(-w * self.most[at], kind="stable")
        at, w = at[order], w[order]
        # What the coordinates from each place on can add, by coordinate and by length.
        adds = np.append(np.cumsum((w * self.most[at])[::-1])[::-1], 0.0)
        rest = np.append(np.sqrt(np.cumsum((w**2)[::-1])[::-1]), 0.0)
        if not len(at) or min(adds[0], rest[0] * self.norms[0]) * SLACK < floor:
            return np.zeros(0, dtype=np.int64)
        read = int(np.argmax(np.minimum(adds, rest * self.norms[0]) * SLACK < floor)) if floor > 0 else len(at)
        read = read or len(at)
        lists = [slice(self.first[i], self.last[i]) for i in at[:read].tolist()]
        rows = np.concatenate([self.rows[s] for s in lists])
        values = np.concatenate([self.values[s] for s in lists]).astype(np.float64)
        sums = np.bincount(rows, np.repeat(w[:read], [s.stop - s.start for s in lists]) * values, len(self.ids))
        if read == len(at):
            return np.flatnonzero((sums > 0) & (sums * SLACK >= floor))
        left = np.sqrt(np.maximum(self.norms**2 - np.bincount(rows, values**2, len(self.ids)), 0.0) * SLACK)
        return np.flatnonzero((sums > 0) & ((sums + np.minimum(adds[read], rest[read] * left)) * SLACK >= floor))

    def scores(self, rows: np.ndarray, of_term: np.ndarray) -> np.ndarray:
        """Exact scores of some rows; ``of_term``: the item's weight of each term, as 64-bit integers."""
        sizes = self.ends[rows] - self.starts[rows]
        begin = np.cumsum(sizes) - sizes
        at = np.arange(int(sizes.sum())) + np.repeat(self.starts[rows] - begin, sizes)
        return np.add.reduceat(of_term[self.terms[at]] * self.impacts[at], begin) if len(at) else np.zeros(0, dtype=np.int64)


def _searched(queries, floors: np.ndarray, k: int, size: int):
    """Documents by falling length to the k best of each item among the task's documents (item, doc, score)."""

    def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[Bucket]:
        held, n = [], 0

        def made() -> Bucket:
            table = pa.Table.from_batches(held)
            flat = [table[c].combine_chunks() for c in ("terms", "impacts")]
            terms, impacts = (x.flatten().to_numpy(zero_copy_only=False) for x in flat)
            sizes = flat[0].value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            return Bucket(table["doc"].to_numpy(), table["norm"].to_numpy(), sizes, terms, impacts.astype(np.int64))

        for batch in batches:
            while batch.num_rows:
                some = batch.slice(0, size - n)
                held.append(some)
                n += some.num_rows
                batch = batch.slice(some.num_rows)
                if n == size:
                    yield made()
                    held, n = [], 0
        if n:
            yield made()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = queries.value
        floor = floors.astype(np.float64)
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(asked.terms)
        of_term = np.zeros(len(asked.weights), dtype=np.int64)
        for bucket in buckets(batches):
            # Cauchy-Schwarz: no product exceeds the product of the lengths.
            for i in np.flatnonzero(asked.norms * bucket.norms[0] * SLACK >= np.maximum(floor, 1)).tolist():
                terms = asked.terms[i]
                rows = bucket.survivors(terms, asked.weights[terms], floor[i])
                if not len(rows):
                    continue
                of_term[terms] = asked.weights[terms]
                docs, scores = np.append(best[i][0], bucket.ids[rows]), np.append(best[i][1], bucket.scores(rows, of_term))
                of_term[terms] = 0
                keep = np.lexsort((docs, -scores))[:k]
                best[i] = docs[keep], scores[keep]
                if len(keep) == k:
                    floor[i] = max(floor[i], float(scores[keep[-1]]))
        items = np.repeat(np.arange(len(best)), [len(b[0]) for b in best])
        columns = [items, *(np.concatenate([b[j] for b in best]) if best else np.zeros(0, np.int64) for j in (0, 1))]
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["item", "doc", "score"])

    return run


def _postings(docs: DataFrame, key: str, text: str, terms: list[str]) -> DataFrame:
    """(doc, n, terms, tfs): documents that hold a term, their number of terms, and the wanted ones with their counts."""
    wanted = docs.sparkSession.sparkContext.broadcast({t.encode(): i for i, t in enumerate(terms)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, n, sizes, numbers, counts = [], [], [], [], []
            for doc, said in zip(batch["doc"].to_pylist(), batch["said"], strict=True):
                many, found = counted_terms(said.as_py() or b"", wanted.value)
                if many:
                    docs.append(doc)
                    n.append(many)
                    sizes.append(len(found))
                    numbers += found.keys()
                    counts += found.values()
            ends = pa.array(np.cumsum([0, *sizes]), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x, kind)) for x, kind in ((numbers, pa.int32()), (counts, pa.int64()))]
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(n, pa.int64()), *lists], ["doc", "n", "terms", "tfs"])

    narrow = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).cast("binary").alias("said"))
    return narrow.mapInArrow(run, "doc long, n long, terms array<int>, tfs array<long>")


def _vectors(postings: DataFrame, rows: int, total: int) -> DataFrame:
    """(doc, norm, terms, impacts) of the documents that hold wanted terms."""
    mean_share = F.expr(f"cast((cast(50 * n as decimal(20,0)) * cast({rows} as decimal(18,0))) div cast({total} as decimal(20,0)) as long)")
    tasks = F.transform("tfs", lambda f: F.expr("1000000000L") * f).alias("up")
    down = F.transform("tfs", lambda f: 1000 * f + 20 * (100 - 50 + F.col("share")))
    shared = postings.where(F.col("doc").isNotNull() & (F.size("terms") > 0)).select("doc", "terms", "tfs", mean_share.alias("share"))
    parts = shared.select("doc", "terms", tasks, down.alias("down"))
    scored = parts.select("doc", "terms", F.expr("zip_with(up, down, (x, y) -> x div y)").alias("impacts"))
    norm = F.sqrt(F.aggregate("impacts", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return scored.select("doc", norm.alias("norm"), "terms", "impacts")


def _block(docs: DataFrame, items: list, k: int, key: str, text: str, bucket: int, first: int) -> DataFrame | None:
    """(item_id, doc, score): the best documents of a block of items (item, terms), k at least where there are so many."""
    spark = docs.sparkSession
    terms = sorted({t for row in items for t in row["terms"]})
    number = {t: i for i, t in enumerate(terms)}
    postings = stage(_postings(docs, key, text, terms), "postings")
    rows, total = postings.agg(F.count(F.lit(1)), F.sum("n")).first()
    if not rows:
        return None
    # One row for each term of the block at most.
    holding = dict(postings.select(F.explode("terms").alias("term")).groupBy("term").count().collect())
    weights = np.array([weight(rows, holding[i]) if i in holding else 0 for i in range(len(terms))], dtype=np.int64)
    queries = spark.sparkContext.broadcast(Queries([np.array(sorted(number[t] for t in row["terms"]), dtype=np.int64) for row in items], weights))
    vectors = stage(_vectors(postings, rows, total), "impacts")
    many = vectors.count()
    if not many:
        return None
    # Few bytes mean much work here: the number of tasks is stated, lest they be made few by size.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def searched(some: DataFrame, floors: np.ndarray) -> DataFrame:
        # Equal lengths are told apart by document, so that copies spread over tasks.
        laid = some.repartitionByRange(parts, F.desc("norm"), "doc").sortWithinPartitions(F.desc("norm"), "doc")
        return stage(laid.mapInArrow(_searched(queries, floors, k, bucket), "item long, doc long, score long"), "ranked")

    cut = vectors.agg(F.percentile_approx("norm", max(0.0, 1 - first / many), 10_000)).first()[0]
    best = searched(vectors.where(F.col("norm") >= cut), np.zeros(len(items)))
    order = Window.partitionBy("item").orderBy(F.desc("score"), "doc")
    kth = best.withColumn("at", F.row_number().over(order)).where(F.col("at") == k).select("item", "score").collect()
    floors = np.zeros(len(items))
    floors[[r["item"] for r in kth]] = [r["score"] for r in kth]
    best = best.unionByName(searched(vectors.where(F.col("norm") < cut), floors))
    names = spark.createDataFrame([(i, row["item_id"]) for i, row in enumerate(items)], "item long, item_id long")
    return best.join(names, "item").select("item_id", "doc", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 50, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", entries: int = ENTRIES, bucket: int = BUCKET, first: int = FIRST) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of greatest score above 0 for each item, ties by lesser key.

    Keys are long integers. Every row of ``docs`` is a document, also where
    keys repeat; NULL and empty texts hold no term. Documents without a key
    count in the statistics and can't be ranked; items without a key or without
    terms have no rows, items that repeat a key are one item with the terms of
    all. Columns of other names don't matter. Empty tables give an empty result.

    Items are taken in blocks of about ``entries`` terms, so that what tasks
    are sent has a bound; each block reads the documents once. ``bucket`` and
    ``first``: documents of a bucket, and about how many are searched first.
    """
    spark = docs.sparkSession
    said = F.regexp_extract_all(ascii_lower(F.col(item_text)), F.lit(TERM), F.lit(0))
    each = items.select(F.col(item_key).cast("long").alias("item_id"), F.explode(said).alias("term")).where("item_id is not null").distinct()
    asked = stage(each.groupBy("item_id").agg(F.collect_list("term").alias("terms")), "items")
    blocks = -(-(asked.agg(F.sum(F.size("terms"))).first()[0] or 0) // entries)
    found = spark.createDataFrame([], "item_id long, doc long, score long")
    for i in range(blocks):
        block = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == i).collect()
        some = _block(docs, block, k, key, text, bucket, first) if block else None
        found = found if some is None else found.unionByName(some)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    ranked = found.withColumnRenamed("doc", "doc_id").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")
