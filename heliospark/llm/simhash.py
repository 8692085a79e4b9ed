"""Near-duplicates by SimHash, joined on a grid of segment bit counts.

A 64-bit fingerprint is cut into 16 segments of 4 bits; the bit counts of its
segments are its point. Two fingerprints differ in at least as many bits as
their points differ in Manhattan distance, so that those within ``BITS`` = 2
bits lie within 2 of each other, and some grid cell is within 1 of both. Each
fingerprint goes to the cells within 1 of its point (33 at most); those that
meet in a cell are verified by their exact bit distance.

Copies by similarity (``keep_one`` with a ``similarity``) are first sought the
same way: the grid's links, and equal fingerprints, are candidates. Others lie
many more bits apart, where segment counts no longer tell pairs apart. These
take fingerprints of 128 bits over the distinct shingles (the grid takes the
last 64 of them), cells of equal bits in ``DRAWS`` draws of ``DRAWN`` bits, and
pairs within ``RADIUS`` bits in a cell as further candidates. All candidates are
verified by the exact Jaccard similarity of their shingles. In a crowded cell
each fingerprint is paired with its nearest one and with the cell's centre only,
and once more between the groups that this makes. What then is left apart of
those that lie near others in crowded cells is decided exactly, by a similarity
join on the rarest shingles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliospark.llm.common import stage
from heliospark.llm.components import components

WORDS = 3
BITS = 2
SEGMENTS, WIDTH = 16, 4
#: Shingles that are hashed at a time, and the size up to which a cell's pairs are all compared.
CHUNK, SMALL = 1 << 16, 64
#: Of 128 bits, two texts of Jaccard similarity 0.8 differ in 19 on average, in more than RADIUS once in 30,000 times;
#: one of 48 draws of 14 bits is equal in 99.5 % of such pairs, in 99.95 % at 0.85.
DRAWS, DRAWN, RADIUS = 48, 14, 36
#: Pairs a member up to which a cell gives all of its pairs at once, and pairs of a stored file.
_PAIRS, _FILE_PAIRS = 4, 1 << 18
#: Frequent shingles whose numbers are broadcast, and shingles that a task holds while it counts.
COMMON, _HELD = 1 << 16, 1 << 20


def fingerprint_of(text: str, words: int = WORDS) -> int:
    """SimHash of the text's word shingles, as a signed 64-bit integer."""
    # bytes.lower and bytes.split know ASCII only, as the contract wants it.
    parts = text.encode().lower().split()
    if not parts:
        return 0
    shingles = map(b" ".join, zip(*(parts[i:] for i in range(words)), strict=False)) if len(parts) >= words else iter([b" ".join(parts)])
    n, ones = 0, np.zeros(64, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    while True:
        hashes = np.fromiter((digest(s, 42) for s in islice(shingles, CHUNK)), dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        n += len(hashes)
        if len(hashes) < CHUNK:
            break
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<i8")[0])


def fingerprint(words: int = WORDS):
    @F.pandas_udf("long")
    def marks(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint_of(t or "", words) for t in texts], dtype="int64")

    return marks


def _point(fp: Column) -> Column:
    """The segment bit counts, three bits for each."""
    bits = F.array(*[F.shiftleft(F.bit_count(F.shiftrightunsigned(fp, WIDTH * i).bitwiseAND(F.lit((1 << WIDTH) - 1))).cast("long"), 3 * i) for i in range(SEGMENTS)])
    return F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))


def _cells(point: Column) -> Column:
    """The grid cells within Manhattan distance 1 of the point."""
    near = []
    for i in range(SEGMENTS):
        count = F.shiftright(point, 3 * i).bitwiseAND(F.lit(7))
        step = F.lit(1 << (3 * i)).cast("long")
        near += [F.when(count > 0, point - step), F.when(count < WIDTH, point + step)]
    return F.array_compact(F.array(point, *near))


def _spanning(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what all exact links of a few fingerprints join, each fingerprint having one at most."""
    far = np.bitwise_count(fps[:, None] ^ fps[None, :])
    near = far <= BITS
    reach = near.copy()
    while True:  # label by the first member in reach
        more = (reach.astype(np.float32) @ near.astype(np.float32)) > 0
        if (more == reach).all():
            break
        reach = more
    first = reach.argmax(1)
    other = np.flatnonzero(first != np.arange(len(fps)))
    return fps[other], fps[first[other]]


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (cell, fp) to verified links; fingerprints of a crowded cell come back as (fp, NULL)."""
    crowd, cell, held = False, None, []

    def close() -> tuple[np.ndarray, np.ndarray]:
        # equal fingerprints are gone, so a link has two ends
        return _spanning(np.array(held, dtype=np.int64).view(np.uint64)) if len(held) > 1 else (np.zeros(0, np.uint64),) * 2

    def batch_of(a: list, b: list) -> pa.RecordBatch:
        ends = [np.concatenate(x).astype(np.uint64).view(np.int64) if x else np.zeros(0, np.int64) for x in (a, b)]
        return pa.RecordBatch.from_arrays([pa.array(e) for e in ends], ["a", "b"])

    for batch in batches:
        cells, fps = batch["cell"].to_numpy(), batch["fp"].to_numpy()
        starts = np.flatnonzero(np.diff(cells, prepend=cells[:1] - 1)) if len(cells) else []
        ends = np.append(starts[1:], len(cells)) if len(cells) else []
        # A fingerprint alone in its cell has no link; a batch's first and last cell may go on in others.
        many = np.flatnonzero((ends - starts > 1) | (starts == 0) | (ends == len(cells))) if len(cells) else []
        a, b, crowded = [], [], []
        for start, end in zip(starts[many].tolist(), ends[many].tolist(), strict=True) if len(cells) else ():
            if cells[start] != cell:
                if not crowd:
                    x, y = close()
                    a.append(x)
                    b.append(y)
                cell, held, crowd = cells[start], [], False
            if not crowd and len(held) + end - start > SMALL:
                crowd = True
                crowded += held
                held = []
            if crowd:
                crowded += fps[start:end].tolist()
            else:
                held += fps[start:end].tolist()
        yield batch_of(a, b)
        if crowded:
            yield pa.RecordBatch.from_arrays([pa.array(crowded, pa.int64()), pa.nulls(len(crowded), pa.int64())], ["a", "b"])
    if not crowd:
        x, y = close()
        yield batch_of([x], [y])


def _crowded_links(fps: DataFrame) -> DataFrame:
    """Exact links among the fingerprints of crowded cells, without comparing all pairs.

    Two of them are within two bits if and only if some value is within one bit
    of both; at most 65 fingerprints share such a value.
    """
    flips = F.array(F.lit(0).cast("long"), *[F.shiftleft(F.lit(1).cast("long"), i) for i in range(64)])
    meet = fps.select(F.col("a").alias("fp"), F.explode(F.transform(flips, lambda bit: F.col("a").bitwiseXOR(bit))).alias("z"))
    stars = meet.groupBy("z").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)
    return stars.select(F.explode(F.slice("fps", 2, 64)).alias("a"), F.col("fps")[0].alias("b"))


def link_fingerprints(fps: DataFrame) -> DataFrame:
    """(a, b): links between the distinct values of the column fp that join all within two bits."""
    # Few bytes become many rows here: the number of tasks is stated, lest they be made few by size.
    tasks = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    nodes = fps.where(F.col("fp").isNotNull()).select("fp").repartition(tasks, "fp").distinct()
    # The lambda has the point reckoned once for all its cells.
    around = F.flatten(F.transform(F.array(_point(F.col("fp"))), _cells))
    cells = nodes.select(F.explode(around).alias("cell"), "fp")
    found = stage(cells.repartition("cell").sortWithinPartitions("cell", "fp").mapInArrow(_links, "a long, b long"), "links")
    links = found.where(F.col("b").isNotNull())
    crowded = found.where(F.col("b").isNull()).select("a").distinct()
    return links.unionByName(_crowded_links(crowded)).distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """For each row of ``docs``: key, fp (signed 64 bits) and component, the least key reachable.

    NULL texts count as empty; texts without words have fingerprint zero and
    link like others. A row whose key is NULL has the least key of its
    component, NULL if no row of it has one. Equal fingerprints are one node, so
    a large group of copies costs one row. An empty table gives an empty result.
    """
    return label(stage(docs.select(F.col(key).alias("key"), fingerprint(words)(F.col(text)).alias("fp")), "fingerprints"))


def label(marked: DataFrame) -> DataFrame:
    """``marked`` (key, fp, ...) with the column component."""
    nodes = marked.groupBy("fp").agg(F.min("key").alias("least"))
    roots = components(link_fingerprints(nodes)).select(F.col("node").alias("fp"), "root")
    rooted = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component"))
    return marked.join(rooted.join(least, "root").select("fp", "component"), "fp")


def shingles_of(text: str, words: int) -> np.ndarray:
    """Distinct word shingles of the text as 128-bit hashes (two columns), sorted; none for a text without words."""
    parts = text.encode().lower().split()
    if not parts:
        return np.zeros((0, 2), dtype="<u8")
    shingles = map(b" ".join, zip(*(parts[i:] for i in range(words)), strict=False)) if len(parts) >= words else [b" ".join(parts)]
    hashes = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, shingles)), dtype="<u8").reshape(-1, 2)
    _, first = np.unique(hashes[:, 0], return_index=True)
    return hashes[first]


def _sketches(words: int):
    """node (equal for equal sets of shingles) and the set's 128-bit SimHash (hi, lo)."""

    @F.pandas_udf("node long, hi long, lo long")
    def sketch(texts: pd.Series) -> pd.DataFrame:
        out = np.zeros((len(texts), 3), dtype=np.int64)
        for i, t in enumerate(texts):
            hashes = shingles_of(t or "", words)
            ones = np.zeros(128, dtype=np.int64)
            for at in range(0, len(hashes), CHUNK):
                part = np.ascontiguousarray(hashes[at : at + CHUNK])
                ones += np.unpackbits(part.view(np.uint8).reshape(-1, 16), axis=1, bitorder="little").sum(0, dtype=np.int64)
            out[i, 0] = xxhash.xxh64_intdigest(hashes[:, 0].tobytes()) - (1 << 63)
            out[i, 1:] = np.packbits(ones * 2 > len(hashes), bitorder="little").view("<i8")
        return pd.DataFrame(out, columns=["node", "hi", "lo"])

    return sketch


def _drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cell, node, hi, lo): each node in the cell of each draw of bits."""
    rng = np.random.default_rng(128)
    draws = [rng.choice(128, DRAWN, replace=False) for _ in range(DRAWS)]
    for batch in batches:
        node, hi, lo = (batch[c].to_numpy() for c in ("node", "hi", "lo"))
        for at in range(0, len(node), 4096):
            some = slice(at, at + 4096)
            bits = np.unpackbits(np.stack([hi[some], lo[some]], 1).view(np.uint8), axis=1, bitorder="little")
            cells = [bits[:, d].astype(np.int64) @ (1 << np.arange(DRAWN)) + (k << DRAWN) for k, d in enumerate(draws)]
            columns = [np.concatenate(cells), *(np.tile(x[some], DRAWS) for x in (node, hi, lo))]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["cell", "node", "hi", "lo"])


def _candidates(rooted: bool):
    """Sorted (cell, node, hi, lo) to pairs (a, b) within the radius; if ``rooted``, those of different ``root`` only.

    A cell of many pairs gives two for each node at most, with the distance
    ``far``: with the nearest node before it and with the cell's centre. Its
    members that are within the radius of others come as (node, NULL, cell).
    """

    def distances(hi: np.ndarray, lo: np.ndarray, mine: np.ndarray, others: np.ndarray) -> np.ndarray:
        return np.bitwise_count(hi[mine, None] ^ hi[None, others]) + np.bitwise_count(lo[mine, None] ^ lo[None, others])

    def centre_of(hi: np.ndarray, lo: np.ndarray) -> int:
        """The node nearest to the bits that most nodes have."""
        bits = np.unpackbits(np.stack([hi, lo], 1).view(np.uint8), axis=1)
        most = np.packbits(bits.sum(0, dtype=np.int64) * 2 > len(hi)).view(np.uint64)
        return int((np.bitwise_count(hi ^ most[0]) + np.bitwise_count(lo ^ most[1])).argmin())

    def pairs_of(cell: int, held: list[np.ndarray]) -> list[tuple]:
        node, hi, lo, root = (np.concatenate([h[i] for h in held]) for i in range(4))
        m = len(node)
        out, nearest, crowd, met = [], [], False, np.zeros(m, dtype=bool)
        hi, lo, width = hi.view(np.uint64), lo.view(np.uint64), max(1, (1 << 22) // m)
        for at in range(0, m, width):
            mine = np.arange(at, min(m, at + width))
            far = distances(hi, lo, mine, np.arange(mine[-1] + 1))
            far[np.arange(mine[-1] + 1)[None, :] >= mine[:, None]] = 255
            near = far <= RADIUS
            if rooted:
                near &= root[mine, None] != root[None, : mine[-1] + 1]
                far[~near] = 255
            if not crowd:
                crowd = sum(len(x) for x, _, _ in out) + int(near.sum()) > _PAIRS * m
            some = near.any(1)
            met[mine] |= some
            met[: mine[-1] + 1] |= near.any(0)
            nearest.append((mine[some], far[some].argmin(1), far[some].min(1, initial=255).astype(np.int64)))
            if not crowd:
                i, j = np.nonzero(near)
                out.append((mine[i], j, np.full(len(i), -1)))
        if not crowd:
            return [(node[i], node[j], d, np.zeros(len(i), dtype=bool)) for i, j, d in out if len(i)]
        hub = centre_of(hi, lo)
        far = distances(hi, lo, np.array([hub]), np.arange(m))[0].astype(np.int64)
        near = np.flatnonzero((far <= RADIUS) & (np.arange(m) != hub) & ((root != root[hub]) if rooted else True))
        # The centre's distance is marked by adding 128, so that it is a choice of its own.
        nearest.append((near, np.full(len(near), hub), far[near] + 128))
        found = [(node[i], node[j], d, np.zeros(len(i), dtype=bool)) for i, j, d in nearest if len(i)]
        m = int(met.sum())
        return [*found, (node[met], np.full(m, cell), np.full(m, -1), np.ones(m, dtype=bool))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held = None, []

        def passed_on(found: list[tuple]) -> pa.RecordBatch:
            none = [np.zeros(0, np.int64)] * 3 + [np.zeros(0, bool)]
            a, b, far, crowd = (np.concatenate(x) for x in zip(*found, strict=True)) if found else none
            ends = [pa.array(a), pa.array(b, mask=crowd), pa.array(b, mask=~crowd), pa.array(far, mask=far < 0)]
            return pa.RecordBatch.from_arrays(ends, ["a", "b", "cell", "far"])

        for batch in batches:
            cells = batch["cell"].to_numpy()
            columns = [batch[c].to_numpy() for c in ("node", "hi", "lo", "root" if rooted else "node")]
            starts = np.flatnonzero(np.diff(cells, prepend=cells[:1] - 1)) if len(cells) else np.zeros(0, np.int64)
            found = []
            for start, end in zip(starts.tolist(), [*starts[1:].tolist(), len(cells)], strict=False):
                if cells[start] != cell:
                    if sum(len(h[0]) for h in held) > 1:
                        found += pairs_of(cell, held)
                    cell, held = int(cells[start]), []
                held.append([c[start:end] for c in columns])
            yield passed_on(found)
        if sum(len(h[0]) for h in held) > 1:
            yield passed_on(pairs_of(cell, held))

    return run


def _sets(of: DataFrame, nodes: DataFrame, rows: DataFrame, words: int) -> DataFrame:
    """(node, set): the distinct shingles of the nodes in ``of``; only their texts are read again."""

    @F.pandas_udf("array<long>")
    def shingles(texts: pd.Series) -> pd.Series:
        return pd.Series([shingles_of(t or "", words)[:, 0].view("<i8") for t in texts])

    texts = rows.select("at", "said").join(nodes.join(of, "node", "left_semi").select("node", "at"), "at").select("node", "said")
    return stage(texts.select("node", shingles("said").alias("set")), "shingles")


def _verified(pairs: DataFrame, nodes: DataFrame, rows: DataFrame, words: int, similarity: float) -> DataFrame:
    """The pairs (a, b) whose shingles' Jaccard similarity is at least ``similarity``."""
    pairs = stage(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    sets = _sets(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), nodes, rows, words)
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("set").alias("y")), "b")
    common, whole = F.size(F.array_intersect("x", "y")), F.size("x") + F.size("y")
    alike = both.where(common >= F.lit(similarity) * (whole - common)).select("a", "b")
    # No more rows than pairs, whose number tells how many files they need.
    return stage(alike.repartition(1 + pairs.count() // _FILE_PAIRS), "similar")


def _grid_pairs(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes (node, lo): those that the grid of segment bit counts links, and each node with the least one of its fingerprint."""
    marked = nodes.select("node", F.col("lo").alias("fp"))
    least = marked.groupBy("fp").agg(F.min("node").alias("least"))
    equal = marked.join(least, "fp").where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b"))
    linked = link_fingerprints(marked)
    for c in ("a", "b"):
        linked = linked.join(least.select(F.col("fp").alias(c), F.col("least").alias(f"node_{c}")), c)
    return equal.unionByName(linked.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")))


def _meeting(similarity: float):
    """Sorted (shingle, node, root, size, place) to the pairs (a, b) of different roots that may be similar.

    ``place`` is the shingle's rank among the node's own, rarest first. Of a
    pair's first common shingle on, no more than the shorter rest can be common.
    """
    share = similarity / (1 + similarity)

    def pairs_of(held: list[list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        node, root, size, place = (np.concatenate([h[i] for h in held]) for i in range(4))
        rest = size - place
        # All pairs of different roots have an end outside the group that most are in.
        _, which, many = np.unique(root, return_inverse=True, return_counts=True)
        few = np.flatnonzero(which != many.argmax())
        a, b = [], []
        for i in few.tolist():
            other = (np.minimum(rest[i], rest) >= share * (size[i] + size) - 1e-9) & (root != root[i])
            # Pairs within the few are met twice: from the later end only.
            other[few[few >= i]] = False
            j = np.flatnonzero(other)
            a.append(np.full(len(j), node[i]))
            b.append(node[j])
        none = [np.zeros(0, np.int64)]
        return np.concatenate(a + none), np.concatenate(b + none)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, held = None, []
        for batch in batches:
            keys = batch["shingle"].to_numpy()
            columns = [batch[c].to_numpy() for c in ("node", "root", "size", "place")]
            starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]).tolist() if len(keys) else []
            found = []
            for start, end in zip(starts, [*starts[1:], len(keys)], strict=False):
                if keys[start] != shingle:
                    if sum(len(h[0]) for h in held) > 1:
                        found.append(pairs_of(held))
                    shingle, held = keys[start], []
                held.append([c[start:end] for c in columns])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *(f[i] for f in found)])) for i in (0, 1)], ["a", "b"])
        if sum(len(h[0]) for h in held) > 1:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in pairs_of(held)], ["a", "b"])

    return run


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, set) to (shingle, n), added up within a task as far as ``_HELD`` shingles go: copies share most of theirs."""
    held, size = [np.zeros(0, np.int64)], 0

    def passed_on() -> pa.RecordBatch:
        shingles, n = np.unique(np.concatenate(held), return_counts=True)
        held[:] = [np.zeros(0, np.int64)]
        return pa.RecordBatch.from_arrays([pa.array(shingles), pa.array(n.astype(np.int64))], ["shingle", "n"])

    for batch in batches:
        held.append(batch["set"].flatten().to_numpy())
        size += len(held[-1])
        if size > _HELD:
            yield passed_on()
            size = 0
    yield passed_on()


def _similar_among(some: DataFrame, nodes: DataFrame, rows: DataFrame, roots: DataFrame, words: int, similarity: float) -> DataFrame:
    """All links (a, b) between nodes of ``some`` with different roots, exactly.

    Two sets of this similarity share one of the rarest shingles of each: of
    all but ``similarity`` of them, and one more. That holds in any order of the
    shingles that all sets share; here the ``COMMON`` most frequent ones of these
    nodes come last, by their number, and all others first, by their hash.
    """
    spark = rows.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sets = _sets(some, nodes, rows, words)
    counts = stage(sets.mapInArrow(_counted, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("df")).where("df > 1"), "counts")
    # At most about the root of twice the number of shingles.
    histogram = sorted(counts.groupBy("df").count().collect(), reverse=True)
    cut = max((r.df + 1 for r, n in zip(histogram, np.cumsum([r["count"] for r in histogram]), strict=True) if n > COMMON), default=0)
    common = sorted((r.shingle, r.df) for r in counts.where(F.col("df") >= cut).collect())
    shared = spark.sparkContext.broadcast(np.array(common, dtype=np.int64).reshape(-1, 2))

    def rarest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, df = shared.value.T
        for batch in batches:
            out = []
            for node, root, own in zip(batch["node"].to_pylist(), batch["root"].to_pylist(), batch["set"], strict=True):
                own = own.values.to_numpy()
                size = len(own)
                at = np.minimum(np.searchsorted(known, own), max(len(known) - 1, 0))
                often = np.where(known[at] == own, df[at], 0) if len(known) else np.zeros(size, np.int64)
                first = np.lexsort((own, often))[: size - math.ceil(similarity * size - 1e-9) + 1]
                n = len(first)
                out.append((own[first], np.full(n, node), np.full(n, root), np.full(n, size), np.arange(n)))
            columns = [np.concatenate([np.zeros(0, np.int64), *c]) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["shingle", "node", "root", "size", "place"])

    placed = sets.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "set")
    rooted = placed.mapInArrow(rarest, "shingle long, node long, root long, size long, place long")
    met = rooted.repartition(tasks, "shingle").sortWithinPartitions("shingle", "node").mapInArrow(_meeting(similarity), "a long, b long")
    return _verified(met, nodes, rows, words, similarity)


def _similar(rows: DataFrame, words: int, similarity: float) -> DataFrame:
    """(node, root) of the nodes that similar texts join to smaller ones; ``rows`` (node, hi, lo, at, said)."""
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    nodes = stage(rows.groupBy("node").agg(F.min(F.struct("at", "hi", "lo")).alias("least")).select("node", "least.*").repartition(tasks, "node"), "nodes")
    cells = nodes.mapInArrow(_drawn, "cell long, node long, hi long, lo long")

    def searched(cells: DataFrame, rooted: bool, near: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        """Links among the candidates and the pairs ``near``; the members (cell, node) of the cells that have more candidates."""
        found = cells.repartition(tasks, "cell").sortWithinPartitions("cell", "node").mapInArrow(_candidates(rooted), "a long, b long, cell long, far long")
        found = stage(found, "candidates")
        pairs = found.where(F.col("b").isNotNull())
        # Of all crowded cells of a node, two pairs: the nearest node and the nearest centre.
        best = pairs.where(F.col("far").isNotNull()).groupBy("a", F.col("far") >= 128).agg(F.min(F.struct("far", "b")).alias("best")).select("a", "best.b")
        pairs = pairs.where(F.col("far").isNull()).select("a", "b").unionByName(best)
        links = _verified(pairs if near is None else pairs.unionByName(near), nodes, rows, words, similarity)
        return links, found.where(F.col("b").isNull()).select("cell", F.col("a").alias("node"))

    links, crowded = searched(cells, False, _grid_pairs(nodes))
    left = stage(crowded.select("node").distinct(), "crowded")
    if left.isEmpty():
        return components(links)
    # What is joined needs no more pairs. Once more between different groups: few pairs are left to decide then.
    roots = components(links)
    rest = crowded.join(nodes.drop("at"), "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    more, _ = searched(rest.select("cell", "node", "hi", "lo", "root"), True)
    roots = _joined(roots, more)
    return _joined(roots, _similar_among(left, nodes, rows, roots, words, similarity))


def _joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``roots`` (node, root) after further links: these join whole groups, so only roots are looked at anew."""
    named = roots.select(F.col("node").alias("a"), F.col("root").alias("ra")), roots.select(F.col("node").alias("b"), F.col("root").alias("rb"))
    between = links.join(named[0], "a", "left").join(named[1], "b", "left")
    above = components(between.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")))
    over = above.select(F.col("node").alias("root"), F.col("root").alias("top"))
    below = roots.join(over, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return stage(below.unionByName(above), "roots")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, similarity: float | None = None) -> DataFrame:
    """The columns of ``docs``, with one row of each group of near-duplicates: that of the least key.

    A NULL key loses to all others; of rows that repeat a key one stays. With
    a ``similarity``, near-duplicates are not texts whose fingerprints differ
    in ``BITS`` bits, but those whose distinct shingles of so many ``words``
    have this Jaccard similarity or more; a text of fewer words is one shingle.
    Texts without words (NULL, empty, blank) are all alike: one of them stays.
    """
    if similarity is not None:
        row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
        rows = stage(docs.select(row, F.col(key).alias("key"), _sketches(words)(F.col(text)).alias("s"), F.monotonically_increasing_id().alias("at")).select("row", "key", "at", "s.*"), "rows")
        roots = _similar(rows.select("node", "hi", "lo", "at", F.col(f"row.`{text}`").alias("said")), words, similarity)
        ranked = rows.select("node", "key", "at").join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("class")).agg(F.min(F.struct(F.col("key").isNull(), "key", "at")).alias("best"))
        return rows.join(ranked.select(F.col("best.at").alias("at")), "at", "left_semi").select("row.*")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    # Stored, so that row numbers hold in both of the following passes.
    rows = stage(docs.select(row, F.col(key).alias("key"), fingerprint(words)(F.col(text)).alias("fp"), F.monotonically_increasing_id().alias("at")), "rows")
    marked = label(rows.select("key", "fp", "at"))
    group = F.coalesce(F.col("component").cast("string"), F.concat(F.lit("fp "), "fp"))
    ranked = marked.groupBy(group.alias("class")).agg(F.min(F.struct(F.col("key").isNull(), "key", "at")).alias("best"))
    return rows.join(ranked.select(F.col("best.at").alias("at")), "at", "left_semi").select("row.*")
