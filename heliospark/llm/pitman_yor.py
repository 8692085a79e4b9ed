"""A hierarchical Pitman-Yor language model over word contexts.

Three levels: a uniform base; one restaurant of all words, the root; one
restaurant for each context. Every word that was seen before another one is a
context of its own, and its restaurant serves every word that followed it; the
end of a text is the context of the next text's first word. A context never
seen has the root's predictive. Every word is a dish of the root, whose
menu is dealt out by word, so that it is seated in tasks, too.

Restaurants are rows that Spark deals out by context, many to a bucket; a
context with very many tokens is dealt over several buckets by the words that
follow. Texts are coded in blocks: a block sends the different pairs of a
context and a word that it holds to their buckets, to be counted when the
model learns, and to be answered from the restaurants when it scores.

Seating is sampled by Gibbs: in each round each bucket, in the task that holds
it, takes all customers of a dish away and seats them anew given the root's
predictive; its tables are the root's customers, whose seating is sampled in
turn, from where the round before left it. Only numbers of tables matter, so
a dish's is drawn at once from its exact distribution, however many customers
it has; one customer has one table, always. Numbers of tables and the root's
predictive are averaged over the rounds after burn-in.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field, replace
from functools import lru_cache
from itertools import compress, count, repeat
from math import lgamma

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heliospark.llm.common import stage, unstage

#: Dishes of the root whose chances are broadcast, words whose counts are; of other words both are joined.
DISHES, COUNTED = 1 << 18, 1 << 18
#: Training tokens for each bucket, and for each part of a context; tokens after which a block of texts ends.
GRAIN, BLOCK = 1 << 20, 1 << 21
#: Rounds, in each of which every customer is seated anew; the strength of all restaurants.
BURN_IN, SAMPLES, STRENGTH = 2, 3, 1.0
#: No word holds a line feed, so it can stand for the end of a text.
END = "\n"
#: Up to so many guests a dish's numbers of tables are weighed by a list; beyond, by an integral. Numbers weighed at once.
_LISTED, _WEIGHED = 1024, 1 << 18
#: Bytes of texts that are split into words at once.
_SPLIT = 1 << 22
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    """The contract's words: bytes know only ASCII case and white space."""
    return (text or "").encode().lower().split()


@dataclass
class Vocabulary:
    """The most frequent words by descending count; ids are places, the chances of the first ones are broadcast."""

    words: list[bytes]
    counts: np.ndarray
    dishes: int
    #: Number of rare words (all training words but those first ones) by their count.
    rare: dict[int, int]
    #: Makes the ids of the words beyond the counted ones different.
    salt: int = 0

    def __post_init__(self) -> None:
        self.place = {w: i for i, w in enumerate(self.words)}
        self.rare_types, self.rare_tokens = sum(self.rare.values()), sum(n * words for n, words in self.rare.items())
        self.types = self.dishes + self.rare_types
        self.tokens = int(self.counts[: self.dishes].sum()) + self.rare_tokens
        #: Every training word of so many tokens is held here.
        self.least = int(self.counts[-1]) if len(self.words) else np.iinfo(np.int64).max
        self.buckets = 1 + self.tokens // GRAIN
        self.parts = 1 + self.counts // GRAIN
        self.menus = 1 + 4 * self.types // GRAIN

    def places(self, words: list[bytes]) -> np.ndarray:
        """Places of the counted words, -1 for the others."""
        return np.fromiter(map(self.place.get, words, repeat(-1)), np.int64, len(words))

    def ids(self, words: list[bytes]) -> np.ndarray:
        """Places of the counted words; below zero, hashes of the others (as ``_hashed``)."""
        out, salt = self.places(words), str(self.salt).encode()
        beyond = np.flatnonzero(out < 0)
        salted = [words[i] + salt for i in beyond.tolist()]
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, salted, repeat(42)), np.uint64, len(salted))
        out[beyond] = -1 - (hashes >> np.uint64(1)).astype(np.int64)
        return out

    def light(self) -> Vocabulary:
        """Without the words, for tasks that are given ids."""
        return replace(self, words=[])

    def counted(self, ids: np.ndarray) -> np.ndarray:
        """Training counts of the held words, 0 for the others."""
        out = np.zeros(len(ids), dtype=np.int64)
        held = ids >= 0
        out[held] = self.counts[ids[held]]
        return out

    def parted(self, contexts: np.ndarray) -> np.ndarray:
        """Over how many parts each context is dealt."""
        out = np.ones(len(contexts), dtype=np.int64)
        held = contexts >= 0
        out[held] = self.parts[contexts[held]]
        return out

    def bucket(self, contexts: np.ndarray, words: np.ndarray) -> np.ndarray:
        """The bucket of each pair: that of the context's part."""
        part = (words.astype(np.uint64) * _MIX >> np.uint64(32)) % self.parted(contexts).astype(np.uint64)
        mixed = (contexts.astype(np.uint64) + part * np.uint64(0x632BE59BD9B4E019)) * _MIX
        return ((mixed ^ mixed >> np.uint64(29)) * _MIX >> np.uint64(32)).astype(np.int64) % self.buckets


    def menu(self, words: np.ndarray) -> np.ndarray:
        """The part of the root that each word is a dish of."""
        mixed = words.astype(np.uint64) * _MIX
        return ((mixed ^ mixed >> np.uint64(29)) * _MIX >> np.uint64(32)).astype(np.int64) % self.menus

    def by_menu(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The words' order by menu, the different menus, and where each ends in that order, after a 0."""
        menus = self.menu(words)
        order = np.argsort(menus, kind="stable")
        first = _firsts(menus[order])
        return order, menus[order][first], np.append(first, len(order))


def _hashed(word, salt: int):
    """Spark's form of the ids below zero."""
    return F.lit(-1) - F.shiftrightunsigned(F.xxhash64(F.concat(word, F.lit(str(salt)))), 1)


def _split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, one after the other (as ``words_of``), and how many each text has."""
    # Taken, since Arrow lower-cases the wrong bytes of a slice.
    whole = texts.take(pa.array(np.arange(len(texts)))).cast(pa.large_string()).fill_null("")
    trimmed = pc.ascii_trim_whitespace(pc.ascii_lower(whole))
    said, some = pc.ascii_split_whitespace(trimmed), pc.binary_length(trimmed).to_numpy() > 0
    # A text without words is split into one empty word.
    return said.flatten().filter(pa.array(np.repeat(some, pc.list_value_length(said).to_numpy()))), pc.list_value_length(said).to_numpy() * some


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows in a row with about _SPLIT bytes of text, one row at least."""
    ends = np.cumsum(pc.binary_length(batch["text"]).fill_null(0).to_numpy(), dtype=np.int64)
    start = 0
    while start < len(ends):
        before = int(ends[start - 1]) if start else 0
        end = max(start + 1, int(np.searchsorted(ends, before + _SPLIT, side="right")))
        yield batch.slice(start, end - start)
        start = end


def _coded(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Blocks of texts; a block ends with the text that fills it."""

    def ended() -> pa.RecordBatch:
        lengths = np.concatenate(counts) + 1
        coded = pa.chunked_array(said).unify_dictionaries()
        named = coded.chunk(0).dictionary
        # Place 0, the end of a text, behind each text's words.
        flat, ends = np.zeros(lengths.sum(), np.int32), np.cumsum(lengths) - 1
        word, types = np.ones(len(flat), bool), 1 + len(named)
        word[ends] = False
        flat[word] = np.concatenate([c.indices.to_numpy() for c in coded.chunks]) + 1
        learned = np.concatenate([b["learned"].to_numpy(zero_copy_only=False) for b in rows]).astype(bool)
        n = np.bincount(flat[np.repeat(learned, lengths)], minlength=types)
        row = pa.concat_arrays([b["row"] for b in rows])
        one = np.array([0, len(row)])
        out = [pa.array([next(numbers)]), pa.ListArray.from_arrays(pa.array(one, pa.int32()), row), _lists(lengths, one, pa.int32()), _joined(named), _pieces("n", n, np.array([0, len(n)]))]
        return pa.RecordBatch.from_arrays([*out, pa.array([_squeezed(flat)], pa.binary()), _lists(learned, one, pa.bool_())], _CODED)

    numbers = count(TaskContext.get().partitionId() << 32)
    said, counts, rows, tokens = [], [], [], 0
    for batch in batches:
        for part in _slices(batch):
            words, lengths = _split(part["text"])
            through, ends = np.cumsum(lengths), np.cumsum(lengths + 1)
            start = 0
            while start < len(lengths):
                word, token = (int(x[start - 1]) if start else 0 for x in (through, ends))
                end = int(np.searchsorted(ends, token + size - tokens)) + 1
                full, end = end <= len(lengths), min(end, len(lengths))
                said.append(words.slice(word, int(through[end - 1]) - word).dictionary_encode())
                counts.append(lengths[start:end])
                rows.append(part.select(["row", "learned"]).slice(start, end - start))
                tokens += int(ends[end - 1]) - token
                if full:
                    yield ended()
                    said, counts, rows, tokens = [], [], [], 0
                    pa.default_memory_pool().release_unused()  # Arrow keeps what is free, and an idle worker would hold it
                start = end
    if rows:
        yield ended()
    said = words = None
    pa.default_memory_pool().release_unused()


_CODED = ["block", "row", "lengths", "words", "n", "codes", "learned"]


def code(docs: DataFrame, text: str = "text", learned=None) -> DataFrame:
    """Texts in blocks, written out: a row for each block, so that they are split into words only once.

    row: the other columns of ``docs`` by text; lengths: tokens by text, the
    end included; words: the block's different words, the end first; n: how
    often the texts that are ``learned`` (all of them by default) hold each;
    codes: places in words of all tokens; learned: by text. Words, n and codes
    are squeezed, since the JVM handles strings one by one.
    """
    size = BLOCK
    others = [F.col(f"`{c}`") for c in docs.columns if c != text]
    row = F.struct(*(others or [F.lit(None).cast("boolean").alias("none")]))  # Parquet holds no struct without fields
    read = docs.select(row.alias("row"), F.col(text).alias("text"), (F.lit(True) if learned is None else learned).alias("learned"))
    kinds = [T.LongType(), T.ArrayType(read.schema["row"].dataType), T.ArrayType(T.IntegerType()), T.BinaryType(), T.BinaryType(), T.BinaryType(), T.ArrayType(T.BooleanType())]
    schema = T.StructType([T.StructField(*x) for x in zip(_CODED, kinds, strict=True)])
    return stage(read.mapInArrow(lambda batches: _coded(batches, size), schema), "coded", compression="zstd")


def _squeezed(values: np.ndarray) -> bytes:
    """Numbers by their first bytes, second bytes, ..., which pack far better than one after the other."""
    width = values.itemsize
    planes = np.ascontiguousarray(np.ascontiguousarray(values).view(np.uint8).reshape(-1, width).T)
    return len(values).to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _spread(packed: bytes, kind: type) -> np.ndarray:
    n, width = int.from_bytes(packed[:8], "little"), np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(packed[8:], width * n, codec="zstd", asbytes=True), np.uint8).reshape(width, n)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


#: What numbers a squeezed column holds.
_KINDS = {
    **dict.fromkeys(("contexts", "words", "guests", "seen", "ids"), np.int64),
    **dict.fromkeys(("runs", "n", "alone", "twice", "pairs", "moving", "tables", "codes"), np.int32),
    **dict.fromkeys(("mean", "share"), np.float32),
    **dict.fromkeys(("chance", "known"), np.float64),
}


def _pieces(name: str, values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A squeezed column: a row for the values from each end to the next."""
    values = values.astype(_KINDS[name], copy=False)
    return pa.array([_squeezed(values[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.binary())


def _read(rows, i: int, *names: str) -> list[np.ndarray]:
    """One row's values of squeezed columns."""
    return [_spread(rows[c][i].as_py(), _KINDS[c]) for c in names]


def _all(table: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """The values of all rows of a squeezed column, and their ends by row after a 0."""
    each = [_read(table, i, name)[0] for i in range(table.num_rows)]
    return np.concatenate([np.zeros(0, _KINDS[name]), *each]), np.append(0, np.cumsum([len(x) for x in each], dtype=np.int64))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n): the words of each block's learned texts."""
    for batch in batches:
        for i in range(batch.num_rows):
            (n,) = _read(batch, i, "n")
            some = n > 0
            yield pa.RecordBatch.from_arrays([pa.array(list(compress(_said(batch, i), some.tolist())), pa.binary()).cast(pa.string()), pa.array(n[some])], ["word", "n"])


def count_words(coded: DataFrame) -> DataFrame:
    """(word, n) over all learned texts; the end of a text is a word."""
    words = coded.select("words", "n").mapInArrow(_counted, "word string, n int")
    return stage(words.groupBy("word").agg(F.sum("n").alias("n")), "words")


def vocabulary(counts: DataFrame) -> Vocabulary:
    """The words whose count is large enough that at most COUNTED reach it, and what the rarer ones add up to.

    The histogram of counts comes to the driver: as many rows as there are
    different counts, at most about the root of twice the number of tokens.
    """
    histogram = {int(r.n): int(r.words) for r in counts.groupBy("n").agg(F.count(F.lit(1)).alias("words")).collect()}
    cut, above = None, 0
    for n in sorted(histogram, reverse=True):
        above += histogram[n]
        if above > COUNTED:
            break
        cut = n
    held = counts.where(F.col("n") >= cut).collect() if cut is not None else []
    held.sort(key=lambda r: (-r.n, r.word))
    dishes = min(DISHES, len(held))
    for r in held[:dishes]:
        histogram[r.n] -= 1
    frequent = np.array([r.n for r in held], dtype=np.int64)
    rare = {n: words for n, words in histogram.items() if words}
    vocab = Vocabulary([r.word.encode() for r in held], frequent, dishes, rare)
    while len(held) < vocab.types and _rare_ids(counts, vocab).groupBy("id").count().where("count > 1").limit(1).count():
        vocab.salt += 1
    return vocab


def _rare_ids(counts: DataFrame, vocab: Vocabulary) -> DataFrame:
    """(word, n, id) of the training words that the vocabulary doesn't hold."""
    return counts.where(F.col("n") < vocab.least).select("word", "n", _hashed(F.col("word"), vocab.salt).alias("id"))


@dataclass
class _Pairs:
    """A block's different pairs of a context and a word, in the order of their buckets."""

    contexts: np.ndarray
    words: np.ndarray
    buckets: np.ndarray
    #: How often each occurs, or None; for each token its pair, or None.
    n: np.ndarray | None
    at: np.ndarray | None

    def __post_init__(self) -> None:
        self.starts = np.flatnonzero(np.append(True, self.buckets[1:] != self.buckets[:-1])[: len(self.buckets)])


def _paired(flat: np.ndarray, ids: np.ndarray, vocab: Vocabulary, tokens: bool) -> _Pairs:
    """The pairs of texts in a row, each closed by its end (place 0), which is also the context of a first word."""
    keys = np.append(0, flat[:-1]) * len(ids) + flat
    order, keys = _sorted(keys) if tokens else (None, np.sort(keys))
    first = _firsts(keys)
    n, keys = np.diff(np.append(first, len(keys))), keys[first]
    contexts, words = ids[keys // len(ids)], ids[keys % len(ids)]
    buckets = vocab.bucket(contexts, words)
    dealt = np.argsort(buckets.astype(np.uint16) if vocab.buckets <= 1 << 16 else buckets, kind="stable")  # 16 bits are sorted in one pass
    at = None
    if tokens:
        back, at = np.empty(len(dealt), dtype=np.int64), np.empty(len(order), dtype=np.int64)
        back[dealt] = np.arange(len(dealt))
        at[order] = np.repeat(back, n)
    return _Pairs(contexts[dealt], words[dealt], buckets[dealt], None if tokens else n[dealt], at)


def _sorted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stable order of numbers from 0, and the numbers in it; where both fit in 63 bits they are sorted as one, several times faster."""
    bits = len(keys).bit_length()
    if len(keys) and int(keys.max()) < 1 << (63 - bits):
        both = np.sort(keys << bits | np.arange(len(keys)))
        return both & ((1 << bits) - 1), both >> bits
    order = np.argsort(keys, kind="stable")
    return order, keys[order]


def _firsts(keys: np.ndarray) -> np.ndarray:
    """Where each different one of sorted numbers begins."""
    return np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])


def _lists(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def _list(batch, name: str, i: int) -> np.ndarray:
    return batch[name][i].values.to_numpy(zero_copy_only=False)


def _flat(table: pa.Table, name: str) -> np.ndarray:
    return table[name].combine_chunks().flatten().to_numpy(zero_copy_only=False)


#: Pairs by context: for each of ``contexts`` the number of its words; the words' ids. All are squeezed.
_PACKED = "contexts binary, runs binary, words binary"


def _packed(contexts: np.ndarray, words: np.ndarray, starts: np.ndarray) -> list[pa.Array]:
    """Columns of _PACKED, a row for the pairs from each start to the next."""
    ends = np.append(starts, len(words))
    new = np.append(True, contexts[1:] != contexts[:-1])[: len(words)]
    new[starts] = True
    runs = np.flatnonzero(new)
    rows = np.searchsorted(runs, ends)
    lengths = np.diff(np.append(runs, len(words)))
    return [_pieces("contexts", contexts[runs], rows), _pieces("runs", lengths, rows), _pieces("words", words, ends)]


def _sent(coded: DataFrame, shared, learning: bool) -> DataFrame:
    """(bucket, block, _PACKED, n): the pairs that each block holds, for each bucket; of learned texts, with n, when learning."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = shared.value
        for batch in batches:
            for i in range(batch.num_rows):
                flat = _read(batch, i, "codes")[0].astype(np.int64)
                if learning:
                    flat = flat[np.repeat(_list(batch, "learned", i), _list(batch, "lengths", i))]
                if not len(flat):
                    continue
                pairs = _paired(flat, vocab.ids(_said(batch, i)), vocab, tokens=False)
                starts, ends = pairs.starts, np.append(pairs.starts, len(pairs.words))
                out = [pa.array(pairs.buckets[starts], pa.int32()), pa.array(np.full(len(starts), batch["block"][i].as_py())), *_packed(pairs.contexts, pairs.words, starts)]
                names = ["bucket", "block", "contexts", "runs", "words"]
                if learning:
                    out, names = [*out, _pieces("n", pairs.n, ends)], [*names, "n"]
                yield pa.RecordBatch.from_arrays(out, names)

    read = ["block", "words", "codes", *(["learned", "lengths"] if learning else [])]
    return coded.select(*read).mapInArrow(run, "bucket int, block long, " + _PACKED + (", n binary" if learning else ""))


def _joined(words: pa.Array) -> pa.Array:
    """The end and words as one squeezed value; none holds a blank."""
    joined = pc.binary_join(pa.LargeListArray.from_arrays(pa.array([0, len(words)], pa.int64()), words), pa.scalar(" ", pa.large_string()))[0].as_py()
    return pa.array([_squeezed(np.frombuffer((f"{END} {joined}" if len(words) else END).encode(), np.uint8))], pa.binary())


def _said(batch, i: int) -> list[bytes]:
    """A block's words."""
    return _spread(batch["words"][i].as_py(), np.uint8).tobytes().split(b" ")


def _merged(sent: pa.Table) -> pa.Table:
    """One bucket's restaurants: what all blocks sent, added up."""
    contexts, of = np.unique(_all(sent, "contexts")[0], return_inverse=True)
    words, dish = np.unique(_all(sent, "words")[0], return_inverse=True)
    order, keys = _sorted(np.repeat(of, _all(sent, "runs")[0]) * len(words) + dish)
    first = _firsts(keys)
    guests, keys = np.add.reduceat(_all(sent, "n")[0][order].astype(np.int64), first), keys[first]
    packed = _packed(contexts[keys // len(words)], words[keys % len(words)], np.zeros(1, dtype=np.int64))
    return pa.table([pa.array([sent["bucket"][0].as_py()], pa.int32()), *packed, _pieces("guests", guests, np.array([0, len(guests)]))], ["bucket", "contexts", "runs", "words", "guests"])


def _restaurants(coded: DataFrame, shared) -> DataFrame:
    """(bucket, _PACKED, guests): the customers of each dish in each context."""
    return _sent(coded, shared, learning=True).groupBy("bucket").applyInArrow(_merged, f"bucket int, {_PACKED}, guests binary")


@lru_cache(maxsize=2)
def _listed(discount: float) -> np.ndarray:
    """Logarithms of the generalised Stirling numbers S(c, t): the weight of all ways to seat c guests of a dish at t tables."""
    out = np.full((_LISTED + 1, _LISTED + 1), -np.inf)
    out[1, 1] = 0.0
    for c in range(1, _LISTED):
        out[c + 1, 1 : c + 1] = out[c, 1 : c + 1] + np.log(c - discount * np.arange(1, c + 1))
        out[c + 1, 1 : c + 2] = np.logaddexp(out[c + 1, 1 : c + 2], out[c, : c + 1])
    return out


def _drawn(guests: np.ndarray, rate: np.ndarray, discount: float, points: np.ndarray) -> np.ndarray:
    """Numbers of tables of dishes with more than one guest, at ``points`` (from 0 to 1) of their distributions.

    A dish of c guests has t tables with a chance in proportion to
    S(c, t) (rate discount)**t.
    """
    out, order = np.empty(len(guests), dtype=np.int64), np.argsort(guests, kind="stable")
    sizes, starts = np.unique(guests[order], return_index=True)
    rate = np.maximum(rate, 1e-300)
    logs = np.log(rate * discount)
    for c, start, end in zip(sizes.tolist(), starts.tolist(), np.append(starts, len(order))[1:].tolist(), strict=True):
        if c > _LISTED:
            break
        listed, tables = _listed(discount)[c, 1 : c + 1], np.arange(1, c + 1)
        for at in (order[i : min(end, i + _WEIGHED // c)] for i in range(start, end, _WEIGHED // c)):
            weights = listed + logs[at, None] * tables
            through = np.exp(weights - weights.max(axis=1, keepdims=True)).cumsum(axis=1)
            out[at] = 1 + (through < points[at, None] * through[:, -1:]).sum(axis=1)
    many = order[np.searchsorted(guests[order], _LISTED, side="right") :]
    for i, saddle in zip(many.tolist(), _saddles(guests[many], rate[many], discount).tolist(), strict=True):
        first, weights = _weighed(int(guests[i]), float(rate[i]), discount, saddle)
        through = np.cumsum(weights)
        out[i] = first + int(np.searchsorted(through, points[i] * through[-1], side="right").clip(0, len(through) - 1))
    return out


def _saddles(guests: np.ndarray, rate: np.ndarray, discount: float) -> np.ndarray:
    """-log z where rate discount z (1 - z)**(discount - 1) is the number of guests, by bisection of logit z; 1 / guests at least."""
    low, high = np.full(len(guests), -700.0), np.full(len(guests), 700.0)
    for _ in range(64):
        mid = (low + high) / 2
        above = np.log(rate * discount) - np.logaddexp(0, -mid) + (1 - discount) * np.logaddexp(0, mid) > np.log(guests)
        low, high = np.where(above, low, mid), np.where(above, mid, high)
    return np.maximum(np.logaddexp(0, -low), 1 / guests)


def _weighed(guests: int, rate: float, discount: float, saddle: float) -> tuple[int, np.ndarray]:
    """The first number of tables that matters for a dish, and the weights of it and those after it.

    S(c, t) discount**t / c! is the coefficient of z**c in g(z)**t / t! with
    g(z) = 1 - (1 - z)**discount. It is had by Cauchy's integral with
    z = exp(-s) through the saddle: near the cut of g on a hyperbola around it,
    elsewhere on the whole circle. The trapezoid rule on either is as exact as
    the numbers are.
    """
    z, w = np.exp(-saddle), -np.expm1(-saddle)
    log_peak = np.log1p(-(w**discount))
    mean = rate * np.exp(log_peak)
    # How fast the integrand falls off at the saddle: the variance of the number of guests at this rate.
    spread = rate * discount * z * w ** (discount - 2) * (w + (1 - discount) * z)
    if saddle < 0.5:
        bend, scale = np.sqrt(0.5), saddle / (1 - np.sqrt(0.5))
        at = np.arange(200) * min(0.12, 0.6 / (scale * bend * np.sqrt(spread)))
        path, step = scale * (1 - bend * np.cosh(at) + 1j * bend * np.sinh(at)), np.cosh(at) + 1j * np.sinh(at)
        path, step = path[path.imag < np.pi], step[path.imag < np.pi]
    else:
        half = int(np.ceil(np.pi / min(0.6 / np.sqrt(spread), np.pi / 40)))
        path, step = saddle + 1j * np.linspace(0, np.pi, half + 1), np.ones(half + 1, dtype=complex)
        step[-1] = 0.5
    step[0] *= 0.5
    grown = np.log(1 - (-np.expm1(-path)) ** discount) - log_peak
    kept = guests * (path.real - saddle) + mean * grown.real + np.log(np.abs(step)) > -40
    path, step, grown = path[kept], step[kept], grown[kept]
    around = 10 * np.sqrt(mean) + 20
    first, end = max(1, int(mean - around)), min(guests, int(mean + around)) + 1
    tables = np.arange(first, end)
    scaled = tables * (np.log(rate) + log_peak) - lgamma(first + 1) - np.append(0.0, np.cumsum(np.log(tables[1:])))
    parts = np.array_split(tables, 1 + len(tables) * len(path) // _WEIGHED)
    sums = np.concatenate([np.exp(np.outer(part, grown) + guests * (path - saddle)) @ step for part in parts])
    return first, np.maximum(sums.real, 0.0) * np.exp(scaled - scaled.max())


class Seating:
    """Numbers of tables of dishes by their guests."""

    def __init__(self, guests: np.ndarray, discount: float, count: np.ndarray | None = None) -> None:
        self.guests = guests
        if count is None:
            # About as many tables as a dish of so many guests has.
            count = np.maximum(1, np.rint(guests.astype(float) ** discount).astype(np.int64))
        self.count = np.minimum(guests, count)

    def tables(self) -> np.ndarray:
        return self.count

    @property
    def owner(self) -> np.ndarray:
        """The dish of each table, if one wants to lay them."""
        return np.repeat(np.arange(len(self.guests)), self.count)

    @property
    def sizes(self) -> np.ndarray:
        """Guests by table, as even as can be: which guest sits where changes no prediction."""
        owner, some = self.owner, np.maximum(self.count, 1)
        rank = np.arange(len(owner)) - np.repeat(np.cumsum(self.count) - self.count, self.count)
        return (self.guests // some)[owner] + (rank < (self.guests % some)[owner])

    def gibbs(self, rng: np.random.Generator, parent: np.ndarray, discount: float, strength: float, steps: int, house: np.ndarray | None = None, besides: np.ndarray | None = None, rates: np.ndarray | None = None) -> None:
        """``steps`` times, all guests of all dishes are seated anew.

        All dishes are one restaurant's, or else each is that of its ``house``,
        which has so many tables ``besides``. Given a draw from the gamma
        distribution of strength / discount + its tables, a restaurant's dishes
        don't depend on each other: integrating that draw out gives the
        restaurant's factor of new tables. ``rates``, where not NaN, are such
        draws, for restaurants that are not all here.
        """
        movers = np.flatnonzero(self.guests > 1)  # a single guest has a table of its own, always
        house = np.zeros(len(self.guests), dtype=np.int64) if house is None else house
        besides = np.zeros(1) if besides is None else besides
        for _ in range(steps if len(movers) else 0):
            rate = rng.gamma(strength / discount + np.bincount(house, weights=self.count, minlength=len(besides)) + besides)
            if rates is not None:
                rate = np.where(np.isnan(rates), rate, rates)
            self.count[movers] = _drawn(self.guests[movers], rate[house[movers]] * parent[movers], discount, rng.random(len(movers)))


#: A bucket's contexts with a dish of more than one guest: dishes with one, dishes with more; each of the latter's word and guests.
_MOVING = "bucket int, contexts binary, alone binary, moving binary, words binary, guests binary"
#: For each such dish its tables, its mean tables; parted contexts' tables.
_STATE = _MOVING + ", tables binary, mean binary, parted array<struct<id:long,n:long>>"


def _moving(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            contexts, runs, guests, words = _read(batch, i, "contexts", "runs", "guests", "words")
            more = guests > 1
            house = np.repeat(np.arange(len(contexts)), runs)
            moving = np.bincount(house[more], minlength=len(contexts))
            some = moving > 0
            yield _row(_MOVING, [batch["bucket"][i].as_py(), contexts[some], (runs - moving)[some], moving[some], words[more], guests[more]])


def _held(words: np.ndarray, dishes: int) -> np.ndarray:
    """Which words are dishes whose chances are broadcast."""
    return (words >= 0) & (words < dishes)


#: A bucket's words of a menu whose chances aren't broadcast, to be asked of the root in each round.
_ASKED = "bucket int, menu int, ids binary"


def _beyond(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = shared.value
        for batch in batches:
            for i in range(batch.num_rows):
                (words,) = _read(batch, i, "words")
                ids = np.unique(words[~_held(words, vocab.dishes)])
                order, menus, ends = vocab.by_menu(ids)
                bucket = np.full(len(menus), batch["bucket"][i].as_py())
                yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(menus, pa.int32()), _pieces("ids", ids[order], ends)], ["bucket", "menu", "ids"])

    return run


def _still(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, tables) of the other contexts: a table for each dish."""
    for batch in batches:
        for i in range(batch.num_rows):
            contexts, runs, guests = _read(batch, i, "contexts", "runs", "guests")
            more = np.bincount(np.repeat(np.arange(len(contexts)), runs), weights=guests > 1, minlength=len(contexts))
            yield pa.RecordBatch.from_arrays([pa.array(contexts[more == 0]), pa.array(runs[more == 0].astype(float))], ["id", "tables"])


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, tables) of a state's contexts: mean tables."""
    for batch in batches:
        for i in range(batch.num_rows):
            contexts, alone, moving, mean = _read(batch, i, "contexts", "alone", "moving", "mean")
            house = np.repeat(np.arange(len(contexts)), moving)
            yield pa.RecordBatch.from_arrays([pa.array(contexts), pa.array(np.bincount(house, weights=mean, minlength=len(contexts)) + alone)], ["id", "tables"])


def _to_root(shared, names: list[str], numbers):
    """(menu, ids, *names): sums by word of the ``numbers`` of a task's dishes, a row for each menu."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = shared.value
        sums, others = np.zeros((len(names), vocab.dishes)), []
        for batch in batches:
            for i in range(batch.num_rows):
                (words,), values = _read(batch, i, "words"), numbers(batch, i)
                held = _held(words, vocab.dishes)
                for total, value in zip(sums, values, strict=True):
                    total += np.bincount(words[held], value[held], vocab.dishes)
                ids, of = np.unique(words[~held], return_inverse=True)
                others.append((ids, *(np.bincount(of, value[~held], len(ids)) for value in values)))
        some = np.flatnonzero(sums[0])
        ids, *totals = (np.concatenate(x) for x in zip((some, *sums[:, some]), *others, strict=True))
        order, menus, ends = vocab.by_menu(ids)
        yield pa.RecordBatch.from_arrays([pa.array(menus, pa.int32()), *(_pieces(c, x[order], ends) for c, x in zip(["ids", *names], [ids, *totals], strict=True))], ["menu", "ids", *names])

    return run


def _census(batch, i: int) -> list[np.ndarray]:
    """Of each pair: its customers, whether it was seen once, whether twice, and that it was."""
    (guests,) = _read(batch, i, "guests")
    return [guests, guests == 1, guests == 2, guests > 0]


def _tables(batch, i: int) -> list[np.ndarray]:
    return _read(batch, i, "tables")


def _gathered(sent: pa.Table, *names: str) -> list[np.ndarray]:
    """What tasks sent to a menu: words in order, and sums by word."""
    ids, of = np.unique(_all(sent, "ids")[0], return_inverse=True)
    return [ids, *(np.bincount(of, _all(sent, c)[0], len(ids)).astype(np.int64) for c in names)]


#: A menu's words in order: training counts, pairs seen once; the root's customers and tables; the predictive's running mean.
#: Some sums over them, and customers less the discount of their tables where chances are broadcast.
_ROOT = "menu int, ids binary, seen binary, alone binary, guests binary, tables binary, chance binary, sums array<long>, known binary"


def _menu(menu: int, columns: list[np.ndarray], sums: list, known: np.ndarray) -> pa.Table:
    names = [c.split(" ")[0] for c in _ROOT.split(", ")]
    packed = (_pieces(c, x, np.array([0, len(x)])) for c, x in zip([*names[1:7], "known"], [*columns, known], strict=True))
    *packed, known = packed
    return pa.table([pa.array([menu], pa.int32()), *packed, pa.array([[int(x) for x in sums]], pa.list_(pa.int64())), known], names)


def _opened(sent: pa.Table) -> pa.Table:
    """A menu before the first round: as if the training texts were the root's customers."""
    ids, seen, alone, twice, pairs = _gathered(sent, "seen", "alone", "twice", "pairs")
    none = np.zeros(len(ids))
    return _menu(sent["menu"][0].as_py(), [ids, seen, alone, seen, none, none], [alone.sum(), twice.sum(), (pairs == 1).sum(), (pairs == 2).sum()], none[:0])


def _chances(root: pa.Table, reckoned: tuple[float, float, float]) -> np.ndarray:
    """The root's predictive of a menu's words."""
    discount, fresh, whole = reckoned
    guests, tables = _read(root, 0, "guests", "tables")
    return (guests - discount * tables + fresh) / whole


def _averaged(root: pa.Table, reckoned: tuple[float, float, float], rounds: int) -> np.ndarray:
    """The predictive's mean over so many rounds after burn-in, with the last one's."""
    (mean,) = _read(root, 0, "chance")
    return mean + (_chances(root, reckoned) - mean) / rounds if rounds > 0 else mean


def _root_seated(shared, round_: int, rate: float, discount: float, reckoned: tuple[float, float, float]):
    """One round of the root: a menu's customers are the restaurants' tables; all are seated anew."""

    def run(root: pa.Table, sent: pa.Table) -> pa.Table:
        menu = root["menu"][0].as_py()
        ids, seen, alone = _read(root, 0, "ids", "seen", "alone")
        more, n = _gathered(sent, "guests")
        guests = alone.astype(np.int64)
        guests[np.searchsorted(ids, more)] += n
        tables, movers = np.minimum(guests, 1), np.flatnonzero(guests > 1)
        tables[movers] = _drawn(guests[movers], np.full(len(movers), rate), discount, np.random.default_rng((menu, round_)).random(len(movers)))
        sums = [guests.sum(), tables.sum(), (guests == 1).sum(), (guests == 2).sum()]
        known = (guests - discount * tables)[_held(ids, shared.value.dishes)]
        return _menu(menu, [ids, seen, alone, guests, tables, _averaged(root, reckoned, round_ - BURN_IN)], sums, known)

    return run


def _priced(reckoned: tuple[float, float, float]):
    """The root's predictive of the words that buckets ask for."""

    def run(root: pa.Table, asked: pa.Table) -> pa.Table:
        (ids,), (wanted, ends) = _read(root, 0, "ids"), _all(asked, "ids")
        chance = _chances(root, reckoned)[np.searchsorted(ids, wanted)]
        return pa.table([*(asked[c].combine_chunks() for c in ("bucket", "menu")), _pieces("chance", chance, ends)], ["bucket", "menu", "chance"])

    return run


def _shares(rounds: int, reckoned: tuple[float, float, float]):
    """(menu, ids, seen, chance, known): the predictive's mean over all rounds after burn-in; that of the counted words besides."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = pa.Table.from_batches([batch.slice(i, 1)])
                (ids,), chance = _read(one, 0, "ids"), _averaged(one, reckoned, rounds)
                packed = [_pieces(c, x, np.array([0, len(x)])) for c, x in (("chance", chance), ("known", chance[ids >= 0]))]
                yield pa.RecordBatch.from_arrays([*(one[c].combine_chunks() for c in ("menu", "ids", "seen")), *packed], ["menu", "ids", "seen", "chance", "known"])

    return run


def _rarer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, share) of the words beyond the counted ones."""
    for batch in batches:
        for i in range(batch.num_rows):
            ids, chance = _read(batch, i, "ids", "chance")
            yield pa.RecordBatch.from_arrays([pa.array(ids[ids < 0]), pa.array(chance[ids < 0])], ["id", "share"])


def _by_count(dishes: int):
    """(seen, words, share): sums by training count, of words whose chances aren't broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, seen, chance = _read(batch, i, "ids", "seen", "chance")
                beyond = ~_held(ids, dishes)
                counts, of, words = np.unique(seen[beyond], return_inverse=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(counts), pa.array(words), pa.array(np.bincount(of, chance[beyond], len(counts)))], ["seen", "words", "share"])

    return run


def _row(schema: str, values: list) -> pa.RecordBatch:
    """One row: the bucket, squeezed arrays, and pairs of arrays as a list of structs."""
    names, out = [], []
    for field, value in zip(schema.split(", "), values, strict=True):
        name, kind = field.split(" ")
        names.append(name)
        if kind == "binary":
            out.append(_pieces(name, value, np.array([0, len(value)])))
        elif kind == "int":
            out.append(pa.array([value], pa.int32()))
        else:
            inner = pa.StructArray.from_arrays([pa.array(v, pa.int64()) for v in value], ["id", "n"])
            out.append(pa.ListArray.from_arrays(pa.array([0, len(inner)], pa.int32()), inner))
    return pa.RecordBatch.from_arrays(out, names)


def _seated(shared_model, shared_root, round_: int):
    """One round: seatings from the state before, and running means of tables after burn-in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared_model.value
        parent, parted = shared_root.value
        vocab, discount, strength = model.vocab, model.discount, model.strength
        for batch in batches:
            for i in range(batch.num_rows):
                bucket = batch["bucket"][i].as_py()
                contexts, alone, moving, words, guests = _read(batch, i, "contexts", "alone", "moving", "words", "guests")
                house, held = np.repeat(np.arange(len(contexts)), moving), _held(words, vocab.dishes)
                chance = np.empty(len(words))
                chance[held] = parent[words[held]]
                if not held.all():
                    ids, of = np.unique(words[~held], return_inverse=True)
                    answers, told = sorted(batch["beyond"][i].as_py(), key=lambda r: r["menu"]), np.empty(len(ids))
                    told[vocab.by_menu(ids)[0]] = np.concatenate([_spread(r["chance"], np.float64) for r in answers])
                    chance[~held] = told[of]
                seats = Seating(guests, discount, _read(batch, i, "tables")[0].astype(np.int64) if round_ else None)
                parts = vocab.parted(contexts)
                here = np.bincount(house, weights=seats.tables(), minlength=len(contexts)) + alone
                # All parts of a context have the same draw, given its tables in the round before; at first as many in each part as here.
                rates = np.full(len(contexts), np.nan)
                for j in np.flatnonzero(parts > 1).tolist():
                    total = parted.get(int(contexts[j]), here[j] * parts[j])
                    rates[j] = np.random.default_rng((int(contexts[j]), round_)).gamma(strength / discount + total)
                seats.gibbs(np.random.default_rng((bucket, round_)), chance, discount, strength, 1, house, alone.astype(float), rates)
                tables = seats.tables()
                mean = _read(batch, i, "mean")[0].astype(float) if round_ else np.zeros(len(guests))
                if round_ >= BURN_IN:
                    mean += (tables - mean) / (round_ - BURN_IN + 1)
                here = np.bincount(house, weights=tables, minlength=len(contexts)) + alone
                yield _row(_STATE, [bucket, contexts, alone, moving, words, guests, tables, mean, (contexts[parts > 1], here[parts > 1].astype(np.int64))])

    return run


def _discount(once: int, twice: int) -> float:
    """From the numbers of dishes seen once and twice, as in Kneser-Ney smoothing; inside (0, 1)."""
    return min(0.95, max(0.05, once / (once + 2 * twice))) if once else 0.5


@dataclass
class Model:
    """The root's averaged predictive of the counted words, and what restaurants are reckoned with."""

    #: Of the dishes whose chances are broadcast, and of all other words together.
    log_known: np.ndarray
    vocab: Vocabulary
    discount: float
    strength: float
    #: Mean tables of the counted words' restaurants.
    tables: np.ndarray
    #: The root's predictive of the counted words, and of a word never seen.
    shares: np.ndarray
    unknown: float = 1.0
    #: The mean predictive of those other words by their training counts.
    by_count: dict[int, float] = field(default_factory=dict)
    #: (id, share): the root's predictive of the words beyond the counted ones.
    rarer: DataFrame | None = None

    def light(self) -> Model:
        """For tasks: without the words, and without what only Spark has."""
        return replace(self, vocab=self.vocab.light(), rarer=None)

    def rare(self, counts: np.ndarray) -> np.ndarray:
        """log10 of such a word's mean share of ``log_known``'s last, by its training count; 0 is the unknown word's."""
        return np.log10([self.by_count.get(n, self.unknown) for n in counts.tolist()]) - self.log_known[0][-1]

    def held(self, ids: np.ndarray) -> np.ndarray:
        """The root's predictive of the counted words, that of a word never seen for the others."""
        out = np.full(len(ids), self.unknown)
        out[ids >= 0] = self.shares[ids[ids >= 0]]
        return out

    def parent(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The root's predictive of words by their ids and training counts; on the driver, for those who want to look at it."""
        out, beyond = self.held(ids), np.flatnonzero((ids < 0) & (counts > 0))
        if len(beyond):
            share = {r.id: r.share for r in self.rarer.where(F.col("id").isin(ids[beyond].tolist())).collect()}
            out[beyond] = [share[i] for i in ids[beyond].tolist()]
        return out

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 1.0) / (self.vocab.tokens + (self.vocab.types + 1.0)))


@dataclass
class Learned:
    """What the corpus has taught, as tables that grow with it."""

    #: (word, n, tables, parent) of the words that the vocabulary doesn't hold: training count, mean tables as a context, the root's predictive.
    words: DataFrame
    #: (bucket, _PACKED, guests, mean), squeezed: customers of each dish in each context; mean tables of those with more than one.
    packed: DataFrame

    @property
    def restaurants(self) -> DataFrame:
        """``packed`` as plain arrays, but for the words, for those who want to look at it."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    plain = [pa.array([x.tolist()], pa.list_(k)) for x, k in zip(_read(batch, i, "contexts", "runs", "guests", "mean"), (pa.int64(), pa.int32(), pa.int64(), pa.float32()), strict=True)]
                    one = batch.slice(i, 1)
                    yield pa.RecordBatch.from_arrays([one["bucket"], one["words"], *plain], ["bucket", "words", "contexts", "runs", "guests", "mean"])

        return self.packed.mapInArrow(run, "bucket int, words binary, contexts array<long>, runs array<int>, guests array<long>, mean array<float>")


def fit(texts: DataFrame) -> tuple[Model, Learned]:
    """The model of the training ``texts`` (text), and the restaurants and the rarer words, which stay in Spark."""
    return learn(code(texts))


@contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Each job's shuffle files go at its end; what is read again is in stages."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def learn(coded: DataFrame) -> tuple[Model, Learned]:
    """The model of the learned texts of ``coded``."""
    with _shuffles_removed(coded.sparkSession):
        return _learned(coded)


def _learned(coded: DataFrame) -> tuple[Model, Learned]:
    spark = coded.sparkSession
    counts = count_words(coded)
    vocab = vocabulary(counts)
    shared = spark.sparkContext.broadcast(vocab)
    rare_words = _rare_ids(counts, vocab)
    restaurants = stage(_restaurants(coded, shared), "restaurants", compression="zstd")
    dishes, strength, share = vocab.dishes, STRENGTH, 1.0 / (vocab.types + 1)  # the base's, of each word
    light = spark.sparkContext.broadcast(vocab.light())
    names = ["seen", "alone", "twice", "pairs"]
    sent = restaurants.select("words", "guests").mapInArrow(_to_root(light, names, _census), "menu int, ids binary" + "".join(f", {c} binary" for c in names))
    root = stage(sent.groupBy("menu").applyInArrow(_opened, _ROOT), "root", compression="zstd")
    once, twice, single, double = _summed_up(root.select("sums").collect())
    model = Model(np.zeros((1, dishes + 1)), vocab, _discount(once, twice), strength, np.zeros(len(vocab.words)), np.zeros(len(vocab.words)))
    known = spark.sparkContext.broadcast(model.light())
    menus = vocab.menu(np.arange(len(vocab.words)))
    # The first guess of the parent's predictive is the words' own shares.
    reckoned = 0.0, share, vocab.tokens + 1.0
    parent = (vocab.counts[:dishes] + share) / (vocab.tokens + 1)
    discount, tables = _discount(single, double), _root_tables(vocab, model.discount, _discount(single, double))
    state = stage(restaurants.mapInArrow(_moving, _MOVING), "moving", compression="zstd")
    asked = stage(state.select("bucket", "words").mapInArrow(_beyond(light), _ASKED), "asked", compression="zstd") if vocab.rare_types else None
    parted, unknown = {}, []
    for round_ in range(BURN_IN + SAMPLES):
        before = state, root
        if asked is not None:
            told = root.groupBy("menu").cogroup(asked.groupBy("menu")).applyInArrow(_priced(reckoned), "bucket int, menu int, chance binary")
            state = state.join(told.groupBy("bucket").agg(F.collect_list(F.struct("menu", "chance")).alias("beyond")), "bucket", "left")
        state = stage(state.mapInArrow(_seated(known, spark.sparkContext.broadcast((parent, parted)), round_), _STATE), "seating", compression="zstd")
        parted = {int(r.id): float(r.n) for r in state.select(F.explode("parted").alias("x")).groupBy("x.id").agg(F.sum("x.n").alias("n")).collect()}
        # The root's guests change with each round; its seating is carried on.
        rate = np.random.default_rng((dishes, round_)).gamma(strength / discount + tables) * share
        sent = state.select("words", "tables").mapInArrow(_to_root(light, ["guests"], _tables), "menu int, ids binary, guests binary")
        root = stage(root.groupBy("menu").cogroup(sent.groupBy("menu")).applyInArrow(_root_seated(light, round_, rate, discount, reckoned), _ROOT), "root", compression="zstd")
        for stale in before:
            unstage(stale)
        rows = root.select("menu", "sums", "known").collect()
        guests, tables, single, double = _summed_up(rows)
        fresh, whole = (strength + discount * tables) * share, strength + guests
        parent = np.zeros(dishes)
        for r in rows:
            parent[menus[:dishes] == r.menu] = (_spread(bytes(r.known), np.float64) + fresh) / whole
        reckoned, discount = (discount, fresh, whole), _discount(single, double)
        if round_ >= BURN_IN:
            unknown.append(fresh / whole)
    stale, root = root, stage(root.mapInArrow(_shares(SAMPLES, reckoned), "menu int, ids binary, seen binary, chance binary, known binary"), "shares", compression="zstd")
    unstage(stale)
    for r in root.select("menu", "known").collect():
        model.shares[menus == r.menu] = _spread(bytes(r.known), np.float64)
    model.unknown = others = float(np.mean(unknown))
    if asked is not None:
        unstage(asked)
        by_count = root.mapInArrow(_by_count(dishes), "seen long, words long, share double").groupBy("seen").agg(F.sum("words").alias("words"), F.sum("share").alias("share")).collect()
        model.by_count = {int(r.seen): r.share / r.words for r in by_count}
        others += sum(r.share for r in by_count)
    model.log_known = np.log10(np.append(model.shares[:dishes], others))[None]
    model.rarer = root.mapInArrow(_rarer, "id long, share double")
    totals = state.mapInArrow(_totals, "id long, tables double").union(restaurants.mapInArrow(_still, "id long, tables double"))
    held = totals.where("id >= 0").groupBy("id").agg(F.sum("tables").alias("tables")).toPandas()
    model.tables[held.id.to_numpy()] = held.tables.to_numpy()
    rarer = totals.where("id < 0").withColumn("parent", F.lit(0.0)).union(model.rarer.select("id", F.lit(0.0), "share"))
    words = rare_words.join(rarer.groupBy("id").agg(F.sum("tables").alias("tables"), F.sum("parent").alias("parent")), "id")
    return model, Learned(stage(words.select("word", "n", "tables", "parent"), "learned", compression="zstd"), restaurants.join(state.select("bucket", "mean"), "bucket"))


def _summed_up(rows: list) -> list[int]:
    return np.sum([[0, 0, 0, 0], *(r.sums for r in rows)], axis=0, dtype=np.int64).tolist()


def _root_tables(vocab: Vocabulary, discount: float, root_discount: float) -> float:
    """A first guess T of the root's tables: a word that c restaurants' tables ask for has about 1 + (1 - c**-root_discount) T / types."""
    counts = np.append(vocab.counts[: vocab.dishes], np.array(list(vocab.rare), dtype=np.int64)).astype(float)
    words = np.append(np.ones(vocab.dishes), list(vocab.rare.values()))
    return vocab.types**2 / float(counts ** (-discount * root_discount) @ words) if vocab.types else 0.0


def _answered(discount: float):
    """The pairs that blocks ask for of one bucket: guests less the discount of their tables, 0 where never seen."""

    def run(asked: pa.Table, held: pa.Table) -> pa.Table:
        contexts, (words, ends) = _all(asked, "contexts")[0], _all(asked, "words")
        out = np.zeros(len(words))
        if held.num_rows and len(words):
            houses, runs, menu, guests, mean = (_all(held, c)[0] for c in ("contexts", "runs", "words", "guests", "mean"))
            share = guests - discount
            share[guests > 1] = guests[guests > 1] - discount * mean
            dishes, dish = np.unique(menu, return_inverse=True)
            keys = np.repeat(np.arange(len(houses)), runs) * len(dishes) + dish
            house = np.minimum(np.searchsorted(houses, contexts), len(houses) - 1)
            of = np.repeat(np.where(houses[house] == contexts, house, -1), _all(asked, "runs")[0])
            dish = np.minimum(np.searchsorted(dishes, words), len(dishes) - 1)
            key = of * len(dishes) + dish
            at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            out = np.where((of >= 0) & (dishes[dish] == words) & (keys[at] == key), np.maximum(share[at], 0.0), 0.0)
        names = ["block", "bucket"]
        return pa.table([*(asked[c].combine_chunks() for c in names), _pieces("share", out, ends)], [*names, "share"])

    return run


def _asked_words(shared):
    """(block, at, word): the words of each block that the vocabulary doesn't hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                said = _said(batch, i)
                at = np.flatnonzero(shared.value.places(said) < 0)
                words = pa.array([said[j] for j in at.tolist()], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), batch["block"][i].as_py())), pa.array(at, pa.int32()), words], ["block", "at", "word"])

    return run


def _known(shared, out: T.StructType):
    """Blocks with the ids of their words in place of these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids = shared.value.ids(_said(batch, i))
                one = batch.slice(i, 1)
                yield pa.RecordBatch.from_arrays([*(one[c] for c in out.names[:-1]), _pieces("ids", ids, np.array([0, len(ids)]))], out.names)

    return run


def _summed(shared):
    """One block: its texts' log10 probabilities, from what its words and pairs were answered."""

    def run(coded: pa.Table, answers: pa.Table) -> pa.Table:
        model = shared.value
        vocab = model.vocab
        (ids, codes), lengths = _read(coded, 0, "ids", "codes"), _flat(coded, "lengths")
        flat = codes.astype(np.int64)
        pairs = _paired(flat, ids, vocab, tokens=True)
        of_words = answers.filter(answers["share"].is_null())
        of_pairs = answers.filter(answers["share"].is_valid()).sort_by("bucket")
        n, tables = vocab.counted(ids), np.zeros(len(ids))
        tables[ids >= 0] = model.tables[ids[ids >= 0]]
        at = of_words["at"].to_numpy()
        n[at], tables[at] = of_words["n"].to_numpy(), of_words["tables"].to_numpy()
        base, parent = model.base(n), model.held(ids)
        parent[at] = of_words["parent"].to_numpy()
        guests = model.strength + n
        back = (model.strength + model.discount * tables) / guests
        context = np.append(0, flat[:-1])
        # A word never learned may have the id of one that was; it has no pairs.
        shares = np.concatenate([_spread(x, np.float32) for x in of_pairs["share"].to_pylist()]).astype(float)
        share = shares[pairs.at] * ((n > 0)[context] & (n > 0)[flat])
        score = np.log10(share / guests[context] + back[context] * parent[flat])
        starts = np.cumsum(lengths) - lengths
        sums = [np.add.reduceat(x, starts) for x in ((n > 0)[flat].astype(np.int64), base[flat], score)]
        return pa.table([coded["row"].combine_chunks().flatten(), pa.array(lengths, pa.int64()), *map(pa.array, sums)], ["row", "n_tokens", "n_known", "base_score", "score"])

    return run


def score(docs: DataFrame, model: Model, learned: Learned, text: str = "text") -> DataFrame:
    """row (a struct of the columns of ``docs``), n_tokens, n_known, train_tokens, base_score, score.

    Whole texts are scored; NULL and empty texts are one end. base_score is the
    add-one unigram model's log10 probability, score this model's.
    """
    return score_coded(code(docs, text), model, learned)


def score_coded(coded: DataFrame, model: Model, learned: Learned) -> DataFrame:
    """As ``score``, for texts that are coded already, learned or not.

    The answers are written out, so that the shuffles that made them are gone
    when the blocks are shuffled to meet them.
    """
    context = coded.sparkSession.sparkContext
    shared, vocab = context.broadcast(model.light()), context.broadcast(model.vocab)
    pairs = _sent(coded, vocab, learning=False).groupBy("bucket").cogroup(learned.packed.groupBy("bucket"))
    pairs = pairs.applyInArrow(_answered(model.discount), "block long, bucket int, share binary")
    words = coded.select("block", "words").mapInArrow(_asked_words(vocab), "block long, at int, word string").join(learned.words, "word")
    with _shuffles_removed(coded.sparkSession):
        words = stage(words.select("block", "at", "n", "tables", "parent"), "known", compression="zstd")
        pairs = stage(pairs, "answered", compression="zstd")
    answers = pairs.unionByName(words, allowMissingColumns=True)
    of = coded.schema
    known = T.StructType([of["block"], of["row"], of["lengths"], of["codes"], T.StructField("ids", T.BinaryType())])
    row = T.StructField("row", of["row"].dataType.elementType)
    sums = T.StructType([row, *(T.StructField(c, k()) for c, k in (("n_tokens", T.LongType), ("n_known", T.LongType), ("base_score", T.DoubleType), ("score", T.DoubleType)))])
    blocks = coded.select("block", "row", "lengths", "codes", "words").mapInArrow(_known(vocab, known), known)
    scored = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_summed(shared), sums)
    return scored.select("row", "n_tokens", "n_known", F.lit(model.vocab.tokens).cast("long").alias("train_tokens"), "base_score", "score")
