"""Two tokenisations of the same texts, aligned.

A text is tokenised whole by both tokenizers. Where tokens that begin with a
space begin together in both, the tokens before them end together: such places,
verified by byte offsets, cut a text into windows, about a word each. How the
tokens of a window go together depends on nothing but their ids, so windows are
aligned once for each tuple of ids and remembered.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliospark.llm import bpe
from heliospark.llm.common import stage

#: Windows that a worker remembers; it starts afresh beyond that.
REMEMBERED = 400_000
#: Bytes of text that are aligned at a time within a batch.
TEXT_BYTES = 2_000_000
#: Runs of characters that A's quick library isn't given.
LONG = 4_000
#: Distinct pairs of ids up to which their counts are broadcast (16 bytes each); beyond it they are joined by a shuffle.
BROADCAST_PAIRS = 1 << 20
#: How two ids make one long integer.
SHIFT = 32
#: Fixed value: what pieces hold for a space.
_SPACE = "▁"


class Pieces:
    """A sentencepiece model and the bytes of its ids."""

    def __init__(self, model: bytes) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        names = map(self.model.id_to_piece, range(self.model.get_piece_size()))
        self.tokens = [bytes([int(p[3:-1], 16)]) if self.model.is_byte(i) else p.replace(_SPACE, " ").encode() for i, p in enumerate(names)]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


class Aligned(NamedTuple):
    """Texts' alignments: groups and links of each, the groups written out, and its distinct linked pairs with how often."""

    groups: np.ndarray
    links: np.ndarray
    said: list[str]
    ends: np.ndarray
    pairs: np.ndarray
    times: np.ndarray


def by_rank(table: bpe.BytePair):
    """The same tokenizer in a library that merges by the ids of what is made; None where that may differ.

    It doesn't if ids follow the order of the merges and BPE makes every token
    of the token's own bytes: then no two tokens stand side by side, merged by
    no rule, whose bytes are a token.
    """
    made = table.rank[np.flatnonzero(table.rank >= 0)]
    if not (table.reachable.all() and (np.diff(made) > 0).all()):
        return None
    import tiktoken

    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=table.ids, special_tokens={})


def long_word(text: str) -> bool:
    """Whether a run of blanks or of others may be longer than LONG."""
    if len(text) <= LONG:
        return False
    words = list(map(len, text.split()))
    return max(words, default=0) > LONG or len(text) - sum(words) - len(words) > LONG


class Aligner:
    """Both tokenizers and the windows seen. A gets a space before each text, as B adds one itself."""

    def __init__(self, definition: str, model: bytes) -> None:
        self.a, self.b = bpe.tokenizer(definition), Pieces(model)
        self._quick = by_rank(self.a)
        self.sizes = [np.array([len(t) for t in x.tokens], dtype=np.int64) for x in (self.a, self.b)]
        self.spaced = [np.array([t.startswith(b" ") for t in x.tokens]) for x in (self.a, self.b)]
        # Each id as it is written: within a group, and at its end.
        marks = ((",", "|"), (",", ";"))
        self._written = [f"{i}{m}" for x, own in zip((self.a, self.b), marks, strict=True) for i in range(len(x.tokens)) for m in own]
        self._forget()

    def _forget(self) -> None:
        # Of each window seen, by its number: its groups written out, and where its links begin among all.
        self._windows: dict[bytes, int] = {}
        self._said: list[str] = []
        self._links, self._starts = np.zeros(0, dtype=np.int64), np.zeros(1, dtype=np.int64)

    def _tokens_a(self, texts: list[str]) -> list[list[int]]:
        if self._quick is None:
            return list(self.a.encode(texts, specials=False))
        # Very long words are left to the encoder that merges them by a heap.
        return [next(self.a.encode([t], specials=False)) if long_word(t) else self._quick.encode_ordinary(t) for t in texts]

    def tokens(self, texts: list[str]) -> list[tuple[list[int], list[int]] | None]:
        """Ids of both; None where there are none or either's bytes aren't those of space and text."""
        out = []
        for text, a, b in zip(texts, self._tokens_a([" " + t for t in texts]), self.b.encode(texts), strict=True):
            whole = b" " + text.encode()
            same = text and all(b"".join(map(x.tokens.__getitem__, ids)) == whole for x, ids in ((self.b, b), (self.a, a)))
            out.append((a, b) if same else None)
        return out

    def _learn(self, keys: list[bytes]) -> None:
        """New windows, all at once. A window's tokens are equally long on both sides, so their ends can be counted through."""
        flat = np.frombuffer(b"".join(keys), dtype=np.int32).astype(np.int64)
        lengths = np.fromiter(map(len, keys), dtype=np.int64) // 4
        mark = np.repeat(np.flatnonzero(flat < 0), lengths)
        places = np.arange(len(flat))
        in_a, in_b = places < mark, places > mark
        sides = [flat[in_a], flat[in_b]]
        ends = [np.cumsum(n[x]) for n, x in zip(self.sizes, sides, strict=True)]
        shared = [other[np.searchsorted(other, own)] == own for own, other in (ends, ends[::-1])]
        group = [np.cumsum(s) - s for s in shared]
        many = [np.bincount(g) for g in group]
        # Written group by group, A's tokens before B's.
        start = np.cumsum(many[0] + many[1]) - many[0] - many[1]
        codes = np.empty(len(sides[0]) + len(sides[1]), dtype=np.int64)
        for side, shift, first in ((0, 0, start), (1, 2 * len(self.a.tokens), start + many[0])):
            own = first - (np.cumsum(many[side]) - many[side])
            codes[np.arange(len(sides[side])) + own[group[side]]] = shift + 2 * sides[side] + shared[side]
        written = list(map(self._written.__getitem__, codes.tolist()))
        links = sides[0][shared[0]] << SHIFT | sides[1][shared[1]]
        window = np.repeat(np.arange(len(keys)), lengths)[in_a][shared[0]]
        stops, tokens = np.cumsum(np.bincount(window, minlength=len(keys))), np.cumsum(lengths - 1).tolist()
        self._windows.update(zip(keys, range(len(self._said), len(self._said) + len(keys)), strict=True))
        self._said += ["".join(written[a:b]) for a, b in zip([0, *tokens], tokens, strict=False)]
        self._starts = np.append(self._starts, len(self._links) + stops)
        self._links = np.append(self._links, links)

    def align(self, pairs: list[tuple[list[int], list[int]]]) -> Aligned:
        """The alignments of some texts, given as the ids of both; a text has one token of each at least."""
        ids, begins, places, first = [], [], [], np.zeros(0, dtype=np.int64)
        for side in (0, 1):
            flat = np.fromiter(chain.from_iterable([p[side] for p in pairs]), dtype=np.int64)
            sizes = self.sizes[side][flat]
            may = self.spaced[side][flat]
            # Texts follow each other and are equally long on both sides, so that their first tokens begin together, too.
            first = np.cumsum([0, *(len(p[side]) for p in pairs[:-1])])
            may[first] = True
            ids.append(flat)
            places.append(np.flatnonzero(may))
            begins.append((np.cumsum(sizes) - sizes)[may])
        near = np.minimum(np.searchsorted(begins[1], begins[0]), len(begins[1]) - 1)
        both = begins[1][near] == begins[0]
        at = [places[0][both], places[1][near[both]]]
        # Each window's key is one slice of bytes: the ids of A, a mark, the ids of B.
        counts = [np.diff(np.append(x, len(i))) for x, i in zip(at, ids, strict=True)]
        key_ends = np.cumsum(counts[0] + counts[1] + 1)
        keys = np.full(int(key_ends[-1]), -1, dtype=np.int32)
        key_starts = key_ends - counts[0] - counts[1] - 1
        keys[np.arange(len(ids[0])) + np.repeat(key_starts - at[0], counts[0])] = ids[0]
        keys[np.arange(len(ids[1])) + np.repeat(key_starts + counts[0] + 1 - at[1], counts[1])] = ids[1]
        packed = keys.tobytes()
        wanted = [packed[s:e] for s, e in zip((key_starts * 4).tolist(), (key_ends * 4).tolist(), strict=True)]
        if len(self._windows) > REMEMBERED:
            self._forget()
        known = list(map(self._windows.get, wanted))
        if missing := list({wanted[i] for i, w in enumerate(known) if w is None}):
            self._learn(missing)
            known = list(map(self._windows.__getitem__, wanted))
        number = np.array(known)
        # The windows of each text, and their links one after another.
        starts = np.searchsorted(at[1], first)
        many = self._starts[number + 1] - self._starts[number]
        text = np.repeat(np.arange(len(pairs)), np.diff(np.append(starts, len(number))))
        groups = np.bincount(text, many, len(pairs)).astype(np.int64)
        own = np.repeat(self._starts[number] - (np.cumsum(many) - many), many)
        links = self._links[np.arange(len(own)) + own]
        each = np.repeat(text, many)
        order = np.lexsort((links, each))
        links, each = links[order], each[order]
        new = np.flatnonzero(np.append(True, (links[1:] != links[:-1]) | (each[1:] != each[:-1])))
        said = ["".join(map(self._said.__getitem__, known[a:b]))[:-1] for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(known)], strict=True)]
        ends = np.cumsum(np.bincount(each[new], minlength=len(pairs)))
        return Aligned(groups, np.bincount(each, minlength=len(pairs)), said, ends, links[new], np.diff(np.append(new, len(links))))


@lru_cache(maxsize=1)
def aligner(definition: str, model: bytes) -> Aligner:
    """One for each worker process and pair of tokenizers."""
    return Aligner(definition, model)


def align(docs: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_a, n_b, n_groups, n_links, alignment, pairs, times): each text's two tokenisations, side by side.

    A is the byte-level BPE of ``a_path`` on a space and the text, B the
    sentencepiece model of ``b_path`` on the text; spelled-out special tokens are
    plain text. ``alignment`` lists the groups between shared ends as
    ``a1,a2|b1;a3|b2,b3``. Tokens that end together are linked: ``pairs`` holds
    each linked pair of ids of the text once (A's id shifted by 32 bits, and
    B's), ``times`` how often. NULL and empty texts, and texts whose bytes the
    tokens don't give back, have zeros, an empty alignment and no pairs. Rows
    stay one for one, repeated and NULL keys included; an empty table gives an
    empty result. The files are read by the driver and sent to the tasks.
    """
    spark = docs.sparkSession
    definition = bpe.load(spark, a_path)
    with open(b_path, "rb") as f:
        model = spark.sparkContext.broadcast(f.read())
    schema = ["key", "n_a", "n_b", "n_groups", "n_links", "alignment", "pairs", "times"]

    def columns_of(table: Aligner, texts: list[str | None]) -> list[pa.Array]:
        tokens = table.tokens([t or "" for t in texts])
        sound = np.array([t is not None for t in tokens])
        nothing = np.zeros(0, dtype=np.int64)
        found = table.align([t for t in tokens if t]) if sound.any() else Aligned(nothing, nothing, [], nothing, nothing, nothing)
        sizes = [np.array([len(t[i]) if t else 0 for t in tokens]) for i in (0, 1)]
        spread = [np.zeros(len(tokens), dtype=np.int64) for _ in range(3)]
        for full, part in zip(spread, (found.groups, found.links, np.diff(found.ends, prepend=0)), strict=True):
            full[sound] = part
        said = iter(found.said)
        offsets = pa.array(np.append(0, np.cumsum(spread[2])).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (found.pairs, found.times.astype(np.int64))]
        return [*map(pa.array, (*sizes, *spread[:2])), pa.array([next(said) if t else "" for t in tokens], pa.string()), *lists]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = aligner(definition.value, model.value)
        for batch in batches:
            sizes = np.cumsum([len(t) if t else 0 for t in batch["text"].to_pylist()])
            part = (sizes // TEXT_BYTES).tolist()
            start = 0
            while start < batch.num_rows:
                end = start + 1
                while end < batch.num_rows and part[end] == part[start]:
                    end += 1
                some = batch.slice(start, end - start)
                yield pa.RecordBatch.from_arrays([some["key"], *columns_of(table, some["text"].to_pylist())], schema)
                start = end

    narrow = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    made = narrow.mapInArrow(run, f"key {dict(narrow.dtypes)['key']}, n_a long, n_b long, n_groups long, n_links long, alignment string, pairs array<long>, times array<long>")
    return made.withColumnRenamed("key", key)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, count, best): how many links of all texts join a pair's ids; best if no pair of B's id has more."""
    each = aligned.select(F.explode(F.arrays_zip("pairs", "times")).alias("e")).groupBy(F.col("e.pairs").alias("pair")).agg(F.sum("e.times").alias("count"))
    counts = stage(each, "pair-counts")
    own = F.col("pair").bitwiseAND(F.lit((1 << SHIFT) - 1))
    most = counts.groupBy(own.alias("b")).agg(F.max("count").alias("most"))
    return stage(counts.withColumn("b", own).join(most, "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best")), "pair-counts")


def with_counts(aligned: DataFrame) -> DataFrame:
    """The columns of ``aligned`` but pairs and times, with n_best and count_sum, reckoned over all its rows.

    ``n_best``: links whose pair no other pair of the same id of B exceeds in
    count, ties included; ``count_sum``: the counts of the row's links, summed.
    """
    rows = stage(aligned.withColumn("at", F.monotonically_increasing_id()), "aligned")
    counts = pair_counts(rows)
    if counts.count() <= BROADCAST_PAIRS:
        counts = F.broadcast(counts)
    each = rows.select("at", F.explode(F.arrays_zip("pairs", "times")).alias("e")).select("at", F.col("e.pairs").alias("pair"), F.col("e.times").alias("times"))
    sums = each.join(counts, "pair").groupBy("at").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum"))
    whole = rows.drop("pairs", "times").join(sums, "at", "left").drop("at")
    return whole.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("n_best", "count_sum")})
