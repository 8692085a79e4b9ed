"""Byte-level BPE: speculate with greedy longest matches, verify, merge only where that fails.

A sequence of tokens is what BPE makes of its bytes if and only if each token
is what BPE makes of its own bytes and each adjacent pair is what BPE makes of
the pair's bytes. Words are cut greedily into the longest tokens; all tokens
and adjacent pairs of a batch are tested at once by undoing merges on arrays;
words that fail go through the merges one by one.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterable, Iterator
from functools import lru_cache
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: how byte-level tokenizers cut a text into words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words whose tokens a worker remembers; it starts afresh beyond that.
REMEMBERED = 200_000
#: Up to so many bytes a word is merged by scanning its pairs, beyond it with a heap.
SHORT = 48
#: Characters of text that are handled at a time within a batch.
TEXT_CHARS = 4_000_000
_NEVER = np.iinfo(np.int64).max
_SHIFT = 21


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class BytePair:
    def __init__(self, definition: str) -> None:
        spec = json.loads(definition)
        letters = _byte_letters()

        def raw(token: str) -> bytes:
            return bytes(letters[c] for c in token)

        vocab = spec["model"]["vocab"]
        self.specials = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = 1 + max([*vocab.values(), *self.specials.values()])
        self.tokens: list[bytes] = [b""] * size
        for token, i in vocab.items():
            if token not in self.specials:
                self.tokens[i] = raw(token)
        self.ids = {t: i for i, t in enumerate(self.tokens) if t}
        for content, i in self.specials.items():
            self.tokens[i] = content.encode()
        # The longest token that begins with given bytes, three at most.
        self.longest: dict[bytes, int] = {}
        for token in self.ids:
            self.longest[token[:3]] = max(self.longest.get(token[:3], 0), len(token))
        if missing := [b for b in range(256) if bytes([b]) not in self.ids]:
            raise ValueError(f"the vocabulary lacks the bytes {missing}")
        merges = [tuple(raw(x) for x in (m.split(" ") if isinstance(m, str) else m)) for m in spec["model"]["merges"]]
        left, right, made = (np.array([self.ids[f(m)] for m in merges], dtype=np.int64) for f in (lambda m: m[0], lambda m: m[1], lambda m: m[0] + m[1]))
        self.merge_of = {(a, b): (i, c) for i, (a, b, c) in enumerate(zip(left.tolist(), right.tolist(), made.tolist(), strict=True))}
        # Rank of the merge that makes a token, -1 for single bytes; and its two parts.
        self.rank = np.full(size, -1, dtype=np.int64)
        self.rank[made[::-1]] = np.arange(len(merges))[::-1]
        self.left, self.right = np.arange(size), np.arange(size)
        self.left[made[::-1]], self.right[made[::-1]] = left[::-1], right[::-1]
        keys = left << _SHIFT | right
        order = np.argsort(keys, kind="stable")
        self._keys, self._ranks = keys[order], order
        self.reachable = self._reachable()
        self._split = regex.compile(PATTERN).findall
        self._apart = regex.compile("|".join(regex.escape(s) for s in sorted(self.specials, key=len, reverse=True))) if self.specials else None
        self._known: dict[str, tuple[int, ...]] = {}
        self._older: dict[str, tuple[int, ...]] = {}

    def _pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left << _SHIFT | right
        at = np.minimum(np.searchsorted(self._keys, keys), len(self._keys) - 1)
        return np.where(self._keys[at] == keys, self._ranks[at], _NEVER) if len(self._keys) else np.full(len(keys), _NEVER)

    def compatible(self, left: np.ndarray, right: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
        """Whether BPE leaves each pair as it is, given that it makes each token of its own bytes.

        Merges are undone, last first. Whenever the tokens at the border could
        have merged before the merge that used one of them up, the pair falls.
        Of equal merges the left one comes first.
        """
        good = np.ones(len(left), dtype=bool)
        at, l, r = np.arange(len(left)), left.astype(np.int64), right.astype(np.int64)
        limit = np.full(len(left), _NEVER) if limit is None else limit.astype(np.int64)
        while len(at):
            falls = self._pair_rank(l, r) < limit
            good[at[falls]] = False
            rl, rr = self.rank[l], self.rank[r]
            on = ~falls & ((rl >= 0) | (rr >= 0))
            at, l, r, rl, rr = at[on], l[on], r[on], rl[on], rr[on]
            undo_left = rl > rr
            limit = np.where(undo_left, rl, rr + 1)
            l, r = np.where(undo_left, self.right[l], l), np.where(undo_left, r, self.left[r])
        return good

    def _reachable(self) -> np.ndarray:
        """Whether BPE makes each token of its own bytes."""
        made = np.flatnonzero(self.rank >= 0)
        good = np.ones(len(self.rank), dtype=bool)
        good[made] = self.compatible(self.left[made], self.right[made], self.rank[made])
        while True:
            now = good & good[self.left] & good[self.right]
            if (now == good).all():
                return now
            good = now

    def _greedy(self, word: bytes) -> list[int]:
        found = self.ids.get(word)
        if found is not None:
            return [found]
        ids, longest, out, at, end = self.ids, self.longest, [], 0, len(word)
        while at < end:
            stop = at + (longest.get(word[at : at + 3]) or 2)
            while (found := ids.get(word[at:stop])) is None:
                stop -= 1
            out.append(found)
            at = min(stop, end)
        return out

    def merge(self, word: bytes) -> list[int]:
        """The word's tokens by its merges, least rank first, leftmost of equals."""
        part = [self.ids[word[i : i + 1]] for i in range(len(word))]
        if len(part) <= SHORT:
            return self._merge_short(part)
        n, after, before = len(part), list(range(1, len(part) + 1)), list(range(-1, len(part) - 1))
        heap: list[tuple[int, int, int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (m := self.merge_of.get((part[i], part[j]))):
                heapq.heappush(heap, (m[0], i, part[i], part[j], m[1]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            j = after[i]
            if part[i] != a or j >= n or part[j] != b:
                continue
            part[i], part[j] = made, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [p for p in part if p >= 0]

    def _merge_short(self, part: list[int]) -> list[int]:
        merge_of, none = self.merge_of.get, (_NEVER, 0)
        open_ = [merge_of(pair, none) for pair in zip(part, part[1:], strict=False)]
        while open_:
            least = min(open_)
            if least is none:
                break
            i = open_.index(least)
            part[i : i + 2] = [least[1]]
            del open_[i]
            if i < len(open_):
                open_[i] = merge_of((part[i], part[i + 1]), none)
            if i:
                open_[i - 1] = merge_of((part[i - 1], part[i]), none)
        return part

    def encode_words(self, words: list[str]) -> list[tuple[int, ...]]:
        raw = [w.encode() for w in words]
        tried = [self._greedy(w) for w in raw]
        sizes = np.fromiter(map(len, tried), dtype=np.int64, count=len(tried))
        flat = np.fromiter(chain.from_iterable(tried), dtype=np.int64, count=int(sizes.sum()))
        owner = np.repeat(np.arange(len(tried)), sizes)
        bad = np.zeros(len(tried), dtype=bool)
        bad[owner[~self.reachable[flat]]] = True
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        pairs, which = np.unique(flat[inner] << _SHIFT | flat[inner + 1], return_inverse=True)
        good = self.compatible(pairs >> _SHIFT, pairs & ((1 << _SHIFT) - 1))
        bad[owner[inner[~good[which]]]] = True
        for i in np.flatnonzero(bad).tolist():
            tried[i] = self.merge(raw[i])
        return [tuple(t) for t in tried]

    def _learn(self, cut: list[list]) -> dict[str, tuple[int, ...]]:
        if len(self._known) > REMEMBERED:
            self._older, self._known = self._known, {}
        known, older = self._known, self._older
        words = {w for w in set(chain.from_iterable(cut)) if w.__class__ is str and w not in known}
        known.update((w, older[w]) for w in words & older.keys())
        new = list(words - older.keys())
        known.update(zip(new, self.encode_words(new), strict=True))
        return known

    def _cut(self, text: str | None, specials: bool) -> list:
        """Words, and the ids of special tokens where the text spells them."""
        if not text:
            return []
        if not specials or not self._apart or not any(s in text for s in self.specials):
            return self._split(text)
        out, at = [], 0
        for m in self._apart.finditer(text):
            out += self._split(text[at : m.start()])
            out.append(self.specials[m.group()])
            at = m.end()
        return out + self._split(text[at:])

    def encode(self, texts: Iterable[str | None], specials: bool = True) -> Iterator[list[int]]:
        """Token ids of each text; NULL has none. ``specials``: spelled-out special tokens become their ids."""
        held: list[str | None] = []
        size = 0
        for text in chain(texts, [Ellipsis]):
            if text is not Ellipsis:
                held.append(text)
                size += len(text or "")
            if held and (text is Ellipsis or size >= TEXT_CHARS):
                cut = [self._cut(t, specials) for t in held]
                known = self._learn(cut)
                for words in cut:
                    yield list(chain.from_iterable([known[w] if w.__class__ is str else (w,) for w in words]))
                held, size = [], 0

    def decode(self, ids: Iterable[int]) -> str:
        """The text; bytes that aren't UTF-8 become replacement characters."""
        return b"".join(map(self.tokens.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def tokenizer(definition: str) -> BytePair:
    """One for each worker process and definition."""
    return BytePair(definition)


def load(spark, path: str):
    """The tokenizer file (a few MB, read by the driver), sent to the executors once."""
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", specials: bool = True) -> DataFrame:
    """(key, ids): the token ids of each text, array<int>; NULL and empty texts have none."""
    shared = load(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = tokenizer(shared.value)
        for batch in batches:
            ids = [np.array(x, dtype=np.int32) for x in table.encode(batch["text"].to_pylist(), specials)]
            ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
            flat = pa.array(np.concatenate([np.zeros(0, np.int32), *ids]))
            yield pa.RecordBatch.from_arrays([batch["key"], pa.ListArray.from_arrays(pa.array(ends), flat)], [key, "ids"])

    narrow = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return narrow.mapInArrow(run, f"`{key}` {dict(narrow.dtypes)['key']}, ids array<int>")


def decode(tokens: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, text): the text of each row's token ids; NULL ids give the empty text."""
    shared = load(tokens.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = tokenizer(shared.value)
        for batch in batches:
            texts = [table.decode(x or []) for x in batch["ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["key"], pa.array(texts, pa.string())], [key, "text"])

    narrow = tokens.select(F.col(key).alias("key"), F.col(ids).alias("ids"))
    return narrow.mapInArrow(run, f"`{key}` {dict(narrow.dtypes)['key']}, text string")


def round_trip(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256): each text encoded and its ids decoded, in one pass.

    The digests are those of the decimal ids joined by commas and of the decoded text.
    """
    shared = load(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = tokenizer(shared.value)
        decimal = [str(i).encode() for i in range(len(table.tokens))]
        for batch in batches:
            counts, coded, decoded = [], [], []
            for ids in table.encode(batch["text"].to_pylist()):
                counts.append(len(ids))
                coded.append(sha256(b",".join(map(decimal.__getitem__, ids))).hexdigest())
                decoded.append(sha256(table.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch["key"], pa.array(counts, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())], [key, "n_tokens", "ids_sha256", "decoded_sha256"])

    narrow = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return narrow.mapInArrow(run, f"`{key}` {dict(narrow.dtypes)['key']}, n_tokens long, ids_sha256 string, decoded_sha256 string")
