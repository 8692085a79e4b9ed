"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

Terms are words and the first four to six letters of longer words. Those whose
document counts by label, over all training rows, tie them to the positive
label span the TF-IDF space. Training rows that hold such terms are the
examples; their inverted index keeps the largest weight of each term in each
block of examples, so that blocks which cannot reach a query's k-th best
cosine are not opened. Votes of the k nearest are weighted by their distance;
how steeply, and against how strong a prior, is chosen by the leave-one-out
log loss of the examples. Documents without such terms share the rate of the
training rows without any.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain, filterfalse

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliospark.llm.common import stage

#: Bounds of the fit: labelled rows read (in expectation), terms, examples kept. They bound what is broadcast.
LABELLED, TERMS, EXAMPLES = 200_000, 20_000, 20_000
#: A term needs this many positive rows, and log odds that stay above LEAST_ODDS when SIGMAS standard errors are taken off.
SUPPORT, LEAST_ODDS, SIGMAS = 3, 2.5, 1.28
NEIGHBOURS, BLOCK = 16, 128
#: Documents that score so high are toxic.
REJECT = 0.7
_PREFIXES = (4, 5, 6)
_words = re.compile(r"[^\W\d_]+").findall
#: Terms that one task counts before it passes its counts on.
_HELD_TERMS = 400_000


#: Bytes of words stay; what is ASCII and no letter parts them.
_LETTERS = bytes(c if chr(c).isalpha() or c > 127 else 32 for c in range(256))
#: Words whose terms a task keeps for the next text.
_HELD_WORDS = 200_000


def words_of(text: str | None) -> list[str]:
    """The words, in any order; the pattern is asked only where a piece is not ASCII alone, as it is several times slower."""
    pieces = (text or "").lower().encode().translate(_LETTERS).decode().split()
    words = list(filter(str.isascii, pieces))
    if len(words) < len(pieces):
        words += chain.from_iterable(map(_words, filterfalse(str.isascii, pieces)))
    return words


def _terms(word: str) -> tuple[str, ...]:
    """The word and its prefixes, which are marked by a star."""
    return word, *(word[:size] + "*" for size in _PREFIXES if len(word) > size)


class _Terms(dict):
    """Terms by word, reckoned once for each word."""

    def __missing__(self, word: str) -> tuple[str, ...]:
        found = self[word] = _terms(word)
        return found


def terms_of(text: str | None) -> Counter:
    """How often each term is in the text; prefixes are marked by a star."""
    out: Counter = Counter()
    for word, n in Counter(words_of(text)).items():
        for term in _terms(word):
            out[term] += n
    return out


@dataclass
class Neighbours:
    """The index and what was learned with it; small, and sent to the executors whole."""

    terms: dict[str, int]
    idf: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    #: Rows of the examples: offsets, terms, weights.
    starts: np.ndarray
    columns: np.ndarray
    weights: np.ndarray
    none_rate: float
    steepness: float = 1.0
    prior: float = 1.0
    rate: float = 0.0
    postings: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    #: Places of the terms of the words that have any; the first letters of all terms.
    _hits: dict = field(default_factory=dict)
    _heads: set = field(default_factory=set)

    def build(self) -> None:
        """For each term: its examples, their weights, its blocks, the largest weight in each block."""
        owner = np.repeat(np.arange(len(self.ids)), np.diff(self.starts))
        order = np.lexsort((owner, self.columns))
        columns, owner, weights = self.columns[order], owner[order], self.weights[order]
        edges = np.searchsorted(columns, np.arange(len(self.terms) + 1))
        self.postings = []
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            who, w = owner[a:b], weights[a:b]
            blocks, at = np.unique(who // BLOCK, return_index=True)
            self.postings.append((who, w, blocks, np.maximum.reduceat(w, at) if len(w) else w))

    def vector(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Terms of the space and their weights, of length one; only words that begin as a term does are looked up, once for many texts."""
        if len(self._hits) > _HELD_WORDS:
            self._hits.clear()
        if not self._heads:
            self._heads = {t[: _PREFIXES[0]] for t in self.terms}
        words, hits, heads, head, counts = words_of(text), self._hits, self._heads, _PREFIXES[0], Counter()
        near = {w for w in set(words) if w[:head] in heads}
        for word in near.difference(hits):
            hits[word] = tuple(self.terms[t] for t in _terms(word) if t in self.terms)
        if near:
            for word, n in Counter(filter(near.__contains__, words)).items():
                for t in hits[word]:
                    counts[t] += n
        return self.weigh(counts)

    def weigh(self, counts: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        columns = np.array(sorted(counts), dtype=np.int64)
        w = (1 + np.log([counts[c] for c in columns.tolist()])) * self.idf[columns] if len(columns) else np.zeros(0)
        return columns, w / np.sqrt((w * w).sum()) if len(w) else w

    def nearest(self, columns: np.ndarray, weights: np.ndarray, k: int = NEIGHBOURS, but: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of the largest cosine above zero and their cosines; ties to the smaller place.

        Blocks are opened from the largest bound down, until no bound is as large as the k-th best cosine.
        """
        bound = np.zeros(-(-len(self.ids) // BLOCK))
        for c, w in zip(columns.tolist(), weights.tolist(), strict=True):
            _, _, blocks, most = self.postings[c]
            bound[blocks] += w * most
        best, scores = np.zeros(0, dtype=np.int64), np.zeros(0)
        for block in np.argsort(-bound, kind="stable").tolist():
            if bound[block] <= 0 or (len(best) == k and bound[block] < scores[-1] - 1e-12):
                break
            cosine = np.zeros(BLOCK)
            for c, w in zip(columns.tolist(), weights.tolist(), strict=True):
                who, ws, _, _ = self.postings[c]
                a, b = np.searchsorted(who, (block * BLOCK, (block + 1) * BLOCK))
                cosine[who[a:b] - block * BLOCK] += w * ws[a:b]
            hit = np.flatnonzero(cosine > 0)
            hit = hit[hit + block * BLOCK != but]
            places, values = np.concatenate([best, hit + block * BLOCK]), np.concatenate([scores, cosine[hit]])
            order = np.lexsort((places, -values))[:k]
            best, scores = places[order], values[order]
        return best, scores

    def vote(self, labels: np.ndarray, cosines: np.ndarray, steepness: float, prior: float) -> float:
        # Nearest examples that share little of the text's direction say little.
        weight = cosines**2 / (1.05 - np.minimum(cosines, 1.0)) ** steepness
        return float((weight @ labels + prior * self.rate) / (weight.sum() + prior))

    def score(self, text: str | None) -> tuple[float, list[int], list[float]]:
        """Score, ids and cosines of the examples that gave it."""
        columns, weights = self.vector(text)
        if not len(columns):
            return self.none_rate, [], []
        best, cosines = self.nearest(columns, weights)
        if not len(best):
            return self.none_rate, [], []
        return self.vote(self.labels[best], cosines, self.steepness, self.prior), self.ids[best].tolist(), cosines.tolist()

    def calibrate(self, sample: int = 2000) -> None:
        """The vote's steepness and prior, by the log loss of examples scored by the others."""
        found = []
        for i in range(0, len(self.ids), max(1, len(self.ids) // sample)):
            row = slice(self.starts[i], self.starts[i + 1])
            best, cosines = self.nearest(self.columns[row], self.weights[row], but=i)
            if len(best):
                found.append((self.labels[i], self.labels[best], cosines))

        def loss(steepness: float, prior: float) -> float:
            p = np.array([self.vote(labels, cosines, steepness, prior) for _, labels, cosines in found])
            y = np.array([f[0] for f in found])
            return float(-np.log(np.clip(np.where(y == 1, p, 1 - p), 1e-9, 1)).sum())

        if found:
            grid = [(s, q) for s in (0.5, 1.0, 2.0) for q in (1.0, 2.0, 4.0)]
            self.steepness, self.prior = min(grid, key=lambda g: loss(*g))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: tuple[Counter, Counter] = (Counter(), Counter())
    rows, terms_by_word = [0, 0], _Terms()

    def passed_on() -> pa.RecordBatch:
        terms = list(held[0].keys() | held[1].keys())
        out = [["", *terms], [rows[1], *(held[1][t] for t in terms)], [rows[0], *(held[0][t] for t in terms)]]
        held[0].clear()
        held[1].clear()
        rows[:] = [0, 0]
        return pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64())], ["term", "pos", "neg"])

    for batch in batches:
        for text, label in zip(batch["text"].to_pylist(), batch["label"].to_pylist(), strict=True):
            if len(terms_by_word) > _HELD_WORDS:
                terms_by_word.clear()
            held[label].update(set().union(*map(terms_by_word.__getitem__, set(words_of(text)))))
            rows[label] += 1
            if len(held[0]) + len(held[1]) > _HELD_TERMS:
                yield passed_on()
    yield passed_on()


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", labelled: int = LABELLED, max_terms: int = TERMS, max_examples: int = EXAMPLES) -> Neighbours:
    """Neighbours from the labelled rows of ``docs``; ``labels`` (key, label 0 or 1) are all training rows.

    Labels that are NULL are left out; of repeated keys the larger label
    counts. At most about ``labelled`` rows are read (by a hash of their key),
    so that the labels can be broadcast; counts cover all of these.
    """
    known = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("label")).where("key is not null and label in (0, 1)").groupBy("key").agg(F.max("label").alias("label"))
    share = min(1.0, labelled / max(1, known.count()))
    known = known.where(F.pmod(F.xxhash64("key"), F.lit(1 << 20)) < int(share * (1 << 20)))
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(known), "key")

    counts = rows.select("text", "label").mapInArrow(_counted, "term string, pos long, neg long").groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    # Written out, as the placed rows below: they are read twice, and the texts behind them once.
    counts = stage(counts.where((F.col("pos") >= SUPPORT) | (F.col("term") == "")), "terms")
    total = counts.where("term = ''").first()
    n_pos, n_neg = (total.pos or 0, total.neg or 0) if total else (0, 0)

    def log_odds(n: str, of: int) -> Column:
        return F.log((F.col(n) + 0.5) / (F.lit(of) - F.col(n) + 0.5))

    error = F.sqrt(sum((1 / (x + 0.5) for x in (F.col("pos"), n_pos - F.col("pos"), F.col("neg"), n_neg - F.col("neg"))), F.lit(0.0)))
    strength = log_odds("pos", n_pos) - log_odds("neg", n_neg) - SIGMAS * error
    chosen = counts.where(F.col("term") != "").withColumn("strength", strength).where(F.col("strength") >= LEAST_ODDS)
    picked = chosen.orderBy(F.desc("strength"), "term").limit(max_terms).collect()
    terms = {r.term: i for i, r in enumerate(picked)}
    idf = np.array([math.log((1 + n_pos + n_neg) / (1 + r.pos + r.neg)) + 1 for r in picked])
    model = Neighbours(terms, idf, np.zeros(0, np.int64), np.zeros(0), np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0), 0.0)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space = shared.value
        for batch in batches:
            found = [space.vector(t) for t in batch["text"].to_pylist()]
            columns = pa.array([c.tolist() for c, _ in found], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch["key"], batch["label"], columns, pa.array([w.tolist() for _, w in found], pa.list_(pa.float64()))], ["key", "label", "columns", "weights"])

    placed = rows.select(F.col("key").cast("long").alias("key"), "label", "text").mapInArrow(vectors, "key long, label int, columns array<long>, weights array<double>")
    placed = stage(placed, "placed").withColumn("some", F.size("columns") > 0)
    # At most max_examples rows, and one row of counts.
    sample = placed.where("some").orderBy(F.xxhash64("key"), "key").limit(max_examples).collect()
    none = placed.where("not some").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("pos")).first()
    model.rate = (n_pos + 0.5) / (n_pos + n_neg + 1)
    model.none_rate = (none.pos + 0.5 * model.rate) / (none.n + 0.5)
    # Alike examples side by side, so that blocks differ in their largest weights.
    sample.sort(key=lambda r: (r.columns, r.key))
    model.ids, model.labels = np.array([r.key for r in sample], dtype=np.int64), np.array([r.label for r in sample], dtype=np.float64)
    model.starts = np.cumsum([0, *(len(r.columns) for r in sample)])
    model.columns = np.array([c for r in sample for c in r.columns], dtype=np.int64)
    model.weights = np.array([w for r in sample for w in r.weights], dtype=np.float64)
    model.build()
    model.calibrate()
    return model


def scored(docs: DataFrame, model: Neighbours, text: str = "text") -> DataFrame:
    """row (a struct of the columns of ``docs``), score, evidence (ids and cosines of the examples).

    Whole texts are read; NULL and empty texts, and others without a term of
    the space, have the rate of such training rows and no evidence.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("score double, evidence array<struct<id:long,cosine:double>>")
    def score(texts):
        import pandas as pd

        found = [shared.value.score(t) for t in texts]
        evidence = [[{"id": i, "cosine": c} for i, c in zip(ids, cosines, strict=True)] for _, ids, cosines in found]
        return pd.DataFrame({"score": [f[0] for f in found], "evidence": evidence})

    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    return docs.select(row, score(F.col(text)).alias("s")).select("row", "s.score", "s.evidence")
