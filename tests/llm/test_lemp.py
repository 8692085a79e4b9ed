"""Norm buckets against brute force: bounds on random vectors, whole searches on small corpora."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from heliospark.llm import lemp
from tests.llm.fixtures import awkward, clashing, documents, read

UPPER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
ITEMS = "item_id long, text string, doc_id long, score long"


def terms_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(UPPER))


def brute(docs, items, k):
    """(item, rank, doc, score) by the formulas, each row of docs a document."""
    counts = [(d, Counter(terms_of(t))) for d, t in docs]
    counts = [(d, c) for d, c in counts if c]
    n_all, total = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    asked = {}
    for i, t in items:
        if i is not None:
            asked.setdefault(i, set()).update(terms_of(t))
    out = []
    for i, terms in asked.items():
        scores = []
        for d, c in counts:
            m = 100 - 50 + (50 * sum(c.values()) * n_all) // total
            score = sum(math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m)) for t in terms if t in c)
            if score > 0 and d is not None:
                scores.append((-score, d))
        out += [(i, rank, d, -s) for rank, (s, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 10**9), st.integers(1, 60), st.integers(1, 30))
def test_no_row_that_reaches_the_threshold_is_dropped(seed, rows, width):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(1, width + 1, rows)
    terms = np.concatenate([rng.choice(width, n, replace=False) for n in sizes])
    impacts = rng.integers(0, 10**6, len(terms))
    ends = np.cumsum(sizes)
    norms = np.array([math.sqrt((impacts[e - n : e].astype(float) ** 2).sum()) for n, e in zip(sizes, ends, strict=True)])
    order = np.argsort(-norms, kind="stable")
    spans = [np.arange(ends[i] - sizes[i], ends[i]) for i in order]
    bucket = lemp.Bucket(order, norms[order], sizes[order], terms[np.concatenate(spans)], impacts[np.concatenate(spans)])
    asked = rng.choice(width + 5, rng.integers(1, width + 5), replace=False)
    weights = np.zeros(width + 5, dtype=np.int64)
    weights[asked] = rng.integers(1, 20_000, len(asked))
    exact = np.array([(weights[terms[s]] * impacts[s]).sum() for s in spans])
    assert (bucket.scores(np.arange(rows), weights) == exact).all()
    for floor in (0, int(np.median(exact)), int(exact.max()), int(exact.max()) + 1):
        found = set(bucket.survivors(asked, weights[asked], float(floor)).tolist())
        assert found >= set(np.flatnonzero((exact > 0) & (exact >= floor)).tolist())


def test_bounds_spare_work():
    """Of many short vectors and a few that match, only those that match are left."""
    rng = np.random.default_rng(5)
    rows, width = 4000, 500
    terms = np.concatenate([rng.choice(width, 10, replace=False) for _ in range(rows)])
    impacts = rng.integers(1, 300_000, len(terms))
    terms[:10], impacts[:10] = np.arange(10), 900_000
    norms = np.sqrt((impacts.reshape(rows, 10).astype(float) ** 2).sum(1))
    order = np.argsort(-norms, kind="stable")
    spread = (order[:, None] * 10 + np.arange(10)).ravel()
    bucket = lemp.Bucket(order, norms[order], np.full(rows, 10), terms[spread], impacts[spread])
    asked = np.arange(10)
    weights = np.full(10, 5000)
    best = 10 * 900_000 * 5000
    assert bucket.survivors(asked, weights, best * 0.5).tolist() == [0]
    assert not len(bucket.survivors(asked, weights, best * 2.0))


def test_terms_across_chunks(monkeypatch):
    text = " ".join(["Ab", "é9", "x_y", "日本", "\x7fq"] * 300)
    want = Counter(terms_of(text))
    wanted = {t.encode(): i for i, t in enumerate(want)}
    for size in (1, 7, 1000, lemp.CHUNK):
        monkeypatch.setattr(lemp, "CHUNK", size)
        n, found = lemp.counted_terms(text.encode(), wanted)
        assert n == sum(want.values()) and found == Counter({wanted[t.encode()]: c for t, c in want.items()})


def ranked(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize(("bucket", "first", "entries"), [(7, 40, lemp.ENTRIES), (lemp.BUCKET, lemp.FIRST, 700), (100, 1, lemp.ENTRIES)])
def test_given_documents(spark, sf_dir, bucket, first, entries):
    docs, items = (read(spark, sf_dir, n) for n in ("documents", "benchmark"))
    found = lemp.search(docs, items, bucket=bucket, first=first, entries=entries)
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()], 50)
    assert ranked(found) == want and len(want) > 1500


def test_awkward_rows(spark):
    docs = clashing(awkward(spark))
    rows = [(1, "One FOUR word3"), (1, "x 日本語"), (None, "one"), (2, None), (3, ""), (4, "absent"), (5, "é ü a b a"), (-7, "lorem lorem " * 50_000)]
    items = spark.createDataFrame([(*r, None, None) for r in rows], ITEMS)
    want = brute([(r.doc_id, r.text) for r in docs.collect()], rows, 3)
    assert ranked(lemp.search(docs, items, k=3, bucket=2, first=2)) == want and {w[0] for w in want} == {1, 5, -7}


def test_many_copies_tie_by_key(spark):
    rng = random.Random(4)
    texts = [(i, "alpha beta gamma") for i in rng.sample(range(10**6), 400)] + [(10**7 + i, f"alpha w{i} " * (i % 5 + 1)) for i in range(200)]
    items = spark.createDataFrame([(1, "beta alpha", None, None), (2, "gamma w7", None, None)], ITEMS)
    assert ranked(lemp.search(documents(spark, texts), items, bucket=32, first=10)) == brute(texts, [(1, "beta alpha"), (2, "gamma w7")], 50)


def test_empty_tables(spark, sf_dir):
    docs, items = (read(spark, sf_dir, n) for n in ("documents", "benchmark"))
    for d, i in ((docs.where("false"), items), (docs, items.where("false")), (documents(spark, [(1, ""), (2, None)]), items), (documents(spark, [(1, "nothing")]), items.limit(1))):
        assert lemp.search(d, i).collect() == []
