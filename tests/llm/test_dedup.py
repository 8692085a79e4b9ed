"""Exact, line and near-duplicate removal against brute force, and their awkward cases."""

import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from heliospark.llm import exact_dedup, line_dedup, simhash
from heliospark.llm.components import components
from heliospark.llm.cuckoo import CuckooFilter
from tests.llm.fixtures import awkward, clashing, documents


def ascii_lower(text):
    return (text or "").encode().lower()


def test_exact_dedup_awkward_rows(spark):
    docs = clashing(awkward(spark))
    found = exact_dedup.mark_duplicates(docs).collect()
    groups = Counter(ascii_lower(r.text) for r in docs.collect())
    assert len(found) == docs.count()
    assert sorted(r.group_size for r in found) == sorted(n for n in groups.values() for _ in range(n))
    assert sum(r.kept for r in found) == len(groups)
    four = [r for r in found if r.group_size == 4]
    assert {r.keep_id for r in four} == {5} and [r.doc_id for r in four if r.kept] == [5]


def test_exact_dedup_heavy_and_rare_agree(spark):
    rng = random.Random(1)
    texts = [(i, "hot" if rng.random() < 0.4 else f"text {rng.randrange(200)}") for i in range(3000)]
    docs = documents(spark, texts)
    wide, narrow = (sorted(map(tuple, exact_dedup.mark_duplicates(docs, heavy=k, tracked=t).collect())) for k, t in ((64, 512), (1, 8)))
    assert wide == narrow
    best = {}
    for i, t in texts:
        best[t] = max(i, best.get(t, -1))
    assert all(r[1] == best[dict(texts)[r[0]]] for r in wide)


def test_exact_dedup_broadcasts_winners_and_runs_no_python(spark, sf_dir):
    df = exact_dedup.mark_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    plan = df._jdf.queryExecution().toString()
    assert "Broadcast" in plan and "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("operator", [exact_dedup.mark_duplicates, line_dedup.drop_lines, simhash.near_duplicates, simhash.keep_one])
def test_empty_table(spark, operator):
    assert operator(documents(spark, [])).collect() == []


def brute_lines(texts, threshold):
    blanks = " \t\n\x0b\x0c\r"
    keys = [[ascii_lower(line.strip(blanks)) for line in (t or "").split("\n")] for t in texts]
    counts = Counter(k for ks in keys for k in set(ks))
    out = []
    for t, ks in zip(texts, keys, strict=True):
        lines = (t or "").split("\n")
        kept = [line for line, k in zip(lines, ks, strict=True) if not (k and counts[k] >= threshold)]
        out.append(("\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def test_line_dedup_against_brute_force(spark):
    rng = random.Random(2)
    shared = [f"Shared LINE {i}" for i in range(6)]
    texts = []
    for _ in range(400):
        lines = [rng.choice(shared[: 1 + rng.randrange(6)]) if rng.random() < 0.3 else f" own {rng.randrange(900)}\r" for _ in range(rng.randrange(6))]
        texts.append("\n".join(lines))
    texts += [None, "", "\n\n", " \t", "shared line 0", "shared line 0"]
    docs = clashing(documents(spark, list(enumerate(texts))))
    found = {r.row.doc_id: (r["kept"], r.n_lines, r.n_dropped) for r in line_dedup.drop_lines(docs, threshold=3).collect()}
    assert found == dict(enumerate(brute_lines(texts, 3)))


def test_line_store_is_reversible(spark):
    def keys(texts):
        return documents(spark, list(enumerate(texts))).select("doc_id", line_dedup.line_keys(F.col("text")).alias("keys"))

    first = [f"common\nrare {i}" for i in range(8)] + ["other"] * 4
    second = [f"other\nmore {i % 5}" for i in range(40)]
    once = line_dedup.LineStore(spark, threshold=5, shards=4)
    once.insert(keys(first))
    store = line_dedup.LineStore(spark, threshold=5, shards=4)
    store.insert(keys(first))
    store.insert(keys(second))
    assert {r.line for r in store.frequent_lines(keys(second), "doc_id").collect()} == {0, 1}
    store.delete(keys(second))
    counts = [sorted((r.key, r.n_docs) for r in s.references().where("n_docs > 0").collect()) for s in (once, store)]
    assert counts[0] == counts[1]
    asked = keys(first + second)
    lines = [sorted(map(tuple, s.frequent_lines(asked.withColumn("doc_id", F.monotonically_increasing_id()), "doc_id").collect())) for s in (once, store)]
    assert lines[0] == lines[1] and len(lines[0]) == 8


def test_cuckoo_filter_inserts_and_deletes():
    rng = np.random.default_rng(3)
    keys = [rng.bytes(16) for _ in range(5000)]
    held = CuckooFilter.build(keys)
    assert held.contains(keys).all()
    assert held.contains([rng.bytes(16) for _ in range(5000)]).mean() < 0.01
    held.delete(keys[:2500])
    again = CuckooFilter.from_bytes(held.to_bytes())
    assert again.contains(keys[2500:]).all() and again.contains(keys[:2500]).mean() < 0.01


def brute_fingerprint(text):
    words = ascii_lower(text).split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [b" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(fps):
    """fps by key; the least key reachable over links of two bits or fewer."""
    keys = sorted(fps)
    root = {k: k for k in keys}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= 2:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: find(k) for k in keys}


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(4)
    base = [[f"w{rng.randrange(500)}" for _ in range(rng.randrange(1, 200))] for _ in range(60)]
    texts = []
    for words in base:
        for _ in range(rng.randrange(1, 5)):
            copy = list(words)
            if len(copy) > 20 and rng.random() < 0.7:
                copy[rng.randrange(len(copy))] = "changed"
            texts.append(" ".join(copy))
    texts += [None, "", " \n", "one", "ONE", "one two"]
    docs = clashing(documents(spark, list(enumerate(texts))))
    found = {r.key: (r.fp % 2**64, r.component) for r in simhash.near_duplicates(docs).collect()}
    fps = {i: brute_fingerprint(t) for i, t in enumerate(texts)}
    roots = brute_components(fps)
    assert found == {i: (fps[i], roots[i]) for i in fps}
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == set(roots.values())


def test_crowded_cells_lose_no_link(spark):
    """Hundreds of fingerprints whose segments have equal bit counts meet in the same cells."""
    rng = random.Random(5)
    fps = set()
    while len(fps) < 400:
        fps.add(sum(0b0011 << 4 * i if rng.random() < 0.93 else rng.choice((0b0101, 0b0110, 0b1001, 0b1010, 0b1100)) << 4 * i for i in range(16)))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    links = simhash.link_fingerprints(spark.createDataFrame([(f,) for f in signed], "fp long"))
    got = {r.node: r.root for r in components(links).collect()}
    keys = {f - (1 << 64) if f >> 63 else f: f for f in fps}
    want = brute_components(keys)
    assert {k: got.get(k, k) for k in keys} == want


def test_near_duplicates_awkward_rows(spark):
    docs = clashing(awkward(spark))
    found = simhash.near_duplicates(docs).collect()
    assert len(found) == docs.count()
    assert {r.component for r in found if r.fp == 0} == {1}
    kept = simhash.keep_one(docs).collect()
    assert len(kept) == len({r.component for r in found})


def test_components_of_a_long_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 201)} | {1000 + i: 1000 for i in range(1, 300)}
