"""The corpus pipeline, each stage against brute force on what the stage before kept."""

import math
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from heliospark.llm import simhash
from heliospark.llm.common import stage
from tests.llm.fixtures import awkward, clashing, documents, read
from tests.llm.test_dedup import brute_lines


def test_stages_on_the_given_documents(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    columns = docs.columns
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line dedup", "simhash near-dedup", "packing"]
    toxic, lines, near, pack = (f for _, f in corpus_pipeline.STAGES)

    one = stage(toxic(spark, docs, sf_dir), "one")
    labels = {r.doc_id: r.toxic for r in read(spark, sf_dir, "labels").collect()}
    kept = {r.doc_id for r in one.collect()}
    gone = {r.doc_id for r in docs.select("doc_id").collect()} - kept
    assert gone and sum(labels.get(i) == 0 for i in gone) <= 0.05 * len(gone)

    two = stage(lines(spark, one, sf_dir), "two")
    before = {r.doc_id: r.text for r in one.collect()}
    want = dict(zip(before, brute_lines(before.values(), 10), strict=True))
    rows = {r.doc_id: r for r in two.collect()}
    assert {i: r.text for i, r in rows.items()} == {i: w[0] for i, w in want.items()}
    assert all(r.n_chars == len(r.text) for i, r in rows.items() if want[i][2])

    three = stage(near(spark, two, sf_dir), "three")
    assert {r.doc_id for r in three.collect()} == brute_similar({i: r.text for i, r in rows.items()})

    four = pack(spark, three, sf_dir).collect()
    assert len(four) == three.count()
    assert [d.columns for d in (one, two, three)] == [columns] * 3
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).collect())) == sorted(map(tuple, four))


def shingled(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[j : j + 5]) for j in range(max(1, len(words) - 4))}


def brute_similar(texts):
    """Least key of each group that all pairs of five-word Jaccard 0.8 or more make."""
    sets, holders = {i: shingled(t) for i, t in texts.items()}, {}
    for i, own in sets.items():
        for s in own:
            holders.setdefault(s, []).append(i)
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        # similar sets share one of any fifth of the larger one's members and one more
        some = sorted(sets[i])[: len(sets[i]) // 5 + 1]
        for j in {j for s in some for j in holders[s]}:
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {find(i) for i in texts}


@pytest.mark.parametrize("with_base", [True, False])
def test_near_stage_keeps_one_of_each_group_of_similar_documents(spark, sf_dir, with_base):
    """The given documents and large groups of edited copies, whose copies are alike or, with more edits, mostly not."""
    rng = random.Random(6)
    texts = {r.doc_id: r.text for r in read(spark, sf_dir, "documents").collect()}
    for group, edits in enumerate((1, 2, 3, 4)):
        base = [f"w{group}x{rng.randrange(300)}" for _ in range(150)]
        if with_base:
            texts[10**8 + group] = " ".join(base)
        for i in range(150):
            words = list(base)
            for at in rng.sample(range(150), edits):
                words[at] = f"new{group}y{i}z{at}"
            texts[10**9 + 1000 * group + i] = " ".join(words)
    docs = documents(spark, list(texts.items()))
    kept = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, sf_dir).collect()}
    assert kept == brute_similar(texts)


@pytest.mark.parametrize(("similarity", "least"), [(0.8, 0.9), (0.85, 0.98), (0.9, 0.995)])
def test_recall_of_lone_pairs(spark, similarity, least):
    """Pairs of just this similarity, apart from all others: no crowded cell, so candidates are a matter of chance."""
    rng = random.Random(int(similarity * 100))
    pairs, size = 400, 180
    texts = {}
    for p in range(pairs):
        # the second text has the first words of the first, then its own
        common = math.ceil(2 * size * similarity / (1 + similarity) - 1e-9)
        words = [f"a{p}b{i}c{rng.randrange(10**6)}" for i in range(size + 4)]
        other = words[: common + 4] + [f"d{p}e{i}" for i in range(size - common)]
        texts[2 * p], texts[2 * p + 1] = " ".join(words), " ".join(other)
        x, y = shingled(texts[2 * p]), shingled(texts[2 * p + 1])
        assert similarity <= len(x & y) / len(x | y) < similarity + 0.01
    kept = simhash.keep_one(documents(spark, list(texts.items())), words=5, similarity=0.8).count()
    found = (2 * pairs - kept) / pairs
    print(f"recall at {similarity}: {found:.4f}")
    assert found >= least


def test_near_stage_asks_the_grid_of_segment_counts(spark, sf_dir, monkeypatch):
    """Its links are candidates of their own: they are found without any draw of bits."""
    words = [f"w{i}" for i in range(402)]
    changed = [*words[:401], "other"]
    docs = documents(spark, [(1, " ".join(words)), (2, " ".join(changed)), (3, "five words of its own")])
    nodes = docs.select("doc_id", simhash._sketches(5)(F.col("text")).alias("s")).select("doc_id", "s.*")
    marks = {r.doc_id: r for r in nodes.collect()}
    assert 0 < (marks[1].lo ^ marks[2].lo).bit_count() <= simhash.BITS
    pairs = {frozenset((r.a, r.b)) for r in simhash._grid_pairs(nodes).collect()}
    assert pairs == {frozenset((marks[1].node, marks[2].node))}
    monkeypatch.setattr(simhash, "_drawn", lambda batches: iter(()))
    assert {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, sf_dir).collect()} == {1, 3}


def test_blank_documents_are_one_group(spark, sf_dir):
    docs = documents(spark, [(1, None), (2, ""), (3, " \t\n"), (4, "one word"), (5, "another word")])
    assert {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, sf_dir).collect()} == {1, 4, 5}


@pytest.mark.parametrize("rows", [True, False])
def test_stages_on_awkward_documents(spark, sf_dir, rows):
    docs = clashing(awkward(spark))
    docs = docs if rows else docs.where("false")
    columns = docs.columns
    for name, apply in corpus_pipeline.STAGES[:-1]:
        docs = stage(apply(spark, docs, sf_dir), name.replace(" ", "-"))
        assert docs.columns == columns
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() == docs.count()
