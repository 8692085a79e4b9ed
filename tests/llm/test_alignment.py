"""Alignments against the public libraries and plain loops over byte offsets."""

import hashlib
import json
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from heliospark.llm import alignment, bpe, queries
from tests.llm.fixtures import awkward, clashing, documents, read

A_PATH, B_PATH = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
A = Tokenizer.from_file(A_PATH)
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=B_PATH)
LETTERS = bpe._byte_letters()


def a_bytes(i):
    return bytes(LETTERS[c] for c in A.id_to_token(i))


def b_bytes(i):
    piece = B.id_to_piece(i)
    return bytes([int(piece[3:5], 16)]) if B.is_byte(i) else piece.replace("▁", " ").encode()


def brute(text):
    """(a ids, b ids, groups, links) by byte offsets."""
    nothing = [], [], "", []
    if not text:
        return nothing
    a, b = A.encode(" " + text, add_special_tokens=False).ids, B.encode(text)
    whole = (" " + text).encode()
    if b"".join(map(a_bytes, a)) != whole or b"".join(map(b_bytes, b)) != whole:
        return nothing
    ends = [np.cumsum([len(f(i)) for i in ids]).tolist() for f, ids in ((a_bytes, a), (b_bytes, b))]
    place = [{e: n for n, e in enumerate(x)} for x in ends]
    assert [len(x) for x in place] == [len(a), len(b)]  # no token without bytes, so one of each ends at a place
    groups, links, i, j = [], [], 0, 0
    for cut in sorted(place[0].keys() & place[1].keys()):
        x, y = i, j
        i, j = place[0][cut] + 1, place[1][cut] + 1
        groups.append(",".join(map(str, a[x:i])) + "|" + ",".join(map(str, b[y:j])))
        links.append((a[i - 1], b[j - 1]))
    return a, b, ";".join(groups), links


def brute_rows(texts):
    """The contract's columns for (key, text) rows."""
    found = [(k, *brute(t)) for k, t in texts]
    counts = Counter(x for *_, links in found for x in links)
    most = {}
    for (_, b), n in counts.items():
        most[b] = max(n, most.get(b, 0))
    return [
        (k, len(a), len(b), groups.count(";") + 1 if groups else 0, len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), groups)
        for k, a, b, groups, links in found
    ]


def rows_of(df, key="doc_id"):
    return sorted((tuple(r) for r in df.select(key, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "alignment").collect()), key=str)


@pytest.fixture(scope="module")
def aligner():
    with open(A_PATH, encoding="utf-8") as a, open(B_PATH, "rb") as b:
        return alignment.Aligner(a.read(), b.read())


def alignments(own, tokens):
    """(groups written out, their number, links, Counter of linked ids) of each text that has tokens."""
    if not any(tokens):
        return []
    r = own.align([t for t in tokens if t])
    starts = [0, *r.ends[:-1].tolist()]
    pairs = [(int(x) >> alignment.SHIFT, int(x) & 0xFFFFFFFF) for x in r.pairs]
    return [
        (r.said[i], int(r.groups[i]), int(r.links[i]), Counter(dict(zip(pairs[a:b], r.times[a:b].tolist(), strict=True))))
        for i, (a, b) in enumerate(zip(starts, r.ends.tolist(), strict=True))
    ]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("ab  the\n\t.,▁é日1"), st.characters(exclude_categories=["Cs"])), max_size=60), min_size=1, max_size=6))
def test_any_texts(texts):
    with open(A_PATH, encoding="utf-8") as a, open(B_PATH, "rb") as b:
        own = alignment.aligner(a.read(), b.read())
    tokens = own.tokens(texts)
    found = iter(alignments(own, tokens))
    for text, t in zip(texts, tokens, strict=True):
        a, b, groups, links = brute(text)
        if t is None:
            assert not a
            continue
        assert t == (a, b)
        assert next(found) == (groups, len(links), len(links), Counter(links))


def test_special_tokens_and_marks_are_plain_text(aligner):
    texts = ["a <|endoftext|> b <s></s> <unk> c", "  two  spaces  ", "x ▁ y", "\ttab", " ", "ﬁ ligature"]
    for text, t in zip(texts, aligner.tokens(texts), strict=True):
        a, b, _, _ = brute(text)
        assert (t or ([], [])) == (a, b)
    assert aligner.tokens(["x ▁ y"]) == [None]


def test_windows_are_remembered(aligner):
    before = len(aligner._windows)
    text = "the same few words " * 500
    [(said, groups, _, _)] = alignments(aligner, aligner.tokens([text]))
    assert said == brute(text)[2] and groups > 1500 and len(aligner._windows) - before <= 8


def test_memory_starts_afresh(aligner, monkeypatch):
    monkeypatch.setattr(alignment, "REMEMBERED", 2)
    texts = ["one two three", "four five", "one two"]
    for _ in range(2):
        found = alignments(aligner, aligner.tokens(texts))
        assert [x[0] for x in found] == [brute(t)[2] for t in texts]


def test_the_quick_library_is_used_where_it_is_the_same(aligner):
    assert aligner._quick is not None
    # A merge that makes a token which its own bytes never become: ab, bc, then (ab, c) after (b, c) took the b.
    letters = {c: i for i, c in enumerate(LETTERS)}
    made = {"bc": 256, "ab": 257, "abc": 258}
    text = {"model": {"vocab": letters | made, "merges": ["b c", "a b", "ab c"]}, "added_tokens": []}
    table = bpe.BytePair(json.dumps(text))
    assert alignment.by_rank(table) is None
    long = ["x" * 5000 + " y", " " * 5000 + "y", "a b " * 3000]
    assert [alignment.long_word(t) for t in long] == [True, True, False]
    for t in long:
        assert aligner.tokens([t]) == [tuple(brute(t)[:2])]


def test_awkward_rows(spark):
    docs = clashing(awkward(spark)).repartition(3)
    texts = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    found = alignment.with_counts(alignment.align(docs, A_PATH, B_PATH))
    assert rows_of(found) == sorted(brute_rows(texts), key=str)


@pytest.mark.parametrize("limit", [alignment.BROADCAST_PAIRS, 0])
def test_query_on_the_given_documents(spark, sf_dir, limit, monkeypatch):
    monkeypatch.setattr(alignment, "BROADCAST_PAIRS", limit)
    texts = [(r.doc_id, r.text) for r in read(spark, sf_dir, "documents").collect()]
    found = {r.doc_id: r for r in queries.QUERIES["op13_alignment"](spark, sf_dir).collect()}
    assert len(found) == len(texts)
    for key, n_a, n_b, groups, links, best, total, said in brute_rows(texts):
        r = found[key]
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum) == (n_a, n_b, groups, links, best, total)
        assert r.groups_sha256 == (hashlib.sha256(said.encode()).hexdigest() if said else "")


def test_text_keys_and_an_empty_table(spark):
    docs = documents(spark, [(1, "one two"), (2, None)]).selectExpr("concat('k', doc_id) AS at", "text AS said")
    found = alignment.with_counts(alignment.align(docs, A_PATH, B_PATH, "at", "said").withColumnRenamed("at", "doc_id"))
    assert rows_of(found) == brute_rows([("k1", "one two"), ("k2", None)])
    assert alignment.with_counts(alignment.align(documents(spark, []), A_PATH, B_PATH)).collect() == []
