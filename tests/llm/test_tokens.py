"""BPE against the public library, token files against the encoder, packing against brute force."""

import random
from hashlib import sha256
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from heliospark.llm import bpe, packing, token_counts
from tests.llm.fixtures import awkward, clashing, documents

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
with open(PATH, encoding="utf-8") as f:
    OURS = bpe.BytePair(f.read())
EOD = 50_256


def same(texts):
    for text, ids in zip(texts, OURS.encode(texts), strict=True):
        assert ids == LIBRARY.encode(text, add_special_tokens=False).ids
        assert OURS.decode(ids) == LIBRARY.decode(ids, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=80), max_size=5))
def test_any_text(texts):
    same(texts)


def test_words_that_fail_and_long_ones():
    rng = random.Random(6)
    same(["".join(rng.choice("abers t'\n1") for _ in range(300)) for _ in range(500)])
    same(["a" * n for n in (1, 47, 48, 49, 5000)] + ["ab" * 3000, "<|endoftext|>", "x<|endoftext|> y<|endoftext|>"])


def test_greedy_fails_for_some_words_and_is_mended():
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefghilmnoprst") for _ in range(9)) for _ in range(500)]
    greedy = [tuple(OURS._greedy(w.encode())) for w in words]
    right = OURS.encode_words(words)
    assert greedy != right and [tuple(OURS.merge(w.encode())) for w in words] == right


def test_decode_of_broken_utf8():
    ids = [OURS.ids[b"\xe9"], OURS.ids[b"a"]]
    assert OURS.decode(ids) == LIBRARY.decode(ids, skip_special_tokens=False)


def test_round_trip_of_awkward_rows(spark):
    docs = clashing(awkward(spark))
    texts = sorted(docs.select("doc_id", "text").collect(), key=str)
    found = sorted(map(tuple, bpe.round_trip(docs, PATH).collect()), key=str)
    want = []
    for i, text in texts:
        ids = LIBRARY.encode(text or "", add_special_tokens=False).ids
        want.append((i, len(ids), sha256(",".join(map(str, ids)).encode()).hexdigest(), sha256((text or "").encode()).hexdigest()))
    assert found == sorted(want, key=str)
    coded = bpe.encode(docs, PATH)
    back = bpe.decode(coded, PATH)
    assert sorted(map(str, (tuple(r) for r in back.collect()))) == sorted(map(str, ((i, t or "") for i, t in texts)))


@pytest.mark.parametrize("operator", [lambda d: bpe.round_trip(d, PATH), lambda d: bpe.encode(d, PATH), packing.pack, lambda d: token_counts.count_documents(token_counts.write_token_files(d, PATH, EOD)[0], EOD)])
def test_empty_table(spark, operator):
    assert operator(documents(spark, [])).collect() == []


@pytest.mark.parametrize("block", [3, 64, 1 << 16])
def test_token_files_give_back_each_document(spark, block):
    docs = clashing(awkward(spark)).repartition(3)
    blocks, owners = token_counts.write_token_files(docs, PATH, EOD, block=block)
    counted = token_counts.count_documents(blocks, EOD)
    found = counted.join(owners, ["file", "ordinal"]).select("key", "n_tokens")
    plain = Tokenizer.from_file(PATH)
    plain.encode_special_tokens = True
    want = [(r.doc_id, len(plain.encode(r.text or "", add_special_tokens=False).ids)) for r in docs.collect()]
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, want))
    assert all(r.closed for r in counted.collect())


def test_separators_in_a_text_are_text(spark):
    blocks, _ = token_counts.write_token_files(documents(spark, [(1, "a<|endoftext|>b")]), PATH, EOD)
    assert token_counts.count_documents(blocks, EOD).count() == 1


def test_plain_files(spark, tmp_path):
    rng = np.random.default_rng(8)
    want = []
    for name, n in (("a.bin", 0), ("b.bin", 1000), ("c.bin", 5000)):
        ids = rng.integers(0, 6, n).astype("<u2")
        ids.tofile(tmp_path / name)
        start = ordinal = 0
        for end in [*np.flatnonzero(ids == 5).tolist(), n]:
            if end < n or end > start:
                want.append((name, ordinal, start, end - start, end < n))
            start, ordinal = end + 1, ordinal + 1
    blocks = token_counts.read_token_files(spark, str(tmp_path), block=7)
    got = [(r.file.rsplit("/", 1)[1], *r[1:]) for r in token_counts.count_documents(blocks, 5).collect()]
    assert sorted(got) == sorted(want)


def padding(lengths, counts, ends):
    return sum(c * (min(e for e in ends if e >= n) - n) for n, c in zip(lengths, counts, strict=True))


def test_boundaries_are_the_best():
    rng = random.Random(9)
    for _ in range(150):
        lengths = sorted(rng.sample(range(1, 60), rng.randrange(1, 9)))
        counts = [rng.randrange(1, 9) for _ in lengths]
        k = rng.randrange(1, 6)
        ends = packing.boundaries(lengths, counts, k)
        tries = [padding(lengths, counts, [*c, lengths[-1]]) for c in combinations(lengths[:-1], min(k, len(lengths)) - 1)]
        assert ends[-1] == lengths[-1] and len(ends) == min(k, len(lengths)) and padding(lengths, counts, ends) == min(tries)


def test_batches_keep_the_budget(spark):
    docs = clashing(awkward(spark)).unionByName(clashing(documents(spark, [(100 + i, "w " * (i % 37)) for i in range(500)])))
    rows = packing.pack(docs, buckets=4, budget=100).collect()
    assert len(rows) == docs.count()
    batches = {}
    for r in rows:
        assert r.n_tokens <= r.bucket_len
        batches.setdefault((r.bucket, r.batch), []).append(r)
    for batch in batches.values():
        assert len(batch) * batch[0].bucket_len <= 100 or len(batch) == 1
        assert sorted(r.slot for r in batch) == list(range(len(batch)))
    for bucket in {b for b, _ in batches}:
        full = [len(batches[k]) for k in sorted(k for k in batches if k[0] == bucket)]
        assert len(set(full[:-1])) <= 1
