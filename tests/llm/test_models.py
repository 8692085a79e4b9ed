"""Top-k search, toxicity, page extraction and the language model: brute force, held-out rows, awkward cases."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import __spark_entry__ as registry
from heliospark.llm import pitman_yor, site_style_tree, topk, toxicity
from heliospark.llm.queries import learned_labels, remainder
from tests.llm.fixtures import awkward, clashing, documents, read


def brute_top(vectors, k, step):
    ints = {i: [math.floor(64 * x) for x in v] for i, v in vectors.items()}
    out = set()
    for q in ints:
        if q % step == 0:
            ranked = sorted((-sum(a * b for a, b in zip(ints[q], v)), i) for i, v in ints.items() if i != q)[:k]
            out |= {(q, at + 1, i, -s) for at, (s, i) in enumerate(ranked)}
    return out


@pytest.mark.parametrize(("n", "copies"), [(900, 0), (300, 200), (10, 0)])
def test_top_k_against_brute_force(spark, monkeypatch, n, copies):
    monkeypatch.setattr(topk, "BLOCK", 128)
    rng = np.random.default_rng(n)
    vectors = {i: rng.normal(size=12).tolist() for i in range(n)}
    vectors |= {n + i: vectors[0] for i in range(copies)}
    df = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<float>")
    exact = {r.vec_id: [float(x) for x in r.embedding] for r in df.collect()}
    found = topk.top_k(df, F.col("id") % 7 == 0, k=20).collect()
    assert {tuple(r) for r in found} == brute_top(exact, 20, 7)
    assert len(found) == len(set(map(tuple, found)))


def test_top_k_awkward_vectors(spark):
    rows = [(0, [1.0, 0.5]), (1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, [0.5, 0.5]), (5, [0.5, 0.5]), (None, [1.0, 1.0]), (7, []), (8, [-1.0, -1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("part", F.lit("x")).withColumn("id", F.lit(-1))
    found = {tuple(r) for r in topk.top_k(df, F.col("id") == 0).collect()}
    assert found == {(0, 1, 5, 64 * 32 + 32 * 32), (0, 2, 7, 0), (0, 3, 8, -64 * 64 - 32 * 64)}
    assert topk.top_k(df.where("false"), F.col("id") == 0).collect() == []


def test_bounds_hold_while_lists_are_read():
    rng = np.random.default_rng(1)
    rows, queries = rng.integers(-20, 20, (500, 8)).astype(float), rng.integers(-20, 20, (30, 8)).astype(float)
    block, exact = topk._Block(np.arange(500), rows), queries @ rows.T
    slack = []
    for share in topk.RUNS:
        low, high = block.bounds(queries, share)
        assert (low <= exact).all() and (exact <= high).all()
        slack.append((high - low).sum())
    assert slack == sorted(slack, reverse=True) and slack[-1] == 0


@pytest.fixture(scope="module")
def toxic_model(spark):
    docs = read(spark, "/root/testdata/sf0.1", "documents").select("doc_id", "text")
    return toxicity.fit(docs, learned_labels(spark, "/root/testdata/sf0.1"))


def test_held_out_accuracy(spark, toxic_model):
    labels = read(spark, "/root/testdata/sf0.1", "labels")
    docs = read(spark, "/root/testdata/sf0.1", "documents").join(labels.select("doc_id", "toxic"), "doc_id").where(remainder("doc_id", 3) == 1)
    rows = toxicity.scored(docs, toxic_model).select("row.toxic", "score").collect()
    hit = sum(r.toxic == 1 and r.score >= toxicity.REJECT for r in rows)
    named = sum(r.score >= toxicity.REJECT for r in rows)
    assert hit / named > 0.9 and hit / sum(r.toxic for r in rows) > 0.7


def test_nearest_is_exact(toxic_model):
    m = toxic_model
    dense = np.zeros((len(m.ids), len(m.terms)))
    for i in range(len(m.ids)):
        row = slice(m.starts[i], m.starts[i + 1])
        dense[i, m.columns[row]] = m.weights[row]
    assert np.allclose((dense**2).sum(1), 1)
    rng = random.Random(2)
    for _ in range(60):
        columns, weights = m.weigh({rng.randrange(len(m.terms)): rng.randrange(1, 4) for _ in range(rng.randrange(1, 6))})
        query = np.zeros(len(m.terms))
        query[columns] = weights
        best, cosines = m.nearest(columns, weights)
        want = np.sort(dense @ query)[::-1][: toxicity.NEIGHBOURS]
        assert np.allclose(cosines, want[want > 0]) and np.allclose(dense[best] @ query, cosines)


def test_toxicity_awkward_rows(spark, toxic_model):
    docs = clashing(awkward(spark))
    rows = toxicity.scored(docs, toxic_model).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in rows if not (r.row.text or "").strip()} == {toxic_model.none_rate}
    none = toxicity.fit(docs.where("false"), spark.createDataFrame([], "doc_id long, toxic int"))
    assert all(r.score == none.none_rate and 0 <= r.score <= 1 for r in toxicity.scored(docs, none).collect())
    assert toxicity.scored(docs.where("false"), toxic_model).collect() == []


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_pages_keep_the_article_and_nothing_else(spark):
    body = "<article><h1>T &amp; U</h1><p>One  <b>two</b>\n three<p>Four<br>five<div class='comments'><p>Reader says</div><form>x</form></article>"
    page = f"<html><head><title>No</title><script>var a='<p>';</script></head><body class='nav-fixed'><nav>menu</nav><div id='ad-1'>buy</div>{body}<footer>foot</footer><!-- <p>c</p> --></body></html>"
    found = site_style_tree.extract(clashing(pages(spark, [(1, "http://h/a", page)]))).collect()
    assert [r.text for r in found] == ["T & U\nOne two three\nFour five"]


def test_style_tree_removes_what_all_pages_of_a_host_share(spark):
    def page(i):
        return f"<body><div class=top><p>Shared notice of the site</p></div><div class=body><h2>Title {i}</h2><p>Story number {i}</p></div><div class=end><p>Call us now</p></div></body>"

    rows = [(i, f"https://Host.example/{i}", page(i)) for i in range(40)] + [(100, "https://other.example/", page(100))]
    found = {r.row.page_id: r.text for r in site_style_tree.extract(pages(spark, rows)).collect()}
    assert all(found[i] == f"Title {i}\nStory number {i}" for i in range(40))
    assert found[100] == "Shared notice of the site\nTitle 100\nStory number 100\nCall us now"


def test_style_tree_judges_what_stands_in_an_article_too(spark):
    """The host's boilerplate goes though markup calls it main; a copy of one of the pages changes nothing."""
    def page(i):
        return f"<body><nav>menu</nav><article><h2>Title {i}</h2><p>Story number {i}</p><div class=line><p>Read it on paper, too</p></div></article><div class=end><p>Call us now</p></div></body>"

    rows = [(i, f"https://host.example/{i}", page(i)) for i in range(20)] + [(20 + i, "https://host.example/3", page(3)) for i in range(40)]
    found = {r.row.page_id: r.text for r in site_style_tree.extract(pages(spark, rows)).collect()}
    assert found == {i: f"Title {i if i < 20 else 3}\nStory number {i if i < 20 else 3}" for i in range(60)}


def test_copies_of_an_article_keep_their_text(spark):
    rows = [(i, "https://copies.example/x", "<body><nav>n</nav><article><p>Same story</p></article></body>") for i in range(50)]
    assert {r.text for r in site_style_tree.extract(pages(spark, rows)).collect()} == {"Same story"}


def test_pages_awkward_rows(spark):
    rows = [(1, None, None), (2, "u", ""), (None, "http://h", "text"), (3, "http://h", "<p>un<closed <div"), (4, "http://h", "</p></div>x<p>y"), (4, "http://h", "</p></div>x<p>y"), (5, "http://h", "<p>" * 3000 + "deep"), (6, "http://h", "&#0;&bogus;&lt;b&gt;")]
    found = site_style_tree.extract(clashing(pages(spark, rows))).collect()
    assert len(found) == len(rows) and all(r.text is not None for r in found)
    assert {r.text for r in found if r.row.page_id in (1, 2)} == {""}
    assert {r.text for r in found if r.row.page_id == 4} == {"x\ny"}
    assert site_style_tree.extract(pages(spark, [])).collect() == []


def test_given_pages_give_their_articles(spark, sf_dir):
    found = registry.queries()["op9_site_style_tree"](spark, sf_dir).join(read(spark, sf_dir, "pages").drop("url"), "page_id").collect()
    for r in found:
        inner = r.html.split("<article>")[1].split("</article>")[0]
        assert r.n_chars == len(r.text) and r.text.split("\n")[0] in site_style_tree._spaces.sub(" ", __import__("html").unescape(inner))
        assert "track(" not in r.text and "©" not in r.text


def test_language_model_base_scores_and_gain(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select("doc_id", "text").collect()
    learned, texts = Counter(), {}
    for r in rows:
        words = [*(r.text or "").encode().lower().split(), b"\n"]
        texts[r.doc_id] = words
        if zlib.crc32(str(r.doc_id).encode()) % 7 != 2:
            learned.update(words)
    n, v = sum(learned.values()), len(learned)
    found = registry.queries()["op10_pitman_yor"](spark, sf_dir).collect()
    assert len(found) == len(rows)
    for r in found:
        words = texts[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(words), sum(learned[w] > 0 for w in words), n)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2)
        assert r.base_score == pytest.approx(sum(math.log10((learned[w] + 1) / (n + v + 1)) for w in words), rel=1e-9)
    held = [r for r in found if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


@pytest.fixture(scope="module")
def tiny(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choices(words, [1 / (i + 1) for i in range(60)], k=rng.randrange(40))) for _ in range(200)]
    return documents(spark, list(enumerate(texts)))


def test_probabilities_add_up(spark, tiny, monkeypatch):
    monkeypatch.setattr(pitman_yor, "DISHES", 20)
    model, counts = pitman_yor.fit(tiny.select("text"))
    assert model.vocab.rare_types == 61 - 20
    assert np.allclose((10.0**model.log_known).sum(1), 1, atol=1e-4)
    rare = sum(words * 10.0 ** model.rare(np.array([n]))[0] for n, words in model.vocab.rare.items())
    assert rare + 10.0 ** model.rare(np.array([0]))[0] == pytest.approx(1, abs=1e-6)


def test_words_beyond_the_broadcast_counts(spark, tiny, monkeypatch):
    """The join gives what the broadcast counts give."""
    model, counts = pitman_yor.fit(tiny.select("text"))
    whole = sorted(map(tuple, pitman_yor.score(tiny, model, counts).select("row.doc_id", "n_known", "base_score").collect()))
    monkeypatch.setattr(pitman_yor, "COUNTED", 15)
    model, counts = pitman_yor.fit(tiny.select("text"))
    assert len(model.vocab.words) <= 15
    parted = sorted(map(tuple, pitman_yor.score(tiny, model, counts).select("row.doc_id", "n_known", "base_score").collect()))
    assert [r[:2] for r in whole] == [r[:2] for r in parted]
    assert np.allclose([r[2] for r in whole], [r[2] for r in parted])


def test_every_word_is_a_context_with_dishes_of_its_own(spark, monkeypatch):
    """However many contexts there are and however rare their words: each has learned what follows it."""
    monkeypatch.setattr(pitman_yor, "DISHES", 8)
    texts = [f"a{i} b{i}" for i in range(700) for _ in range(3)]
    model, learned = pitman_yor.fit(documents(spark, list(enumerate(texts))).select("text"))
    asked = [f"a{i} b{(i + j) % 700}" for j in (0, 1) for i in range(700)]
    found = {r.row.doc_id: r.score for r in pitman_yor.score(documents(spark, list(enumerate(asked))), model, learned).collect()}
    assert all(found[i] > found[700 + i] + 1.5 for i in range(700))


@pytest.mark.parametrize(("counted", "grain", "block"), [(1 << 18, 1 << 20, 5 << 20), (15, 300, 100), (40, 100, 50)])
def test_language_model_against_its_restaurants(spark, tiny, monkeypatch, counted, grain, block):
    """Buckets, parts of contexts, blocks and joins give what plain sums over the restaurants give, and chances add up."""
    for name, value in (("DISHES", 20), ("COUNTED", counted), ("GRAIN", grain), ("BLOCK", block)):
        monkeypatch.setattr(pitman_yor, name, value)
    model, learned = pitman_yor.fit(tiny.select("text"))
    pairs, unigrams = Counter(), Counter()
    for r in tiny.collect():
        words = [b"\n", *r.text.encode().split(), b"\n"]
        pairs.update(zip(words, words[1:]))
        unigrams.update(words[1:])
    names = dict(zip(model.vocab.ids(list(unigrams)).tolist(), unigrams))
    guests, tables = Counter(), Counter()
    for r in learned.restaurants.collect():
        mean, contexts = iter(r["mean"]), [c for c, n in zip(r.contexts, r.runs) for _ in range(n)]
        for c, w, n in zip(contexts, pitman_yor._spread(bytes(r.words), np.int64).tolist(), r.guests):
            pair = names[c], names[w]
            guests[pair] += n
            tables[pair] += next(mean) if n > 1 else 1
    assert guests == pairs and all(1 <= tables[p] <= n for p, n in pairs.items())
    assert any(n > 1 for n in model.vocab.parts.tolist()) == (grain == 100 or grain == 300)
    words = [*unigrams, b"never"]
    parent = dict(zip(words, model.parent(model.vocab.ids(words), np.array([unigrams[w] for w in words])).tolist()))
    assert sum(parent.values()) == pytest.approx(1)
    seated = Counter()
    for (c, _), t in tables.items():
        seated[c] += t

    def chance(c, w):
        s, d = model.strength, model.discount
        return (max(guests[c, w] - d * tables[c, w], 0) + (s + d * seated[c]) * parent[w]) / (s + unigrams[c])

    for c in words:
        assert sum(chance(c, w) for w in words) == pytest.approx(1, abs=1e-6)
    asked = [*(r.text for r in tiny.collect()), "never w1 never", "", None, "w3 never", "W1 w2"]
    found = {r.row.doc_id: r.score for r in pitman_yor.score(documents(spark, list(enumerate(asked))), model, learned).collect()}
    for i, text in enumerate(asked):
        said = [b"\n", *(text or "").lower().encode().split(), b"\n"]
        assert found[i] == pytest.approx(sum(math.log10(chance(c, w)) for c, w in zip(said, said[1:])), abs=1e-4)


def test_rounds_of_seating_take_little_memory(spark, tiny, monkeypatch):
    """A bucket's dishes are packed bytes to the JVM, and a task has one Python worker, the first round's as well."""
    staged, stage = [], pitman_yor.stage

    def seen(df, name, **options):
        if name == "seating":
            plan = df._jdf.queryExecution().executedPlan().toString()
            staged.append((df.schema, plan.split("Exchange")[0].count("MapInArrow")))
        return stage(df, name, **options)

    monkeypatch.setattr(pitman_yor, "stage", seen)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pitman_yor.fit(tiny.select("text"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(staged) == pitman_yor.BURN_IN + pitman_yor.SAMPLES
    for schema, workers in staged:
        assert workers == 1
        assert {f.name for f in schema if f.dataType.typeName() == "array"} <= {"parted"}


def test_toxicity_counts_the_training_texts_once(spark, tmp_path, monkeypatch):
    """What is read twice of the counts is written out, not reckoned twice from the texts."""
    counted, folder = toxicity._counted, str(tmp_path)

    def noted(batches):
        for batch in batches:
            with open(f"{folder}/{batch['text'][0].as_py()}", "a") as out:
                out.write(f"{batch.num_rows}\n")
            yield batch

    monkeypatch.setattr(toxicity, "_counted", lambda batches: counted(noted(batches)))
    docs = documents(spark, [(i, f"w{i % 7} {'vile' if i % 3 == 0 else 'kind'} things") for i in range(60)])
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)], "doc_id long, toxic int")
    model = toxicity.fit(docs.select("doc_id", "text"), labels)
    assert sum(int(n) for f in tmp_path.iterdir() for n in f.read_text().split()) == 60
    assert "vile" in model.terms and "kind" not in model.terms


def test_toxicity_words_are_the_runs_of_letters():
    rng = random.Random(6)
    for _ in range(3000):
        text = "".join(rng.choices("aBzÉé_09 -Kİß٣²\t\n\x1c\u2003abcdefgh", k=rng.randrange(60)))
        assert sorted(toxicity.words_of(text)) == sorted(re.findall(r"[^\W\d_]+", text.lower()))
    assert toxicity.words_of(None) == []


def test_texts_are_coded_without_strings_for_the_jvm(spark, monkeypatch):
    """Blocks reach the JVM as packed bytes, and hold the contract's words of every text, whatever its slice."""
    monkeypatch.setattr(pitman_yor, "BLOCK", 40)
    monkeypatch.setattr(pitman_yor, "_SPLIT", 30)
    rng = random.Random(5)
    texts = [None, "", " \n", *("".join(rng.choices(" \t\n\x0b\x0c\raBÉé\x1c\xa0 \u2003K", k=rng.randrange(60))) for _ in range(300))]
    coded = pitman_yor.code(documents(spark, list(enumerate(texts))).select("doc_id", "text").coalesce(1))
    assert not any(isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StringType) for f in coded.schema)
    blocks, found = coded.toArrow(), {}
    assert blocks.num_rows > 10
    for i in range(blocks.num_rows):
        words, (codes, n) = pitman_yor._said(blocks, i), pitman_yor._read(blocks, i, "codes", "n")
        assert words[0] == b"\n" and n.tolist() == np.bincount(codes, minlength=len(words)).tolist()
        ends = np.cumsum(blocks["lengths"][i].as_py())
        assert all(e >= 40 for e in ends[-1:]) or i == blocks.num_rows - 1
        for row, part in zip(blocks["row"][i].as_py(), np.split(codes, ends[:-1]), strict=True):
            found[row["doc_id"]] = [words[c] for c in part.tolist()]
    assert found == {i: [*pitman_yor.words_of(t), b"\n"] for i, t in enumerate(texts)}


def test_seating_keeps_its_guests():
    rng = np.random.default_rng(4)
    guests = rng.integers(1, 50, 40)
    seats = pitman_yor.Seating(guests, 0.6)
    for _ in range(5):
        seats.gibbs(rng, np.full(40, 1 / 40), 0.6, 1.0, 20)
        assert (np.bincount(seats.owner, seats.sizes, 40) == guests).all() and (seats.sizes > 0).all()
        assert (seats.tables()[guests == 1] == 1).all()


def test_language_model_awkward_rows(spark, tiny):
    docs = clashing(awkward(spark))
    model, counts = pitman_yor.fit(docs.select("text"))
    rows = pitman_yor.score(docs, model, counts).collect()
    assert len(rows) == docs.count() and all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in rows)
    model, counts = pitman_yor.fit(docs.select("text").where("false"))
    rows = pitman_yor.score(docs, model, counts).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 and math.isfinite(r.score) for r in rows)
    assert pitman_yor.score(docs.where("false"), model, counts).collect() == []


def table_chances(c, p, discount, strength, most):
    """How likely a restaurant's only dish of c guests has 1, 2, ... tables: all orders of seating added up, guest by guest."""
    t, logs = np.arange(1, most + 1), np.full(most, -np.inf)
    logs[0] = math.log(p * strength)
    for n in range(1, c):
        joined = logs + np.log(np.maximum(n - discount * t, 1e-300))
        opened = np.append(-np.inf, (logs + np.log(p * (strength + discount * t)))[:-1])
        logs = np.logaddexp(np.where(t <= n, joined, -np.inf), opened)
    chances = np.exp(logs - logs.max())
    return chances / chances.sum()


@pytest.mark.parametrize(("c", "p", "discount"), [(40, 0.3, 0.6), (900, 0.05, 0.8), (10_000, 0.02, 0.6), (10_000, 0.1, 0.6), (5_000, 0.9, 0.3)])
def test_a_round_seats_all_guests_of_a_dish(c, p, discount):
    """Five rounds forget the first guess, however many guests there are, and go on to the exact distribution."""
    chances = table_chances(c, p, discount, 1.0, min(c, 3000))
    tables = np.arange(1, len(chances) + 1)
    mean = chances @ tables
    spread = math.sqrt(chances @ (tables - mean) ** 2)
    rng, guests, found = np.random.default_rng(8), np.full(300, c), []
    seats = pitman_yor.Seating(guests, discount)
    for round_ in range(9):
        seats.gibbs(rng, np.full(300, p), discount, 1.0, 6, np.arange(300), np.zeros(300))
        if round_ >= 4:
            found.append(seats.tables().copy())
    assert np.mean(found) == pytest.approx(mean, abs=0.15 * spread)
    assert np.std(found) == pytest.approx(spread, rel=0.1)


def test_dishes_of_one_restaurant_against_all_seatings():
    """Two dishes share the restaurant's tables: their joint distribution, summed over all numbers of tables."""
    (a, b), discount, strength = ([table_chances(n, p, 0.7, 1.0, n) for n, p in ((12, 0.5), (5, 0.1))], 0.7, 1.0)

    def openings(t):  # the factor of t tables in one restaurant
        return math.lgamma(strength / discount + t) - math.lgamma(strength / discount)

    joint = np.array([[x * y * math.exp(openings(i + j) - openings(i) - openings(j)) for j, y in enumerate(b, 1)] for i, x in enumerate(a, 1)])
    joint /= joint.sum()
    rng, house = np.random.default_rng(1), np.repeat(np.arange(4000), 2)
    seats = pitman_yor.Seating(np.tile([12, 5], 4000), discount)
    seats.gibbs(rng, np.tile([0.5, 0.1], 4000), discount, strength, 40, house, np.zeros(4000))
    found = seats.tables().reshape(-1, 2).mean(0)
    assert found == pytest.approx([joint.sum(1) @ np.arange(1, 13), joint.sum(0) @ np.arange(1, 6)], rel=0.03)


def test_tables_of_many_guests_by_integral():
    """Beyond the list the weights are those of the same recurrence."""
    n = pitman_yor._LISTED
    for discount in (0.05, 0.5, 0.95):
        for rate in (1e-9, 0.3, 5.0, 200.0, 1e4):
            logs = pitman_yor._listed(discount)[n, 1:] + np.arange(1, n + 1) * math.log(rate * discount)
            want = np.exp(logs - logs.max())
            saddle = pitman_yor._saddles(np.array([n]), np.array([rate]), discount)[0]
            first, weights = pitman_yor._weighed(n, rate, discount, saddle)
            found = np.zeros(n)
            found[first - 1 : first - 1 + len(weights)] = weights
            assert np.allclose(found / found.sum(), want / want.sum(), atol=1e-6)
    big = np.array([5_000_000] * 50)
    tables = pitman_yor._drawn(big, np.full(50, 2000.0), 0.7, np.linspace(0.01, 0.99, 50))
    assert (np.diff(tables) >= 0).all() and 1850 < tables[0] < 2000 < tables[-1] < 2150


@pytest.mark.parametrize(("dishes", "counted"), [(4, 4), (4, 1 << 18), (1 << 18, 1 << 18)])
def test_rare_words_are_dishes_of_the_root(spark, monkeypatch, dishes, counted):
    """Of two words as frequent as each other, that which follows many others is likelier after a word never seen."""
    monkeypatch.setattr(pitman_yor, "DISHES", dishes)
    monkeypatch.setattr(pitman_yor, "COUNTED", counted)
    texts = [f"c{i % 3} c{i % 2}" for i in range(300)] + [f"x{i} v" for i in range(40)] + ["y w" for _ in range(40)] + [f"x{i} z{i % 11}" for i in range(40)]
    model, learned = pitman_yor.fit(documents(spark, list(enumerate(texts))).select("text"))
    found = {r.row.doc_id: r.score for r in pitman_yor.score(documents(spark, [(1, "never v"), (2, "never w")]), model, learned).collect()}
    assert found[1] > found[2] + 0.3
    counts = Counter(w for t in texts for w in [*t.encode().split(), b"\n"])
    words = [*counts, b"never"]
    shares = dict(zip(words, model.parent(model.vocab.ids(words), np.array([counts[w] for w in words])).tolist()))
    assert sum(shares.values()) == pytest.approx(1) and shares[b"v"] > 2 * shares[b"w"]


def test_a_frequent_pair_is_seated_whole(spark):
    """The tables of a pair seen 4,000 times are those that its guests and the root ask for."""
    texts = ["a b"] * 4000 + [f"p{i} b q{i} s{i}" for i in (*range(500), *range(150))]
    model, learned = pitman_yor.fit(documents(spark, list(enumerate(texts))).select("text"))
    a, b = model.vocab.ids([b"a", b"b"]).tolist()
    tables = None
    for r in learned.restaurants.collect():
        mean = iter(r["mean"])
        contexts = [c for c, n in zip(r.contexts, r.runs) for _ in range(n)]
        for c, w, n in zip(contexts, pitman_yor._spread(bytes(r.words), np.int64).tolist(), r.guests):
            here = next(mean) if n > 1 else 1
            if (c, w) == (a, b):
                tables = here
    chances = table_chances(4000, model.held(np.array([b]))[0], model.discount, model.strength, 1500)
    want = chances @ np.arange(1, 1501)
    assert tables == pytest.approx(want, abs=2)
    assert 4000**model.discount > 10 * want
