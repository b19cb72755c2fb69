"""Lexical search, spelling variants and quality against brute force, with every awkward row."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickersift.functions.scratch import staged
from tickersift.llm import lexical_search, quality, spelling

SCHEMA = "doc_id long, text string, term string, score double, word string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    stems = ["".join(rng.choices("aeioulnrst", k=rng.randint(3, 9))) for _ in range(60)]
    variants = [w[:i] + rng.choice(["", "x", "é", w[i : i + 1] * 2]) + w[i + 1 :] for w in stems for i in (1, len(w) - 1)]
    words = stems * 6 + variants + ["Éclair", "ÉCLAIR", "naïveté", "naïvete", "über-all", "o'clock", "10.5", "ß" * 7, "word漢字word", "n" * 70, "n" * 71]
    texts = [" ".join(rng.choices(words, k=rng.choice([1, 4, 40, 300]))) for _ in range(120)]
    texts += [None, "", " \n ", "!!!", "...漢字...", " ".join(rng.choices(words, k=20_000)), *["the same text over and over " + stems[0]] * 30]
    out = [(i, t, "clash", 7.0, "clash") for i, t in enumerate(texts)]
    return [*out, out[3], out[3], (None, texts[5], None, None, None), (None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("texts") / "documents.parquet")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


def terms_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def ranked_by_hand(rows, items, k):
    split = [(r[0], Counter(terms_of(r[1]))) for r in rows]
    split = [(i, c) for i, c in split if c]
    every, total = len(split), sum(sum(c.values()) for _, c in split)
    df = Counter(t for _, c in split for t in c)
    found = []
    for item, text in items:
        asked, scores = Counter(terms_of(text)), []
        for doc_id, c in split:
            m = 75 + (25 * sum(c.values()) * every) // total
            weight = lambda t: math.floor(1000 * math.log((2 * every + 2) / (2 * df[t] + 1)))
            score = sum(q * weight(t) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 12 * m)) for t, q in asked.items() if t in c)
            if score > 0:
                scores.append((-score, doc_id is None, doc_id or 0, doc_id))
        found += [(item, rank, s[3], -s[0]) for rank, s in enumerate(sorted(scores)[:k], 1)]
    return found


@pytest.mark.parametrize("limits", [(65_536, 4_000_000), (7, 4_000_000), (65_536, 500)])
def test_ranked_documents_equal_brute_force(spark, docs, rows, limits):
    texts = [r[1] for r in rows if r[1]]
    items = [(1, texts[0]), (2, "the same text over and over"), (3, texts[2] + " " + texts[2]), (4, "..."), (5, "unheardof"), (6, "ÉCLAIR Éclair 10 漢字")]
    items += [(10 + i, " ".join(t.split()[:40])) for i, t in enumerate(texts[3:20])]
    table = [(*x, "extra") for x in items] + [(2, "the same text over and over", "x"), (None, "text", "x"), (7, None, "x")]
    asked = spark.createDataFrame(table, "item_id int, text string, doc_id string")
    index = staged(lexical_search.lexical_index(docs, *limits), "index")
    for blocks in (256, 5):
        found = lexical_search.lexical_search(index, asked, 9, blocks)
        assert found.schema["item_id"].dataType.simpleString() == "int"
        assert sorted(map(tuple, found.collect()), key=str) == sorted(ranked_by_hand(rows, items, 9), key=str)


def test_search_over_nothing(spark, docs):
    items = spark.createDataFrame([(1, "text")], "item_id long, text string")
    assert not lexical_search.ranked_documents(docs.where("false"), items).collect()
    assert not lexical_search.ranked_documents(docs.where("text is null"), items).collect()
    assert not lexical_search.ranked_documents(docs, items.where("false")).collect()


def test_intervals_leave_most_documents_unscored():
    rng = np.random.default_rng(5)
    n = 4000
    places = [np.flatnonzero(rng.random(n) < share) for share in (0.9, 0.5, 0.05, 0.01)]
    impacts = [rng.integers(1, 1_000_000, len(p)) for p in places]
    postings = lexical_search.Postings(places, impacts, n)
    weights = np.array([10, 700, 3000, 4500])
    found, scores, scored = postings.best(np.arange(4), weights, 20)
    dense = np.zeros(n, np.int64)
    for p, i, w in zip(places, impacts, weights, strict=True):
        dense[p] += i * w
    assert sorted(scores)[-20:] == sorted(dense)[-20:] and (dense[found] == scores).all() and scored < n / 4
    low, high = np.array([0, 3, 5, 5]), np.array([7, 4, 5, 900])
    want = [postings.impacts[a:b].max() if b > a else 0 for a, b in zip(low, high, strict=True)]
    assert postings.impacts[postings.largest(low, high)].tolist() == want


def words_by_hand(rows, every):
    counts = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if h % every == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            counts[word] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def one_edit_by_hand(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    edits = {a[:i] + a[i + 1 :] for i in range(len(a))} if len(a) > len(b) else set()
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return b in edits if edits else one_edit_by_hand(b, a)


@pytest.mark.parametrize("limits", [(20_000, 50_000), (40, 15), (1, 1)])
def test_spelling_variants_equal_brute_force(spark, docs, rows, limits, monkeypatch):
    monkeypatch.setattr(spelling.near_words, "__defaults__", (6, *limits))
    monkeypatch.setattr(spelling, "BLOCK_PAIRS", 50)
    counts = words_by_hand(rows, 7)
    words = staged(spelling.vocabulary(docs, every=7), "words")
    assert dict(map(tuple, words.collect())) == counts
    near = {w: [x for x in counts if one_edit_by_hand(w, x)] for w in counts}
    form = {w: f for w, x in near.items() if x and counts[f := min(x, key=lambda v: (-counts[v], v))] >= 5 * counts[w]}
    root = lambda w: root(form[w]) if w in form else w
    want = [(w, form.get(w), root(w), n, len(near[w]), counts[form[w]] if w in form else None) for w, n in counts.items()]
    assert sorted(map(tuple, spelling.spelling_variants(words).collect()), key=str) == sorted(want, key=str)
    assert form and any(root(w) != form[w] for w in form) and any(len(w) > spelling.MATRIX_WIDTH and near[w] for w in counts)


def test_chains_of_forms_and_no_words(spark, docs):
    chain = [(f"w{i}", f"w{i + 1}") for i in range(13)] + [("a", "b")]
    roots = dict(map(tuple, spelling.follow_forms(spark.createDataFrame(chain, "word string, form string")).collect()))
    assert roots == {w: "b" if w == "a" else "w13" for w, _ in chain}
    assert not spelling.spelling_variants(staged(spelling.vocabulary(docs.where("false")), "none")).collect()


def test_quality_is_learned_from_the_rest(spark):
    rng = random.Random(2)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 9))) for _ in range(300)]
    good = lambda: ". ".join(" ".join(rng.choices(words, k=9)) for _ in range(8))
    spoil = [lambda t: t.upper() + "!!", lambda t: t.replace(" ", "%% "), lambda t: " ".join([t.split()[0]] * 60)]
    rows = [(i, good() if i % 5 else rng.choice(spoil)(good()), int(i % 5 > 0)) for i in range(900)]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t, _ in rows], "doc_id long, text string, score string, id int")
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows] + [(None, 0, 0), (5, None, 0), (5, 0, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit_quality(docs, labels)
    found = quality.score_quality(docs, model)
    assert found.columns == [*docs.columns, "score_"]
    scores = {r["doc_id"]: r["score_"] for r in found.collect()}
    held = [(scores[i], q) for i, _, q in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([(s >= 0.5) == q for s, q in held]) > 0.98 and all(0 <= s <= 1 for s in scores.values())
    flags = {r["doc_id"]: r["h"] for r in docs.select("doc_id", quality.held_out(F.col("doc_id")).alias("h")).collect()}
    assert flags == {i: zlib.crc32(str(i).encode()) % 3 == 1 for i, _, _ in rows}
    # What is held out changes nothing.
    flipped = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = quality.fit_quality(docs, flipped)
    assert np.array_equal(again.single, model.single) and np.array_equal(again.grids, model.grids)


def test_quality_of_awkward_rows(spark, docs, rows):
    labels = spark.createDataFrame([(i, i % 2) for i in range(0, 150)], "doc_id long, quality int")
    model = quality.fit_quality(docs, labels)
    found = quality.score_quality(docs, model).collect()
    by_text = {}
    for r in found:
        by_text.setdefault(r["text"] or "", set()).add(r["score_"])
    assert len(found) == len(rows) and all(len(s) == 1 for s in by_text.values())
    assert not quality.score_quality(docs.where("false"), model).collect()
    blank = quality.score_quality(docs, quality.fit_quality(docs, labels.where("false")))
    assert {r["score_"] for r in blank.collect()} == {0.5}


def test_tables_find_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.random((3000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 2] > 0.3)).astype(float)
    model = quality.train(x, y, np.ones(3000))
    assert model.pairs[0] == (0, 2)
    fresh = rng.random((2000, 3))
    truth = (fresh[:, 0] > 0.5) ^ (fresh[:, 2] > 0.3)
    assert ((model.scores(fresh) >= 0.5) == truth).mean() > 0.9


def test_queries_get_all_their_neighbours_whatever_the_first_limit(spark, monkeypatch):
    from tickersift.llm import adaptive_search

    monkeypatch.setattr(adaptive_search.Index, "first_limits", lambda self, lifted, k: np.zeros(len(lifted), np.float32))
    rng = np.random.default_rng(3)
    table = spark.createDataFrame([(i, rng.standard_normal(8).tolist()) for i in range(300)], "vec_id long, embedding array<double>")
    found = adaptive_search.approximate_top_k(table, F.col("vec_id") % 20 == 0, 7, list_rows=30).groupBy("query_id").count().collect()
    assert {r["query_id"]: r["count"] for r in found} == {i: 7 for i in range(0, 300, 20)}
