"""Toxicity, ranked search and whitening against brute force, on odd rows, hot groups and tables without rows."""

import math
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnlake.llm import search, toxicity, whitening

# toxicity


def grams(text):
    """The n-grams of a text, by the rule of the docstring."""
    clean = " ".join(re.sub(r"[\W_]+", " ", text.lower()).split())
    clean = f" {clean} " if clean else " "
    return {clean[i : i + n] for n in toxicity.ORDERS for i in range(len(clean) - n + 1)}


def bucket(gram):
    return int(toxicity.buckets(np.array([ord(c) for c in gram], np.uint32))[-1])


@pytest.mark.parametrize("text", ["", "a", "You, YOU idiot!", "naïve  ÉCOLE -- x_9\n\tİst", "ab " * 100, "\U0001f600 ok"])
def test_buckets_are_those_of_the_ngrams(text):
    want = {bucket(g) for g in grams(text)} if text.isascii() else None
    got = toxicity.Presence().of(text).tolist()
    assert len(got) == len(set(got))
    if want is not None:
        assert set(got) == want


def test_slices_do_not_change_buckets(monkeypatch):
    text = " ".join(f"w{i}x{i * i}" for i in range(400))
    whole = set(toxicity.Presence().of(text).tolist())
    monkeypatch.setattr(toxicity, "SLICE", 17)
    assert set(toxicity.Presence().of(text).tolist()) == whole


def test_log_count_ratios_by_brute_force(spark):
    rows = [("you idiot", 1), ("you idiot", 1), ("what an idiot!", 1), ("you are kind", 0), ("", 0), ("a kind day", 0)]
    ratios, far = toxicity.log_count_ratios(spark.createDataFrame(rows, "text string, toxic int").repartition(3))
    size = 1 << toxicity.BUCKET_BITS
    counts = {1: Counter(), 0: Counter()}
    for text, toxic in rows:
        counts[toxic].update({bucket(g) for g in grams(text)})
    totals = {c: sum(counts[c].values()) + size for c in (0, 1)}
    for b in {*counts[0], *counts[1], 5}:
        p, n = counts[1][b] + 1, counts[0][b] + 1
        want = math.log(p / totals[1]) - math.log(n / totals[0])
        assert ratios[b] == pytest.approx(want, abs=1e-12)
        assert far[b] == pytest.approx(abs(want) / math.sqrt(1 / p + 1 / n), abs=1e-12)
    assert toxicity.chosen_buckets(far, 0.0, 3).tolist() == sorted(np.argsort(-far, kind="stable")[:3].tolist())


def planted(spark, n=900):
    """Every third text holds one of two words that only labelled toxic ones have; a third are copies of one text."""
    rows, labels = [], []
    for i in range(n):
        toxic = i % 3 == 0
        body = [f"w{(i * 7 + k * 13) % 50} plain" for k in range(20)] if i % 3 != 1 else ["the same text again"] * 10
        rows.append((i, " ".join(body[:10] + (["vile" if i % 2 else "rotten"] if toxic else []) + body[10:])))
        if i % 2 or i % 5 == 0:
            labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return docs, spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxic_words_are_learnt(spark):
    docs, labels = planted(spark)
    found = toxicity.scored(docs, toxicity.train(docs, labels)).collect()
    assert all(r["predicted"] == (r["doc_id"] % 3 == 0) and 0 <= r["score"] <= 1 for r in found)


def test_bounded_fit_learns_the_same(spark):
    docs, labels = planted(spark, 3000)
    assert 1000 < toxicity.labelled(docs, labels, 1200).count() < 1400 < toxicity.labelled(docs, labels).count()
    found = toxicity.scored(docs, toxicity.train(docs, labels, fit_rows=1200)).collect()
    assert all(r["predicted"] == (r["doc_id"] % 3 == 0) for r in found)


def test_toxicity_accuracy_of_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    held = [r for r in toxicity.query(spark, folder).collect() if r["held_out"] and r["doc_id"] in labels]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in held)
    toxic = [r["predicted"] for r in held if labels[r["doc_id"]]]
    clean = [r["predicted"] for r in held if not labels[r["doc_id"]]]
    assert np.mean(toxic) > 0.7 and np.mean(clean) < 0.01


def test_toxicity_of_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame(
        [(1, 1), (1, 0), (2, 1), (3, 0), (7, 0), (None, 1), (9, None), (99, 1), (10, 0), (10, 0)], "doc_id long, toxic int"
    )
    assert {(r["doc_id"], r["toxic"]) for r in toxicity.labelled(odd, labels).collect()} == {(1, 1), (2, 1), (3, 0), (7, 0), (10, 0)}
    docs = odd.withColumn("score", F.lit("old"))
    rows = toxicity.scored(docs, toxicity.train(docs, labels)).collect()
    assert len(rows) == odd.count() and rows[0].asDict().keys() == {*odd.columns, "score", "predicted"}
    assert all(0 <= r["score"] <= 1 for r in rows)
    by_text = {}
    for r in rows:
        assert by_text.setdefault(r["text"] or "", r["score"]) == r["score"]
    assert toxicity.scored(empty, toxicity.train(empty, labels)).collect() == []


@pytest.mark.parametrize(("given", "share"), [([], 1 / 2), ([(1, 1), (2, 1)], 3 / 4), ([(1, 0), (7, 0), (3, 0)], 1 / 5)])
def test_toxicity_without_two_classes(spark, odd, given, share):
    model = toxicity.train(odd, spark.createDataFrame(given, "doc_id long, toxic int"))
    assert {round(r["score"], 9) for r in toxicity.scored(odd, model).collect()} <= {round(share, 9), round(4 / 5, 9)}


def test_long_text_is_read_to_its_end(spark):
    docs, labels = planted(spark)
    model = toxicity.train(docs, labels)
    long = spark.createDataFrame([(1, "w1 plain " * 400_000 + "rotten"), (2, "w1 plain " * 400_000)], "doc_id long, text string")
    assert [r["predicted"] for r in toxicity.scored(long, model).orderBy("doc_id").collect()] == [1, 0]


# ranked search


def terms(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", lower)


def brute_search(docs, items, k):
    docs = [(d, Counter(terms(t))) for d, t in docs if terms(t)]
    n, length = len(docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    weights = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * x + 1))) for t, x in df.items()}
    found = Counter()
    for item, text in {(i, t) for i, t in items if t}:
        scores = []
        for d, c in docs:
            m = 100 - 25 + 25 * sum(c.values()) * n // length
            scores.append((sum(weights[t] * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(text) if t in c), d))
        best = sorted((s for s in scores if s[0] > 0), key=lambda s: (-s[0], s[1] is None, s[1] or 0))[:k]
        found.update((item, rank, d, s) for rank, (s, d) in enumerate(best, 1))
    return found


def searched(df):
    return Counter((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect())


def test_search_of_odd_rows(spark, odd, empty, items):
    docs = [(r["doc_id"], r["text"]) for r in odd.collect()]
    want = brute_search(docs, [(r["item_id"], r["text"]) for r in items.collect()], 20)
    assert searched(search.search(odd, items)) == want
    assert searched(search.search(odd, items, limit=20)) == want  # in parts
    assert search.search(empty, items).collect() == []
    assert search.search(odd, items.limit(0)).collect() == []


@pytest.mark.parametrize("seed", range(4))
def test_search_by_brute_force(spark, seed):
    """Hot words, many ties, copies, and blocks so small that accumulators stop in most of them."""
    random = np.random.default_rng(seed)
    words = np.array([f"W{i}" for i in range(80)])
    odds = 1 / np.arange(1, 81) ** (0.5 + seed / 2)
    text = lambda most: " ".join(random.choice(words, random.integers(0, most), p=odds / odds.sum()))
    docs = [(i, text(60)) for i in range(600)] + [(1000 + i, "W70 w3 w1 W1 w2") for i in range(60)] + [(None, "w70 w3"), (5, "w70")]
    items = [(i, text(25)) for i in range(25)] + [(90, "w70 w3 w1 w70"), (91, "nowhere")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    wanted = spark.createDataFrame(items, "item_id long, text string")
    for k, block in ((20, 300), (3, 40), (1, 1 << 21)):
        assert searched(search.search(frame, wanted, k=k, block=block)) == brute_search(docs, items, k)


def test_accumulators_stop(monkeypatch):
    """Once rare words have filled the result, frequent ones create none: most documents are never added up."""
    texts = ["rare words here and the and"] * 30 + ["and the and of"] * 2000
    items = search.Items(["rare words and the of"])
    holding = np.zeros(len(items.numbers) + 2, np.int64)
    found = [items.postings(t) for t in texts]
    for n, t, _ in found:
        holding[t] += 1
        holding[-2:] += (1, n)
    ranking = search.Ranking(items, holding)
    block = search.Block(
        np.repeat(np.arange(len(texts)), [len(f[1]) for f in found]), np.concatenate([f[1] for f in found]),
        np.concatenate([f[2] for f in found]), np.array([ranking.penalty(f[0]) for f in found]), len(items.numbers),
    )
    counted = []
    monkeypatch.setattr(search.np, "flatnonzero", lambda x, f=np.flatnonzero: counted.append(len(f(x))) or f(x))
    at, scores = block.scores(ranking.queries[0], ranking.weights, 20, 1)
    assert counted[0] == 30 and at.tolist() == list(range(30)) and len(set(scores.tolist())) == 1


# whitening


def exact_whitening(rows, components):
    """By fractions and a symmetric eigen-decomposition of the centred vectors."""
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for v in rows]
    n, d = len(x), len(x[0])
    sums = [sum(v[i] for v in x) for i in range(d)]
    deviations = [sum((n * v[i] - sums[i]) ** 2 for i in range(d)) for v in x]
    centred = np.array([[float(Fraction(v[i]) - Fraction(sums[i], n)) for i in range(d)] for v in x])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    return deviations, values / values.sum(), centred @ vectors[:, :components], values


def vectors_of(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, n string")


@pytest.mark.parametrize("shape", [(200, 6), (50, 40), (300, 3)])
def test_whitening_by_fractions(spark, shape):
    random = np.random.default_rng(shape[0])
    values = random.normal(0, 1, shape) * 2.0 ** random.integers(-2, 9, shape[1]) + random.integers(-3000, 3000, shape[1])
    values[: shape[0] // 3] = values[0]  # a third are one vector
    frame = vectors_of(spark, [(i, v, "x") for i, v in enumerate(values.tolist())]).repartition(4)
    components = min(whitening.COMPONENTS, shape[1])
    deviations, explained, projected, eigenvalues = exact_whitening(values.tolist(), components)
    rows = whitening.whitened(frame).collect()
    assert len(rows) == shape[0] * components
    assert {r["identity_error"] for r in rows} == {rows[0]["identity_error"]} and rows[0]["identity_error"] < 1e-9
    got = np.zeros((shape[0], components))
    for r in rows:
        assert r["n"] == shape[0] and int(r["deviation"]) == deviations[r["vec_id"]]
        assert r["explained"] == pytest.approx(explained[r["component"] - 1], rel=1e-9)
        got[r["vec_id"], r["component"] - 1] = r["whitened"]
    want = projected / np.sqrt(eigenvalues[:components])
    signs = np.sign((got * want).sum(axis=0))
    assert np.abs(got - want * signs).max() < 1e-6
    assert np.abs(np.cov(got.T, bias=True) - np.eye(components)).max() < 1e-9


def test_whitening_drops_what_is_no_vector(spark):
    good = [(i, [float(i % 3), float(i * i % 7), -float(i)], None) for i in range(9)]
    odd = [(1, None, None), (2, [1.0, None, 2.0], "a"), (3, [1.0, float("nan"), 2.0], "a"), (4, [float("inf")] * 3, "a"), (5, [], "a"),
           (6, [1.0, 2.0], "a"), (None, [3.0, 3.0, 3.0], "a"), (8, good[8][1], "again")]
    rows = whitening.whitened(vectors_of(spark, good + odd)).collect()
    assert {r["n"] for r in rows} == {11} and len(rows) == 33
    assert sum(r["vec_id"] is None for r in rows) == 3
    alike = [tuple(r)[1:] for r in rows if r["vec_id"] == 8]
    assert len(alike) == 6 and len(set(alike)) == 3


def test_whitening_without_variance(spark):
    none = whitening.whitened(vectors_of(spark, [])).collect()
    assert none == []
    one = whitening.whitened(vectors_of(spark, [(7, [1.0, 2.0], "x")] * 2)).collect()
    assert [(r["component"], r["whitened"], r["explained"], r["identity_error"], int(r["deviation"])) for r in one] == [
        (1, None, 0.0, None, 0), (2, None, 0.0, None, 0)] * 2
    flat = whitening.whitened(vectors_of(spark, [(i, [float(i), 5.0, 2.0 * i], "x") for i in range(10)])).collect()
    assert {r["component"]: r["whitened"] is None for r in flat} == {1: False, 2: True, 3: True}
    assert flat[0]["identity_error"] < 1e-9


def test_whitening_of_enormous_entries_is_exact(spark):
    values = [[1e13, -3.0], [-1e13, 5.5], [2.5e13, 1e300], [0.25, -1e300]]
    rows = whitening.whitened(vectors_of(spark, [(i, v, "x") for i, v in enumerate(values)])).collect()
    clip = lambda c: math.floor(min(max(64 * c, -(2.0**53)), 2.0**53)) + 1_000_000
    x = [[clip(c) for c in v] for v in values]
    sums = [sum(v[i] for v in x) for i in (0, 1)]
    want = {i: sum((4 * v[k] - sums[k]) ** 2 for k in (0, 1)) for i, v in enumerate(x)}
    assert {r["vec_id"]: int(r["deviation"]) for r in rows} == want


def test_whitening_refuses_very_wide_vectors(spark):
    with pytest.raises(ValueError, match="at most"):
        whitening.whitened(vectors_of(spark, [(1, [0.0] * (whitening.MOST_DIMENSIONS + 1), "x")]))
