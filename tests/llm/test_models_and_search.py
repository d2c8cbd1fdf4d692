"""Classifiers on held-out rows, search against all products."""

import random
from collections import Counter

import numpy as np
import pytest
from tessera.llm import quality_classifier, topk_search, toxicity
from tessera.llm._dist import components, dense_ranks

from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(9)
    good = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    rows, labels = [], []
    for i in range(600):
        w = [rng.choice(good) for _ in range(rng.randint(20, 120))]
        junk, toxic = i % 7 == 0, i % 5 == 0
        if junk:
            w = [x.upper() + "!!" for x in w]
        if toxic:
            w.insert(rng.randrange(len(w)), rng.choice(["vileword", "vilewords", "Vileword."]))
        rows.append((i, " ".join(w)))
        if i % 4:
            labels.append((i, int(not junk), int(toxic)))
    labels += [(0, None, None), (1, 1, 0), (10**6, 1, 1)]
    docs = spark.createDataFrame([*rows, (2000, ""), (2001, None), (None, "no id"), rows[3]], "doc_id long, text string")
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), rows


@pytest.mark.parametrize("kind", ["quality", "toxic"])
def test_classifiers_on_held_out_rows(labelled, kind):
    import zlib

    docs, labels, rows = labelled
    out = (quality_classifier if kind == "quality" else toxicity).classify(docs, labels).collect()
    assert len(out) == docs.count()
    m, held = (5, 0) if kind == "quality" else (4, 2)
    assert all(r.held_out == (zlib.crc32(b"" if r.doc_id is None else str(r.doc_id).encode()) % m == held) for r in out)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)
    truth = {i: int(bool(i % 7)) if kind == "quality" else int(i % 5 == 0) for i, _ in rows}
    judged = [(r.predicted, truth[r.doc_id]) for r in out if r.doc_id in truth and r.held_out]
    assert np.mean([p == t for p, t in judged]) > 0.97


def test_without_labels(labelled, spark):
    docs, labels, _ = labelled
    none = labels.limit(0)
    assert all(r.predicted == 1 for r in quality_classifier.classify(docs.limit(5), none).collect())
    assert all(r.predicted == 0 for r in toxicity.classify(docs.limit(5), none).collect())
    assert toxicity.classify(docs.limit(0), labels).collect() == []
    assert toxicity.keep(docs, labels).columns == docs.columns


@pytest.mark.parametrize("spread", [1.0, 30.0])
def test_topk_equals_all_products(spark, spread):
    rng = np.random.default_rng(4)
    base = rng.normal(0, 1, (400, 8)) * np.exp(rng.normal(0, np.log(spread) / 3, (400, 1)))
    vectors = [(i, v.tolist(), 1) for i, v in enumerate(base)]
    vectors += [(400 + i, vectors[7][1], 1) for i in range(40)]  # a common vector
    vectors += [(500, None, 1), (501, [1.0, None] + [0.0] * 6, 1), (502, [float("nan")] * 8, 1), (503, [float("inf")] * 8, 1), (None, [1.0] * 8, 1), (520, [1.0, 2.0], 1), (540, [0.0] * 8, 1)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>, rank int")
    got = {}
    for r in topk_search.search(df, bucket_rows=32, query_rows=8).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    fine = {i: [int(np.floor(64 * x)) for x in v] for i, v, _ in vectors if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    for q in (i for i in fine if i % 20 == 0):
        all_ = sorted(((-sum(a * b for a, b in zip(fine[q], v, strict=True)), i) for i, v in fine.items() if i != q and len(v) == len(fine[q])))[:20]
        assert sorted(got.get(q, [])) == [(k, i, -s) for k, (s, i) in enumerate(all_, 1)]
    assert topk_search.search(df.limit(0)).collect() == []


def test_topk_of_huge_components_and_many_equal_scores(spark):
    """Scores beyond 64 bits saturate, scores beyond 53 bits stay exact, ties go to the lesser id."""
    rng = np.random.default_rng(6)
    vectors = [(i, [float(v) for v in rng.integers(-(2**30), 2**30, 4)]) for i in range(120)]
    vectors += [(200 + i, [3e17, -3e17, 1e18, 0.0]) for i in range(30)] + [(240, [1e300, 1.0, 0.0, 0.0]), (260, [2.0**40 + 1, 1.0, 0.0, 0.0]), (261, [2.0**40 + 1, 1.0, 0.0, 0.0])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    got = {}
    for r in topk_search.search(df, k=5, bucket_rows=16, query_rows=3).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    whole = {i: [int(np.floor(min(max(64 * x, -9.2e18), 9.2e18))) for x in v] for i, v in vectors}
    clip = lambda x: max(min(x, 2**63 - 1), -(2**63))
    for q in (i for i in whole if i % 20 == 0):
        expected = sorted((-clip(sum(a * b for a, b in zip(whole[q], v, strict=True))), i) for i, v in whole.items() if i != q)[:5]
        assert sorted(got[q]) == [(k, i, -s) for k, (s, i) in enumerate(expected, 1)]


def test_short_vectors_do_not_travel(spark):
    """With unequal norms, blocks of queries get few rows: those that are long enough for one of them."""
    rng = np.random.default_rng(8)
    vectors = [(i, (v / np.linalg.norm(v) * length).tolist()) for i, (v, length) in enumerate(zip(rng.normal(0, 1, (3000, 6)), np.exp(rng.normal(0, 1.5, 3000)) * 10, strict=True))]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    met = []
    real = topk_search._met

    def counted(left, right, n, k):
        met.append(right.count())
        return real(left, right, n, k)

    topk_search._met = counted
    try:
        assert topk_search.search(df, bucket_rows=64, query_rows=16).count() == 150 * 20
    finally:
        topk_search._met = real
    blocks = -(-150 // 16)
    assert sum(met) < 0.5 * 3000 * blocks


def test_components_and_ranks(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(k, k + 1) for k in range(300, 360)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}
    df = spark.range(1000).withColumn("k", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 5))
    for k, rows in df.groupBy("k").agg(F.collect_list("id")).collect():
        ranks = sorted(r.r for r in dense_ranks(df.where(F.col("k") == k), ["k"], [F.col("id")], "r", 7).collect())
        assert ranks == list(range(len(rows)))


def sigmoid(x):
    return 1 / (1 + np.exp(-x))


def plain_ftrl(examples, labels, bias, alpha, l1, l2, epochs, beta=1.0):
    """Follow the regularised leader, feature by feature; examples are dicts."""
    z, n, zb, nb = {}, {}, 0.0, 0.0
    weight = lambda f: 0.0 if abs(z.get(f, 0.0)) <= l1 else -(z[f] - np.sign(z[f]) * l1) / ((beta + n[f] ** 0.5) / alpha + l2)
    order = np.random.default_rng(7)
    for _ in range(epochs):
        for k in order.permutation(len(examples)).tolist():
            w = {f: weight(f) for f in examples[k]}
            b = bias - zb / ((beta + nb**0.5) / alpha)
            g = sigmoid(sum(w[f] * x for f, x in examples[k].items()) + b) - labels[k]
            for f, x in examples[k].items():
                have = n.get(f, 0.0)
                n[f] = have + (g * x) ** 2
                z[f] = z.get(f, 0.0) + g * x - (n[f] ** 0.5 - have**0.5) / alpha * w[f]
            zb += g - ((nb + g * g) ** 0.5 - nb**0.5) / alpha * (b - bias)
            nb += g * g
    return {f: weight(f) for f in z}, bias - zb / ((beta + nb**0.5) / alpha)


def test_toxicity_equals_a_plain_version(labelled):
    """Features, ratios, updates and scores, one by one, with Python's dictionaries."""
    _, _, rows = labelled
    items, y = [t for _, t in rows[:150]], [float(i % 5 == 0) for i, _ in rows[:150]]

    def grams(t):
        t = f" {t.lower()} "
        return {t[k : k + n] for n in (4, 5, 6) for k in range(len(t) - n + 1)}

    place = {}

    def own(t):
        out = set()
        for g in grams(t):
            if g not in place:
                h = np.zeros(1, np.uint64) + np.uint64(ord(g[0]))
                for c in g[1:]:
                    h = h * np.uint64(0x1000001B3) + np.uint64(ord(c))
                place[g] = int(toxicity.mix(h + np.uint64(len(g) << 56))[0] >> np.uint64(64 - toxicity.BITS))
            out.add(place[g])
        return out

    sets = [own(t) for t in items]
    ones, zeros = sum(y), len(y) - sum(y)
    p, q = Counter(f for s, v in zip(sets, y, strict=True) if v for f in s), Counter(f for s, v in zip(sets, y, strict=True) if not v for f in s)
    ratio = {f: np.log((p[f] + 0.5) / (ones + 1)) - np.log((q[f] + 0.5) / (zeros + 1)) for f in p.keys() | q.keys()}
    weights, bias = plain_ftrl([{f: ratio[f] for f in s} for s in sets], y, float(np.log((ones + 1) / (zeros + 9))), 0.1, 8.0, 0.5, 3)
    got = toxicity.Scorer(*toxicity.fit(items, y)).score([*items, ""])
    expected = [sigmoid(bias + sum(weights[f] * ratio[f] for f in s)) for s in [*sets, set()]]
    assert np.allclose(got, expected, atol=1e-9) and any(weights.values())


def test_quality_equals_a_plain_version(labelled):
    """Hashed word n-grams, updates and scores, one by one."""
    _, _, rows = labelled
    items, y = [t.encode() for _, t in rows[:80]], [float(bool(i % 7)) for i, _ in rows[:80]]
    owner, place, value = quality_classifier.features(items)
    whole = [{int(f): float(np.float32(v)) for o, f, v in zip(owner, place, value, strict=True) if o == d} for d in range(len(items))]
    # a feature's value is the root of its share of its kind, so the squares of a text's five kinds sum to 5
    assert all(abs(sum(v * v for v in x.values()) - 5) < 0.2 for x in whole)
    words = {w for x in items for w in x.split()}
    word_places = {w: {int(f) for f in quality_classifier.features([w])[1]} for w in list(words)[:20]}
    assert all(word_places[w] & set(whole[d]) for w in word_places for d in range(len(items)) if w in items[d].split())
    weights, bias = plain_ftrl(whole, y, quality_classifier._ftrl.prior(y, 9, 1), 0.5, 0.1, 0.1, 4)
    got = quality_classifier.score([*items, b""], *quality_classifier.fit(items, y))
    expected = [sigmoid(bias + sum(weights[f] * v for f, v in x.items())) for x in [*whole, {}]]
    assert np.allclose(got, expected, atol=1e-6)
