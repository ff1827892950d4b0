import random

import numpy as np
import zlib

from tests.llm.cases import EDGE_SCHEMA, edge_docs, no_docs, words
from corpusmill.llm import decontam as D
from corpusmill.llm import toxicity as X

BAD = ["zarg", "bloop", "idiot"]


def corpus(spark, n=600, seed=1):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        t = words(rng, rng.randrange(20, 120), 3000).split(" ")
        bad = i % 6 == 0
        for _ in range(rng.randrange(2, 6) if bad else 0):
            t[rng.randrange(len(t))] = rng.choice(BAD) + rng.choice(["", "", "ish", "son"])
        rows.append((i, " ".join(t)))
        if i % 3 != 1:
            labels.append((i, int(bad) if rng.random() > 0.02 else 1 - int(bad)))
    return rows, spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out_accuracy(spark):
    rows, docs, labels = corpus(spark)
    got = {r.doc_id: r for r in X.score_texts(docs, labels).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    held = [i for i, _ in rows if got[i].held_out]
    assert np.mean([got[i].predicted == (i % 6 == 0) for i in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())


def test_label_model_finds_accuracies_and_discounts_copies():
    rng = np.random.default_rng(0)
    y = rng.random(4000) < 0.2
    votes = np.stack([np.where(y, rng.random(4000) < a, rng.random(4000) < b) for a, b in ((0.9, 0.02), (0.6, 0.05), (0.3, 0.3))], 1)
    votes = np.hstack([votes, votes[:, :1], votes[:, :1]])            # two voters that repeat the first
    label = np.where(rng.random(4000) < 0.3, y.astype(float), np.nan)
    m = X.label_model(votes, label)
    assert abs(m["fire_toxic"][0] - 0.9) < 0.06 and abs(m["fire_clean"][0] - 0.02) < 0.02
    assert m["weight"][0] < 0.45 < m["weight"][1]
    assert ((m["posterior"] > 0.5) == y).mean() > 0.93


def test_toxicity_edges(spark):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (4, 7), (None, 1), (99, 0)], "doc_id long, toxic int")
    got = X.score_texts(edge_docs(spark), labels).collect()
    assert len(got) == edge_docs(spark).count() and all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out for r in got if r.doc_id is None)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in X.score_texts(spark.createDataFrame([(1, "you idiot moron"), (2, "fine")], "doc_id long, text string"), none).collect()}
    assert got[1] >= got[2]
    assert X.score_texts(no_docs(spark), none).count() == 0
    _, docs, lab = corpus(spark, 60)
    twice = X.score_texts(docs.unionByName(docs), lab).groupBy("doc_id").agg({"score": "max", "*": "count"}).collect()
    assert all(r["count(1)"] == 2 for r in twice)


def bench_case(spark):
    rng = random.Random(8)
    items = [(i, words(rng, n, 20000) + ". " + words(rng, 8, 20000) + ".") for i, n in enumerate([12, 20, 40, 60, 110])]
    rows = [(i, words(rng, rng.randrange(30, 400), 3000)) for i in range(80)]
    planted = []
    for k in range(40):
        item, text = items[k % len(items)]
        w = text.split(" ")
        if k % 2:
            w = [rng.choice(["zz", "yy"]) if rng.random() < 0.1 else x for x in w]
        host = words(rng, 200, 3000).split(" ")
        at = rng.randrange(200)
        t = " ".join(host[:at] + w + host[at:])
        rows.append((100 + k, t.upper() if k % 4 == 1 else t.replace(". ", "\n") if k % 4 == 3 else t))
        planted.append((100 + k, item))
    half = items[3][1].split(" ")
    rows.append((900, " ".join(half[:20]) + " " + words(rng, 100, 3000)))          # too little of an item
    return rows, items, planted


def test_finds_planted_and_leaves_clean(spark):
    rows, items, planted = bench_case(spark)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in D.benchmark_matches(docs, bench).collect()}
    assert got == set(planted)
    assert got == {(r.doc_id, r.item_id) for r in D.benchmark_matches(docs, bench, block_items=2).collect()}


def test_weighted_lcs_equals_recursion():
    rng = np.random.default_rng(1)

    def slow(a, b, w):
        if not len(a) or not len(b):
            return 0.0
        return max(slow(a[1:], b, w[1:]), slow(a, b[1:], w), w[0] + slow(a[1:], b[1:], w[1:]) if a[0] == b[0] else 0)
    for _ in range(40):
        a, b, w = rng.integers(0, 3, 6), rng.integers(0, 3, 6), rng.random(6)
        got, x, y = D.weighted_lcs(a, b, w)
        assert abs(got - slow(a, b, w)) < 1e-9 and abs(w[x].sum() - got) < 1e-9 and (a[x] == b[y]).all()


def test_decontam_edges(spark):
    bench = spark.createDataFrame([(1, None), (2, ""), (None, "a b c d e f"), (3, "..."), (4, "a b c"), (4, "a b c")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in D.benchmark_matches(edge_docs(spark), bench).collect()}
    assert {(1, 4), (12, 4)} <= got and all(i == 4 for _, i in got)
    assert D.benchmark_matches(no_docs(spark), bench).count() == 0
    assert D.benchmark_matches(edge_docs(spark), bench.limit(0)).count() == 0
    assert set(EDGE_SCHEMA) and True
