import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from corpusmill.llm import common, quality as Q
from tests.llm.cases import edge_docs, no_docs

LABELS = "doc_id long, quality int, toxic int, text string"


def buffer(texts):
    return common.text_buffer(pa.array(texts))


def plain_grams(t):
    """The n-grams of a text by plain loops: word pairs and shapes only as counts of distinct ones."""
    words = [w.lower() if w.isascii() else w for w in t.replace("\t", " ").replace("\n", " ").split(" ") if w]
    kinds = []
    for b in t.encode():
        k = "a" if 97 <= b < 123 or b > 127 else "A" if 65 <= b < 91 else "0" if 48 <= b < 58 else " " if b in b" \t\n\x0b\x0c\r" else chr(b)
        if k == " ":
            k = "\n" if b == 10 else " "
        kinds.append(k)
    runs = []
    for k in kinds:
        if runs and runs[-1][0] == k:
            runs[-1][1] += 1
        else:
            runs.append([k, 1])
    runs = [(k, min(3, 1 + (n > 1) + (n > 3))) for k, n in runs]
    grams = {("w", w) for w in words} | {("p", *p) for p in zip(words, words[1:])}
    for i in range(len(words) - 3):
        q = words[i:i + 4]
        grams.add(("e", tuple(q[a] == q[b] for a, b in ((0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3)))))
    for n in range(1, 5):
        grams |= {("s", *runs[i:i + n]) for i in range(len(runs) - n + 1)}
    return grams


@pytest.mark.parametrize("block", [7, 64, 1 << 20])
def test_indicators_are_the_distinct_n_grams(monkeypatch, block):
    monkeypatch.setattr(Q, "BLOCK", block)
    rng = random.Random(4)
    texts = ["", "a", "One two, two!! 33", " x\n\ny  z ", "é É ü###", "same same same same same"]
    texts += ["".join(rng.choice("ab AB1!#\n ") for _ in range(rng.randrange(60))) for _ in range(40)]
    text, bucket = Q.indicators(*buffer(texts))
    assert (np.diff(text) >= 0).all()
    for i, t in enumerate(texts):
        got = bucket[text == i]
        assert len(set(got)) == len(got)
        # 2 ** 18 buckets: a rare collision may join two n-grams
        assert 0 <= len(plain_grams(t)) - len(got) <= 1, t
        alone = Q.indicators(*buffer([t]))[1]
        assert (alone == got).all()


def test_ratios_by_hand():
    r = Q.log_count_ratios([np.array(s) for s in ([1, 2], [1], [2, 3], [2])], np.array([1, 1, 0, 0]), min_support=2)
    # bucket 1: p 2, q 0; bucket 2: p 1, q 2; bucket 3 is too rare
    assert r[1] == pytest.approx(np.log(3 / 5) - np.log(1 / 4)) and r[2] == pytest.approx(np.log(2 / 5) - np.log(3 / 4)) and r[3] == 0


def test_dual_coordinate_descent_solves_the_hinge_loss():
    rng = np.random.default_rng(0)
    n, d = 120, 6
    x = rng.normal(size=(n, d))
    y = np.where(x[:, 0] + 0.5 * rng.normal(size=n) > 0.3, 1.0, -1.0)
    v = Q.dual_coordinate_descent(lambda i: (np.arange(d), x[i]), y, np.full(n, 0.7), d, rounds=3000, tolerance=1e-8)
    full = np.column_stack([x, np.ones(n)])

    def loss(u):
        return u @ u / 2 + 0.7 * np.maximum(0, 1 - y * (full @ u)).sum()
    best = loss(v)
    for _ in range(300):
        assert loss(v + rng.normal(size=d + 1) * rng.choice([1e-3, 1e-2, 0.1])) >= best - 1e-6


def documents(n, seed=8):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = ["".join(rng.choice("aeinrst") for _ in range(rng.randrange(2, 8))) for _ in range(rng.randrange(1, 60))]
        good = rng.random() < 0.8
        if not good:
            kind = rng.randrange(3)
            words = [w + "%%%" for w in words] if kind == 0 else [w.upper() + "!!" for w in words] if kind == 1 else [words[0]] * 20
        rows.append((i, " ".join(words)))
        if rng.random() < 0.7:
            labels.append((i, int(good), 0, "x"))
    return rows, labels


def test_held_out_accuracy_and_no_leak(spark):
    rows, labels = documents(1500)
    truth = dict((i, q) for i, q, *_ in labels)
    docs, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, LABELS)
    got = {r.doc_id: r for r in Q.score_texts(docs, lab).collect()}
    assert len(got) == len(rows)
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for i, r in got.items())
    held = [i for i in truth if got[i].held_out]
    assert np.mean([got[i].predicted == truth[i] for i in held]) > 0.97
    # other labels of held-out rows change nothing
    other = spark.createDataFrame([(i, 1 - q if got[i].held_out else q, t, x) for i, q, t, x in labels], LABELS)
    assert {r.doc_id: r.score for r in Q.score_texts(docs, other).collect()} == {i: r.score for i, r in got.items()}
    # a bounded sample still gives every row
    few = Q.score_texts(docs, lab, labelled_rows=200, min_support=2).collect()
    assert len(few) == len(rows) and np.mean([r.predicted == truth[r.doc_id] for r in few if r.doc_id in truth and r.held_out]) > 0.9


def test_edges(spark):
    docs = edge_docs(spark)
    none = spark.createDataFrame([], LABELS)
    got = Q.score_texts(docs, none).collect()
    assert len(got) == docs.count() and {round(r.score, 6) for r in got} == {0.5}
    lab = spark.createDataFrame([(i, i % 2, 0, "x") for i in range(14)] + [(None, 1, 0, ""), (3, None, 0, ""), (4, 7, 1, ""), (5, 0, 0, ""), (5, 1, 0, "")], LABELS)
    got = Q.score_texts(docs, lab, min_support=1)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = got.collect()
    assert len(rows) == docs.count() and all(r.held_out for r in rows if r.doc_id is None)
    assert len({r.score for r in rows if r.doc_id == 1}) == 1
    assert Q.score_texts(no_docs(spark), lab).collect() == []
    assert Q.score_texts(no_docs(spark), none).collect() == []
