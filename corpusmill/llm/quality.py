"""Quality classifier: naive Bayes support vectors (Wang and Manning 2012).

1. Indicators of a whole text's n-grams, hashed to ``2 ** BITS`` buckets: words
   and word pairs (A-Z lower-cased); one to four successive runs of one
   character class (lower case, upper case, digits, white space, each mark by
   itself, with the run's length in three steps); and of four successive
   words, which are equal.
2. An indicator is scaled by its class log-count ratio r = log((a + p) / |a + p|)
   - log((a + q) / |a + q|), p and q the numbers of high and low quality texts that
   have it. Indicators of fewer than ``min_support`` texts are left out, and a
   text's scaled indicators are brought to length one.
3. A linear hinge-loss model by dual coordinate descent (Hsieh et al. 2008),
   each class weighted alike in total; a logistic curve over the margins of
   rows kept back from it turns margins into scores.

Only rows whose crc32(doc_id as text) mod 5 is not 0 give labels. Inputs of a
score are the text's own n-grams, never labels, lang, source or doc_id.

Bounds (parameters): the classifier (ratios, weights, curve) is fitted on at
most ``labelled_rows`` labelled texts, chosen by a hash of the id; every whole
text is scored, in one pass. Nulls: a null text is scored as the empty text; a row with
a null doc_id counts as held out; labels that are null or not 0/1 are ignored,
of several labels of one doc_id the largest holds. Without labels of both
classes every text gets the share of high quality among the labels (0.5
without any). Repeated rows give repeated results; an empty table gives an empty
result. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import BLOCK, WORD_CODE, batch_words, drop, mix, pick, pieces, text_buffer, written

LABELLED_ROWS = 12_000
BITS = 18
MIN_SUPPORT = 5
THRESHOLD = 0.3
PIECE = 1 << 19          # bytes of texts that are cut into n-grams at a time

# character classes: marks by themselves, the others together
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[97:123] = 1                       # lower case, and every byte of a character beyond ASCII
_CLASS[128:] = 1
_CLASS[65:91] = 2
_CLASS[48:58] = 3
_CLASS[[32, 9, 11, 12, 13]] = 4
_STREAMS = {"word": 1, "pair": 2, "shape": 3, "equal": 8}


# ---------------------------------------------------------------- indicators
def _bucket(h: np.ndarray, stream: int) -> np.ndarray:
    return (mix(h + WORD_CODE[40 + stream]) >> np.uint64(64 - BITS)).astype(np.int64)


def _shapes(buf: np.ndarray, off: np.ndarray):
    """(code, text) of each run of one character class, in blocks; a block
    starts with the last three runs of the one before."""
    starts = off[:-1]
    at, size = 0, BLOCK
    code, text = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    while at < len(buf):
        to = min(len(buf), at + size)
        kind = _CLASS[buf[at:to]]
        new = np.ones(len(kind), bool)
        new[1:] = kind[1:] != kind[:-1]
        new[starts[np.searchsorted(starts, at):np.searchsorted(starts, to)] - at] = True
        run = np.append(np.flatnonzero(new), len(kind))
        if to < len(buf):                        # the last run may go on
            if len(run) == 2:
                size *= 2
                continue
            run = run[:-1]
        length = np.diff(run)
        step = 1 + (length > 1) + (length > 3)
        more = kind[run[:-1]].astype(np.uint64) * np.uint64(4) + step.astype(np.uint64)
        code = np.concatenate((code[-3:], more))
        text = np.concatenate((text[-3:], np.searchsorted(off, run[:-1] + at, "right") - 1))
        yield code, text
        at, size = at + int(run[-1]), BLOCK


def indicators(buf: np.ndarray, off: np.ndarray, wanted: np.ndarray | None = None):
    """(text, bucket) of the distinct n-gram buckets of each text, sorted;
    with ``wanted`` only the buckets that it marks."""
    found = []

    def add(text, bucket):
        if wanted is not None:
            keep = wanted[bucket]
            text, bucket = text[keep], bucket[keep]
        found.append(np.unique((text << BITS) | bucket))

    for _, _, _, _, h, owner in batch_words(buf, off):
        add(owner, _bucket(h, _STREAMS["word"]))
        same = owner[1:] == owner[:-1]
        add(owner[1:][same], _bucket(h[:-1] * WORD_CODE[0] + h[1:] * WORD_CODE[1], _STREAMS["pair"])[same])
        if len(h) > 3:
            inside = owner[3:] == owner[:-3]
            equal = np.zeros(len(h) - 3, np.uint64)
            for k, (i, j) in enumerate(((0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3))):
                equal |= (h[i:len(h) - 3 + i] == h[j:len(h) - 3 + j]).astype(np.uint64) << np.uint64(k)
            add(owner[3:][inside], _bucket(equal, _STREAMS["equal"])[inside])
    for code, text in _shapes(buf, off):
        for n in range(1, min(4, len(code)) + 1):
            inside = text[n - 1:] == text[:len(text) - n + 1]
            h = np.zeros(len(code) - n + 1, np.uint64)
            for k in range(n):
                h = h * np.uint64(1024) + code[k:len(code) - n + 1 + k]
            add(text[n - 1:][inside], _bucket(h, _STREAMS["shape"] + n)[inside])
    keys = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return keys >> BITS, keys & ((1 << BITS) - 1)


# ---------------------------------------------------------------- model
def log_count_ratios(sets, y: np.ndarray, min_support: int = MIN_SUPPORT, alpha: float = 1.0) -> np.ndarray:
    """r of every bucket from the rows' sets of distinct buckets and their labels;
    0 for buckets of fewer than ``min_support`` rows."""
    count = np.zeros((2, 1 << BITS))
    for buckets, label in zip(sets, y):
        count[label, buckets] += 1
    q, p = count
    used = p + q >= min_support
    if not used.any():
        return np.zeros(1 << BITS)
    p, q = p + alpha, q + alpha
    return np.where(used, np.log(p / p[used].sum()) - np.log(q / q[used].sum()), 0.0)


def dual_coordinate_descent(row, y: np.ndarray, cost: np.ndarray, width: int, rounds: int = 40, tolerance: float = 0.01,
                            seed: int = 3) -> np.ndarray:
    """Weights (intercept last) of min |w|^2 / 2 + sum cost_i max(0, 1 - y_i w x_i), y in -1, 1; row(i) gives
    the columns and values of x_i. One dual variable at a time, in a random order, until none violates its
    bounds by more than ``tolerance``."""
    rng = np.random.default_rng(seed)
    n = len(y)
    w = np.zeros(width + 1)
    alpha = np.zeros(n)
    for _ in range(rounds):
        worst = 0.0
        for i in rng.permutation(n):
            cols, x = row(i)
            slope = y[i] * (w[cols] @ x + w[-1]) - 1
            a = alpha[i]
            if (a == 0 and slope >= 0) or (a == cost[i] and slope <= 0):
                continue
            worst = max(worst, abs(slope))
            alpha[i] = min(max(a - slope / (x @ x + 1.0), 0.0), cost[i])
            step = (alpha[i] - a) * y[i]
            w[cols] += step * x
            w[-1] += step
        if worst < tolerance:
            break
    return w


def logistic_curve(margin: np.ndarray, y: np.ndarray, rounds: int = 60) -> tuple[float, float]:
    """Slope and shift of a logistic curve over margins, with softened targets (Platt 1999)."""
    hi, lo = (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2)
    target = np.where(y == 1, hi, lo)
    ab = np.array([1.0, 0.0])
    x = np.column_stack([margin, np.ones(len(margin))])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ ab, -30, 30)))
        hessian = (x * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(hessian, x.T @ (target - p))
        ab += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return max(float(ab[0]), 1e-3), float(ab[1])


@dataclass
class Model:
    ratio: np.ndarray
    weights: np.ndarray
    curve: tuple[float, float]

    def margins(self, buf, off) -> np.ndarray:
        n = len(off) - 1
        text, bucket = indicators(buf, off, self.ratio != 0)
        r = self.ratio[bucket]
        size = np.sqrt(np.bincount(text, r * r, n))
        return np.bincount(text, r * self.weights[bucket], n) / np.maximum(size, 1e-12) + self.weights[-1]

    def scores(self, buf, off) -> np.ndarray:
        slope, shift = self.curve
        return 1 / (1 + np.exp(-np.clip(slope * self.margins(buf, off) + shift, -30, 30)))


def train(sets: list[np.ndarray], y: np.ndarray, *, min_support: int = MIN_SUPPORT, c: float = 4.0) -> Model:
    """Model of rows with sets of distinct buckets and labels y; each fifth row
    is kept back for the curve."""
    n = len(y)
    share = float(y.mean()) if n else 0.5
    back = np.arange(n) % 5 == 4
    fit = np.flatnonzero(~back)
    if len(set(y[fit])) < 2:
        odds = np.log(max(share, 1e-3) / max(1 - share, 1e-3))
        return Model(np.zeros(1 << BITS), np.zeros((1 << BITS) + 1), (1.0, float(odds)))
    ratio = log_count_ratios((sets[i] for i in fit), y[fit], min_support)

    def row(i):
        cols = sets[i]
        x = ratio[cols]
        return cols, x / max(np.sqrt(x @ x), 1e-12)

    sign = np.where(y[fit] == 1, 1.0, -1.0)
    cost = c * len(fit) / 2 / np.where(sign > 0, (sign > 0).sum(), (sign < 0).sum())
    w = dual_coordinate_descent(lambda i: row(fit[i]), sign, cost, 1 << BITS)
    test = np.flatnonzero(back) if len(set(y[back])) == 2 else np.arange(n)
    margin = np.array([w[cols] @ x + w[-1] for cols, x in map(row, test)])
    return Model(ratio, w, logistic_curve(margin, y[test]))


# ---------------------------------------------------------------- Spark
def _labelled(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """(doc_id, text, quality) of at most ``most`` labelled training ids, by a hash of the id."""
    trains = F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    known = labels.where("quality in (0, 1)").where(trains).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    spot = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30))
    n = max(known.count(), 1)
    few = known.where(spot < int((1 << 30) * min(1.0, most / n))).orderBy(spot, "doc_id").limit(most)
    return docs.where(trains).join(F.broadcast(few), "doc_id")        # at most ``most`` small rows


def fit(docs: DataFrame, labels: DataFrame, *, labelled_rows: int = LABELLED_ROWS, min_support: int = MIN_SUPPORT) -> Model:
    """docs (doc_id, text), labels (doc_id, quality)."""
    sample = written(_labelled(docs, labels, labelled_rows).repartition(16), "quality-sample")

    def cut(batches):
        for b in pieces(batches, most=PIECE):
            text, bucket = indicators(*text_buffer(b["text"]))
            off = np.searchsorted(text, np.arange(b.num_rows + 1))
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"], b["quality"], pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(bucket, pa.int32()))],
                ["doc_id", "quality", "idx"])

    # bounded by labelled_rows
    rows = sample.mapInArrow(cut, "doc_id long, quality int, idx array<int>").toArrow()
    drop(sample)
    if not len(rows):
        return train([], np.zeros(0, int))
    idx = rows["idx"].combine_chunks()
    off = np.concatenate(([0], np.cumsum(pc.list_value_length(idx).to_numpy(zero_copy_only=False))))
    y, ids = rows["quality"].to_numpy().astype(int), rows["doc_id"].to_numpy()
    flat = idx.flatten().to_numpy()
    order = np.lexsort((np.diff(off), ids))                       # no matter which task a row came from
    order = order[np.random.default_rng(1).permutation(len(order))]
    return train([flat[off[i]:off[i + 1]] for i in order], y[order], min_support=min_support)


def score_texts(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label_id: str = "doc_id",
                label: str = "quality", threshold: float = THRESHOLD, **how) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    src = pick(docs, doc_id=(doc_id, "long"), text=(text, "string"))
    model = fit(src, pick(labels, doc_id=(label_id, "long"), quality=(label, "int")), **how)
    held = src.sparkSession.sparkContext.broadcast(model)             # 2 ** BITS ratios and weights

    def score(batches):
        for b in pieces(batches, most=PIECE):
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["held_out"], pa.array(held.value.scores(*text_buffer(b["text"])))],
                                             ["doc_id", "held_out", "score"])

    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(True))
    return (src.select("doc_id", "text", held_out.alias("held_out"))
            .mapInArrow(score, "doc_id long, held_out boolean, score double")
            .withColumn("predicted", (F.col("score") >= threshold).cast("int")))
