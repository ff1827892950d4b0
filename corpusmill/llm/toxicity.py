"""Toxicity by weak supervision.

1. Voters: a lexicon, stems and words mined from labelled training texts (by
   their likelihood ratio between the classes), and surface patterns.
2. A generative label model over a bounded sample: each voter fires with its
   own probability under either class; the given label is one more voter of
   unknown accuracy. Accuracies, the class prior and the voters' correlations
   within a class are estimated by expectation-maximisation; correlated voters
   share their weight.
3. A linear classifier (logistic regression) is trained on the posterior
   labels of the sample, scaled on its training labels so that 0.5 parts the
   classes, and scores every whole text in one pass.

Only rows whose crc32(doc_id as text) mod 5 is not 0 give labels. Inputs of a
score are the text's own voters, never labels, lang, source or doc_id.

Bounds (parameters): ``labelled_rows`` labelled and ``plain_rows`` unlabelled
texts in the sample, ``max_voters`` mined voters. Nulls: a null text is scored
as the empty text; a row with a null doc_id counts as held out; labels that
are null or not 0/1 are ignored, of several labels of one doc_id the largest
holds. Without labels the lexicon votes alone. Repeated rows give repeated
results; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import drop, pick, quoted, written

LABELLED_ROWS = 20_000
PLAIN_ROWS = 5_000
MAX_VOTERS = 300
MIN_SUPPORT = 4           # toxic training texts that a mined voter must occur in
STEM = range(3, 9)        # lengths of mined stems

# A start; everything else is learned.
LEXICON = ("idiot", "moron", "stupid", "dumb", "loser", "scum", "trash", "pathetic", "worthless", "disgusting",
           "clown", "imbecile", "filth", "vermin", "fool", "ugly", "hate", "shut up", "go die")
_WORD = re.compile(r"[^\W\d_]+")
PATTERNS = {
    "insult_address": re.compile(r"\byou(?:'re| are)?(?: such)? an? \w+", re.I),
    "shouting": re.compile(r"\b[A-Z]{4,}\b"),
    "exclaiming": re.compile(r"!{2,}"),
    "masked_word": re.compile(r"\b[a-z]+[*#@$%&]+[a-z]+\b", re.I),
}


@dataclass
class Voters:
    """Feature index of each voter: whole words, stems, then patterns."""
    words: dict[str, int] = field(default_factory=dict)
    stems: dict[str, int] = field(default_factory=dict)
    phrases: dict[str, int] = field(default_factory=dict)
    n: int = 0

    def add(self, table: str, key: str):
        if key not in getattr(self, table):
            getattr(self, table)[key] = self.n
            self.n += 1

    @property
    def width(self) -> int:
        return self.n + len(PATTERNS)

    def counts(self, text: str) -> tuple[Counter, int]:
        """How often each voter fires in a whole text, and its number of words."""
        low = text.lower()
        bag = Counter(_WORD.findall(low))
        fired: Counter = Counter()
        words, stems = self.words, self.stems
        lengths = self.lengths
        for w, c in bag.items():
            j = words.get(w)
            if j is not None:
                fired[j] += c
            for k in lengths:
                if len(w) < k:
                    break
                j = stems.get(w[:k])
                if j is not None:
                    fired[j] += c
        for p, j in self.phrases.items():
            if p in low:
                fired[j] += low.count(p)
        for k, pattern in enumerate(PATTERNS.values()):
            c = sum(1 for _ in pattern.finditer(text))
            if c:
                fired[self.n + k] += c
        return fired, sum(bag.values())

    @property
    def lengths(self):
        return sorted({len(s) for s in self.stems})


def _features(texts, voters: Voters):
    """CSR parts: offsets, voter indexes, counts, and words per text."""
    off, idx, cnt, words = [0], [], [], []
    for t in texts:
        fired, n = voters.counts(t or "")
        idx.extend(fired.keys())
        cnt.extend(fired.values())
        off.append(len(idx))
        words.append(n)
    return np.array(off), np.array(idx, np.int64), np.array(cnt, float), np.array(words, float)


def design(off, idx, cnt, words, width: int, lexical: int) -> np.ndarray:
    """Inputs of the classifier: log counts of each voter, then totals over
    the lexical voters that are likelier in toxic texts."""
    x = np.zeros((len(words), width + 3), np.float32)
    rows = np.repeat(np.arange(len(words)), np.diff(off))
    x[rows, idx] = np.log1p(cnt)
    lex = idx < lexical
    hits = np.bincount(rows[lex], cnt[lex], len(words))
    kinds = np.bincount(rows[lex], None, len(words))
    x[:, width] = np.log1p(hits)
    x[:, width + 1] = np.log1p(kinds)
    x[:, width + 2] = np.log1p(1000 * hits / np.maximum(words, 1))
    return x


# ---------------------------------------------------------------- label model
def label_model(fires: np.ndarray, label: np.ndarray, rounds: int = 12) -> dict:
    """Posterior of class 1 per row. fires: (rows, voters) 0/1; label: 1, 0 or
    nan where none was given. Returns posteriors, accuracies and weights."""
    n, m = fires.shape
    known = ~np.isnan(label)
    votes = fires.astype(np.float32)
    both = (votes.T @ votes).astype(float)      # how often two voters fire together
    q = np.where(known, np.where(label == 1, 0.95, 0.05), 0.0)
    if not known.any():
        q = np.clip(0.02 + 0.9 * (votes.sum(1) > 0), 0, 1)
    else:                                     # unlabelled rows start at the labelled rows' share
        q[~known] = q[known].mean()
    weight = np.ones(m)
    for step in range(rounds):
        total1, total0 = q.sum() + 2, (1 - q).sum() + 2
        in1, in0 = q.astype(np.float32) @ votes, (1 - q).astype(np.float32) @ votes
        p1 = (in1 + 0.5) / total1
        p0 = (in0 + 0.5) / total0
        right1 = (q[known] @ (label[known] == 1) + 9) / (q[known].sum() + 10)
        right0 = ((1 - q[known]) @ (label[known] == 0) + 9) / ((1 - q[known]).sum() + 10)
        prior = np.clip(q.mean(), 1e-3, 1 - 1e-3)
        if step in (0, 3, 6):                 # correlations of the voters within a class
            # residual products from sums alone: no matrix of residuals
            cross = np.outer(in1, p1) + np.outer(in0, p0)
            mixed = q @ (1 - q) * (np.outer(p1, p0) + np.outer(p0, p1))
            cov = (both - cross - cross.T + q @ q * np.outer(p1, p1) + mixed + (1 - q) @ (1 - q) * np.outer(p0, p0)) / n
            sd = np.sqrt(np.maximum(np.diag(cov), 0)) + 1e-9
            rho = np.clip(cov / np.outer(sd, sd), 0, 1)
            rho[rho < 0.1] = 0
            np.fill_diagonal(rho, 0)
            weight = 1 / (1 + rho.sum(1))
        on, off = np.log(p1 / p0), np.log((1 - p1) / (1 - p0))
        odds = np.log(prior / (1 - prior)) + (votes @ (weight * (on - off)).astype(np.float32)).astype(float) + (weight * off).sum()
        given = np.where(label == 1, np.log(right1 / (1 - right0)), np.log((1 - right1) / right0))
        odds = odds + np.where(known, given, 0)
        q = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return {"posterior": q, "fire_toxic": p1, "fire_clean": p0, "weight": weight, "label_right": (right1, right0), "prior": prior}


def fit_logistic(x: np.ndarray, target: np.ndarray, ridge: float = 0.1, rounds: int = 25) -> np.ndarray:
    """Weights (intercept last) of a logistic regression on soft targets."""
    w = np.zeros(x.shape[1] + 1)
    pull = np.full(len(w), ridge)
    pull[-1] = 1e-3
    for _ in range(rounds):
        hessian, slope = np.diag(pull), -pull * w
        for at in range(0, len(x), 2048):              # a few rows at a time: bounds the driver's memory
            part = np.column_stack([x[at:at + 2048], np.ones(len(x[at:at + 2048]))])
            p = 1 / (1 + np.exp(-np.clip(part @ w, -30, 30)))
            hessian = hessian + (part * np.maximum(p * (1 - p), 1e-4)[:, None]).T @ part
            slope = slope + part.T @ (target[at:at + 2048] - p)
        step = np.linalg.solve(hessian, slope)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-5:
            break
    return w


# ---------------------------------------------------------------- Spark
def _sample(docs: DataFrame, labels: DataFrame, labelled_rows: int, plain_rows: int) -> DataFrame:
    """(doc_id, text, toxic): bounded samples of labelled training texts and of
    other training texts (toxic null), by a hash of the id."""
    trains = F.crc32(F.col("doc_id").cast("string")) % 5 != 0
    spot = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))

    def bounded(rows: DataFrame, most: int) -> DataFrame:
        n = max(rows.count(), 1)
        return rows.where(spot < int((1 << 30) * min(1.0, most / n))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)

    known = labels.where("toxic in (0, 1) and doc_id is not null").where(trains).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    first = bounded(known, labelled_rows)                       # at most labelled_rows small rows
    rows = docs.where("doc_id is not null").where(trains)
    got = rows.join(F.broadcast(first), "doc_id")
    n = max(rows.count(), 1)
    plain = rows.where(spot < int((1 << 30) * min(1.0, (plain_rows + labelled_rows) / n)))
    plain = plain.join(F.broadcast(first.select("doc_id")), "doc_id", "left_anti") \
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(plain_rows).withColumn("toxic", F.lit(None).cast("int"))
    return got.select("doc_id", "text", "toxic").unionByName(plain.select("doc_id", "text", "toxic"))


def mine_voters(sample: DataFrame, max_voters: int = MAX_VOTERS, min_support: int = MIN_SUPPORT,
                lexicon: tuple[str, ...] = LEXICON) -> Voters:
    """The lexicon plus the words and stems with the largest likelihood ratio
    between labelled toxic and clean texts of the sample."""
    labelled = sample.where("toxic is not null")

    def candidates(batches):
        for b in batches:
            seen = [Counter(), Counter()]
            for text, y in zip(b["text"].to_pylist(), b["toxic"].to_pylist()):
                bag = set(_WORD.findall((text or "").lower()))
                found = {"=" + w for w in bag}
                for k in STEM:
                    found.update([w[:k] for w in bag if len(w) >= k])
                seen[y].update(found)
            keys = list(seen[0].keys() | seen[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([seen[1][k] for k in keys], pa.int64()),
                                              pa.array([seen[0][k] for k in keys], pa.int64())], ["key", "pos", "neg"])

    tally = labelled.mapInArrow(candidates, "key string, pos long, neg long").groupBy("key") \
        .agg(F.sum("pos").alias("a"), F.sum("neg").alias("b")).where(F.col("a") >= min_support)
    totals = {r.toxic: r.n for r in labelled.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    voters = Voters()
    for w in lexicon:
        voters.add("phrases" if " " in w else "words", w)
    if totals.get(1) and totals.get(0):
        one, zero = float(totals[1]), float(totals[0])
        a, b = F.col("a").cast("double"), F.col("b").cast("double")
        share = (a + b) / (one + zero)

        def part(x, total):          # x log(x / expected) + (total - x) log(...)
            rest = total - x
            return (F.when(x > 0, x * F.log(x / (total * share))).otherwise(0.0)
                    + F.when(rest > 0, rest * F.log(rest / (total * (1 - share)))).otherwise(0.0))

        top = (tally.where((a / one > 3 * (b + 0.5) / zero) & (a + b < one + zero))
               .withColumn("g", 2 * (part(a, F.lit(one)) + part(b, F.lit(zero)))).where("g > 15")
               .orderBy(F.desc("g"), "key").limit(max_voters).select("key").collect())
        for (key,) in top:
            voters.add(*(("words", key[1:]) if key[0] == "=" else ("stems", key)))
    return voters


@dataclass
class Model:
    voters: Voters
    weights: np.ndarray
    report: dict

    def scores(self, texts) -> np.ndarray:
        parts = _features(texts, self.voters)
        x = design(*parts, self.voters.width, self.voters.n)
        z = x @ self.weights[:-1] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, *, labelled_rows: int = LABELLED_ROWS, plain_rows: int = PLAIN_ROWS,
        max_voters: int = MAX_VOTERS) -> Model:
    """docs (doc_id, text), labels (doc_id, toxic)."""
    sample = written(_sample(docs, labels, labelled_rows, plain_rows).repartition(16), "toxicity-sample")
    voters = mine_voters(sample, max_voters)

    def vote(batches):
        for b in batches:
            off, idx, cnt, words = _features(b["text"].to_pylist(), voters)
            yield pa.RecordBatch.from_arrays(
                [b["toxic"], pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(idx)),
                 pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(cnt)), pa.array(words)],
                ["toxic", "idx", "cnt", "words"])

    # bounded by labelled_rows + plain_rows
    rows = sample.mapInArrow(vote, "toxic int, idx array<long>, cnt array<double>, words double").toArrow()
    drop(sample)
    idx, cnt = rows["idx"].combine_chunks(), rows["cnt"].combine_chunks()
    if not len(rows):
        return Model(voters, np.append(np.zeros(voters.width + 3), -3.0), {})
    off = np.concatenate(([0], np.cumsum(pc.list_value_length(idx).to_numpy(zero_copy_only=False))))
    parts = (off, idx.flatten().to_numpy(), cnt.flatten().to_numpy(), rows["words"].to_numpy())
    x = design(*parts, voters.width, voters.n)
    label = rows["toxic"].to_numpy().astype(float)
    fires = np.hstack([x[:, :voters.width] > 0, x[:, [voters.width + 1]] > np.log1p(1.5), x[:, [voters.width + 2]] > np.log1p(3.0)])
    report = label_model(fires, label)
    weights = fit_logistic(x, report["posterior"])
    known = ~np.isnan(label)
    if 0 < label[known].sum() < known.sum():          # scale and intercept by the training labels (Platt)
        scale, shift = fit_logistic((x[known] @ weights[:-1] + weights[-1])[:, None], label[known], ridge=1e-3)
        weights = np.append(weights[:-1] * scale, weights[-1] * scale + shift)
    return Model(voters, weights, report)


def score_texts(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text",
                label_id: str = "doc_id", label: str = "toxic", threshold: float = 0.5, **how) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    src = pick(docs, doc_id=(doc_id, "long"), text=(text, "string"))
    model = fit(src, pick(labels, doc_id=(label_id, "long"), toxic=(label, "int")), **how)
    held = src.sparkSession.sparkContext.broadcast(model)        # max_voters words and weights

    def score(batches):
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                s = held.value.scores(part["text"].to_pylist())
                yield pa.RecordBatch.from_arrays([part["doc_id"], part["held_out"], pa.array(s)], ["doc_id", "held_out", "score"])

    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(True))
    return (src.select("doc_id", "text", held_out.alias("held_out"))
            .mapInArrow(score, "doc_id long, held_out boolean, score double")
            .withColumn("predicted", (F.col("score") >= threshold).cast("int")))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: documents that are scored toxic go; ids that are null stay."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    verdict = score_texts(docs, labels).where("predicted = 1 and doc_id is not null").select("doc_id").distinct()
    return docs.join(verdict, "doc_id", "left_anti").select(*[quoted(c) for c in docs.columns])
