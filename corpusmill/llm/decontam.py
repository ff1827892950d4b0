"""Benchmark decontamination by latent semantic retrieval.

1. One pass over all passages gathers word frequencies and a sparse sign
   sketch of the TF-IDF matrix (each passage is added, with a random sign, to
   one of SKETCH rows): the range finder of a randomised SVD.
2. The sketch and the benchmark's own passages give the latent basis. As the
   benchmark's passages are among the rows, products with them survive the
   projection as long as the rank is not smaller than their number.
3. A second pass searches: passages with so much of an item's rare words that
   the check below can succeed (an exact bound) are projected, and compared by
   cosine with the item's passages.
4. Each candidate is checked in its document: the longest common subsequence
   of words, weighted by squared idf, must cover ``share`` of the item, and
   ``answer_share`` of its answer (its last sentence) unless nearly all of the
   item is there.

Words are runs of ASCII letters, digits and other letters, A-Z lower-cased.
Sums, not rows, reach the driver: FEATURES x (SKETCH + 1) numbers. Benchmarks
larger than BLOCK_ITEMS items are searched in blocks of items.

Nulls: null or empty texts and items have no words and match nothing; rows
with a null doc_id or item_id take no part. Rows that repeat give one result
per (doc_id, item_id). Empty tables give an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import NOT_WORD, batch_words, mix, numbers, pick, pieces, quoted, text_buffer, words_of

FEATURES_BITS = 14
FEATURES = 1 << FEATURES_BITS
SKETCH = 96
RANK = 768
WINDOW, STRIDE = 64, 32
BLOCK_ITEMS = 300
COSINE = 0.3
RARE_IDF = 5.0            # words in fewer than one of 150 passages
SHARE = 0.6
ANSWER_SHARE = 0.5
WHOLE = 0.85                  # above this the answer is not asked for
_CHUNK = 1 << 12


def _feature(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - FEATURES_BITS)).astype(np.int64)


def _sums(docs: DataFrame, vocabulary: np.ndarray):
    """(frequency per feature, frequency per vocabulary word, sketch, passages)."""
    cells = FEATURES * SKETCH

    def gather(batches):
        total = np.zeros(FEATURES, np.int64)
        own = np.zeros(len(vocabulary) + 1, np.int64)
        sketch = np.zeros(cells, np.float32)
        passages = 0
        for b in pieces(batches):
            buf, off = text_buffer(b["text"])
            ids = numbers(b["doc_id"]).astype(np.uint64)
            for _, _, _, _, h, owner in batch_words(buf, off, NOT_WORD):
                if not len(h):
                    continue
                first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
                nth = (np.arange(len(h)) - np.repeat(first, np.diff(np.append(first, len(h))))) // STRIDE
                start = np.flatnonzero(np.concatenate(([True], (owner[1:] != owner[:-1]) | (nth[1:] != nth[:-1]))))
                spot = mix(ids[owner[start]] * np.uint64(0x9E3779B97F4A7C15) + nth[start].astype(np.uint64))
                size = np.diff(np.append(start, len(h)))
                row = np.repeat((spot % np.uint64(SKETCH)).astype(np.int64), size)
                sign = np.repeat(np.where(spot >> np.uint64(63), 1, -1).astype(np.float32), size)
                f = _feature(h)
                np.add.at(sketch, row * FEATURES + f, sign)
                total += np.bincount(f, minlength=FEATURES)
                at = np.searchsorted(vocabulary, h)
                at[at == len(vocabulary)] = 0
                own += np.bincount(np.where(vocabulary[at] == h, at, len(vocabulary)), minlength=len(vocabulary) + 1)
                passages += len(start)
        whole = np.concatenate((sketch, total.astype(np.float32), own.astype(np.float32), np.array([passages], np.float32))).astype(np.float64)
        for k in range(0, len(whole), _CHUNK):
            yield pa.RecordBatch.from_arrays([pa.array([k // _CHUNK], pa.int32()), pa.array([whole[k:k + _CHUNK].astype(np.float32).tobytes()], pa.binary())],
                                             ["chunk", "part"])

    def add(t: pa.Table) -> pa.Table:
        out = np.zeros(len(t["part"][0].as_py()) // 4)
        for x in t["part"]:
            out += np.frombuffer(x.as_py(), np.float32)
        return pa.table({"chunk": t["chunk"][:1], "part": pa.array([out.tobytes()], pa.binary())})

    schema = "chunk int, part binary"
    spread = docs.mapInArrow(gather, schema)
    merged = spread.groupBy("chunk").applyInArrow(add, schema)
    rows = merged.toArrow()                                  # of fixed size
    parts = dict(zip(rows["chunk"].to_pylist(), rows["part"].to_pylist()))
    if not parts:
        return None
    whole = np.concatenate([np.frombuffer(parts[k], np.float64) for k in range(len(parts))])
    sketch, rest = whole[:cells].reshape(SKETCH, FEATURES), whole[cells:]
    return rest[:FEATURES], rest[FEATURES:FEATURES + len(vocabulary)], sketch, rest[-1]


def latent_basis(sketch: np.ndarray, items: np.ndarray, rank: int) -> np.ndarray:
    """Right singular vectors (features x rank) of the sketch (scaled to the
    size of its rows) and the benchmark's passages, by the Gram matrix."""
    size = np.sqrt((sketch * sketch).sum(1, keepdims=True))
    rows = np.vstack([sketch / np.where(size > 0, size, 1), items])
    value, left = np.linalg.eigh(rows @ rows.T)
    top = np.argsort(value)[::-1][:rank]
    top = top[value[top] > 1e-6 * value.max()]
    return (rows.T @ left[:, top] / np.sqrt(value[top])).astype(np.float32)


def weighted_lcs(a: np.ndarray, b: np.ndarray, weight: np.ndarray):
    """(best weight, matched positions of a, matched positions of b) of a
    common subsequence; weight per position of a."""
    table = np.zeros((len(a) + 1, len(b) + 1))
    for i in range(len(a)):
        take = np.where(b == a[i], table[i, :-1] + weight[i], 0)
        table[i + 1, 1:] = np.maximum.accumulate(np.maximum(table[i, 1:], take))
    i, j, x, y = len(a), len(b), [], []
    while i and j:
        if table[i, j] == table[i - 1, j]:
            i -= 1
        elif table[i, j] == table[i, j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            x.append(i)
            y.append(j)
    return table[-1, -1], x[::-1], y[::-1]


class _Index:
    """The benchmark block: items' words and weights, latent passages.

    An item can only be matched by ``share`` of its weight T if its rare words
    (weight R) are matched by R - (1 - share) T at least; a match a quarter
    longer than the item is spread over ``runs`` runs of STRIDE words, each of
    which lies in one window, so one window has that much divided by ``runs``.
    Windows below that for every item need not be projected.
    """

    def __init__(self, items, answers, vocabulary, idf, feature_idf, basis, passages_of, latent, params):
        self.items, self.answers, self.vocabulary, self.feature_idf = items, answers, vocabulary, feature_idf
        self.basis, self.passages_of, self.latent, self.params = basis, passages_of, latent, params
        self.weight = idf ** 2                               # per vocabulary word
        places = [np.searchsorted(vocabulary, w) for w in items]
        self.item_weight = [self.weight[x] for x in places]
        rare = idf >= RARE_IDF
        total = np.array([w.sum() for w in self.item_weight])
        most = np.array([w[rare[x]].sum() for w, x in zip(self.item_weight, places)])
        runs = np.array([max(1, -(-5 * len(w) // (4 * STRIDE))) for w in items])
        self.need = (most - (1 - params[1]) * total) / runs - 1e-6
        # rare vocabulary word: items that have it
        has = sorted({(int(v), i) for i, x in enumerate(places) for v in x if rare[v]})
        self.has_item = np.array([i for _, i in has], np.int64)
        self.has_start = np.searchsorted([v for v, _ in has], np.arange(len(vocabulary) + 1))
        self.always = np.flatnonzero(self.need <= 0)         # items without enough rare words

    def _project(self, windows) -> np.ndarray:
        feats = [np.unique(_feature(x)) for x in windows]
        cut = np.concatenate(([0], np.cumsum([len(x) for x in feats])[:-1]))
        f = np.concatenate(feats)
        v = np.add.reduceat(self.basis[f] * self.feature_idf[f, None], cut, axis=0)
        return v / np.maximum(np.sqrt((v * v).sum(1, keepdims=True)), 1e-9)

    def _candidates(self, at, known, cut):
        """(text, window, item) of a run of texts whose words start at ``cut``, sorted."""
        n = np.diff(cut)
        windows = np.maximum(1, -(-(n - STRIDE) // STRIDE))
        base = np.concatenate(([0], np.cumsum(windows)))
        hit = np.flatnonzero(known)
        many = self.has_start[at[hit] + 1] - self.has_start[at[hit]]
        hit, many = hit[many > 0], many[many > 0]
        item = self.has_item[np.repeat(self.has_start[at[hit]] - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(many.sum())]
        weight = np.repeat(self.weight[at[hit]], many)
        text = np.repeat(np.searchsorted(cut, hit, "right") - 1, many)
        last = (np.repeat(hit, many) - cut[text]) // STRIDE          # the windows that hold the word: this one and the one before
        text, item, weight = (np.concatenate((x, x)) for x in (text, item, weight))
        w = np.concatenate((last, last - 1))
        ok = (w >= 0) & (w < windows[text])
        name = (base[text] + w)[ok] * len(self.items) + item[ok]
        name, back = np.unique(name, return_inverse=True)
        enough = np.bincount(back, weight[ok], len(name)) >= self.need[name % len(self.items)] if len(name) else np.zeros(0, bool)
        name = name[enough]
        if len(self.always):
            name = np.union1d(name, (np.arange(base[-1])[n[np.repeat(np.arange(len(n)), windows)] > 0][:, None] * len(self.items) + self.always).ravel())
        spot, item = np.divmod(name, len(self.items))
        text = np.searchsorted(base, spot, "right") - 1
        return text, spot - base[text], item

    def search(self, h: np.ndarray, cut: np.ndarray):
        """Matches in a run of texts: (text, item, cosine, share, answer share, first word, last word)."""
        at = np.searchsorted(self.vocabulary, h)
        at[at == len(self.vocabulary)] = 0
        known = self.vocabulary[at] == h
        text, window, item = self._candidates(at, known, cut)
        if not len(text):
            return []
        floor, share, answer_share, whole = self.params
        start = cut[text] + STRIDE * window
        end = np.minimum(start + WINDOW, cut[text + 1])
        spots, back = np.unique(start, return_inverse=True)
        ends = np.zeros(len(spots), np.int64)
        ends[back] = end
        latent = self._project([h[a:b] for a, b in zip(spots, ends)])
        best: dict[tuple[int, int], tuple] = {}
        done: dict[tuple[int, int], int] = {}
        for t, a, b, i, k in zip(text.tolist(), start.tolist(), end.tolist(), item.tolist(), back.tolist()):
            own = self.passages_of == i
            cosine = float((self.latent[own] @ latent[k]).max())
            if cosine < floor:
                continue
            words, iw = self.items[i], self.item_weight[i]
            lo, hi = max(int(cut[t]), a - len(words)), min(int(cut[t + 1]), b + len(words))
            if done.get((t, i), -1) >= hi:                   # an earlier region held this one
                continue
            done[t, i] = hi
            total = iw.sum()
            got, x, y = weighted_lcs(words, h[lo:hi], iw)
            if not x or got < share * total - 1e-6:
                continue
            own = self.answers[i]
            answer = iw[[q for q in x if q >= own]].sum() / max(iw[own:].sum(), 1e-9)
            if answer < answer_share and got < whole * total:
                continue
            found = (got / total, cosine, answer, int(lo - cut[t] + y[0]), int(lo - cut[t] + y[-1]))
            if found > best.get((t, i), ()):
                best[t, i] = found
        return [(t, i, c, s, a, x, y) for (t, i), (s, c, a, x, y) in sorted(best.items())]


def _answer_start(text: str, count: int, words_in) -> int:
    """Index of the first word of the item's last sentence (its last third if it has one sentence)."""
    cuts = [k + 1 for k, c in enumerate(text[:-1].rstrip(" .!?\n")) if c in ".!?\n"]
    if cuts:
        n = words_in(text[:cuts[-1]])
        if 0 < n < count:
            return n
    return count - max(1, count // 3)


def benchmark_matches(docs: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", text: str = "text",
                      item_id: str = "item_id", item_text: str = "text", cosine: float = COSINE, share: float = SHARE,
                      answer_share: float = ANSWER_SHARE, whole: float = WHOLE, rank: int = RANK,
                      block_items: int = BLOCK_ITEMS) -> DataFrame:
    """One row per contaminated (doc_id, item_id): cosine, lcs_share,
    answer_share, first_word, last_word (of the match in the document)."""
    spark = docs.sparkSession
    src = pick(docs, doc_id=(doc_id, "long"), text=(text, "string")).where("doc_id is not null")
    bench = pick(benchmark, item_id=(item_id, "long"), text=(item_text, "string")).where("item_id is not null").dropDuplicates()
    blocks = max(1, -(-bench.count() // block_items))
    schema = "doc_id long, item_id long, cosine double, lcs_share double, answer_share double, first_word int, last_word int"
    out = spark.createDataFrame([], schema)
    for block in range(blocks):
        listed = bench.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).orderBy("item_id", "text").collect()
        words = lambda t: words_of(np.frombuffer(t.encode(), np.uint8), NOT_WORD)[2]
        rows = [(r.item_id, r.text, words(r.text)) for r in listed if r.text]
        rows = [r for r in rows if len(r[2])]
        if not rows:
            continue
        vocabulary = np.unique(np.concatenate([r[2] for r in rows]))
        sums = _sums(src, vocabulary)
        if sums is None:
            continue
        cf, own, sketch, passages = sums
        idf = np.log1p(max(passages, 1) / np.maximum(cf, 1)).astype(np.float32)
        own_idf = np.log1p(max(passages, 1) / np.maximum(own, 1))
        passages_of, tfidf = [], []
        for i, (_, _, w) in enumerate(rows):
            for at in range(0, max(1, len(w) - STRIDE), STRIDE):
                f = np.unique(_feature(w[at:at + WINDOW]))
                v = np.zeros(FEATURES)
                v[f] = idf[f]
                passages_of.append(i)
                tfidf.append(v / np.sqrt(v @ v))
        tfidf = np.array(tfidf)
        basis = latent_basis(sketch * idf, tfidf, rank)
        latent = tfidf.astype(np.float32) @ basis
        latent /= np.maximum(np.sqrt((latent * latent).sum(1, keepdims=True)), 1e-9)
        answers = [_answer_start(t, len(w), lambda x: len(words(x))) for _, t, w in rows]
        index = spark.sparkContext.broadcast(_Index([w for _, _, w in rows], answers, vocabulary, own_idf, idf, basis,
                                                    np.array(passages_of), latent, (cosine, share, answer_share, whole)))
        names = np.array([r[0] for r in rows], np.int64)

        def search(batches, index=index, names=names):
            for b in pieces(batches):
                buf, off = text_buffer(b["text"])
                ids = numbers(b["doc_id"])
                got = []
                for i, j, _, _, h, owner in batch_words(buf, off, NOT_WORD):
                    cut = np.searchsorted(owner, np.arange(i, j + 1))
                    got += [(int(ids[i + m[0]]), int(names[m[1]]), *m[2:]) for m in index.value.search(h, cut)]
                kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int32(), pa.int32()]
                cols = list(zip(*got)) or [[]] * 7
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds)],
                                                 ["doc_id", "item_id", "cosine", "lcs_share", "answer_share", "first_word", "last_word"])

        out = out.unionByName(src.mapInArrow(search, schema)) if block else src.mapInArrow(search, schema)
    # an item_id with several texts, a doc_id with several rows: the best match
    return out.groupBy("doc_id", "item_id").agg(F.max(F.struct("lcs_share", "cosine", "answer_share", "first_word", "last_word")).alias("x")) \
        .select("doc_id", "item_id", "x.cosine", "x.lcs_share", "x.answer_share", "x.first_word", "x.last_word")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: documents that hold a benchmark item go."""
    found = benchmark_matches(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti").select(*[quoted(c) for c in docs.columns])
