import hashlib

import numpy as np

from tests.llm.cases import edge_docs, near_docs, no_docs
from corpusmill.llm import suffix_dedup as S


def brute(rows, length=50):
    texts = [(i, (t or "").encode()) for i, t in rows]
    first = {}
    for i, b in texts:
        for k in range(len(b) - length + 1) if i is not None else ():
            w = b[k:k + length]
            first[w] = min(first.get(w, i), i)
    out = []
    for i, b in texts:
        keep = bytearray(b"\1" * len(b))
        for k in range(len(b) - length + 1) if i is not None else ():
            if first[b[k:k + length]] < i:
                keep[k:k + length] = b"\0" * length
        kept = bytes(x for x, y in zip(b, keep) if y)
        spans = sum(1 for x, y in zip(b"\1" + keep, keep) if x and not y)
        out.append((i, len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def run(df, **how):
    return sorted((tuple(r) for r in S.dedup_bytes(df, **how).collect()), key=str)


def test_equals_brute_force(spark):
    for seed in (1, 2, 3):
        rows, df = near_docs(spark, seed)
        assert run(df) == brute(rows)


def test_many_ranges_and_lengths(spark):
    rows, df = near_docs(spark, 4)
    assert run(df, range_entries=64) == brute(rows)
    assert run(df, length=33) == brute(rows, 33)
    assert run(df, length=81) == brute(rows, 81)


def test_periodic_and_overlapping(spark):
    rows = [(1, "ab" * 60), (2, "ab" * 40 + "z"), (3, "ba" * 30), (4, "é" * 80), (5, "é" * 30 + "x"), (6, "a" * 49), (7, "a" * 49),
            (8, "q" * 50), (9, "pq" + "q" * 60 + "r"), (10, "a" * 300)]
    assert run(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 256)
    rows, _ = near_docs(spark, 6, 20)
    buf = np.frombuffer(b"".join(t.encode() for _, t in rows), np.uint8)
    off = np.concatenate(([0], np.cumsum([len(t.encode()) for _, t in rows])))
    windows = sum(int(n.sum()) for *_, n, _, _ in S.anchor_runs(buf, off, 50))
    assert windows == sum(max(0, len(t.encode()) - 49) for _, t in rows)


def test_window_classes_are_sorted_suffix_classes():
    rng = np.random.default_rng(2)
    buf = rng.integers(0, 2, 4000).astype(np.uint8)
    n = rng.integers(1, 20, 40)
    start = rng.integers(0, 3800, 40)
    start[20:] = start[:20]                               # equal contexts, other buckets or not
    n[20:] = n[:20]
    lead = np.minimum(n, 7)
    bucket = rng.integers(0, 3, 40)
    cls, who = S.window_classes(np.concatenate([buf[s:s + k + 49] for s, k in zip(start, n)]),
                                np.concatenate(([0], np.cumsum(n + 49)))[:-1], lead, n, bucket, 50)
    pos = np.concatenate([np.arange(k) for k in n])
    key = [(bucket[w], p - lead[w], buf[start[w] + p:start[w] + p + 50].tobytes()) for w, p in zip(who, pos)]
    names = {}
    assert all(names.setdefault(k, c) == c for k, c in zip(key, cls)) and len(set(names.values())) == len(names)


def test_edges(spark):
    rows = [(r.doc_id, r.text) for r in edge_docs(spark).collect()]
    assert run(edge_docs(spark)) == brute(rows)
    assert S.dedup_bytes(no_docs(spark)).count() == 0


def test_stage(spark):
    rows, df = near_docs(spark, 8)
    want = {i: n - r for i, n, r, _, _ in brute(rows)}
    out = {r.doc_id: r for r in S.stage(spark, df, None).collect()}
    assert set(out) == {i for i, n in want.items() if n}
    assert all(len(out[i].text.encode()) == want[i] for i in out)
    assert S.stage(spark, edge_docs(spark), None).columns == edge_docs(spark).columns


def test_hot_buckets_one_distance_at_a_time(spark, monkeypatch):
    for seed, hot in ((5, 1), (6, 2)):
        monkeypatch.setattr(S, "HOT", hot)
        monkeypatch.setattr(S, "CHUNK", 3)
        rows, df = near_docs(spark, seed)
        assert run(df) == brute(rows)
        assert run(df, length=33) == brute(rows, 33)


def _hot_bucket(n, length=50, seed=1):
    """Contexts around one anchor: bytes that all share, then bytes of their own."""
    rng = np.random.default_rng(seed)
    k = S.kmer_of(length)
    shared = rng.integers(97, 123, 40 - k, np.uint8).tobytes()
    rows = sorted((20, shared + rng.integers(97, 100, 30, np.uint8).tobytes(), i) for i in range(n))
    rows = [(lead, shared[:20] + data[20:], i) for lead, data, i in rows]
    return rows, k


def _solved(rows, k, length=50, size=1000):
    import pyarrow as pa
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]

    def batches():
        for at in range(0, len(rows), size):
            part = rows[at:at + size]
            cols = [[7] * len(part), [i for _, _, i in part], [a for a, _, _ in part], [len(d) + k - length + 1 for _, d, _ in part], [d for _, d, _ in part]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["h", "doc_id", "lead", "n", "bytes"])
    out = {}
    for b in S._first_docs(length)(batches()):
        for low, firsts in zip(b["low"].to_pylist(), b["firsts"].to_pylist()):
            out[low] = None if firsts is None else np.frombuffer(firsts, np.int64).tolist()
    return out


def test_a_hot_bucket_against_all_windows(monkeypatch):
    rows, k = _hot_bucket(400)
    monkeypatch.setattr(S, "HOT", 10)
    got = _solved(rows, k, size=64)
    whole = {i: d[:lead] + bytes(k) + d[lead:] for lead, d, i in rows}
    first = {}
    for i in sorted(whole):
        for p in range(len(whole[i]) - 49):
            first.setdefault((p - 20, whole[i][p:p + 50]), i)
    for i, b in whole.items():
        want = [first[p - 20, b[p:p + 50]] for p in range(len(b) - 49)]
        assert (got[i] or [i] * len(want)) == want


def test_a_hundred_thousand_contexts_around_one_anchor():
    import tracemalloc
    rows, k = _hot_bucket(100_000)
    tracemalloc.start()
    got = _solved(rows, k)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # distinct contexts only; the whole run, results included
    assert len(got) == len({d for _, d, _ in rows}) and peak < 300 << 20
