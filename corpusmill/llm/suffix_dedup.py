"""Suffix-array dedup: remove every byte covered by a string of ``length``
bytes that also starts in a document with a smaller doc_id.

Blockwise over suffix buckets. Every window of ``length`` bytes has an anchor,
the k-mer with the smallest hash in it (the leftmost of several), so equal
windows are in the same bucket (anchor hash) and at the same distance from
their anchor. 1. Texts that repeat exactly are one text. 2. Anchors that only
one text has are left out: their windows occur nowhere else. 3. For the others
the bytes around the anchor (its context) go to the anchor's bucket; equal
contexts of a bucket are one. 4. The suffixes of a bucket are sorted up to
``length`` bytes: positions of a difference cover modulo 13, counted from the
anchor, get precomputed ranks of the long block that starts there, and a
suffix is compared by its own bytes before and after the first such block and
by that block's rank. Each class of equal windows gets its smallest doc_id.
5. Every occurrence whose class has a smaller doc_id is removed.

Only contexts are gathered by bucket, once per batch and bucket, never all
occurrences; these are joined back with the ranked contexts by (bucket,
context), where Spark splits hot keys.

Nulls: a null text is empty; a row with a null doc_id takes no part and keeps
all its bytes. Rows that repeat a doc_id don't remove each other's bytes. An
empty table gives an empty result. Texts are compared as UTF-8 bytes, matches
never cross documents. Copies are recognised by 128-bit hashes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from corpusmill.llm.common import BYTE_CODE, mix, numbers, pick, pieces, powers, quoted, small_batches, text_buffer

LENGTH = 50
RANGE_ENTRIES = 3_000_000     # anchors that one task of the filter aims at
BLOCK = 1 << 18               # bytes hashed together: keeps the arrays of a task small
COVER, PERIOD = (0, 1, 3, 9), 13      # a difference cover modulo 13
EDGE = 18                     # bytes of a window that are compared directly
_POS = (1 << 21) - 1
_LAST = np.uint64(2**64 - 1)
# for each residue of (suffix - anchor) modulo the period: steps to the next cover position
_STEP = np.array([min(d for d in range(PERIOD) if (r + d) % PERIOD in COVER) for r in range(PERIOD)])


def kmer_of(length: int) -> int:
    return max(8, 2 * length // 5)


def _kmer_hash(b: np.ndarray, k: int) -> np.ndarray:
    """Polynomial hash of each run of k bytes, by doubling."""
    cur, size, base = BYTE_CODE[b], 1, 0xD6E8FEB86659FD93
    out, done = None, 0
    while True:
        if k & 1:
            if out is None:
                out, done = cur, size
            else:
                n = len(b) - done - size + 1
                out, done = out[:n] * np.uint64(base) + cur[done:done + n], done + size
        k >>= 1
        if not k:
            return out
        cur = cur[:-size] * np.uint64(base) + cur[size:]
        size, base = 2 * size, base * base % 2**64


def _sliding_min(a: np.ndarray, w: int) -> np.ndarray:
    size = 1
    while 2 * size <= w:
        a, size = np.minimum(a[:-size], a[size:]), 2 * size
    return np.minimum(a[:-(w - size)], a[w - size:]) if w > size else a


def anchor_runs(buf: np.ndarray, off: np.ndarray, length: int):
    """Runs of windows (inside one text) with the same anchor: yields blocks of
    (text index, anchor, first window, windows, anchor hash, hash of the run's
    context); offsets within the text. The context is the run's bytes."""
    k = kmer_of(length)
    w = length - k + 1
    zeros = (BYTE_CODE[np.zeros(k, np.uint8)] * powers(k)[0][:k]).sum()
    n, at = len(buf), 0
    while at + length <= n:
        b = buf[at:min(n, at + BLOCK + length - 1)]
        m = len(b) - length + 1                              # windows of this block
        h = mix(_kmer_hash(b, k))
        order = (h & ~np.uint64(_POS)) | np.arange(len(h), dtype=np.uint64)
        low = _sliding_min(order, w)[:m]
        ends = off[np.searchsorted(off, at, "right"):np.searchsorted(off, at + len(b), "left")] - at
        gone = (ends[:, None] - np.arange(1, length)).ravel()     # windows that cross an end
        low[gone[(gone >= 0) & (gone < m)]] = _LAST
        first = np.concatenate(([0], np.flatnonzero(low[1:] != low[:-1]) + 1))
        count = np.diff(np.append(first, m))
        real = low[first] != _LAST
        first, count = first[real], count[real]
        if len(first):
            anchor = (low[first] & np.uint64(_POS)).astype(np.int64)
            up, down = powers(len(b) + 1)
            sums = np.zeros(len(b) + 1, np.uint64)
            np.cumsum(BYTE_CODE[b] * up[:len(b)], out=sums[1:])
            to = first + count + length - 1
            # of the context with zeros in the place of the anchor, whose hash is the bucket
            rest = (sums[anchor] - sums[first] + sums[to] - sums[anchor + k]) * down[first] + zeros * up[anchor - first]
            ctx = mix(rest + ((to - first) * 4096 + anchor - first).astype(np.uint64))
            doc = np.searchsorted(off, first + at, "right") - 1
            base = off[doc] - at
            yield doc, anchor - base, first - base, count, h[anchor], ctx
        at += BLOCK


def _planes(a: np.ndarray, size: int = 0) -> bytes:
    """The low bytes of numbers (all, or some) as planes, which compress better in a shuffle."""
    return np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T[:size or a.itemsize].tobytes()


def _numbers(data: bytes, kind, size: int = 0) -> np.ndarray:
    whole = np.dtype(kind).itemsize
    got = np.frombuffer(data, np.uint8).reshape(size or whole, -1).T
    out = np.zeros((len(got), whole), np.uint8)
    out[:, :got.shape[1]] = got
    return out.reshape(-1).view(kind)


# ---------------------------------------------------------------- which anchors are shared
def _filter_rows(length: int, bits: int, stored: int):
    """Batches of (key, text) -> one row per hash range with all anchors of the
    batch (one per hash where the batch itself shows that texts share it), and
    one row per text with the anchors that are known to be shared. Of a hash,
    the range and ``stored`` more bytes are kept: enough for a filter, which may
    call an anchor shared that is not, never the other way round."""

    def work(batches):
        for b in pieces(batches):
            buf, off = text_buffer(b["text"])
            parts = [x[:2] + (x[4],) for x in anchor_runs(buf, off, length)]
            if not parts:
                continue
            doc, pos, h = (np.concatenate(x) for x in zip(*parts))
            h = mix(h)                                        # anchors are the smallest hashes: mixed again, the ranges are even
            key = numbers(b["key"])[doc]
            order = np.lexsort((pos, key, h))
            h, key, pos = h[order], key[order], pos[order]
            new = np.concatenate(([True], (h[1:] != h[:-1]) | (key[1:] != key[:-1]) | (pos[1:] != pos[:-1])))
            h, key, pos = h[new], key[new], pos[new]
            first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
            size = np.diff(np.append(first, len(h)))
            shared = key[first] != key[first + size - 1]
            known = np.repeat(shared, size)
            lead = np.zeros(len(h), bool)
            lead[first] = True
            keep = ~known | lead
            ask = np.where(known, -1, pos).astype(np.int32)[keep]
            hs, ks = h[keep], key[keep]
            names, idx = np.unique(ks, return_inverse=True)
            part = (hs >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hs), np.int64)
            order = np.lexsort((ask, idx, part))              # by range, then text: the numbers of a text compress well
            hs, idx, ask, part = hs[order], idx[order], ask[order], part[order]
            ranges, cuts = np.unique(part, return_index=True)      # those that the batch has
            cuts = np.append(cuts, len(part))
            hs = (hs << np.uint64(bits)) >> np.uint64(64 - 8 * stored)
            rows = []
            for r, lo, hi in zip(ranges.tolist(), cuts, cuts[1:]):
                used, own = np.unique(idx[lo:hi], return_inverse=True)
                rows.append((r, _planes(hs[lo:hi], stored), _planes(own.astype(np.uint16)), _planes(ask[lo:hi]), _planes(names[used])))
            for k, p in _by_key(key[known], pos[known].astype(np.int32)):
                rows.append((-1 - int(k) % (1 << bits), b"", b"", p, int(k).to_bytes(8, "little", signed=True)))
            kinds = [pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), kinds)], ["r", "h", "d", "p", "k"])

    return work


def _by_key(key, pos):
    """(key, its distinct positions as bytes) for each key."""
    if not len(key):
        return
    order = np.lexsort((pos, key))
    key, pos = key[order], pos[order]
    new = np.concatenate(([True], (key[1:] != key[:-1]) | (pos[1:] != pos[:-1])))
    key, pos = key[new], pos[new]
    cut = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
    for a, b in zip(cut[:-1], cut[1:]):
        yield key[a], pos[a:b].tobytes()


def _shared_anchors(table: pa.Table, stored: int) -> pa.Table:
    """One hash range: (key, position) of the anchors that two texts have."""
    h, d, p, k = (table[c].to_pylist() for c in "hdpk")
    if table["r"][0].as_py() < 0:
        key = np.concatenate([np.repeat(np.frombuffer(x, "<i8"), len(y) // 4) for x, y in zip(k, p)])
        pos = np.concatenate([np.frombuffer(y, np.int32) for y in p])
    else:
        hs = np.concatenate([_numbers(x, np.uint64, stored) for x in h])
        key = np.concatenate([_numbers(x, np.int64)[_numbers(y, np.uint16)] for x, y in zip(k, d)])
        pos = np.concatenate([_numbers(x, np.int32) for x in p])
        del h, d, p, k
        order = np.argsort(hs, kind="stable")
        hs = hs[order]
        first = np.flatnonzero(np.concatenate(([True], hs[1:] != hs[:-1])))
        size = np.diff(np.append(first, len(hs)))
        own = key[order]
        shared = (np.minimum.reduceat(own, first) != np.maximum.reduceat(own, first)) | (np.minimum.reduceat(pos[order], first) < 0)
        hit = np.repeat(shared, size) & (pos[order] >= 0)
        key, pos = own[hit], pos[order][hit]
    order = np.lexsort((pos, key))
    key, pos = key[order], pos[order].astype(np.int32)
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (pos[1:] != pos[:-1])
    return pa.table({"key": pa.array(key[new].astype(np.int64)), "pos": pa.array(pos[new])})


# ---------------------------------------------------------------- contexts and occurrences
def _runs_of(length: int, contexts: bool):
    """Batches of (doc_id, nth, packed text, pos) -> occurrences (h, ctx, doc_id, spot:
    nth, first window and number of windows), or the batch's distinct contexts (h, doc_id, lead, n, bytes); the bytes of
    the anchor itself, which the bucket implies, are left out."""

    k = kmer_of(length)

    def work(batches):
        for b in pieces(batches, "packed", PACKED):
            buf, off = _unpacked(b["packed"])
            ids = numbers(b["doc_id"])
            who = np.repeat(np.arange(b.num_rows), pc.list_value_length(b["pos"]).to_numpy(zero_copy_only=False))
            asked = np.unique((who << 32) + b["pos"].flatten().to_numpy(zero_copy_only=False))
            parts = []
            for x in anchor_runs(buf, off, length):
                at = (x[0] << 32) + x[1]
                hit = np.searchsorted(asked, at)
                hit[hit == len(asked)] = 0
                keep = asked[hit] == at if len(asked) else np.zeros(len(at), bool)
                parts.append([y[keep] for y in x])
            if not parts:
                continue
            doc, anchor, first, n, h, ctx = (np.concatenate(x) for x in zip(*parts))
            h, ctx = h.view(np.int64), ctx.view(np.int64)
            if not contexts:
                spot = (numbers(b["nth"])[doc].astype(np.int64) << 44) + (first << 12) + n       # one number instead of three
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(ctx), pa.array(ids[doc]), pa.array(spot)],
                                                 ["h", "ctx", "doc_id", "spot"])
                continue
            order = np.lexsort((ids[doc], ctx, h))
            order = order[np.concatenate(([True], (h[order][1:] != h[order][:-1]) | (ctx[order][1:] != ctx[order][:-1])))] \
                if len(order) else order
            for at in range(0, len(order), CHUNK):         # the bytes of a few contexts at a time
                o = order[at:at + CHUNK]
                size = n[o] + length - 1 - k
                cut = np.concatenate(([0], np.cumsum(size)))
                place = np.arange(cut[-1]) - np.repeat(cut[:-1], size)
                place += k * (place >= np.repeat((anchor - first)[o], size))
                data = buf[np.repeat(off[doc[o]] + first[o], size) + place]
                own = pa.Array.from_buffers(pa.binary(), len(o), [None, pa.py_buffer(cut.astype(np.int32)), pa.py_buffer(data.tobytes())])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h[o]), pa.array(ids[doc[o]]), pa.array((anchor - first)[o].astype(np.int32)),
                     pa.array(n[o].astype(np.int32)), own], ["h", "doc_id", "lead", "n", "bytes"])

    return work


def _words(buf, at, offsets):
    """The bytes at some offsets from each position, eight to a number."""
    got = buf[at[:, None] + offsets]
    if got.shape[1] % 8:
        got = np.hstack([got, np.zeros((len(got), 8 - got.shape[1] % 8), np.uint8)])
    return list(np.ascontiguousarray(got).view(np.uint64).T)


def window_classes(buf, start, lead, n, bucket, length: int):
    """Sort the suffixes of some buckets up to ``length`` bytes: a class number
    per window (contexts in order, each with n windows). Same class: same
    bucket, same distance from the anchor and the same bytes."""
    block = length - EDGE
    size = n + length - 1
    cut = np.concatenate(([0], np.cumsum(size)))
    ctx = np.repeat(np.arange(len(n)), size)
    place = np.arange(cut[-1]) - cut[ctx]
    # ranks of the cover sample: blocks of length - EDGE bytes
    sampled = np.isin((place - lead[ctx]) % PERIOD, COVER) & (place + block <= size[ctx])
    at = np.flatnonzero(sampled)
    keys = _words(buf, start[ctx[at]] + place[at], np.arange(block))
    order = np.lexsort(keys)
    fresh = np.zeros(len(at), bool)
    for key in keys:
        fresh[1:] |= key[order][1:] != key[order][:-1]
    rank = np.zeros(cut[-1], np.int64)
    rank[at[order]] = np.cumsum(fresh)
    # the windows themselves
    who = np.repeat(np.arange(len(n)), n)
    wcut = np.concatenate(([0], np.cumsum(n)))
    pos = np.arange(wcut[-1]) - wcut[who]
    gap = pos - lead[who]
    step = _STEP[gap % PERIOD]
    edge = np.arange(EDGE)
    offsets = np.where(edge[None, :] < step[:, None], edge, edge + block)
    got = buf[(start[who] + pos)[:, None] + offsets]
    got = np.hstack([got, np.zeros((len(got), -EDGE % 8), np.uint8)])
    keys = [*np.ascontiguousarray(got).view(np.uint64).T, rank[cut[who] + pos + step], gap, bucket[who]]
    order = np.lexsort(keys)
    fresh = np.zeros(len(who), bool)
    for key in keys:
        fresh[1:] |= key[order][1:] != key[order][:-1]
    out = np.empty(len(who), np.int64)
    out[order] = np.cumsum(fresh)
    return out, who


def _class_numbers(keys: list) -> np.ndarray:
    """A number per row, equal for rows that are equal in all keys."""
    order = np.lexsort(keys)
    fresh = np.zeros(len(order), bool)
    for key in keys:
        fresh[1:] |= key[order][1:] != key[order][:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(fresh)
    return out


def bucket_lows(buf, start, lead, n, doc, length: int) -> np.ndarray:
    """One bucket: the smallest doc_id of each window's class, contexts in
    order. Like window_classes(), but one distance from the anchor at a time: there
    the cover block starts at the same byte of every window, and only its rank
    and the bytes around it are held, some hundred bytes per context."""
    block = length - EDGE
    wcut = np.concatenate(([0], np.cumsum(n)))
    out = np.empty(int(wcut[-1]), np.int64)
    edge = np.arange(EDGE)
    for gap in range(-int(lead.max()), int((n - lead).max())):
        own = np.flatnonzero((gap >= -lead) & (gap < n - lead))
        if not len(own):
            continue
        at = start[own] + lead[own] + gap
        step = _STEP[gap % PERIOD]
        rank = _class_numbers(_words(buf, at + step, np.arange(block)))
        cls = _class_numbers([*_words(buf, at, np.where(edge < step, edge, edge + block)), rank])
        low = np.full(int(cls.max()) + 1, np.iinfo(np.int64).max)
        np.minimum.at(low, cls, doc[own])
        out[wcut[own] + lead[own] + gap] = low[cls]
    return out


def _objects(values: list) -> np.ndarray:
    out = np.empty(len(values), object)
    out[:] = values
    return out


def _context_hash(data: list[bytes], lead, n, h) -> np.ndarray:
    """The hash that anchor_runs() gives the same context (anchor zeroed there too)."""
    cut = np.concatenate(([0], np.cumsum([len(x) for x in data])))
    b = np.frombuffer(b"".join(data), np.uint8)
    up, down = powers(len(b) + 1)
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(BYTE_CODE[b] * up[:len(b)], out=sums[1:])
    size = np.diff(cut).astype(np.uint64)
    return mix((sums[cut[1:]] - sums[cut[:-1]]) * down[cut[:-1]] + size * np.uint64(4096) + lead.astype(np.uint64)).view(np.int64)


CHUNK = 2_000                 # contexts sorted together
HOT = 1_000                   # a bucket of more contexts is sorted one distance from the anchor at a time


def _first_docs(length: int):
    """Rows sorted by (h, lead, bytes, doc_id), distinct contexts of buckets ->
    per (h, ctx) the smallest doc_id of each of its windows (one number if all
    are the same). Streams; holds one bucket's distinct contexts."""
    gone = kmer_of(length)

    def solve(h, doc, lead, n, data):
        cut = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1], [True])))
        many = np.repeat(np.diff(cut) > 1, np.diff(cut))
        firsts = [None] * len(h)
        # the anchor's bytes as zeros: they are the same in a bucket
        data = [x[:a] + bytes(gone) + x[a:] for x, a in zip(data, lead.tolist())]
        ctx = _context_hash(data, lead, n, h)
        multi = np.flatnonzero(many)
        if len(multi):
            buf = np.frombuffer(b"".join([data[i] for i in multi]), np.uint8)
            nn, ll = n[multi].astype(np.int64), lead[multi].astype(np.int64)
            start = np.concatenate(([0], np.cumsum(nn + length - 1)))[:-1]
            if len(cut) == 2 and len(multi) > HOT:
                low = bucket_lows(buf, start, ll, nn, doc[multi], length)
            else:
                cls, who = window_classes(buf, start, ll, nn, np.unique(h[multi], return_inverse=True)[1], length)
                low = np.full(cls.max() + 1, np.iinfo(np.int64).max)
                np.minimum.at(low, cls, doc[multi][who])
                low = low[cls]
            at = np.concatenate(([0], np.cumsum(nn)))
            for k, i in enumerate(multi):
                own = low[at[k]:at[k + 1]]
                if (own != doc[i]).any():
                    firsts[i] = own.tobytes()
        return pa.RecordBatch.from_arrays([pa.array(h), pa.array(ctx), pa.array(doc), pa.array(firsts, pa.binary())],
                                          ["h", "ctx", "low", "firsts"])

    def parts(cols):
        """Whole buckets, several small ones together, a large one by itself."""
        h = cols[0]
        starts = np.append(np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))), len(h))
        at = 0
        for a, z in zip(starts[:-1], starts[1:]):
            if z - a > HOT:
                if a > at:
                    yield solve(*[c[at:a] for c in cols])
                yield from sliced(solve(*[c[a:z] for c in cols]))
                at = z
            elif z - at > CHUNK:
                if a > at:
                    yield solve(*[c[at:a] for c in cols])
                at = a
        if at < len(h):
            yield solve(*[c[at:] for c in cols])

    def sliced(batch):
        for at in range(0, batch.num_rows, CHUNK):
            yield batch.slice(at, CHUNK)

    def work(batches):
        held = []                                             # pieces of the last bucket so far
        for b in batches:
            cols = [numbers(b[c]) for c in ("h", "doc_id", "lead", "n")] + [_objects(b["bytes"].to_pylist())]
            h, _, lead, _, data = cols
            if not len(h):
                continue
            keep = np.concatenate(([True], (h[1:] != h[:-1]) | (lead[1:] != lead[:-1]) | (data[1:] != data[:-1])))
            if held:
                keep[0] = (held[-1][0][-1], held[-1][2][-1], held[-1][4][-1]) != (h[0], lead[0], data[0])
            cols = [c[keep] for c in cols]
            h = cols[0]
            if not len(h):
                continue
            last = int(np.searchsorted(h, h[-1]))             # the last bucket may go on
            if held and (last or h[0] != held[-1][0][-1]):
                held.append([c[:last] for c in cols])
                yield from parts([np.concatenate(x) for x in zip(*held)])
                held = []
            elif last:
                yield from parts([c[:last] for c in cols])
            held.append([c[last:] for c in cols])
        if held:
            yield from parts([np.concatenate(x) for x in zip(*held)])

    return work


def _intervals(length: int):
    """Occurrences with their windows' smallest doc_ids -> bytes to remove."""

    def work(batches):
        for b in batches:
            doc, spot, low = (numbers(b[c]) for c in ("doc_id", "spot", "low"))
            nth, first, n = (spot >> 44).astype(np.int32), (spot >> 12) & 0xFFFFFFFF, spot & 4095
            plain = np.flatnonzero(numbers(b["firsts"].is_null()) & (low < doc))
            out = [(doc[plain], nth[plain], first[plain], (first + n)[plain] + length - 1)]
            for i in np.flatnonzero(~numbers(b["firsts"].is_null())):
                gone = np.frombuffer(b["firsts"][int(i)].as_py(), np.int64) < doc[i]
                edge = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(np.int8), [0]))))
                s, e = edge[0::2] + first[i], edge[1::2] + first[i]
                out.append((np.full(len(s), doc[i]), np.full(len(s), nth[i], np.int32), s, e + length - 1))
            d, k, s, e = (np.concatenate(x) for x in zip(*out))
            yield pa.RecordBatch.from_arrays([pa.array(d), pa.array(k), pa.array(s.astype(np.int32)), pa.array(e.astype(np.int32))],
                                             ["doc_id", "nth", "s", "e"])

    return work


def _merged(batches):
    """(doc_id, nth, spans) with overlapping spans joined: a few are left of each text."""
    for b in batches:
        parts = [merge_spans(numbers(x.values.field("s")), numbers(x.values.field("e"))) for x in b["spans"]]
        off = np.concatenate(([0], np.cumsum([len(s) for s, _ in parts]))).astype(np.int32)
        s, e = (np.concatenate(x).astype(np.int32) for x in zip(*parts)) if parts else (np.zeros(0, np.int32),) * 2
        spans = pa.ListArray.from_arrays(pa.array(off), pa.StructArray.from_arrays([pa.array(s), pa.array(e)], ["s", "e"]))
        yield pa.RecordBatch.from_arrays([b["doc_id"], b["nth"], spans], ["doc_id", "nth", "spans"])


def merge_spans(s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of some half-open byte ranges."""
    order = np.argsort(s, kind="stable")
    s, e = s[order], np.maximum.accumulate(e[order])
    new = np.concatenate(([True], s[1:] > e[:-1]))
    return s[new], e[np.append(np.flatnonzero(new)[1:] - 1, len(e) - 1)]


PACKED = 1 << 20              # bytes of packed texts taken together


def _packed(batches):
    """Texts as zstd frames: half the bytes to shuffle."""
    press = zstandard.ZstdCompressor(level=3)
    for b in pieces(batches):
        z = [press.compress(x) for x in b["text"].cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([b["doc_id"], b["key"], b["key2"], pa.array(z, pa.binary())], ["doc_id", "key", "key2", "packed"])


def _unpacked(column):
    unpress = zstandard.ZstdDecompressor()
    return text_buffer(pa.array([unpress.decompress(x) for x in column.to_pylist()], pa.binary()))


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    src = pick(docs, doc_id=(doc_id, "long"), text=(text, "string")).withColumn("text", F.coalesce("text", F.lit("")))
    return src.select("doc_id", F.xxhash64("text").alias("key"), F.xxhash64(F.lit(7), "text").alias("key2"),
                      F.octet_length("text").alias("n_bytes"), "text")


SAME = ["key", "key2", "n_bytes"]


def removed_spans(texts: DataFrame, length: int = LENGTH, range_entries: int = RANGE_ENTRIES) -> tuple[DataFrame, DataFrame]:
    """(doc_id, key, key2, spans) of the texts (doc_id, key, key2, n_bytes, text)
    that lose bytes to another text, and all long texts packed (doc_id, key, key2, packed). Of
    exact copies only the one with the smallest doc_id is looked at."""
    if not 32 <= length < 4096:
        raise ValueError("length must be from 32 to 4095 bytes")
    small_batches(texts.sparkSession)
    distinct = texts.where(F.col("n_bytes") >= length).groupBy(*SAME).agg(F.min("doc_id").alias("doc_id"))
    # several texts under one doc_id are told apart by nth
    distinct = distinct.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id").orderBy("key", "key2")).cast("int"))
    total = texts.agg(F.sum("n_bytes")).first()[0] or 0
    w = length - kmer_of(length) + 1
    entries = int(total * 2 / (w + 1))
    bits = (entries // range_entries).bit_length()
    stored = min(8, max(4, -(-(entries.bit_length() + 10 - bits) // 8)))
    long = texts.where(F.col("n_bytes") >= length)
    shared = (long.select("key", "text").mapInArrow(_filter_rows(length, bits, stored), "r long, h binary, d binary, p binary, k binary")
              .groupBy("r").applyInArrow(lambda t: _shared_anchors(t, stored), "key long, pos int")
              .groupBy("key").agg(F.collect_list("pos").alias("pos")))
    same = ["doc_id", "key", "key2"]
    bodies = long.select(*same, "text").mapInArrow(_packed, "doc_id long, key long, key2 long, packed binary")
    rows = bodies.join(distinct.join(shared, "key").select(*same, "nth", "pos"), same).select("doc_id", "nth", "packed", "pos")
    contexts = (rows.mapInArrow(_runs_of(length, True), "h long, doc_id long, lead int, n int, bytes binary")
                .repartition("h").sortWithinPartitions("h", "lead", "bytes", "doc_id")
                .mapInArrow(_first_docs(length), "h long, ctx long, low long, firsts binary"))
    found = rows.mapInArrow(_runs_of(length, False), "h long, ctx long, doc_id long, spot long")
    spans = (found.join(contexts, ["h", "ctx"]).select("doc_id", "spot", "low", "firsts")
             .mapInArrow(_intervals(length), "doc_id long, nth int, s int, e int")
             .groupBy("doc_id", "nth").agg(F.collect_list(F.struct("s", "e")).alias("spans"))
             .mapInArrow(_merged, "doc_id long, nth int, spans array<struct<s: int, e: int>>"))

    return distinct.join(spans, ["doc_id", "nth"]).select(*same, "spans"), bodies


def cut_digests(texts: DataFrame, length: int = LENGTH, range_entries: int = RANGE_ENTRIES) -> DataFrame:
    """(doc_id, key, key2, removed, spans, sha) of the texts that lose bytes to
    another text: bytes and runs removed, and the SHA-256 of what stays."""
    same = ["doc_id", "key", "key2"]
    gone, bodies = removed_spans(texts, length, range_entries)

    def cut(batches):
        for b in pieces(batches, "packed", PACKED):
            buf, off = _unpacked(b["packed"])
            rows = []
            for i, x in enumerate(b["spans"]):
                flat = x.values
                kept, s, e = _without(buf[off[i]:off[i + 1]], numbers(flat.field("s")), numbers(flat.field("e")))
                rows.append((int((e - s).sum()), len(s), hashlib.sha256(kept).hexdigest()))
            cols = [pa.array(list(c), t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["key"], b["key2"], *cols], [*same, "removed", "spans", "sha"])

    return bodies.join(gone, same).select(*same, "packed", "spans") \
        .mapInArrow(cut, "doc_id long, key long, key2 long, removed long, spans long, sha string").dropDuplicates(same)


def _without(own: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The bytes outside some spans, and the spans merged."""
    s, e = merge_spans(s, e)
    keep = np.ones(len(own), bool)
    for a, z in zip(s, e):
        keep[a:z] = False
    return own[keep].tobytes(), s, e


def _kept_texts(text: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
    """Texts without their spans; bytes of a character that is cut apart go too."""
    return pd.Series([t if s is None else _without(np.frombuffer((t or "").encode(), np.uint8), s, e)[0].decode("utf-8", "ignore")
                      for t, s, e in zip(text, starts, ends)], dtype=object)


# nondeterministic for the optimizer: else a later filter on the text would run it a second time
_kept_text = F.pandas_udf(_kept_texts, StringType()).asNondeterministic()


def dedup_bytes(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH,
                range_entries: int = RANGE_ENTRIES) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    src = _keyed(docs, doc_id, text)
    known = src.where("doc_id is not null")
    changed = cut_digests(known, length, range_entries)
    firsts = known.groupBy(*SAME).agg(F.min("doc_id").alias("first"))
    out = (src.select("doc_id", *SAME, F.sha2("text", 256).alias("own")).join(firsts, SAME, "left")
           .join(changed, ["doc_id", "key", "key2"], "left"))
    copy = (F.col("first") < F.col("doc_id")) & (F.col("n_bytes") >= length)
    return out.select("doc_id", F.col("n_bytes").cast("long").alias("n_bytes"),
                      F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("removed", F.lit(0))).cast("long").alias("n_removed"),
                      F.when(copy, F.lit(1)).otherwise(F.coalesce("spans", F.lit(0))).cast("long").alias("n_spans"),
                      F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("sha", "own")).alias("kept_sha256"))


def dedup_texts(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH,
                range_entries: int = RANGE_ENTRIES // 3) -> DataFrame:
    """The documents with what remains of their texts, all other columns as
    they are. Bytes of a character that is cut apart go too; a document that
    nothing is left of has the empty text."""
    key = {"_id": F.col(f"`{doc_id}`").cast("long"), "_k": F.xxhash64(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))),
           "_k2": F.xxhash64(F.lit(7), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")))}
    src = _keyed(docs, doc_id, text).where("doc_id is not null")
    firsts = src.groupBy(*SAME).agg(F.min("doc_id").alias("first"))
    copies = src.where(F.col("n_bytes") >= length).select("doc_id", *SAME).join(firsts, SAME).where("first < doc_id") \
        .select("doc_id", "key", "key2").distinct().withColumn("_copy", F.lit(True))
    gone, _ = removed_spans(src, length, range_entries)
    # spans and marks move to the texts, which move once
    changed = gone.withColumn("_copy", F.lit(False)).unionByName(copies, allowMissingColumns=True) \
        .select(F.col("doc_id").alias("_id"), F.col("key").alias("_k"), F.col("key2").alias("_k2"), "_copy", F.col("spans.s").alias("_s"), F.col("spans.e").alias("_e"))
    own = F.col(f"`{text}`")
    return docs.withColumns(key).join(changed, ["_id", "_k", "_k2"], "left") \
        .withColumn("_cut", F.col("_copy").isNotNull()) \
        .withColumn(text, F.when(F.col("_copy"), F.lit("")).when(F.col("_cut"), _kept_text(own.cast("string"), "_s", "_e")).otherwise(own)) \
        .select(*[quoted(c) for c in docs.columns], "_cut")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: texts without repeated passages; documents that nothing is left of go."""
    out = dedup_texts(docs).where("not _cut or text <> ''")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("_cut"), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*[quoted(c) for c in docs.columns])
