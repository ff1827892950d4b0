"""Best-fit packing of token pieces with Martello-Toth dominance reduction.

A document's tokens are its ids and one end id; documents longer than a
sequence are cut into full pieces, the remainder first. Only lengths matter to
the packing, so it runs on the histogram of lengths, which has at most
``capacity`` rows however large the corpus is:

1. Reduction (after Martello and Toth): for the longest remaining length,
   a set of at most three items that provably dominates every other set with
   that item is fixed as a sequence, as many times as it occurs; the reduced
   instance is looked at again until nothing more can be fixed.
2. Best fit on what remains, longest first, equal sequences handled together.

The plan (length, ranks, first sequence, offset) goes to every task; pieces get
their rank within their length by two windows salted with buckets of ids, so a
length that a third of all pieces share is spread.

Nulls: a null text is the empty text (one end id). A row with a null doc_id is
packed too. Rows that repeat are packed each. An empty table gives an empty
result.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm.common import numbers, pick, pieces as text_pieces, shuffle_partitions, written
from corpusmill.llm.token_ids import encoder

CAPACITY = 2048
END_ID = 0


# ---------------------------------------------------------------- the plan
def _dominating(count: np.ndarray, w: int, capacity: int):
    """A set (tuple of lengths) holding w that dominates all other sets with w
    among the remaining items, or None if that can't be shown."""
    free = capacity - w
    count = count.copy()
    count[w] -= 1
    have = np.flatnonzero(count[:free + 1])
    if not len(have):
        return (w,)                                  # nothing fits beside it
    if count[free]:
        return (w, free)                             # a full sequence
    low = int(have[0])
    second = low if count[low] > 1 else int(have[1]) if len(have) > 1 else free + 1
    best = int(have[-1])
    if low + second > free:
        return (w, best)                             # one more item fits at most
    third = low if count[low] > 2 else second if second > low and count[second] > 1 else \
        int(have[have > second][0]) if (have > second).any() else free + 1
    if low + second + third > free:                  # two more at most
        pair = _best_pair(count, have, free)
        if pair and pair[0] + pair[1] <= best:
            return (w, best)                         # the one item is no smaller than any pair
        if pair and pair[1] == best and _largest_smaller(count, have, free) <= pair[0]:
            return (w, *pair)                        # both items are no smaller than those of any pair
    return None


def _best_pair(count, have, free):
    """The pair (a <= b) with the largest sum that fits."""
    best, i, j = None, 0, len(have) - 1
    while i <= j:
        a, b = int(have[i]), int(have[j])
        if a + b > free or i == j and count[a] < 2:
            j -= 1
            continue
        if best is None or a + b > sum(best):
            best = (a, b)
        i += 1
    return best


def _largest_smaller(count, have, free):
    """The largest item that can be the smaller one of a pair that fits."""
    for i in range(len(have) - 1, -1, -1):
        a = int(have[i])
        b = a if count[a] > 1 else int(have[i + 1]) if i + 1 < len(have) else free + 1
        if a + b <= free:
            return a
    return 0


def reduce_instance(count: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Fix dominating sets; ``count`` keeps what remains. (lengths, times) each."""
    fixed = []
    changed = True
    while changed:
        changed = False
        for w in range(capacity, 0, -1):
            while count[w]:
                found = _dominating(count, w, capacity)
                if found is None:
                    break
                need = defaultdict(int)
                for x in found:
                    need[x] += 1
                times = int(min(count[x] // k for x, k in need.items()))
                if len(found) == 1 or found == (w, capacity - w):
                    pass                              # holds for all of them alike
                elif times > 1:
                    times = _safe_times(count, need, found, w, capacity, times)
                for x, k in need.items():
                    count[x] -= k * times
                fixed.append((found, times))
                changed = True
    return fixed


def _safe_times(count, need, found, w, capacity, most):
    """How often the same set may be fixed at once: as long as it is still the
    dominating one on the reduced instance (found by halving)."""
    def holds(times):
        rest = count.copy()
        for x, k in need.items():
            rest[x] -= k * (times - 1)
        return _dominating(rest, w, capacity) == found
    low, high = 1, most
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if holds(mid) else (low, mid - 1)
    return low


def best_fit(count: np.ndarray, capacity: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Best fit, longest first. ((length, copies), ...), times each."""
    room: dict[int, dict[tuple, int]] = defaultdict(lambda: defaultdict(int))     # free space: contents: how many

    def put(free, contents, n):
        if n:
            room[free][contents] += n

    for w in range(capacity, 0, -1):
        left = int(count[w])
        while left:
            free = min((f for f in room if f >= w and room[f]), default=None)
            if free is None:
                each = capacity // w
                put(capacity - each * w, ((w, each),), left // each)
                if left % each:
                    put(capacity - left % each * w, ((w, left % each),), 1)
                break
            each = free // w
            contents, n = next(iter(room[free].items()))
            full = min(n, left // each)
            if full:
                used, times = each, full
            else:
                used, times = left, 1
            room[free][contents] -= times
            if not room[free][contents]:
                del room[free][contents]
            put(free - used * w, (*contents, (w, used)), times)
            left -= used * times
    return [(c, n) for by in room.values() for c, n in by.items()]


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first rank, copies, times, first sequence, offset): piece
    number r of a length, with first rank <= r < first rank + copies * times,
    goes to sequence first + (r - first rank) % times, at offset + length *
    ((r - first rank) // times)."""
    count = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of {length} tokens")
        count[length] = n
    sets = [(tuple((x, 1) for x in s), n) for s, n in reduce_instance(count, capacity)]
    sets += best_fit(count, capacity)
    rows, next_rank, sequence = [], defaultdict(int), 0
    for contents, times in sets:
        offset = 0
        for length, copies in contents:
            rows.append((length, next_rank[length], copies, times, sequence, offset))
            next_rank[length] += copies * times
            offset += length * copies
        sequence += times
    return rows


# ---------------------------------------------------------------- Spark
def token_pieces(docs: DataFrame, tokenizer: str, *, capacity: int = CAPACITY, end_id: int = END_ID,
                 with_ids: bool = False) -> DataFrame:
    """One row per piece of (doc_id, text): doc_id, piece, start, length,
    ids_crc32 and, if asked for, the ids."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids

    def cut(batches):
        enc = encoder(tokenizer)
        for part in text_pieces(batches):
            ids, off = enc.encode_batch(part["text"])
            ids = np.insert(ids.astype("<u4"), off[1:], end_id)
            n = np.diff(off) + 1                              # with the id at the end
            first = np.where(n % capacity, n % capacity, np.minimum(n, capacity))
            k = 1 + (n - first) // capacity                   # pieces of each document
            doc = np.repeat(np.arange(len(n)), k)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(k) - k, k)
            start = np.where(piece > 0, first[doc] + (piece - 1) * capacity, 0)
            length = np.where(piece > 0, capacity, first[doc])
            at = (np.cumsum(n) - n)[doc] + start
            raw = memoryview(ids.tobytes())
            crc = [zlib.crc32(raw[4 * i:4 * (i + w)]) for i, w in zip(at.tolist(), length.tolist())]
            cols = [part["doc_id"].take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                    pa.array(length, pa.int32()), pa.array(crc, pa.int64())]
            if with_ids:
                cols.append(pa.ListArray.from_arrays(pa.array(np.append(at, len(ids)), pa.int32()), pa.array(ids.view("<i4"))))
            yield pa.RecordBatch.from_arrays(cols, names)

    return docs.mapInArrow(cut, "doc_id long, piece int, start long, length int, ids_crc32 long" + ", ids array<int>" * with_ids)


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to a written table of pieces (length and an order by doc_id, piece)."""
    spark = pieces.sparkSession
    salted = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(4 * shuffle_partitions(spark))).cast("int"))
    counts = salted.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}   # capacity rows at most
    steps = defaultdict(list)
    for length, *row in plan(histogram, capacity):
        steps[length].append(row)
    held = spark.sparkContext.broadcast({k: np.array(sorted(v), np.int64) for k, v in steps.items()})
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32", "start")
    ranked = (salted.withColumn("rank", F.row_number().over(within) - 1).join(base, ["length", "bucket"])
              .withColumn("rank", F.col("rank") + F.col("base")))

    def seat(rank: pa.Array, length: pa.Array):
        rank, length = numbers(rank), numbers(length)
        sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
        for w in np.unique(length):
            at = length == w
            p = held.value[int(w)]
            own = p[np.searchsorted(p[:, 0], rank[at], "right") - 1]
            k = rank[at] - own[:, 0]
            sequence[at] = own[:, 3] + k % own[:, 2]
            offset[at] = own[:, 4] + w * (k // own[:, 2])
        return pa.array(sequence), pa.array(offset)

    keep = [c for c in pieces.columns]

    def seats(batches):
        for b in batches:
            s, o = seat(b["rank"], b["length"])
            yield pa.RecordBatch.from_arrays([*[b[c] for c in keep], s, o], [*keep, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    return ranked.select(*keep, "rank").mapInArrow(seats, schema)


def pack(docs: DataFrame, tokenizer: str, *, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY,
         end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, [ids,] sequence_id, offset."""
    src = pick(docs, doc_id=(doc_id, "long"), text=(text, "string"))
    pieces = written(token_pieces(src, tokenizer, capacity=capacity, end_id=end_id, with_ids=with_ids), "pieces")
    return place(pieces, capacity).withColumn("length", F.col("length").cast("long"))


def sequences(docs: DataFrame, tokenizer: str, **how) -> DataFrame:
    """The packed training rows: sequence_id and its ids (at most capacity)."""
    parts = pack(docs, tokenizer, with_ids=True, **how)
    return parts.groupBy("sequence_id").agg(F.flatten(F.transform(
        F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])).alias("ids"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: the kept documents as packed pieces."""
    import public_tokenizers
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
