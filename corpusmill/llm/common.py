"""Shared pieces: written tables, connected components, vectorised hashing."""

from __future__ import annotations

import gc

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.session import scratch_dir, small_batches  # noqa: F401  (small_batches: for the operators)

_MADE: list[str] = []


def quoted(name: str) -> Column:
    """A column by its literal name (dots and spaces included)."""
    return F.col("`" + name.replace("`", "``") + "`")


def pick(df: DataFrame, **cols: tuple[str, str]) -> DataFrame:
    """Only the named columns, renamed and cast, so that extra columns with
    clashing names never meet the operator's own: pick(df, doc_id=("id", "long"))."""
    return df.select(*[quoted(src).cast(kind).alias(out) for out, (src, kind) in cols.items()])


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared scratch folder: cuts lineage
    and survives lost executors."""
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    df.write.parquet(path)
    _MADE.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def drop(df: DataFrame) -> None:
    """Delete a table made by written() that nothing reads any more."""
    path = getattr(df, "_scratch_path", None)
    if path in _MADE:
        _MADE.remove(path)
        _delete(df.sparkSession, path)


def made() -> list[str]:
    """The tables that this session still holds."""
    return list(_MADE)


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Delete some of them."""
    for path in paths:
        if path in _MADE:
            _MADE.remove(path)
            _delete(spark, path)


def sweep(spark: SparkSession) -> None:
    """The caller's clean-up: deletes every table this session still holds.
    Call it when results made from them have been consumed."""
    discard(spark, made())


def release(spark: SparkSession) -> None:
    """Ask for the shuffle files of plans that nobody holds any more: Spark
    deletes them once the driver's collector has met their plans."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _delete(spark: SparkSession, path: str) -> None:
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jpath, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# ---------------------------------------------------------------- components
def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Connected components of undirected links: one row (node, root) per node
    that has a link to another node; root is the smallest node reachable.

    Alternating large-star / small-star (Kiveris et al. 2014) over DataFrame
    joins; each round is a written table, nothing is collected but two
    numbers per round that tell whether the links still change.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    e = written(e, "cc")
    seen = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("x"), F.least("u", "m").alias("m"))
        large = e.join(low, e.v == low.x).select("u", F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "x")
        small = (large.join(least, large.u == least.x)
                 .select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")),
                                           F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("s"))
                 .select("s.u", "s.v").where("u <> v").distinct())
        nxt = written(small, "cc")
        now = tuple(nxt.agg(F.count("*"), F.expr("coalesce(sum(cast(xxhash64(u, v) as decimal(38, 0))), 0)")).first())
        drop(e)
        e = nxt
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"links still change after {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


# ---------------------------------------------------------------- arrays of a batch
def text_buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary Arrow array; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, pa.scalar(b"" if pa.types.is_binary(column.type) else "", column.type))
    wide = column.type in (pa.large_string(), pa.large_binary())
    _, offs, data = column.buffers()
    off = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1]
    off = off.astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[off[0]:off[-1]] if len(off) else buf[:0], off - off[0] if len(off) else np.zeros(1, np.int64)


def pieces(batches, text: str = "text", most: int = 4 << 20, rows: int = 30_000):
    """The batches in pieces of at most ``most`` bytes of text (one row at
    least) and ``rows`` rows, which bounds the arrays made from them."""
    for b in batches:
        _, off = text_buffer(b[text])
        at = 0
        while at < b.num_rows:
            to = int(np.searchsorted(off, off[at] + most, "right")) - 1
            to = min(max(to, at + 1), at + rows, b.num_rows)
            yield b.slice(at, to - at)
            at = to


def numbers(column) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BLOCK = 1 << 20
_BASE = 0xD6E8FEB86659FD93
_rng = np.random.default_rng(20240607)
BYTE_CODE = _rng.integers(1, 2**64, 256, dtype=np.uint64) | np.uint64(1)
WORD_CODE = _rng.integers(1, 2**64, 64, dtype=np.uint64) | np.uint64(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
NOT_WORD = np.zeros(256, bool)        # ASCII other than letters and digits
NOT_WORD[:128] = [not chr(c).isalnum() for c in range(128)]
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse modulo 2**64 for i < n at least."""
    if len(_powers.get("up", ())) < n:
        m = max(n, BLOCK + 4096)
        inv = pow(_BASE, -1, 2**64)
        for key, base in (("up", _BASE), ("down", inv)):
            steps = np.full(m, base, np.uint64)
            steps[0] = 1
            _powers[key] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def words_of(buf: np.ndarray, gaps: np.ndarray = SPACE, bounds: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words (by default [^\\x20\\x09-\\x0D]+, A-Z lower-cased) of some bytes:
    start and end offsets, and a 64-bit hash of each. Works in blocks cut at
    gaps. No word crosses the offsets in bounds."""
    starts, ends, hashes = [], [], []
    n, at = len(buf), 0
    while at < n:
        to = min(n, at + BLOCK)
        if to < n:                                   # cut after the last white space of the block
            back = np.flatnonzero(gaps[buf[at:to]])
            while not len(back) and to < n:          # one word longer than a block
                more = min(n, to + BLOCK)
                back = np.flatnonzero(gaps[buf[at:more]])
                to = more
            to = at + int(back[-1]) + 1 if len(back) else to
        b = LOWER[buf[at:to]]
        gap = gaps[b]
        begins = ~gap
        closes = begins.copy()
        begins[1:] &= gap[:-1]
        closes[:-1] &= gap[1:]
        if bounds is not None:
            cut = bounds[np.searchsorted(bounds, at, "right"):np.searchsorted(bounds, to, "left")] - at
            begins[cut] = ~gap[cut]
            closes[cut - 1] = ~gap[cut - 1]
        s, e = np.flatnonzero(begins), np.flatnonzero(closes) + 1
        up, down = powers(len(b) + 1)
        sums = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(BYTE_CODE[b] * up[:len(b)], out=sums[1:])
        h = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
        starts.append(s + at)
        ends.append(e + at)
        hashes.append(h)
        at = to
    if not starts:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(0, np.uint64)
    return np.concatenate(starts), np.concatenate(ends), np.concatenate(hashes)


def batch_words(buf: np.ndarray, off: np.ndarray, gaps: np.ndarray = SPACE):
    """words_of() for each text of a batch, without words across texts: yields
    (first text, last text + 1, word starts, ends, hashes, text index of each
    word) for runs of texts of about a block together."""
    n, i = len(off) - 1, 0
    while i < n:
        j = int(np.searchsorted(off, off[i] + BLOCK, "right")) - 1
        j = min(n, max(i + 1, j))
        lo, hi = int(off[i]), int(off[j])
        bounds = off[i:j + 1] - lo
        s, e, h = words_of(buf[lo:hi], gaps, bounds)
        owner = np.searchsorted(bounds, s, "right") - 1
        yield i, j, s - bounds[owner], e - bounds[owner], h, owner + i
        i = j


def shingle_hashes(h: np.ndarray, owner: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of ``width`` words inside one text, and the index of its first word."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    first = np.flatnonzero(owner[:n] == owner[width - 1:])
    acc = np.zeros(n, np.uint64)
    for k in range(width):
        acc += h[k:k + n] * WORD_CODE[k]
    return mix(acc[first]), first
