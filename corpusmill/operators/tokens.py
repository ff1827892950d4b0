"""Tokenization, truncation and sequence packing.

The native tokenizer splits on runs of Unicode whitespace (Python's
``str.split()``) with ``translate`` + ``split`` on the JVM, and gives each
token a hashed id, so the hot path stays in codegen. An external tokenizer
(e.g. a local ``tokenizers`` vocabulary file) can be plugged in; it runs in
an Arrow-batched pandas UDF and is loaded once per Python worker.
"""

from __future__ import annotations

from typing import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.functions.text import WS_CHARS, _c, hash_bucket
from corpusmill.session import small_batches

_TOKENIZER_CACHE: dict = {}


_OTHER_WS = WS_CHARS.replace(" ", "")


def native_tokens(col) -> Column:
    """Whitespace tokens (Python ``str.split()``).

    Every whitespace character is first mapped to a space with
    ``translate`` (a character map, no regex), then the text is split on the
    single space and the empty pieces of whitespace runs are dropped.
    """
    spaced = F.translate(_c(col), _OTHER_WS, " " * len(_OTHER_WS))
    return F.filter(F.split(spaced, " ", -1), lambda t: t != "")


def hashed_ids(tokens_col, vocab_size: int = 1 << 20) -> Column:
    """Deterministic ids for native tokens: ``xxhash64(token) mod vocab_size``
    (JVM hash, no Python; a stand-in vocabulary when none is given)."""
    return F.transform(_c(tokens_col), lambda t: F.pmod(F.xxhash64(t), F.lit(vocab_size)).cast("int"))


def external_ids(col, factory: Callable[[], Callable[[list[str]], list[list[int]]]], key: str, skip: bool = False) -> Column:
    """Token ids from an external tokenizer, Arrow-batched.

    ``factory`` builds a callable ``texts -> ids`` (e.g. wrapping
    ``tokenizers.Tokenizer.from_file(path).encode_batch``); it is called once
    per worker and cached under ``key``. A batch that fails fails the task or, with
    ``skip``, is tried text by text, and texts that fail get NULL (E3).
    """
    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def _enc(s: pd.Series) -> pd.Series:
        fn = _TOKENIZER_CACHE.get(key)
        if fn is None:
            fn = _TOKENIZER_CACHE[key] = factory()
        texts = s.fillna("").tolist()
        try:
            return pd.Series(fn(texts), dtype=object)
        except Exception:  # noqa: BLE001
            if not skip:
                raise

        def one(text):
            try:
                return fn([text])[0]
            except Exception:  # noqa: BLE001  (a text the tokenizer cannot read)
                return None
        return pd.Series([one(t) for t in texts], dtype=object)

    return _enc.asNondeterministic()(_c(col))   # never duplicated into pushed-down filters


def tokenize(df: DataFrame, col: str = "text", out: str = "tokens", drop_text: bool = True,
             factory=None, key: str = "default", on_error: str = "fail", failed: Observation | None = None) -> DataFrame:
    """Batched tokenization; the text column is removed like ``remove_columns``.
    ``on_error='skip'`` leaves out rows whose text the external tokenizer
    cannot read; ``failed`` counts them (``failed``) during the next action."""
    skip = on_error == "skip"
    if factory is not None:
        small_batches(df.sparkSession)
    expr = native_tokens(col) if factory is None else external_ids(col, factory, key, skip)
    res = df.withColumn(out, expr)
    if factory is not None and skip:
        if failed is not None:
            res = res.observe(failed, F.count_if(F.col(out).isNull()).alias("failed"))
        res = res.where(F.col(out).isNotNull())
    return res.drop(col) if drop_text and col != out else res


def truncate_tokens(df: DataFrame, col: str = "tokens", n: int = 512,
                    mask: str = "attention_mask", also: tuple[str, ...] = ()) -> DataFrame:
    """Keep the first ``n`` tokens (and of every column in ``also``), no
    padding; attention mask of ones."""
    for c in (col, *also):
        df = df.withColumn(c, F.slice(F.col(c), 1, n))
    return df.withColumn(mask, F.array_repeat(F.lit(1), F.size(F.col(col))))


def run_offsets(runs: DataFrame, group: str, order: str, length: str, chunk: int | None,
                buckets: int | None = None, unique: bool = False) -> DataFrame:
    """[start, end) offset of every run in the concatenation of its group,
    ordered by ``order``.

    With ``chunk`` set, the running sum is segmented: one window partitioned
    by (group, chunk of ``chunk`` consecutive order values) gives each run
    its running sum inside the chunk and the chunk total; the totals of
    earlier chunks (one row per chunk, read from the same window output)
    give each chunk its base offset through a small running window. The
    input is computed and shuffled once (the two branches share the
    exchange, and the join keeps its partitioning), and no window ever holds
    a whole group.

    ``buckets`` takes the place of ``chunk`` for orders that are text or have
    gaps: the order is then (md5 bucket of ``order``, ``order``), so every
    chunk holds its share of the rows whatever the values are. With ``unique``
    a value of ``order`` that occurs twice in a group fails the job.
    """
    n = F.col(length)
    if chunk is None:
        w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return runs.withColumn("_end", F.sum(n).over(w)).withColumn("_start", F.col("_end") - n)
    place = hash_bucket(F.col(order).cast("string"), buckets) if buckets else F.expr(f"`{order}` div {chunk}")
    r = runs.withColumn("_chunk", F.coalesce(place.cast("bigint"), F.lit(-1)))   # never NULL: joined by plain equality below
    wc = Window.partitionBy(group, "_chunk").orderBy(order)
    local = r.select("*",
                     F.sum(n).over(wc.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("_run"),
                     F.sum(n).over(wc.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_tot"))
    if unique:
        again = F.lag(F.struct(order)).over(wc) == F.struct(order)      # a struct is compared with its NULLs
        local = local.withColumn("_run", F.when(again, F.raise_error(F.concat(
            F.lit(f"{order} occurs twice: "), F.coalesce(F.col(order).cast("string"), F.lit("NULL"))))).otherwise(F.col("_run")))
    totals = local.groupBy(group, "_chunk").agg(F.max("_tot").alias("_tot"))      # on the window's partitioning
    wb = Window.partitionBy(group).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(F.col(group).alias("_b_group"), F.col("_chunk").alias("_b_chunk"),
                         F.coalesce(F.sum("_tot").over(wb), F.lit(0)).alias("_base"))
    cond = (local[group] == base["_b_group"]) & (local["_chunk"] == base["_b_chunk"])
    j = local.join(base, cond, "left")
    return (j.withColumn("_end", F.col("_base") + F.col("_run"))
             .withColumn("_start", F.col("_end") - n)
             .drop("_chunk", "_run", "_tot", "_b_group", "_b_chunk", "_base"))


def pack(df: DataFrame, id_col: str, col: str = "tokens", block: int = 2048, eos: str | int = "</s>",
         shards: int = 64, drop_last: bool = False, chunk: int | None = 1 << 16,
         buckets: int | None = None, unique: bool = False) -> DataFrame:
    """Concatenate token runs (each followed by ``eos``) and cut fixed blocks.

    Runs are spread over ``shards`` by the md5 bucket of their id; within a
    shard, runs are concatenated in id order. Offsets are a distributed prefix sum over
    (shard, id, length) rows (``run_offsets``, segmented by ``chunk`` ids, or by ``buckets``
    for text ids), so the running sum is spread over many tasks. A run is cut into one
    slice per block it touches (``transform`` over the block sequence, then ``inline``), and every
    block is assembled by a group of at most ``block`` tokens.

    With ``unique`` ids the token arrays take no part in the prefix sum: the
    offsets are joined to them by id (an id that occurs twice fails the job). Without,
    ids may repeat, and the arrays go through the offset windows.
    """
    shard = F.coalesce(hash_bucket(F.col(id_col).cast("string"), shards), F.lit(0)).alias("shard")
    ids = F.col(id_col).alias("run_id")
    runs = df.select(shard, ids, F.concat(F.col(col), F.array(F.lit(eos))).alias("_t"))
    if unique:
        lens = df.select(shard, ids, (F.size(col) + 1).alias("_n"))
        at = run_offsets(lens, "shard", "run_id", "_n", chunk, buckets, unique=True) \
            .select(F.col("shard").alias("_s"), F.col("run_id").alias("_id"), "_start", "_end")
        runs = runs.join(at, (F.col("shard") == F.col("_s")) & F.col("run_id").eqNullSafe(F.col("_id"))).drop("_s", "_id")
    else:
        runs = run_offsets(runs.withColumn("_n", F.size("_t")), "shard", "run_id", "_n", chunk, buckets)
    start, end = F.col("_start"), F.col("_end")

    def piece(b):
        lo = F.greatest(b * block, start)
        hi = F.least((b + 1) * block, end)
        return F.struct(b.alias("block"), lo.alias("_off"),
                        F.slice("_t", (lo - start + 1).cast("int"), (hi - lo).cast("int")).alias("_p"))

    # one slice per block the run touches, built inside the row: the run's
    # tokens are copied once in total, not once per block
    blocks_of_run = F.sequence(F.floor(start / block), F.floor((end - 1) / block))
    pieces = runs.select("shard", F.inline(F.transform(blocks_of_run, piece)))
    blocks = (pieces.groupBy("shard", "block")
                    .agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_off", "_p"))),
                                               lambda s: s["_p"])).alias("tokens")))
    blocks = blocks.withColumn("n_tokens", F.size("tokens"))
    if drop_last:
        blocks = blocks.where(F.col("n_tokens") == block)
    return blocks
