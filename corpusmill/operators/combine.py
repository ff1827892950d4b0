"""Union of sources, seed floor, caps and preview."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.text import clip
from corpusmill.sources.tables import SEED_RANK, make_ord


def union_sources(frames: list[DataFrame]) -> DataFrame:
    """Bag union in the given order; missing columns become NULL.

    Order is carried by each frame's ``ord``; filters above the union are
    pushed into every branch by the optimizer.
    """
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def seed_rows(seed: DataFrame) -> DataFrame:
    """Seed pairs ordered after every source."""
    return seed.select("instruction", "response",
                       make_ord(F.lit(SEED_RANK), F.col("seed_id")).alias("ord"))


def with_floor(df: DataFrame, seed: DataFrame, mode: str = "always", n: int = 20) -> DataFrame:
    """Append the seed corpus.

    ``always``: seeds are always appended. ``if_below``: seeds are appended
    only when fewer than ``n`` rows were collected (zero included). The
    count is a scalar subquery over ``df.limit(n)``: no action while the
    plan is built and at most ``n`` rows counted per partition.
    """
    s = seed_rows(seed)
    if mode == "if_below":
        small = df.limit(n).select(F.count(F.lit(1))).scalar()
        s = s.where(small < F.lit(n))
    elif mode != "always":
        raise ValueError(f"unknown floor mode {mode!r}")
    return df.unionByName(s, allowMissingColumns=True)


def _local_top(df: DataFrame, by: list, n: int, ord_col: str, g: int, desc: bool = False) -> DataFrame:
    """First level of a two-level top-n: rows are bucketed by their map
    partition (``spark_partition_id() % g``), and ``row_number() <= n`` per
    (group, bucket) is planned with a partial WindowGroupLimit, so every map
    partition ships at most n rows per group and each of the g buckets keeps
    n. The second level then merges g x n rows per group instead of n rows
    from every map partition."""
    b = df.withColumn("_b", F.pmod(F.spark_partition_id(), F.lit(g)))
    w = Window.partitionBy(*by, "_b").orderBy(F.col(ord_col).desc() if desc else F.col(ord_col))
    return b.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r", "_b")


def cap_total(df: DataFrame, n: int, ord_col: str = "ord", fanout: int | None = None) -> DataFrame:
    """First ``n`` rows in collection order (T1): planned as TakeOrderedAndProject,
    i.e. a per-partition top-n and one merge of at most n x partitions rows.
    ``fanout=g`` (about the square root of the partitions, on jobs with very
    many) puts a first level of g buckets before the merge of n x g rows."""
    if fanout:
        df = _local_top(df, [], n, ord_col, fanout)
    return df.orderBy(ord_col).limit(n)


def cap_per_group(df: DataFrame, by, n: int, ord_col: str = "ord", fanout: int | None = None) -> DataFrame:
    """First ``n`` rows of each group in collection order (W1, T1 per source).

    ``row_number() <= n`` is planned with WindowGroupLimit before and after
    the shuffle, so a hot group sends at most n rows per map partition;
    ``fanout=g`` puts a first level per (group, one of g partition buckets)
    before the merge of n x g rows per group.
    """
    by = [by] if isinstance(by, str) else list(by)
    if fanout:
        df = _local_top(df, by, n, ord_col, fanout)
    w = Window.partitionBy(*by).orderBy(F.col(ord_col))
    return (df.withColumn("_rn", F.row_number().over(w))
              .where(F.col("_rn") <= n).drop("_rn"))


def preview(df: DataFrame, n: int = 5, clip_len: int = 100, ord_col: str = "ord",
            cols: tuple[str, ...] = ("instruction", "response"), suffix: str = "") -> DataFrame:
    """First ``n`` records in order with clipped columns."""
    top = cap_total(df, n, ord_col)
    return top.select(ord_col, *[clip(c, clip_len, suffix=suffix).alias(c) for c in cols])
