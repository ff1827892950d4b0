"""First-wins dedupe on a derived key (A1).

Default plan: ``row_number() = 1`` per key ordered by ``ord``. Spark plans
it with a partial WindowGroupLimit before the shuffle, so every map
partition ships at most one row per key (a key holding a third of all rows
ships one row per partition), and the input is scanned once.
Alternative (``strategy='semi'``): ``min(ord)`` per key as a hash aggregate,
then a left-semi join on the unique ``ord``. ``dropDuplicates`` would keep
an arbitrary row and is not used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def winners(df: DataFrame, key: Column, ord_col: str = "ord", hash_key: bool = False) -> DataFrame:
    k = F.unhex(F.sha2(key, 256)) if hash_key else key
    return df.select(k.alias("_k"), F.col(ord_col)).groupBy("_k").agg(F.min(ord_col).alias(ord_col))


def dedupe_first(df: DataFrame, key: Column, ord_col: str = "ord", hash_key: bool = False,
                 strategy: str = "window") -> DataFrame:
    """Keep the first row (smallest ``ord``) of every key.

    ``strategy='semi'``: winners by aggregate, then a left-semi join on
    ``ord`` (two scans of the input, only (key, ord) in the aggregate
    shuffle; the join broadcasts the winners when AQE measures them small,
    else sort-merges on the uniform ``ord``).
    ``strategy='window'``: ``row_number() = 1`` per key ordered by ``ord``;
    one scan, and WindowGroupLimit keeps one row per key and map partition
    before the shuffle, so a hot key ships one row per partition.
    ``hash_key=True`` groups by a SHA-256 of the key (for whole-text keys).
    """
    if strategy == "window":
        k = F.unhex(F.sha2(key, 256)) if hash_key else key
        w = Window.partitionBy(k).orderBy(F.col(ord_col))
        return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")
    w = winners(df, key, ord_col, hash_key).select(ord_col)
    return df.join(w, ord_col, "left_semi")


def mark_first(df: DataFrame, key: Column, ord_col: str = "ord", hash_key: bool = False,
               flag: str = "kept") -> DataFrame:
    """Every row with a boolean ``kept`` flag (for reports over both sides)."""
    w = winners(df, key, ord_col, hash_key).select(ord_col, F.lit(True).alias(flag))
    return df.join(w, ord_col, "left").withColumn(flag, F.coalesce(F.col(flag), F.lit(False)))
