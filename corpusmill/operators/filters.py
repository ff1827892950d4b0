"""Row filters (F1-F4). Cheap length tests come before regex tests so the
optimizer can evaluate them first inside the same codegen stage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import constants as K
from corpusmill.functions.text import is_blank, whole_match


def script_filter(df: DataFrame, col: str, char_class: str = K.CJK_CLASS, min_len: int = 21) -> DataFrame:
    """Whole passage inside ``char_class`` and at least ``min_len`` code points (F1)."""
    c = F.col(col)
    return df.where((F.length(c) >= min_len) & whole_match(c, char_class))


def min_length(df: DataFrame, col: str, n: int, strict: bool = False) -> DataFrame:
    """``length >= n`` (or ``> n`` when ``strict``) (F2)."""
    ln = F.length(F.col(col))
    return df.where(ln > n if strict else ln >= n)


def subset_contains(df: DataFrame, col: str, subset: str | None = None) -> DataFrame:
    """Case-insensitive literal containment; no subset keeps every row."""
    if not subset:
        return df
    return df.where(F.contains(F.lower(F.coalesce(F.col(col), F.lit(""))), F.lit(subset.lower())))


def drop_blank(df: DataFrame, col: str) -> DataFrame:
    """Drop NULL and whitespace-only values."""
    c = F.col(col)
    return df.where(c.isNotNull() & ~is_blank(c))
