"""Keyword alignment score (A3).

Each response is scored against every category: the share of the
category's keywords contained in the lower-cased response; an empty
category scores NULL instead of dividing by zero. The categories are a
parameter of fixed, small size; they are expanded per row with ``inline``
over a literal array, so no join (and no cross join) is planned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def categories_column(categories: dict[str, list[str]]) -> Column:
    items = []
    for name, kws in categories.items():
        kw = F.array(*[F.lit(k.lower()) for k in kws]) if kws else F.array().cast("array<string>")
        items.append(F.struct(F.lit(name).alias("category"), kw.alias("keywords")))
    return F.array(*items)


def alignment_score(df: DataFrame, col: str, categories: dict[str, list[str]],
                    keep: list[str] | None = None) -> DataFrame:
    keep = keep or [c for c in df.columns if c != col]
    low = F.lower(F.col(col))
    expanded = df.select(*keep, low.alias("_low"), F.inline(categories_column(categories)))
    hits = F.size(F.filter(F.col("keywords"), lambda k: F.contains(F.col("_low"), k)))
    return expanded.select(*keep, "category",
                           F.try_divide(hits.cast("double"), F.size("keywords").cast("double")).alias("score"))
