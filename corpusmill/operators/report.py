"""Collection report (A2): passages per source, kept after dedupe, output size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from corpusmill.sources.tables import RANK_BITS


def collection_report(df: DataFrame, key: Column, text_col: str = "text", by: str = "source",
                      ord_col: str = "ord") -> DataFrame:
    """Passages collected and kept (first-wins on ``key``) per source, and
    the kept characters.

    One scan and no join: rows are counted per (key, source) with their
    smallest ``ord`` and its length (partial aggregates, so a hot key ships a
    row per partition and source); the winner of a key is the smallest of
    these few rows; then one aggregate per source. Keys travel as SHA-256.
    """
    k = F.unhex(F.sha2(F.coalesce(key, F.lit("")), 256))
    base = df.select(F.col(by).alias("_by"), F.col(ord_col).alias("_ord"), F.length(F.col(text_col)).alias("_chars"), k.alias("_k"))
    per = base.groupBy("_k", "_by").agg(F.count(F.lit(1)).alias("_n"), F.min("_ord").alias("_ord"),
                                        F.min_by("_chars", "_ord").alias("_chars"))
    first = F.col("_ord") == F.min("_ord").over(Window.partitionBy("_k"))
    return per.withColumn("_first", first).groupBy(F.col("_by").alias(by)).agg(
        F.sum("_n").alias("n_collected"),
        F.sum(F.col("_first").cast("bigint")).alias("n_kept"),
        F.sum(F.when(F.col("_first"), F.col("_chars")).otherwise(F.lit(0))).cast("bigint").alias("kept_chars"),
    )


def observed(df: DataFrame, name: str = "corpus") -> tuple[DataFrame, Observation]:
    """Attach row/char counters that are filled by the next action on ``df``
    (e.g. the sink write), so the totals cost no extra job."""
    obs = Observation(name)
    cols = [F.count(F.lit(1)).alias("rows")]
    if "text" in df.columns:
        cols.append(F.sum(F.length("text")).alias("chars"))
    return df.observe(obs, *cols), obs


def values(obs: Observation) -> dict:
    """The numbers of an observation; none where the optimizer found the
    observed part empty and left it out of the plan."""
    jvm = getattr(obs, "_jo", None)
    return {} if jvm is not None and jvm.getRow().schema() is None else dict(obs.get)


class Counters:
    """Rows and characters per source, counted while a plan runs: ``watch``
    puts one ``Observation`` into it, for the ranks that ``ord`` can hold
    (``names``: rank -> name), and ``read`` gives its numbers after an action.
    A stage that is run again after a loss is counted again, so the numbers of
    a plan part below a shuffle are upper bounds then."""

    def __init__(self, names: dict[int, str], label: str, text_col: str | None = None, ord_col: str = "ord"):
        self.names, self.obs, self.text_col, self.ord_col = names, Observation(label), text_col, ord_col

    def watch(self, df: DataFrame) -> DataFrame:
        rank = F.shiftright(F.col(self.ord_col), RANK_BITS)
        cols = [F.count_if(rank == r).alias(f"n{r}") for r in self.names]
        if self.text_col:
            cols += [F.sum(F.when(rank == r, F.length(self.text_col))).alias(f"c{r}") for r in self.names]
        return df.observe(self.obs, *cols)

    def read(self) -> dict[str, dict[str, int]]:
        got = values(self.obs)
        return {name: {"rows": int(got.get(f"n{r}") or 0), **({"chars": int(got.get(f"c{r}") or 0)} if self.text_col else {})}
                for r, name in self.names.items()}
