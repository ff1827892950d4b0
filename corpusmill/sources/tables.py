"""Table scans, source selection and the collection-order key.

Rows have no order in Spark, but first-wins dedupe and caps depend on the
order passages were collected in. Every passage therefore carries ``ord``:
(source rank, document ordinal, position) packed into one BIGINT, which is
a stable data value (never ``monotonically_increasing_id``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RANK_BITS = 56
DOC_BITS = 36
POS_BITS = 20
SEED_RANK = 127  # seeds sort after every source (rank < 128)


def read_table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """Parquet scan with explicit column pruning. Its parallelism comes from
    the split size (spark.sql.files.maxPartitionBytes, see session.sizing_conf)."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.select(*columns) if columns else df


def _within(c: Column, bits: int, what: str) -> Column:
    """The value, or a failed job when it is NULL or outside [0, 2**bits)."""
    c = c.cast("bigint")
    return F.when((c >= 0) & (c < (1 << bits)), c).otherwise(
        F.raise_error(F.concat(F.lit(f"{what} outside [0, 2^{bits}): "), F.coalesce(c.cast("string"), F.lit("NULL")))).cast("bigint"))


def make_ord(rank, doc_ord, pos=None) -> Column:
    """Pack (rank, doc_ord, pos) into one sortable BIGINT.

    Ranges: rank < 128, doc_ord < 2^36, pos < 2^20; anything else, NULL
    included (a source that the rank map misses), fails the job, as it would
    give two rows one ``ord`` or sort before all others. ``min`` over a BIGINT
    plans as a hash aggregate (partial + final), unlike ``min`` over a struct.
    """
    r = F.col(rank) if isinstance(rank, str) else rank
    d = F.col(doc_ord) if isinstance(doc_ord, str) else doc_ord
    p = F.lit(0) if pos is None else (F.col(pos) if isinstance(pos, str) else pos)
    return (F.shiftleft(_within(r, 7, "source rank"), RANK_BITS)
            + F.shiftleft(_within(d, DOC_BITS, "document ordinal"), POS_BITS)
            + _within(p, POS_BITS, "position"))


def rank_map(order: list[str]) -> Column:
    """Literal map source -> rank (position in the chosen order)."""
    kv = []
    for i, s in enumerate(order):
        kv += [F.lit(s), F.lit(i)]
    return F.create_map(*kv)


def select_sources(df: DataFrame, chosen: list[str], known: list[str] | None = None,
                   source_col: str = "source") -> DataFrame:
    """Keep only chosen sources, ranked in the given order.

    Unknown keys (not in ``known``) are skipped, as the builder warns and
    goes on. ``isin`` reaches the parquet scan as a pushed filter.
    """
    keep = [s for s in dict.fromkeys(chosen) if known is None or s in known]
    return (df.where(F.col(source_col).isin(keep))
              .withColumn("source_rank", F.element_at(rank_map(keep), F.col(source_col))))


def scan_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored crawl, one row per page, routed by host and first path segment."""
    pages = read_table(spark, sf_dir, "pages", ["page_id", "url", "html"])
    return pages.select(
        "page_id", "url",
        F.parse_url("url", F.lit("HOST")).alias("host"),
        F.regexp_extract("url", r"^[a-z]+://[^/]+/([^/?#]*)", 1).alias("route"),
        F.length("html").alias("html_chars"),
    )


def scan_passages(docs: DataFrame) -> DataFrame:
    """Titled passages: missing content becomes '' (D3)."""
    return docs.select(
        F.col("source"),
        F.col("doc_id").cast("string").alias("text_id"),
        F.concat(F.col("source"), F.lit(" #"), F.col("doc_id").cast("string")).alias("title"),
        F.coalesce(F.col("text"), F.lit("")).alias("content"),
        F.col("lang").alias("language"),
    )


def seed_from_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seed corpus stand-in: benchmark items as instruction/response pairs."""
    b = read_table(spark, sf_dir, "benchmark", ["item_id", "text"])
    return b.select(
        F.col("item_id").alias("seed_id"),
        F.col("text").alias("instruction"),
        F.col("text").alias("response"),
    )
