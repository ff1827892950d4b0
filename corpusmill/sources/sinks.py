"""JSONL sinks.

Spark writes one part file per task, UTF-8, no ASCII escaping, compact
separators, and omits NULL fields. The flat record is filled with defaults
first, so all five fields are always present; the nested record wants
absent keys omitted, which is what the writer does for NULL struct fields.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.sources.tables import DOC_BITS, POS_BITS, RANK_BITS

FLAT_FIELDS = ["instruction", "response", "source", "language", "text"]


def sink_jsonl(df: DataFrame, path: str, ordered: bool = False, ord_col: str = "ord",
               mode: str = "overwrite", watch=None, spans: list[tuple[int, int, int]] | None = None, mark: bool = True, record=None) -> None:
    """Flat 5-field JSONL. ``ordered=True`` splits by ranges of ``ord`` and
    sorts within partitions, so part files concatenated in name order are in
    collection order (no single-partition sort). With ``spans`` (see
    ``range_of``) the ranges come from the parts of ``ord`` alone; without,
    Spark samples the frame for them, which runs its upstream plan once more.

    ``record`` (``DataFrame -> DataFrame``) makes the five fields behind the
    range exchange, so that texts they hold more than once are shuffled once.
    ``watch`` (``DataFrame -> DataFrame``, e.g. an ``observe``) is applied
    after the range exchange, so that a sampling job does not count rows
    twice. ``mark=False`` leaves the folder without ``_SUCCESS``: a later step completes it.
    """
    out = df
    if ordered and ord_col in df.columns:
        if spans is None:
            out = df.repartitionByRange(ord_col)
        else:
            parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
            out = df.repartitionById(max(parts, len(spans)), range_of(F.col(ord_col), spans, parts))
        out = out.sortWithinPartitions(ord_col)
    if record is not None:
        out = record(out)
    if watch is not None:
        out = watch(out)
    out.select(*FLAT_FIELDS).write.mode(mode).option("ignoreNullFields", "true") \
        .option("mapreduce.fileoutputcommitter.marksuccessfuljobs", str(mark).lower()).json(path)


def range_of(ord_: Column, spans: list[tuple[int, int, int]], parts: int) -> Column:
    """Number of the range that an ``ord`` falls into, growing with it. ``spans``
    lists (rank, smallest, largest document ordinal); a span gets its share of
    ``parts`` ranges (one at least) by its width and is cut evenly."""
    spans = sorted(spans)
    total = sum(hi - lo + 1 for _, lo, hi in spans)
    rank = F.shiftright(ord_, RANK_BITS)
    doc = F.shiftright(ord_, POS_BITS).bitwiseAND(F.lit((1 << DOC_BITS) - 1))
    spare, at, out = max(parts - len(spans), 0), 0, None
    for r, lo, hi in spans:
        width = hi - lo + 1
        k = 1 + spare * width // total
        place = F.lit(at) + F.least(F.greatest(F.floor((doc - lo).cast("double") * k / width), F.lit(0)), F.lit(k - 1))
        out = F.when(rank == r, place) if out is None else out.when(rank == r, place)
        at += k
    return out.otherwise(F.raise_error(F.concat(F.lit("no range for source rank "), rank.cast("string")))).cast("int")


def complete(spark: SparkSession, path: str) -> None:
    """Mark a folder as complete."""
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/_SUCCESS")
    jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(jpath, True).close()


def nested_record(df: DataFrame, content_col: str = "content", text_col: str = "text") -> DataFrame:
    """``{text, meta}`` where meta holds every column except content/text."""
    meta_cols = [c for c in df.columns if c not in (content_col, text_col)]
    return df.select(F.col(text_col).alias("text"), F.struct(*meta_cols).alias("meta"))


def sink_nested(df: DataFrame, path: str, content_col: str = "content", text_col: str = "text",
                mode: str = "overwrite") -> None:
    nested_record(df, content_col, text_col).write.mode(mode) \
        .option("ignoreNullFields", "true").json(path)
