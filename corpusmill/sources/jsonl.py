"""JSONL inputs.

D2 reads lines as text and parses each once, into a map of its fields, so
that *key presence* can be told apart from a NULL value: a record is "rich"
when both ``instruction`` and ``response`` keys are present, otherwise its
``text`` goes to the assistant side and a template to the user side. Blank
lines are skipped; a malformed line fails the job (as the reader does), or is
routed to a rejects frame with ``on_error='rejects'``. Of a key that a line
repeats the last value counts; values that are not strings stay JSON text.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import constants as K
from corpusmill.functions.text import is_blank, pick, strip
from corpusmill.session import path_exists

ABSTRACT_SCHEMA = "title string, abstract string, source string, license string"


def _fields(line: Column) -> Column:
    """Map of a line's fields; NULL where the line is not one JSON object."""
    whole = F.from_json(line, "map<string,string>", {"allowSingleQuotes": "false"})
    return F.when(F.endswith(line, F.lit("}")), whole)


def _value(fields: Column, key: str) -> Column:
    return F.try_element_at(F.map_values(F.map_filter(fields, lambda k, _: k == key)), F.lit(-1))


def scan_two_format(spark: SparkSession, path: str, templates: list[str] = K.PROMPTS_4,
                    on_error: str = "fail", extra_fields: str = "") -> DataFrame:
    """Two-format instruction JSONL -> (user_msg, asst_msg, rich)."""
    lines = spark.read.text(path).where(~is_blank("value")).select(strip("value").alias("value"))
    # one row per parsed line, by a generator: a filter on the map would be
    # pushed down and parse the line a second time
    good = F.col("j").isNotNull()
    one = F.array(F.struct(F.col("j").alias("j")))
    if on_error == "fail":
        one = F.when(good, one).otherwise(F.raise_error(F.concat(F.lit("malformed JSON line: "), F.substring("value", 1, 200))))
    else:
        one = F.when(good, one)
    parsed = lines.select("value", _fields(F.col("value")).alias("j")).select(F.inline(one))
    j = F.col("j")
    rich = F.map_contains_key(j, "instruction") & F.map_contains_key(j, "response")
    text = F.coalesce(_value(j, "text"), F.lit(""))
    extra = [f.split() for f in extra_fields.split(",")] if extra_fields else []
    return parsed.select(
        *[_value(j, name).try_cast(kind).alias(name) for name, kind in extra],
        rich.alias("rich"),
        F.when(rich, _value(j, "instruction")).otherwise(pick(text, templates)).alias("user_msg"),
        F.when(rich, _value(j, "response")).otherwise(text).alias("asst_msg"),
    )


def write_rejects(spark: SparkSession, path: str, out: str) -> int:
    """Malformed lines of ``path`` as text files under ``out``; their number
    is counted during the write."""
    obs = Observation("rejects")
    rejects(spark, path).observe(obs, F.count(F.lit(1)).alias("n")).write.mode("overwrite").text(out)
    return int(obs.get["n"])


def rejects(spark: SparkSession, path: str) -> DataFrame:
    """Malformed non-blank lines of a JSONL input."""
    lines = spark.read.text(path).where(~is_blank("value"))
    return lines.where(_fields(strip("value")).isNull())


def scan_abstracts(spark: SparkSession, path: str, attribution_prefix: str = "Abstract: ") -> DataFrame:
    """Abstracts JSONL {title, abstract, source, license} as passages."""
    a = spark.read.schema(ABSTRACT_SCHEMA).option("mode", "FAILFAST").json(path)
    return a.select(
        F.lit(K.ABSTRACTS_SOURCE).alias("source"),
        F.substring(F.md5(F.coalesce("title", F.lit(""))), 1, 8).alias("text_id"),
        F.lit("english").alias("language"),
        F.coalesce("abstract", F.lit("")).alias("content"),
        F.col("title"),
        F.col("license"),
        F.concat(F.lit(attribution_prefix), F.coalesce("source", F.lit("")), F.lit("; "),
                 F.coalesce("title", F.lit(""))).alias("attribution"),
    )


def reuse_or_build(spark: SparkSession, path: str, build: Callable[[], DataFrame],
                   skip_if_exists: bool = True, schema: str | None = None) -> DataFrame:
    """Materialised-corpus reuse (D4): read the corpus at ``path`` when it is
    complete (its ``_SUCCESS`` mark is there, and reuse is on); otherwise
    build it, write it there, and read the written table back (which also
    cuts the lineage). A folder that an interrupted job left is rebuilt."""
    if not (skip_if_exists and path_exists(spark, f"{path.rstrip('/')}/_SUCCESS")):
        build().write.mode("overwrite").json(path)
    r = spark.read
    if schema:
        r = r.schema(schema)
    return r.json(path)


def first_lines(spark: SparkSession, path: str, n: int) -> DataFrame:
    """First ``n`` physical lines (column ``value``) of the files under
    ``path``; only the first files in name order that hold so many lines
    are read."""
    head = _first_files(spark, path, n)
    lines = spark.read.text(head or path).select(
        "value", F.col("_metadata.file_path").alias("_f"),
        F.col("_metadata.file_block_start").alias("_b"),
        F.monotonically_increasing_id().alias("_i"))
    return lines.orderBy("_f", "_b", "_i").limit(n)


def _first_files(spark: SparkSession, path: str, n: int) -> list[str]:
    """The first files in name order with ``n`` lines together (an empty list
    where the file system cannot be listed from here)."""
    try:
        jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        listed = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(jpath)
        names = sorted(s.getPath().toString() for s in listed if s.isFile() and s.getLen() and s.getPath().getName()[:1] not in "._")
    except Exception:  # noqa: BLE001  (Spark Connect has no JVM handle)
        return []
    for k in range(1, len(names) + 1):
        if spark.read.text(names[:k]).limit(n).count() >= n:
            return names[:k]
    return names


def preview_lines(spark: SparkSession, path: str, n: int = 3, clip_len: int = 120) -> DataFrame:
    """First ``n`` physical lines of a JSONL output (files in name order),
    blank ones then dropped; a line shows its ``text`` field when it has
    one, else the raw line; clipped (T2).

    Physical order = (file, split start, position in the split): splits of
    one file are read whole by one task, and ``monotonically_increasing_id``
    grows in read order inside a task. Planned as a top-n, never a sort of
    the whole output.
    """
    first = first_lines(spark, path, n)
    shown = F.coalesce(F.get_json_object("value", "$.text"), F.col("value"))
    return first.where(~is_blank("value")).select(F.substring(shown, 1, clip_len).alias("preview"))


def read_or_cache(spark: SparkSession, primary: Callable[[], DataFrame], cache_path: str,
                  schema: str | None = None) -> DataFrame:
    """Source with a cache fallback (D4): the primary builder's frame, or -
    when building it fails at analysis (missing table or path, unreadable
    schema) - the cached JSONL at ``cache_path``. Failures are decided while
    the plan is built, so the fallback costs no job."""
    try:
        df = primary()
        df.schema  # forces analysis of the primary source
        return df
    except Exception:  # noqa: BLE001  (AnalysisException and friends)
        if not path_exists(spark, cache_path):
            raise
        r = spark.read
        if schema:
            r = r.schema(schema)
        return r.json(cache_path)
