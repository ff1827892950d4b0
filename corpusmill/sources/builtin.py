"""Built-in registered sources over a folder of tables.

* ``documents`` - passage table ``documents`` (doc_id, text, lang, source);
  pairs in echo style.
* ``titled`` - the same passages with a title, optionally those whose title
  contains ``subset``; pairs in commentary style.
* ``selected`` - stored pages -> passages of the elements matching CSS-like
  selectors -> script whitelist and minimum length (-> the first ``cap``
  accepted passages in collection order, when given); pairs in echo style.
* ``crawl`` - stored pages ``pages`` (page_id, html) -> main text ->
  cleanup -> paragraphs (-> the first ``cap`` per page, when given); pairs in quoted style.
* ``abstracts`` - abstracts JSONL {title, abstract, source, license};
  pairs in commentary style.
* ``described`` - stored pages -> page title and description (meta tag,
  else the description paragraph; kept when longer than 40) ->
  question from the title, answer from the description (summary style).

All sources take ``license``, ``attribution`` and ``modality``. ``selected``,
``crawl`` and ``described`` are page sources: those chosen together share one
scan and one parse (``sources.pages``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.operators.filters import subset_contains
from corpusmill.sources import pages
from corpusmill.sources.jsonl import scan_abstracts
from corpusmill.sources.registry import page_source, register, register_pages
from corpusmill.sources.tables import read_table, scan_passages


def provenance(df: DataFrame, license: str | None = None, attribution: str | None = None,
               modality: str | None = None) -> DataFrame:
    """Licence, attribution and modality of a source as columns of its passages (those that are given)."""
    for name, value in (("license", license), ("attribution", attribution), ("modality", modality)):
        if value is not None:
            df = df.withColumn(name, F.lit(value))
    return df


@register("documents", pair_style="echo")
def documents(spark, data_dir: str, **origin):
    docs = read_table(spark, data_dir, "documents", ["doc_id", "text", "lang", "source"])
    p = scan_passages(docs).select("source", "text_id", "language", "content",
                                   F.col("text_id").cast("bigint").alias("doc_ord"), F.lit(0).alias("pos"))
    return provenance(p, **origin)


@register("titled", pair_style="commentary")
def titled(spark, data_dir: str, subset: str | None = None, **origin):
    docs = read_table(spark, data_dir, "documents", ["doc_id", "text", "lang", "source"])
    p = subset_contains(scan_passages(docs), "title", subset)
    return provenance(p.select("source", "text_id", "language", "content", "title",
                               F.col("text_id").cast("bigint").alias("doc_ord"), F.lit(0).alias("pos")), **origin)


register_pages("crawl", pair_style="quoted")(pages.crawl_source)
register_pages("selected", pair_style="echo", total="cap")(pages.selected_source)
register_pages("described", pair_style="summary", total="cap")(pages.described_source)


def selected(spark, data_dir: str, **params):
    """The ``selected`` source alone; with ``cap`` its first passages in collection order."""
    return page_source(spark, "selected", data_dir, **params).drop("source_rank", "title")


@register("abstracts", pair_style="commentary")
def abstracts(spark, path: str, **origin):
    """``ord`` comes from a 56-bit hash of all fields (36 bits as document
    ordinal, 20 as position): equal abstracts share it and are one row to the
    first-wins rule, different ones with one title do not."""
    a = scan_abstracts(spark, path).dropDuplicates(["source", "text_id", "content", "title", "license", "attribution"])
    h = F.xxhash64("title", "content", "license", "attribution")
    return provenance(a.select("source", "text_id", "language", "content", "title", "license", "attribution",
                               F.shiftrightunsigned(h, 28).alias("doc_ord"),
                               F.pmod(F.shiftrightunsigned(h, 8), F.lit(1 << 20)).alias("pos")), **origin)
