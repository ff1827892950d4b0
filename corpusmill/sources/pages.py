"""Sources over stored pages, read together.

A page source says what it takes from a parsed page (``read``, inside the
parser's task) and how such an item becomes passages (``rows``, a column
expression). All chosen page sources of one folder share one scan of
``pages``, one parse of every page and one Python node: the parser's rows
carry their source's rank, and one projection turns each row into the
passages of its source.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions.constants import CJK_CLASS, PASSAGE_SELECTORS
from corpusmill.functions.text import whole_match
from corpusmill.operators.clean import CLEANERS, paragraphs
from corpusmill.session import small_batches
from corpusmill.sources import html as H
from corpusmill.sources.tables import read_table

# what a parsed page gives: (position, title or None, text)
Items = Iterator[tuple[int, "str | None", str]]
# (position, title, text, page id) columns -> array of (pos, title, content)
Rows = Callable[[Column, Column, Column, Column], Column]
ORIGIN = ("license", "attribution", "modality")


@dataclass(frozen=True)
class PageSource:
    name: str
    read: Callable[[object], Items]
    rows: Rows
    language: str = "english"
    positions: bool = True               # the text id names the position, too
    origin: dict = field(default_factory=dict)


def _one(pos: Column, title: Column, content: Column) -> Column:
    return F.array(F.struct(pos.cast("int").alias("pos"), title.cast("string").alias("title"), content.alias("content")))


def crawl_source(name: str = "crawl", separator: str = "\n", style: str = "parens", para_sep: str = "\n", min_len: int = 30,
                 cap: int | None = None, main_tag: str = "div", main_class: str = "main", **origin) -> PageSource:
    """Main text -> cleanup -> paragraphs (-> the first ``cap`` of the page)."""
    def read(doc) -> Items:
        main = H.main_node(doc, main_tag, main_class)
        if main is not None:
            yield 0, None, H.get_text(main, separator, True)

    def rows(pos, title, text, page):
        label = F.concat(F.lit("Page "), page.cast("string"))
        return F.transform(paragraphs(CLEANERS[style](text), para_sep, min_len, cap),
                           lambda p: F.struct(p["pos"].cast("int").alias("pos"), label.alias("title"), p["paragraph"].alias("content")))
    return PageSource(name, read, rows, origin=origin)


def selected_source(name: str = "selected", selectors: str = PASSAGE_SELECTORS, char_class: str = CJK_CLASS, min_len: int = 21,
                    language: str = "classical", **origin) -> PageSource:
    """Elements that match the selectors -> script whitelist and minimum length."""
    def read(doc) -> Items:
        for pos, node in enumerate(H.select(doc, selectors)):
            yield pos, None, H.get_text(node)

    def rows(pos, title, text, page):
        kept = (F.length(text) >= min_len) & whole_match(text, char_class)
        return F.when(kept, _one(pos, title, text))
    return PageSource(name, read, rows, language, origin=origin)


def described_source(name: str = "described", min_len: int | None = 40, language: str = "english", **origin) -> PageSource:
    """Page title and description (meta tag, else the description paragraph)."""
    def read(doc) -> Items:
        meta, para = H.descriptions(doc)
        text = meta or para
        if text:
            title = H.find(doc, "title")
            yield 0, H.get_text(title) if title is not None else "", text

    def rows(pos, title, text, page):
        return _one(pos, title, text) if min_len is None else F.when(F.length(text) > min_len, _one(pos, title, text))
    return PageSource(name, read, rows, language, positions=False, origin=origin)


def parsed_items(pages: DataFrame, sources: list[tuple[int, PageSource]]) -> DataFrame:
    """(rank, page_id, pos, title, body): each page parsed once for all sources.
    A page that cannot be read by a source gives one row with the error as
    body and a negative pos for it. Rows leave in batches of bounded size."""
    readers = [(rank, s.read) for rank, s in sources]
    schema = pa.schema([("rank", pa.int32()), ("page_id", pa.int64()), ("pos", pa.int32()), ("title", pa.string()), ("body", pa.string())])

    def items(html):
        try:
            doc = H.parse(html)
        except Exception as e:  # noqa: BLE001  (one bad page must not fail the task)
            for rank, _ in readers:
                yield rank, -1, None, f"{type(e).__name__}: {e}"[:500]
            return
        for rank, read in readers:
            try:
                for item in read(doc):
                    yield rank, *item
            except Exception as e:  # noqa: BLE001
                yield rank, -1, None, f"{type(e).__name__}: {e}"[:500]

    def work(batches):
        rows, held = [], 0

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(list(c), k.type) for c, k in zip(zip(*rows), schema)], schema=schema)
        for b in batches:
            for page, html in zip(b.column("page_id").to_pylist(), b.column("html")):
                if not html.is_valid:
                    continue
                for rank, pos, title, body in items(html.as_py()):
                    rows.append((rank, page, pos, title, body))
                    held += len(body) + 64
                    if held > H.PASSAGE_CHARS:
                        yield flush()
                        rows, held = [], 0
        if rows:
            yield flush()

    small_batches(pages.sparkSession)
    return pages.select("page_id", "html").mapInArrow(work, "rank int, page_id bigint, pos int, title string, body string")


def read_pages(spark: SparkSession, data_dir: str, sources: list[tuple[int, PageSource]]) -> DataFrame:
    """Passages of all ``sources`` ((rank, source) pairs) with ``source_rank``:
    one scan of the pages, one parse. Pages in error are left out."""
    items = parsed_items(read_table(spark, data_dir, "pages", ["page_id", "html"]), sources)
    rank, page = F.col("rank"), F.col("page_id")

    def by_rank(value: Callable[[PageSource], Column]) -> Column:
        out = None
        for r, s in sources:
            out = F.when(rank == r, value(s)) if out is None else out.when(rank == r, value(s))
        return out

    passages = by_rank(lambda s: s.rows(F.col("pos"), F.col("title"), F.col("body"), page))
    out = items.where("pos >= 0").select(rank, page, F.inline(passages))
    number = page.cast("string")
    text_id = by_rank(lambda s: F.concat(number, F.lit("-"), F.col("pos").cast("string")) if s.positions else number)
    given = [c for c in ORIGIN if any(s.origin.get(c) is not None for _, s in sources)]
    unknown = {k for _, s in sources for k in s.origin} - set(ORIGIN)
    if unknown:
        raise TypeError(f"unknown source parameters: {sorted(unknown)}")
    return out.select(by_rank(lambda s: F.lit(s.name)).alias("source"), text_id.alias("text_id"),
                      by_rank(lambda s: F.lit(s.language)).alias("language"), "content", "title",
                      *[by_rank(lambda s: F.lit(s.origin.get(c)).cast("string")).alias(c) for c in given],
                      page.alias("doc_ord"), "pos", rank.alias("source_rank"))
