"""Source plug-ins (E1) and source selection in order.

A source is a builder ``(spark, **params) -> DataFrame`` returning passages
with at least the string columns of ``PASSAGE_FIELDS``. Builders are lazy:
a source that is not chosen never enters the plan. Chosen sources are
unioned in the given order; each carries ``source_rank`` (its position),
which feeds ``ord`` so that first-wins rules see the collection order.
"""

from __future__ import annotations

import logging
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.operators.combine import cap_total, union_sources
from corpusmill.sources.pages import PageSource, read_pages
from corpusmill.sources.tables import make_ord

log = logging.getLogger(__name__)

PASSAGE_FIELDS = ("source", "text_id", "language", "content")

Builder = Callable[..., DataFrame]
_REGISTRY: dict[str, Builder] = {}
_PAGES: dict[str, tuple[Callable[..., PageSource], str | None]] = {}
_STYLE: dict[str, str] = {}


def register(name: str, pair_style: str = "echo"):
    """Decorator: add a builder to the registry under ``name``; ``pair_style``
    is how its passages become instruction pairs (echo, quoted, commentary)."""
    def deco(fn: Builder) -> Builder:
        _REGISTRY[name] = fn
        _STYLE[name] = pair_style
        return fn
    return deco


def register_pages(name: str, pair_style: str = "echo", total: str | None = None):
    """Decorator: add a page source; chosen page sources of one folder share
    one scan and one parse. ``total`` names the parameter, if any, that keeps
    the first passages of the whole source; with it the source is read alone."""
    def deco(make: Callable[..., PageSource]):
        _PAGES[name] = (make, total)
        _REGISTRY[name] = lambda spark, **params: page_source(spark, name, **params).drop("source_rank")
        _STYLE[name] = pair_style
        return make
    return deco


def page_source(spark: SparkSession, name: str, data_dir: str, **params) -> DataFrame:
    """One page source by itself."""
    make, total = _PAGES[name]
    n = params.pop(total, None) if total else None
    df = read_pages(spark, data_dir, [(0, make(**params))])
    if n is None:
        return df
    # the first passages in collection order: a top-n, not a global sort
    return cap_total(df.withColumn("_ord", make_ord(F.lit(0), "doc_ord", "pos")), n, "_ord").drop("_ord")


def _shared(name: str, params: dict) -> bool:
    return name in _PAGES and "data_dir" in params and params.get(_PAGES[name][1]) is None


def pair_style(name: str) -> str:
    return _STYLE.get(name, "echo")


def registered() -> list[str]:
    return list(_REGISTRY)


def check_passages(df: DataFrame, name: str) -> DataFrame:
    """Fail early when a builder does not return the passage schema."""
    types = {f.name: f.dataType for f in df.schema.fields}
    missing = [c for c in PASSAGE_FIELDS if c not in types]
    wrong = [c for c in PASSAGE_FIELDS if c in types and not isinstance(types[c], T.StringType)]
    if missing or wrong:
        raise ValueError(f"source {name!r}: missing {missing}, non-string {wrong}")
    return df


def chosen_builders(chosen: list[str]) -> list[str]:
    """Known names in the given order, each once; unknown names are logged
    and skipped (an empty list when none is known)."""
    keep = []
    for name in dict.fromkeys(chosen):
        if name in _REGISTRY:
            keep.append(name)
        else:
            log.warning("unknown source %r - skipped", name)
    return keep


def source_units(spark: SparkSession, chosen: list[str], params: dict | None = None,
                 to_pairs: Callable[[DataFrame, "str | dict[int, str]"], DataFrame] | None = None) -> list[tuple[str, Callable[[], DataFrame]]]:
    """(name, builder) of what is read together: a source by itself, or the
    chosen page sources of one folder (names joined by ``+``). With ``to_pairs``
    passages are turned into pairs with their source's pair style
    (``to_pairs(df, style)``; for page sources that share one frame, style maps ranks to styles)."""
    params = params or {}
    names = chosen_builders(chosen)
    if not names:
        raise ValueError(f"none of the sources {chosen} is registered")

    def alone(rank, name):
        def build():
            df = check_passages(_REGISTRY[name](spark, **params.get(name, {})), name)
            df = df.withColumn("source_rank", F.lit(rank))
            return to_pairs(df, pair_style(name)) if to_pairs else df
        return build

    def together(data_dir, ranked):
        def build():
            made = [(rank, _PAGES[name][0](**{k: v for k, v in params[name].items() if k not in ("data_dir", _PAGES[name][1])}))
                    for rank, name in ranked]
            df = read_pages(spark, data_dir, made)
            return to_pairs(df, {rank: pair_style(name) for rank, name in ranked}) if to_pairs else df
        return build

    units, shared = [], {}
    for rank, name in enumerate(names):
        own = params.get(name, {})
        if _shared(name, own):
            shared.setdefault(own["data_dir"], []).append((rank, name))
        else:
            units.append((name, alone(rank, name)))
    return units + [("+".join(n for _, n in ranked), together(d, ranked)) for d, ranked in shared.items()]


def build_sources(spark: SparkSession, chosen: list[str], params: dict | None = None, to_pairs=None) -> DataFrame:
    """Union of the chosen sources in order, each with its ``source_rank``, or
    of their pairs (see ``source_units``)."""
    return union_sources([build() for _, build in source_units(spark, chosen, params, to_pairs)])
