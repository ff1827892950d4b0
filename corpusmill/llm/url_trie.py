"""URL filters: a trie over reversed host labels and path segments.

``judge_urls`` looks every url up in the trie; of the rules that fit, the
deepest host wins, then the longest path; of two rules with the same host and
path, block wins. Urls without a fitting rule get the default verdict.

Nulls: a null url, or one without ``://``, has host and path ''. It can fit
only a rule whose host and path are both empty. Repeated rows give repeated
results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import pick

ALLOW, BLOCK = "allow", "block"
TRIE_BYTES = 32 << 20          # rule text that the trie, sent to every task, may hold
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


def rule(verdict: str, text: str) -> Rule:
    """Rule from 'host/path': the path starts at the first slash."""
    host, slash, path = text.partition("/")
    if verdict not in (ALLOW, BLOCK):
        raise ValueError(verdict)
    return Rule(host.translate(str.maketrans(_UPPER, _LOWER)), slash + path, verdict)


class _Paths:
    """Path trie: whole segments as edges; ``tails`` holds rules whose last,
    unfinished segment is a prefix of the url's next segment."""

    __slots__ = ("edges", "tails", "longest")

    def __init__(self):
        self.edges, self.tails, self.longest = {}, {}, 0

    def add(self, r: Rule):
        node, (*whole, tail) = self, r.path.split("/")
        for seg in whole:
            node = node.edges.setdefault(seg, _Paths())
        old = node.tails.get(tail)
        if old is None or r.verdict == BLOCK:
            node.tails[tail] = r
        node.longest = max(node.longest, len(tail))

    def longest_match(self, path: str) -> Rule | None:
        node, best, at = self, None, 0
        while node is not None:
            cut = path.find("/", at)
            seg = path[at:] if cut < 0 else path[at:cut]
            # a rule's tail may not reach past this segment, a whole segment must end in a slash
            for k in range(min(node.longest, len(seg)), -1, -1):
                if seg[:k] in node.tails:
                    best = node.tails[seg[:k]]
                    break
            node, at = (node.edges.get(seg), cut + 1) if cut >= 0 else (None, at)
        return best


class UrlTrie:
    def __init__(self, rules: Iterable[Rule]):
        self.root: dict = {}
        self.size = 0
        for r in rules:
            node = self.root
            for label in reversed(r.host.split(".")) if r.host else ():
                node = node.setdefault(label, {})
            node.setdefault(None, _Paths()).add(r)
            self.size += len(r.name)

    def match(self, host: str, path: str) -> Rule | None:
        node, best = self.root, None
        for label in (*reversed(host.split(".")), None) if host else (None,):
            if None in node:
                best = node[None].longest_match(path) or best
            node = node.get(label) if label is not None else None
            if node is None:
                break
        return best


def split_url(url: str):
    """(host, path) columns: host after the first '://' up to '/', '?', '#' or
    the end, A-Z lower-cased; path from there up to '?', '#' or the end."""
    u = F.coalesce(F.col(url), F.lit(""))
    cut = F.instr(u, "://")
    rest = F.when(cut > 0, F.substring(u, cut + 3, F.length(u))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), path


def judge_urls(pages: DataFrame, rules: Sequence[Rule], *, page_id: str = "page_id", url: str = "url",
               default: str = ALLOW) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict.

    The trie travels in the tasks' closure behind a check of its size
    (TRIE_BYTES of rule text); a larger rule list must come as a table, see
    ``judge_urls_by_join``.
    """
    trie = UrlTrie(rules)
    if trie.size > TRIE_BYTES:
        spark = pages.sparkSession
        table = spark.createDataFrame([(r.host, r.path, r.verdict) for r in rules], "host string, path string, verdict string")
        return judge_urls_by_join(pages, table, page_id=page_id, url=url, default=default)
    host, path = split_url("url")
    parsed = pick(pages, page_id=(page_id, "long"), url=(url, "string")).select("page_id", host.alias("host"), path.alias("path"))
    held = pages.sparkSession.sparkContext.broadcast(trie)

    def look_up(batches):
        found = held.value
        for b in batches:
            hit = [found.match(h, p) for h, p in zip(b["host"].to_pylist(), b["path"].to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array([r.name if r else None for r in hit], pa.string()),
                 pa.array([r.verdict if r else default for r in hit], pa.string())],
                ["page_id", "host", "path", "rule", "verdict"])

    return parsed.mapInArrow(look_up, "page_id long, host string, path string, rule string, verdict string")


def judge_urls_by_join(pages: DataFrame, rules: DataFrame, *, page_id: str = "page_id", url: str = "url",
                       default: str = ALLOW) -> DataFrame:
    """The same verdicts for rule tables of any size: each distinct (host,
    path) is joined on its host suffixes and on the paths' whole segments, the
    longest fitting rule wins. No broadcast."""
    host, path = split_url("url")
    parsed = pick(pages, page_id=(page_id, "long"), url=(url, "string")).select("page_id", host.alias("host"), path.alias("path"))
    asked = parsed.select("host", "path").distinct()

    def stems(p):          # '' and every prefix that ends in a slash
        segs = F.split(p, "/")
        return F.transform(F.sequence(F.lit(0), F.size(segs) - 1),
                           lambda k: F.when(k == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice(segs, 1, k), "/"), F.lit("/"))))

    labels = F.split("host", r"\.")
    tails = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    keys = asked.select("host", "path", F.explode(F.array_distinct(F.concat(tails, F.array(F.lit(""))))).alias("r_host"),
                        stems(F.col("path")).alias("stems")).select("host", "path", "r_host", F.explode("stems").alias("r_stem"))
    listed = rules.select(F.translate("host", _UPPER, _LOWER).alias("r_host"), F.col("path").alias("r_path"),
                          F.col("verdict").alias("r_verdict"), F.element_at(stems(F.col("path")), -1).alias("r_stem"))
    best = (keys.join(listed, ["r_host", "r_stem"]).where(F.expr("startswith(path, r_path)"))
            .groupBy("host", "path").agg(F.max(F.struct(F.length("r_host").alias("n"), F.length("r_path").alias("m"), "r_verdict",
                                                        F.concat("r_host", "r_path").alias("rule"))).alias("x")))
    return (parsed.join(best, ["host", "path"], "left")
            .select("page_id", "host", "path", F.col("x.rule").alias("rule"),
                    F.coalesce("x.r_verdict", F.lit(default)).alias("verdict")))
