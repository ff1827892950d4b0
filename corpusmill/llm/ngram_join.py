"""N-gram Jaccard self-join by a token-group matrix.

A document's set holds its distinct word 5-grams as 64-bit hashes, in one
global order. Documents with equal sets are one node. Two sets with
Jaccard >= t share, in the first n - ceil(t n) + l(n) tokens of either, at
least l(ceil(t n)) tokens (prefix principle with an l-fold overlap); prefixes
and counts below use this, so nothing that links is lost:

1. Tokens of prefixes that only one node has are dropped, then nodes with too
   few shared tokens left (they cannot link).
2. Similar nodes are partitioned into groups: each takes its most frequent
   shared prefix token as group key, which near copies have in common.
3. The token-group matrix holds each group's token union (token, group). A
   node's overlap with a group's union bounds its overlap with any member; only
   groups whose bound reaches l are opened.
4. In an opened group the whole sets are compared exactly. Large groups are
   compared in blocks of bounded token numbers.

Links lead to classes by connected components. Nulls: a null or blank text has
an empty set (n_shingles 0) and links with nothing; a row with a null doc_id
gets component_id null and links with nothing. Rows that repeat a doc_id give
repeated rows. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import (WORD_CODE, batch_words, components, drop, mix, numbers, pick, pieces, quoted, shingle_hashes,
                                   text_buffer, written)

WIDTH = 5
PERCENT = 80
SHARE = 8                 # l(n): per cent of a set that two prefixes must share
BLOCK_TOKENS = 1 << 20    # most tokens of either side of a blocked comparison


def sets_of(buf, off, width: int = WIDTH):
    """(text index, sorted distinct shingle hashes) of each text that has words."""
    for i, j, _, _, h, owner in batch_words(buf, off):
        sh, first = shingle_hashes(h, owner, width)
        words = np.searchsorted(owner, np.arange(i, j + 1))
        cuts = np.searchsorted(first, words)
        for k in range(j - i):
            n = words[k + 1] - words[k]
            if n >= width:
                s = np.sort(sh[cuts[k]:cuts[k + 1]])
                yield i + k, s[np.concatenate(([True], s[1:] != s[:-1]))]
            elif n:
                own = h[words[k]:words[k + 1]]
                yield i + k, mix(mix((own * WORD_CODE[10:10 + n]).sum(keepdims=True)) + WORD_CODE[20 + n])


def node_of(tokens: np.ndarray) -> int:
    """64-bit name of a set (of distinct sorted tokens)."""
    total = mix(tokens ^ WORD_CODE[40]).sum(keepdims=True) + np.full(1, len(tokens), np.uint64) * WORD_CODE[41]
    return int(mix(total).view(np.int64)[0])


def _least(n, percent):            # ceil(t n), in numpy
    return (percent * n + 99) // 100


def _share(n):                     # l(n)
    return np.maximum(1, (SHARE * n + 99) // 100)


def prefix_length(n, percent: int = PERCENT):
    return np.minimum(n, n - _least(n, percent) + _share(n))


def _needed(n: str, percent: int):
    """l(ceil(t n)) as a column."""
    return F.expr(f"greatest(1, ({SHARE} * (({percent} * {n} + 99) div 100) + 99) div 100)")


def document_sets(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n, node, prefix) per row; node is null for empty sets."""

    def work(batches):
        for b in pieces(batches):
            buf, off = text_buffer(b["text"])
            n, node, cut, toks = np.zeros(b.num_rows, np.int32), np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64), []
            for i, s in sets_of(buf, off, width):
                n[i], node[i] = len(s), node_of(s)
                cut[i] = prefix_length(len(s), percent)
                toks.append(s[:cut[i]].view(np.int64))
            off = pa.array(np.concatenate(([0], np.cumsum(cut))).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [b["doc_id"], pa.array(n), pa.array(node, mask=n == 0),
                 pa.ListArray.from_arrays(off, pa.array(np.concatenate(toks) if toks else np.zeros(0, np.int64)))],
                ["doc_id", "n", "node", "prefix"])

    return docs.mapInArrow(work, "doc_id long, n int, node long, prefix array<long>")


def _shared(batches):
    """Of rows sorted by (token, node): the distinct ones whose token has two
    nodes at least. Streams; holds one row between batches."""
    held, held_shared = None, False
    for b in batches:
        tok, node, n = (numbers(b[c]) for c in ("token", "node", "n"))
        if not len(tok):
            continue
        prior = held is not None
        if prior:
            tok, node, n = (np.concatenate(([x], y)) for x, y in zip(held, (tok, node, n)))
        new = np.concatenate(([True], (tok[1:] != tok[:-1]) | (node[1:] != node[:-1])))
        tok, node, n = tok[new], node[new], n[new]
        same = tok[1:] == tok[:-1]
        shared = np.concatenate(([prior and held_shared], same)) | np.concatenate((same, [False]))
        held, held_shared = (tok[-1], node[-1], n[-1]), bool(shared[-1])
        out = np.flatnonzero(shared[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(tok[out]), pa.array(node[out]), pa.array(n[out])], ["token", "node", "n"])
    if held is not None and held_shared:
        yield pa.RecordBatch.from_arrays([pa.array([held[0]]), pa.array([held[1]]), pa.array([held[2]], pa.int32())], ["token", "node", "n"])


def compare_block(nodes, is_query, is_member, off, tokens, percent: int):
    """Spanning links (node, smallest node of its class here) by exact Jaccard
    between the queries and the members of a block."""
    n = np.diff(off)
    _, name = np.unique(tokens, return_inverse=True)
    row = np.repeat(np.arange(len(nodes)), n)
    keep = is_member[row]
    order = np.argsort(name[keep], kind="stable")
    listed, who = name[keep][order], row[keep][order]
    start = np.searchsorted(listed, np.arange(name.max() + 2 if len(name) else 1))
    group = np.arange(len(nodes))
    members = np.flatnonzero(is_member)
    for q in np.flatnonzero(is_query):
        if (group[members] == group[q]).all():
            continue
        own = name[off[q]:off[q + 1]]
        lo, hi = start[own], start[own + 1]
        many = hi - lo
        at = np.repeat(lo - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(many.sum())
        both = np.bincount(who[at], minlength=len(nodes))
        hit = np.flatnonzero(100 * both >= percent * (n[q] + n - both))
        hit = hit[both[hit] > 0]
        met = np.unique(np.append(group[hit], group[q]))
        if len(met) > 1:
            group[np.isin(group, met)] = met[0]
    low = np.full(len(nodes), np.iinfo(np.int64).max)
    np.minimum.at(low, group, nodes)
    low = low[group]
    linked = low != nodes
    return nodes[linked], low[linked]


def _open_groups(table: pa.Table, percent: int) -> pa.Table:
    tokens = table["tokens"].combine_chunks()
    tokens = tokens.chunk(0) if isinstance(tokens, pa.ChunkedArray) else tokens
    off = np.concatenate(([0], np.cumsum(numbers(table["n"]).astype(np.int64))))
    a, b = compare_block(numbers(table["node"]), numbers(table["is_query"]), numbers(table["is_member"]),
                         off, tokens.flatten().to_numpy(), percent)
    return pa.table({"a": a, "b": b})


def _whole_sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(node, tokens) of the wanted (doc_id, node): reads their whole texts again."""
    rows = docs.join(wanted.select("doc_id", F.col("node").alias("asked")), "doc_id")

    def work(batches):
        for b in pieces(batches):
            buf, off = text_buffer(b["text"])
            asked, node, cut, toks = numbers(b["asked"]), [], [0], []
            for i, s in sets_of(buf, off, width):
                if node_of(s) == asked[i]:            # rows that repeat a doc_id with another text fall out
                    node.append(asked[i])
                    cut.append(cut[-1] + len(s))
                    toks.append(s.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(node, pa.int64()), pa.ListArray.from_arrays(
                    pa.array(cut, pa.int32()), pa.array(np.concatenate(toks) if toks else np.zeros(0, np.int64)))],
                ["node", "tokens"])

    return rows.mapInArrow(work, "node long, tokens array<long>").dropDuplicates(["node"])


def set_links(docs: DataFrame, sets: DataFrame, *, width: int = WIDTH, percent: int = PERCENT,
              block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Links (a, b) between nodes that connect the same nodes as all pairs of
    sets with Jaccard >= percent / 100 do. docs (doc_id, text); sets from document_sets()."""
    usable = sets.where("node is not null and doc_id is not null")
    postings = usable.select(F.explode("prefix").alias("token"), "node", "n")
    shared = written(postings.repartition("token").sortWithinPartitions("token", "node")
                     .mapInArrow(_shared, "token long, node long, n int"), "shared-tokens")
    alive = shared.groupBy("node").agg(F.count("*").alias("c"), F.first("n").alias("n")) \
        .where(F.col("c") >= _needed("n", percent)).select("node")
    left = shared.join(alive, "node")
    df = left.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    left = written(left.join(df, "token"), "live-tokens")
    drop(shared)
    keys = left.groupBy("node", "n").agg(F.count("*").alias("c"), F.max(F.struct("df", "token")).alias("best")) \
        .where(F.col("c") >= _needed("n", percent)).select("node", F.col("best.token").alias("own"))
    keys = written(keys, "group-keys")
    live = left.join(keys, "node")
    matrix = live.select("token", F.col("own").alias("grp")).distinct()
    opened = (live.join(matrix, "token").where("own <= grp").groupBy("node", "n", "own", "grp")
              .agg(F.count("*").alias("c")).where(F.col("c") >= _needed("n", percent)).select("node", "n", "own", "grp"))
    opened = written(opened, "open-groups")
    drop(left)
    sizes = opened.groupBy("grp").agg(
        F.ceil(F.sum("n") / block_tokens).cast("int").alias("qbs"),
        F.ceil(F.sum(F.when(F.col("own") == F.col("grp"), F.col("n"))) / block_tokens).cast("int").alias("mbs"),
        F.count("*").alias("rows")).where("rows > 1 and mbs > 0").drop("rows")
    spot = lambda seed, k: F.pmod(F.xxhash64(F.lit(seed), "node"), F.col(k)).cast("int")
    placed = (opened.join(sizes, "grp").withColumn("qb", spot(1, "qbs")).withColumn("mb", spot(2, "mbs"))
              .withColumn("as_query", F.expr("transform(sequence(0, mbs - 1), x -> struct(qb as q, x as m))"))
              .withColumn("as_member", F.expr("if(own = grp, transform(sequence(0, qbs - 1), x -> struct(x as q, mb as m)), "
                                              "cast(array() as array<struct<q: int, m: int>>))"))
              .withColumn("at", F.explode(F.array_union("as_query", "as_member")))
              .select("grp", "node", "n", "at.q", "at.m", (F.col("at.q") == F.col("qb")).alias("is_query"),
                      ((F.col("own") == F.col("grp")) & (F.col("at.m") == F.col("mb"))).alias("is_member")))
    reps = usable.groupBy("node").agg(F.min("doc_id").alias("doc_id")).join(opened.select("node").distinct(), "node")
    whole = _whole_sets(docs, reps, width)
    rows = placed.join(whole, "node").select("grp", "q", "m", "node", "n", "is_query", "is_member", "tokens")
    links = rows.groupBy("grp", "q", "m").applyInArrow(lambda t: _open_groups(t, percent), "a long, b long")
    return links


def jaccard_classes(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH,
                    percent: int = PERCENT, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id
    reachable by links, itself included), n_copies (rows with the same set)."""
    src = pick(docs, doc_id=(doc_id, "long"), text=(text, "string"))
    sets = written(document_sets(src, width, percent), "shingle-sets")
    roots = components(set_links(src, sets, width=width, percent=percent, block_tokens=block_tokens))
    nodes = sets.where("node is not null and doc_id is not null").groupBy("node") \
        .agg(F.min("doc_id").alias("rep"), F.count("*").alias("n_copies"))
    nodes = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    first = nodes.groupBy("root").agg(F.min("rep").alias("component"))
    named = nodes.join(first, "root").select("node", "component", "n_copies")
    return (sets.select("doc_id", "n", "node").join(named, "node", "left")
            .select("doc_id", F.col("n").cast("long").alias("n_shingles"),
                    F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"),
                    F.when(F.col("doc_id").isNotNull(), F.coalesce("n_copies", F.lit(1))).alias("n_copies")))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: of each class the document with the smallest doc_id stays."""
    gone = jaccard_classes(docs).where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*[quoted(c) for c in docs.columns])
