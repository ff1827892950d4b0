"""Prefix trie of conversations, rolled up by centroid decomposition.

1. Turns get their position by a range sort of (conv_id, turn, digest) and the
   counts of the sorted partitions, so no conversation is held or sorted by
   one task.
2. A rebuilt conversation's prefixes are named by SHA-256 chains over runs of
   ``run`` turns; a long conversation's runs are chained the same way one
   level up. A prefix is a trie node, known from then on as (conv_id of its
   smallest member, depth); its parent is that member's prefix one turn
   shorter.
3. Centroid decomposition of the parent-edge forest. The weight of a node is
   its number of members. A component's centroid is the deepest node that has
   half of the component's weight below or at it. Removing it leaves the part
   above and one component per child, each of at most half the weight; the
   totals of the centroid and all below it (in the component) are added to
   every node on the path from the centroid to the component's top. After
   O(log weight) rounds each node has the total of its subtree. Components of
   more than ``most`` nodes are split by joins, all of one round together; the
   others, of bounded size, are finished inside tasks by the same steps.
4. The digest of the conversations that end at a node is fed chunk by chunk
   in id order; a task holds one chunk of ids.

Defined results. Null role or text: empty. Null turns come first; equal turns
are ordered by the SHA-256 of (role, text). Rows without conv_id take no part.
``c % 5`` keeps the sign, as in SQL. Repeated rows are turns of their own. An
empty table gives an empty result (no root without members). Extra columns are
ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm.common import drop, pick, shuffle_partitions, written

HEAD = 9                 # h is below this
BASE = 5                 # conversation c starts as conversation c - c % BASE
RUN = 1024               # turns of a hashed run
MOST = 8_192             # nodes of a component that a task finishes
CHUNK = 50_000           # ids of a chunk of one node's digest
SALT = 4_096             # turns of a conversation that share a join key


# ---------------------------------------------------------------- turns
def ordered_turns(conversations: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
                  text: str = "text") -> DataFrame:
    """(conv_id, pos, token, bytes): pos counts a conversation's turns from 0;
    token is the SHA-256 of (role, text), bytes the text's UTF-8 length."""
    src = pick(conversations, conv_id=(conv_id, "long"), turn=(turn, "long"), role=(role, "string"), text=(text, "string"))
    role_, text_ = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = src.where("conv_id is not null").select(
        "conv_id", "turn", F.unhex(F.sha2(F.concat(F.octet_length(role_).cast("string"), F.lit(":"), role_, text_), 256)).alias("token"),
        F.octet_length(text_).cast("long").alias("bytes"))
    parts = shuffle_partitions(rows.sparkSession)
    rows = rows.repartitionByRange(parts, "conv_id", "turn", "token").sortWithinPartitions("conv_id", "turn", "token")

    def count(batches):
        last, n = None, 0
        for b in batches:
            at = []
            for c in b["conv_id"].to_pylist():
                n = n + 1 if c == last else 0
                last = c
                at.append(n)
            yield pa.RecordBatch.from_arrays([b["conv_id"], b["part"], pa.array(at, pa.int64()), b["token"], b["bytes"]],
                                             ["conv_id", "part", "local", "token", "bytes"])

    rows = written(rows.select("conv_id", F.spark_partition_id().alias("part"), "token", "bytes")
                   .mapInArrow(count, "conv_id long, part int, local long, token binary, bytes long"), "trie-turns")
    sizes = rows.groupBy("conv_id", "part").agg((F.max("local") + 1).alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    # a sorted partition begins inside at most one conversation: as many rows as partitions at most
    later = sizes.withColumn("before", before).where("before is not null").select("conv_id", "part", "before")
    return rows.join(F.broadcast(later), ["conv_id", "part"], "left") \
        .select("conv_id", (F.col("local") + F.coalesce("before", F.lit(0))).alias("pos"), "token", "bytes")


def rebuilt(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, token, bytes, n): the rebuilt conversations' turns, n the
    rebuilt length; a conversation without turns is one row with pos -1."""
    heads = (turns.where((F.col("conv_id") % BASE == 0) & (F.col("pos") < HEAD - 1))
             .groupBy(F.col("conv_id").alias("base"))
             .agg(F.array_sort(F.collect_list(F.struct("pos", "token", "bytes"))).alias("head")))      # HEAD - 1 turns at most
    convs = (turns.groupBy("conv_id").agg(F.count("*").alias("own"))
             .withColumn("h", F.crc32(F.col("conv_id").cast("string")) % HEAD)
             .withColumn("base", F.col("conv_id") - F.col("conv_id") % BASE)
             .join(heads, "base", "left")
             .withColumn("kept", F.expr("slice(coalesce(head, array()), 1, int(h))"))
             .withColumn("k", F.size("kept"))
             .withColumn("n", F.col("k") + F.greatest(F.col("own") - F.col("h"), F.lit(0)))
             .select("conv_id", "own", "h", "kept", "k", "n"))
    convs = written(convs, "trie-convs")
    first = convs.select("conv_id", F.posexplode("kept").alias("pos", "t"), "n") \
        .select("conv_id", F.col("pos").cast("long").alias("pos"), "t.token", "t.bytes", "n")
    none = convs.where("n = 0").select("conv_id", F.lit(-1).cast("long").alias("pos"), F.lit(None).cast("binary").alias("token"),
                                       F.lit(0).cast("long").alias("bytes"), "n")
    blocks = convs.where("own > h").select(                      # SALT turns of a conversation share a key
        "conv_id", "h", "k", "n", F.explode(F.expr(f"sequence(0L, (own - 1) div {SALT})")).alias("block"))
    own = (turns.withColumn("block", F.expr(f"pos div {SALT}")).join(blocks, ["conv_id", "block"])
           .where(F.col("pos") >= F.col("h"))
           .select("conv_id", (F.col("pos") - F.col("h") + F.col("k")).alias("pos"), "token", "bytes", "n"))
    return first.unionByName(own).unionByName(none)


# ---------------------------------------------------------------- names of prefixes
def prefix_names(rows: DataFrame, run: int = RUN) -> DataFrame:
    """rows (conv_id, pos, token): (conv_id, pos, name, above); name is equal for
    equal sequences of tokens 0..pos only, above is the name at pos - 1 (null
    at pos 0). No task holds more than one run of a conversation."""
    parts = shuffle_partitions(rows.sparkSession)

    def chain(batches):
        key, digest = None, b""
        for b in batches:
            names, befores = [], []
            for c, p, t in zip(b["conv_id"].to_pylist(), b["pos"].to_pylist(), b["token"].to_pylist()):
                if key != (c, p // run):
                    key, digest = (c, p // run), b""
                befores.append(digest or None)
                digest = hashlib.sha256(b"t" + digest + t).digest()
                names.append(digest)
            yield pa.RecordBatch.from_arrays([b["conv_id"], b["pos"], pa.array(names, pa.binary()), pa.array(befores, pa.binary())],
                                             ["conv_id", "pos", "name", "above"])

    runs = (rows.select("conv_id", "pos", "token").repartition(parts, "conv_id", F.expr(f"pos div {run}"))
            .sortWithinPartitions("conv_id", "pos").mapInArrow(chain, "conv_id long, pos long, name binary, above binary"))
    runs = written(runs, "trie-names")
    tails = runs.where(F.col("pos") % run == run - 1).select("conv_id", F.expr(f"pos div {run}").alias("pos"), F.col("name").alias("token"))
    if tails.isEmpty():
        return runs
    up = prefix_names(tails, run).select("conv_id", F.col("pos").alias("done"), F.col("name").alias("up"), F.col("above").alias("upper"))
    full = F.col("pos") % run == run - 1          # a whole number of runs: named one level up
    below = F.when(full, F.col("upper")).otherwise(F.col("up"))

    def joined(x):
        return F.when(below.isNull(), x).when(x.isNull(), below) \
            .otherwise(F.unhex(F.sha2(F.concat(F.encode(F.lit("j"), "UTF-8"), below, x), 256)))

    top = F.unhex(F.sha2(F.concat(F.encode(F.lit("r"), "UTF-8"), "up"), 256))
    up = up.withColumn("up", top).withColumn("upper", F.unhex(F.sha2(F.concat(F.encode(F.lit("r"), "UTF-8"), "upper"), 256)))
    return (runs.withColumn("done", F.expr(f"(pos + 1) div {run} - 1")).join(up, ["conv_id", "done"], "left")
            .select("conv_id", "pos", F.when(full, F.col("up")).otherwise(joined(F.col("name"))).alias("name"), joined(F.col("above")).alias("above")))


# ---------------------------------------------------------------- digests of ends
def ends_digests(ends: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """ends (conv_id, depth, member): SHA-256 hex of each node's members, as
    decimals in ascending order, comma-joined. Members are sorted by range, so
    one node's may lie in many partitions; chunks of them are hashed in order."""
    parts = shuffle_partitions(ends.sparkSession)

    def pack(batches):
        schema = pa.schema([("conv_id", pa.int64()), ("depth", pa.int64()), ("first", pa.int64()), ("ids", pa.string())])
        key, held = None, []

        def row():
            return {"conv_id": key[0], "depth": key[1], "first": held[0], "ids": ",".join(map(str, held))}
        for b in batches:
            done = []
            for c, d, m in zip(b["conv_id"].to_pylist(), b["depth"].to_pylist(), b["member"].to_pylist()):
                if key != (c, d) or len(held) >= chunk:
                    if held:
                        done.append(row())
                    key, held = (c, d), []
                held.append(m)
            if done:
                yield pa.RecordBatch.from_pylist(done, schema)
        if held:
            yield pa.RecordBatch.from_pylist([row()], schema)

    def digest(batches):
        schema = pa.schema([("conv_id", pa.int64()), ("depth", pa.int64()), ("sha", pa.string())])
        key, state = None, None
        for b in batches:
            done = []
            for c, d, ids in zip(b["conv_id"].to_pylist(), b["depth"].to_pylist(), b["ids"].to_pylist()):
                if key != (c, d):
                    if key is not None:
                        done.append({"conv_id": key[0], "depth": key[1], "sha": state.hexdigest()})
                    key, state = (c, d), hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.encode())
            yield pa.RecordBatch.from_pylist(done, schema)
        if key is not None:
            yield pa.RecordBatch.from_pylist([{"conv_id": key[0], "depth": key[1], "sha": state.hexdigest()}], schema)

    chunks = (ends.repartitionByRange(parts, "conv_id", "depth", "member").sortWithinPartitions("conv_id", "depth", "member")
              .mapInArrow(pack, "conv_id long, depth long, first long, ids string"))
    return (chunks.repartition(parts, "conv_id", "depth").sortWithinPartitions("conv_id", "depth", "first")
            .mapInArrow(digest, "conv_id long, depth long, sha string"))


# ---------------------------------------------------------------- centroid decomposition
def _finish(top: int, parent: list, children: list, weight: list, leaf: list, saved: list, leaves: list, saves: list) -> None:
    """Decompose one component in place. weight holds subtree weights within the
    component; leaves and saves collect the subtree totals."""
    removed = set()
    tops = [top]
    while tops:
        t = tops.pop()
        z, half = t, weight[t]
        while True:                                   # the deepest node with half of the weight
            nxt = [k for k in children[z] if k not in removed and 2 * weight[k] >= half]
            if not nxt:
                break
            z = nxt[0]
        a = b = 0
        below = [z]                                   # the centroid and all below it in the component
        while below:
            v = below.pop()
            a += leaf[v]
            b += saved[v]
            below.extend(k for k in children[v] if k not in removed)
        gone, v = weight[z], z
        while True:                                   # along the path from the centroid to the top
            leaves[v] += a
            saves[v] += b
            weight[v] -= gone
            if v == t:
                break
            v = parent[v]
        removed.add(z)
        tops.extend(k for k in children[z] if k not in removed)
        if z != t:
            tops.append(t)


_SUMS = "conv_id long, depth long, leaves long, saves long"


def _finish_batches(batches):
    """Rows of components, sorted by (component, depth): the totals of each node
    within its component. Holds one component at a time."""
    schema = pa.schema([("conv_id", pa.int64()), ("depth", pa.int64()), ("leaves", pa.int64()), ("saves", pa.int64())])

    def solve(rows):
        place = {(r[2], r[1]): i for i, r in enumerate(rows)}
        parent = [place.get((r[3], r[1] - 1), -1) for r in rows]
        children: list = [[] for _ in rows]
        for i, p in enumerate(parent):
            if p >= 0:
                children[p].append(i)
        n = len(rows)
        leaves, saves = [0] * n, [0] * n
        _finish(0, parent, children, [r[4] for r in rows], [r[5] for r in rows], [r[6] for r in rows], leaves, saves)
        return [(r[2], r[1], a, b) for r, a, b in zip(rows, leaves, saves)]

    def table(done):
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*done)], schema=schema)

    key, held, done = None, [], []
    names = ["top", "depth", "conv_id", "parent", "weight", "leaf", "saved", "top_depth"]
    for b in batches:
        for r in zip(*[b[c].to_pylist() for c in names]):
            if key != (r[0], r[7]):
                if held:
                    done += solve(held)
                key, held = (r[0], r[7]), []
                if len(done) >= 10_000:
                    yield table(done)
                    done = []
            held.append(r)
    if held:
        done += solve(held)
    if done:
        yield table(done)


def rollup(nodes: DataFrame, paths: DataFrame, most: int = MOST) -> DataFrame:
    """nodes (conv_id, depth, parent, weight, leaf, saved); paths (member, depth,
    conv_id): the node at each depth of a conversation. Returns (conv_id, depth,
    leaves, saves), the sums of leaf and saved over each node's subtree.

    A component is named by its top (conv_id, depth); rows of components that
    are split further travel, the others wait in written tables.
    """
    parts = shuffle_partitions(nodes.sparkSession)
    cols = ["conv_id", "depth", "parent", "weight", "leaf", "saved", "top", "top_depth"]
    root = nodes.where("depth = 0").select("conv_id").first()                  # one root: the whole trie is one component
    state = written(nodes.withColumn("top", F.lit(root[0] if root else None).cast("long"))
                    .withColumn("top_depth", F.lit(0).cast("long")).select(cols), "trie-state")
    sums, waiting = [], []
    while True:
        sizes = state.groupBy("top", "top_depth").agg(F.count("*").alias("size"), F.max("weight").alias("whole"))
        sizes = written(sizes, "trie-sizes")
        big = sizes.where(F.col("size") > most)
        if big.isEmpty():
            waiting.append(state)
            break
        # a component without a big one's key is finished inside a task
        waiting.append(written(state.join(big.select("top", "top_depth"), ["top", "top_depth"], "left_anti").select(cols), "trie-small"))
        live = state.join(big.select("top", "top_depth", "whole"), ["top", "top_depth"])
        z = (live.where("2 * weight >= whole").groupBy("top", "top_depth")
             .agg(F.max(F.struct(F.col("depth").alias("z_depth"), F.col("conv_id").alias("z"), F.col("weight").alias("gone"))).alias("m"))
             .select("top", "top_depth", "m.*"))
        z = written(z, "trie-centroids")
        live = written(live.join(z, ["top", "top_depth"]).withColumn("block", F.expr(f"depth div {SALT}")), "trie-live")
        # which nodes lie below the centroid: their smallest member's path goes through it
        asked = live.where("depth > z_depth").select("conv_id", "block", "top", "top_depth", "z", "z_depth").distinct()
        at = paths.select(F.col("member").alias("conv_id"), F.col("depth").alias("z_depth"), F.col("conv_id").alias("on"))
        under = paths.select(F.col("member").alias("conv_id"), (F.col("depth") - 1).alias("z_depth"), F.col("conv_id").alias("child"))
        split = (asked.join(at, ["conv_id", "z_depth"]).where("on = z").join(under, ["conv_id", "z_depth"])
                 .select("conv_id", "block", "top", "top_depth", "child"))
        live2 = live.join(split, ["conv_id", "block", "top", "top_depth"], "left") \
            .withColumn("is_z", (F.col("conv_id") == F.col("z")) & (F.col("depth") == F.col("z_depth"))) \
            .withColumn("child", F.when(F.col("depth") > F.col("z_depth"), F.col("child")))
        live2 = written(live2, "trie-split")
        totals = (live2.where("is_z or child is not null").groupBy("top", "top_depth")
                  .agg(F.sum("leaf").alias("a"), F.sum("saved").alias("b")))
        path = (z.join(totals, ["top", "top_depth"]).withColumnRenamed("z", "member").alias("c")
                .join(paths.alias("p"), F.expr("p.member = c.member and p.depth between c.top_depth and c.z_depth"))
                .select("p.conv_id", "p.depth", "a", "b", "gone"))
        path = written(path, "trie-path")
        sums.append(path.select("conv_id", "depth", F.col("a").alias("leaves"), F.col("b").alias("saves")))
        nxt = (live2.where("not is_z").join(path.select("conv_id", "depth", F.col("gone").alias("less")), ["conv_id", "depth"], "left")
               .withColumn("weight", F.col("weight") - F.coalesce("less", F.lit(0)))
               .withColumn("top", F.coalesce("child", "top"))
               .withColumn("top_depth", F.when(F.col("child").isNotNull(), F.col("z_depth") + 1).otherwise(F.col("top_depth"))).select(cols))
        nxt = written(nxt, "trie-state")
        for t in (sizes, live, live2, state):
            drop(t)
        state = nxt
    for small in waiting:
        sums.append(small.repartition(parts, "top", "top_depth").sortWithinPartitions("top", "top_depth", "depth")
                    .mapInArrow(_finish_batches, _SUMS))
    out = sums[0]
    for s in sums[1:]:
        out = out.unionByName(s)
    return out.groupBy("conv_id", "depth").agg(F.sum("leaves").alias("leaves"), F.sum("saves").alias("saves"))


# ---------------------------------------------------------------- operator
def prefix_trie(conversations: DataFrame, *, run: int = RUN, most: int = MOST, chunk: int = CHUNK, **columns) -> DataFrame:
    """One row per trie node: conv_id (smallest member), depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    turns = written(rebuilt(ordered_turns(conversations, **columns)), "trie-rebuilt")
    names = prefix_names(turns.where("pos >= 0"), run)
    named = written(turns.where("pos >= 0").join(names.select("conv_id", "pos", "name"), ["conv_id", "pos"])
                    .select(F.col("conv_id").alias("member"), (F.col("pos") + 1).alias("depth"), "name", "bytes", "n"), "trie-prefixes")
    found = named.groupBy("name").agg(
        F.count("*").alias("n_convs"), F.min("member").alias("conv_id"), F.first("depth").alias("depth"),
        F.first("bytes").alias("bytes"), F.sum(F.col("n") - F.col("depth") + 1).alias("weight"))
    found = written(found, "trie-found")
    # every conversation's first row (or its empty one) stands for its root prefix
    roots = turns.where("pos <= 0").select(F.col("conv_id").alias("member"), "n")
    root = roots.agg(F.count("*").alias("n_convs"), F.min("member").alias("conv_id"), F.sum(F.col("n") + 1).alias("weight")) \
        .where("n_convs > 0").select("conv_id", F.lit(0).cast("long").alias("depth"), "n_convs", F.lit(0).cast("long").alias("bytes"), "weight")
    paths = named.join(found.select("name", "conv_id"), "name").select("member", "depth", "conv_id", "n")
    lowest = roots.agg(F.min("member")).first()[0]
    paths = written(paths.unionByName(roots.select("member", F.lit(0).cast("long").alias("depth"), F.lit(lowest).cast("long").alias("conv_id"), "n")), "trie-paths")
    nodes = found.select("conv_id", "depth", "n_convs", "bytes", "weight").unionByName(root)
    up = paths.select(F.col("member").alias("conv_id"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent"))
    nodes = nodes.join(up, ["conv_id", "depth"], "left")
    nodes = written(nodes, "trie-linked")
    kids = nodes.where("depth > 0").groupBy(F.col("parent").alias("conv_id"), (F.col("depth") - 1).alias("depth")) \
        .agg(F.count("*").alias("n_children"))
    nodes = written(nodes.join(kids, ["conv_id", "depth"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "trie-nodes")
    rolled = rollup(nodes.select("conv_id", "depth", "parent", "weight", (F.col("n_children") == 0).cast("long").alias("leaf"),
                                 ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved")), paths.drop("n"), most)
    ends = ends_digests(paths.where("depth = n").select("conv_id", "depth", "member"), chunk)
    return (nodes.join(rolled, ["conv_id", "depth"]).join(ends, ["conv_id", "depth"], "left")
            .select("conv_id", "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children",
                    F.col("leaves").alias("n_leaves"), F.col("saves").alias("saved_tokens"),
                    F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("ends_sha256")))
