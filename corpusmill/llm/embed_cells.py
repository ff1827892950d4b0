"""Embedding near-dedup: spherical k-means cells, blocked cosine products.

Vectors are compared only when their labels are equal and not null. Identical
vectors collapse to one class first. Centroids are fitted on a bounded sample;
every vector is then assigned to its nearest cell and also visits each cell in
which a partner could live: for unit vectors x, y in cells i <> j with
cos >= t the two margins x.(ci-cj) and y.(cj-ci) add up to at most
|x-y| |ci-cj| <= sqrt(2-2t) |ci-cj|, so one of them is at most half of that
and this vector visits the other's cell. No pair is missed, whatever the
centroids are (recall 1 against brute force). Cells larger than a block are
cut into blocks that are compared pairwise; no task holds more than two.

Nulls: vectors that are null, zero, or hold null or non-finite components, and
vectors with a null label, link with nothing (n_links 0, component_id and kept
their own). A row with a null vec_id takes no part and gets a null component.
Vectors of different length never link. Rows that repeat a vec_id are one node
of the graph. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import components, numbers, quoted, written

THRESHOLD = 0.98
FIT_ROWS = 20_000        # most vectors that the centroids are fitted on
PER_CELL = 8_192         # vectors per cell aimed at
MAX_CELLS = 512
BLOCK_ROWS = 4_096       # most vectors of either side of a blocked product
STRIP = 512


def fit_cells(x: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Centroids (unit length) of unit vectors x by spherical k-means."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        own = np.argmax(x @ c.T, axis=1)
        for j in range(len(c)):
            total = x[own == j].sum(axis=0)
            norm = np.sqrt(total @ total)
            if norm > 0:
                c[j] = total / norm
    return c


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)        # no overflow in the squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _margins(x, own, centroids, reach):
    """visits[i, j]: vector i may have a partner at home in cell j."""
    dots = x @ centroids.T
    gap = np.sqrt(np.maximum(0, ((centroids[:, None] - centroids[None]) ** 2).sum(-1)))
    return dots[np.arange(len(x)), own][:, None] - dots <= reach * gap[own] + 1e-9


def _compare(home, probe, centroids, cell, threshold, reach):
    """Link counts and spanning links between the home vectors of a cell and
    its probes (home vectors of the cell too, and visitors from others)."""
    hid, hw, hx = home
    pid, pw, pown, px = probe
    h_count, p_count = np.zeros(len(hid), np.int64), np.zeros(len(pid), np.int64)
    group = np.arange(len(hid))
    link = np.full(len(pid), -1)
    h_visits = _margins(hx, np.full(len(hid), cell), centroids, reach)
    for at in range(0, len(pid), STRIP):
        to = min(len(pid), at + STRIP)
        near = px[at:to] @ hx.T >= threshold
        if not near.any():
            continue
        own = pown[at:to]
        visitor = own != cell
        # a visitor's pair is counted once: in the lower cell if either side visits the other's
        near &= ~visitor[:, None] | (own < cell)[:, None] | ~h_visits[:, own].T
        near &= pid[at:to, None] != hid[None, :]
        p_count[at:to] += near @ hw
        h_count += (pw[at:to] * visitor) @ near
        for i in np.flatnonzero(near.any(axis=1)):
            met = np.flatnonzero(near[i])
            groups = np.unique(group[met])
            if len(groups) > 1:
                group[np.isin(group, groups)] = groups[0]
            link[at + i] = met[0]
    low = np.full(len(hid), np.iinfo(np.int64).max)
    np.minimum.at(low, group, hid)
    hit = link >= 0
    np.minimum.at(low, group[link[hit]], pid[hit])
    return h_count, p_count, low[group], np.where(hit, low[group[link]] if len(hid) else 0, pid)


def embedding_links(rows: DataFrame, *, threshold: float = THRESHOLD, fit_rows: int = FIT_ROWS,
                    per_cell: int = PER_CELL, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame]:
    """(counts, links) over distinct vectors (grp, dim, vec_id, w, embedding):
    counts (vec_id, n) of linked rows per vector, links (a, b) that connect
    the same vectors as all pairs at or above the threshold do."""
    spark = rows.sparkSession
    reach = float(np.sqrt(2 - 2 * threshold) / 2)
    totals = rows.groupBy("dim").count().collect()        # a few vector lengths
    if not totals:
        return spark.createDataFrame([], "vec_id long, n long"), spark.createDataFrame([], "a long, b long")
    if len(totals) > 64:
        raise ValueError("more than 64 vector lengths")
    centroids = {}
    for dim, n in totals:
        k = int(np.clip(n // per_cell, 1, MAX_CELLS))
        share = rows.where(F.col("dim") == dim)
        sample = share.orderBy(F.xxhash64("vec_id"), "vec_id").select("embedding").limit(min(fit_rows, 64 * k)).toArrow()
        centroids[dim] = fit_cells(_unit(_matrix(sample["embedding"])), k) if k > 1 else np.eye(1, dim)
    held = spark.sparkContext.broadcast(centroids)

    def assign(batches):
        for b in batches:
            for dim in np.unique(numbers(b["dim"])):
                part = b.filter(pa.array(numbers(b["dim"]) == dim))
                c = held.value[int(dim)]
                x = _unit(_matrix(part["embedding"]))
                own = np.argmax(x @ c.T, axis=1).astype(np.int32)
                who, cell = np.nonzero(_margins(x, own, c, reach) | (np.arange(len(c)) == own[:, None]))
                t = part.take(pa.array(who))
                yield pa.RecordBatch.from_arrays(
                    [t["grp"], t["dim"], t["vec_id"], t["w"], t["embedding"], pa.array(own[who]), pa.array(cell.astype(np.int32))],
                    ["grp", "dim", "vec_id", "w", "embedding", "own", "cell"])

    placed = rows.mapInArrow(assign, "grp string, dim int, vec_id long, w long, embedding array<double>, own int, cell int")
    key = ["grp", "dim", "cell"]
    sizes = placed.groupBy(*key).agg(F.sum((F.col("own") == F.col("cell")).cast("long")).alias("homes"), F.count("*").alias("rows"))
    sizes = sizes.where("homes > 0").select(*key, F.ceil(F.col("homes") / block_rows).cast("int").alias("hbs"),
                                            F.ceil(F.col("rows") / block_rows).cast("int").alias("pbs"))
    spot = lambda seed, n: F.pmod(F.xxhash64(F.lit(seed), "vec_id"), F.col(n)).cast("int")
    sized = placed.join(sizes, key)
    probes = sized.withColumn("pb", spot(1, "pbs")).withColumn("hb", F.explode(F.sequence(F.lit(0), F.col("hbs") - 1))) \
        .withColumn("home", F.lit(False))
    homes = sized.where("own = cell").withColumn("hb", spot(2, "hbs")) \
        .withColumn("pb", F.explode(F.sequence(F.lit(0), F.col("pbs") - 1))).withColumn("home", F.lit(True))
    cols = [*key, "hb", "pb", "home", "vec_id", "w", "own", "embedding"]

    def products(table: pa.Table) -> pa.Table:
        dim, cell = table["dim"][0].as_py(), table["cell"][0].as_py()
        is_home = numbers(table["home"])
        h, p = table.filter(pa.array(is_home)), table.filter(pa.array(~is_home))
        hid, pid = numbers(h["vec_id"]), numbers(p["vec_id"])
        if not len(hid) or not len(pid):
            z = np.zeros(0, np.int64)
            hid, hn, hl, pid, pn, pl = z, z, z, z, z, z
        else:
            hn, pn, hl, pl = _compare((hid, numbers(h["w"]), _unit(_matrix(h["embedding"]))),
                                      (pid, numbers(p["w"]), numbers(p["own"]), _unit(_matrix(p["embedding"]))),
                                      held.value[dim], cell, threshold, reach)
        ids, n, low = np.concatenate((hid, pid)), np.concatenate((hn, pn)), np.concatenate((hl, pl))
        hit = (n > 0) | (low != ids)
        return pa.table({"vec_id": ids[hit], "n": n[hit], "low": low[hit]})

    found = written(homes.select(*cols).unionByName(probes.select(*cols)).groupBy(*key, "hb", "pb")
                    .applyInArrow(products, "vec_id long, n long, low long"), "cell-links")
    return found.groupBy("vec_id").agg(F.sum("n").alias("n")), found.select(F.col("vec_id").alias("a"), F.col("low").alias("b"))


def embedding_classes(vectors: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label",
                      threshold: float = THRESHOLD, **how) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    e = F.col("embedding")
    src = vectors.select(quoted(vec_id).cast("long").alias("vec_id"), quoted(label).cast("string").alias("grp"),
                         quoted(embedding).cast("array<double>").alias("embedding"))
    usable = (F.col("vec_id").isNotNull() & F.col("grp").isNotNull() & e.isNotNull() & (F.size(e) > 0)
              & F.coalesce(F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))
              & F.coalesce(F.exists(e, lambda v: v != 0), F.lit(False)))
    # -0.0 and 0.0 are one value
    good = src.where(usable).withColumn("embedding", F.transform("embedding", lambda v: v + F.lit(0.0)))
    classes = good.groupBy("grp", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("w"))
    members = good.join(classes, ["grp", "embedding"]).select("vec_id", "rep", "w")
    members = written(members, "vec-classes")
    distinct = written(classes.select("grp", F.size("embedding").alias("dim"), F.col("rep").alias("vec_id"), "w", "embedding"), "vectors")
    counts, links = embedding_links(distinct, threshold=threshold, **how)
    links = links.unionByName(members.where("vec_id <> rep").select(F.col("vec_id").alias("a"), F.col("rep").alias("b")))
    roots = components(links)
    per_id = members.distinct().join(counts.withColumnRenamed("vec_id", "rep"), "rep", "left") \
        .groupBy("vec_id").agg(F.sum(F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links"))
    return (src.select("vec_id").join(per_id, "vec_id", "left")
            .join(roots.withColumnRenamed("node", "vec_id"), "vec_id", "left")
            .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                    F.coalesce("root", "vec_id").alias("component_id"),
                    F.coalesce(F.coalesce("root", "vec_id") == F.col("vec_id"), F.lit(True)).alias("kept")))
