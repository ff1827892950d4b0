"""Embedding whitening by shifted CholeskyQR.

The rows are x = floor(64 c) + 1000000 as longs. Their exact sums S per
dimension come from one pass; a centred row is y = (n x - S) / n, from exact
integers. Distributed Gram passes then orthogonalise the centred rows: the
first adds the shift of Fukaya et al. (2020), so that its Cholesky factor
exists whatever the condition is; each further pass sums the Gram matrix of
the rows solved against the triangular factor so far, and the factors are
composed, until the solved rows are orthonormal. R (with Y = QR) holds the
singular values of Y to full precision, which a single Gram matrix does not; its SVD
gives the components and eigenvalues s^2 / n.

Each task sends one d x d matrix per pass; they are added in two levels of
streamed partial sums, so that no task or driver holds more than a few
(d is the vectors' length, the only size that the driver sees).

Defined results. Rows whose vector is null or holds null or non-finite
entries are dropped, from the fit and the result. A shorter vector counts as
c = 0 in its missing dimensions. Entries beyond 2^30 are taken as 2^30.
Components whose eigenvalue is zero (constant
or dependent dimensions) have no rows. deviation is null where it exceeds a
long. Rows that repeat or have a null vec_id are rows as all others. An empty
table gives an empty result. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import pick

SCALE, OFFSET = 64, 1_000_000
LARGEST = 2.0 ** 30      # entries beyond are taken as this
COMPONENTS = 32
PASSES = 8               # most Gram passes; three or four are usual
STRIP = 1 << 18          # entries of the rows that a task holds at a time
MERGE = 64               # matrices added by a task of the first level


def fit_rows(embeddings: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, x): the rows that take part, as array<long>."""
    src = pick(embeddings, vec_id=(vec_id, "long"), e=(embedding, "array<double>"))
    bad = F.exists("e", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return src.where(F.col("e").isNotNull() & ~bad).select(
        "vec_id", F.transform("e", lambda c: F.floor(F.least(F.greatest(c, F.lit(-LARGEST)), F.lit(LARGEST)) * SCALE) + OFFSET).alias("x"))


def _strips(batch: pa.RecordBatch, d: int):
    """(rows of the batch, matrix of their x) in strips of bounded size."""
    step = max(1, STRIP // max(d, 1))
    for at in range(0, batch.num_rows, step):
        part = batch.slice(at, step)
        column = part["x"]
        sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False)
        flat = column.flatten().to_numpy(zero_copy_only=False)
        if (sizes == d).all():
            yield part, flat.reshape(len(part), d)
        else:
            x = np.full((len(part), d), OFFSET, np.int64)
            x[np.arange(d) < sizes[:, None]] = flat
            yield part, x


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """(n x - S) / n with n x - S exact: about a whole number near the mean, so
    that no product leaves 64 bits."""
    near = sums // n
    return (x - near).astype(np.float64) - (sums - near * n) / n


def _add(df: DataFrame) -> np.ndarray:
    """Sum of the rows' arrays (``part array<double>``): streamed partial sums in two levels."""
    def total(batches):
        acc = None
        for b in batches:
            for at in range(b.num_rows):
                row = b["part"].slice(at, 1).flatten().to_numpy(zero_copy_only=False)
                acc = row.copy() if acc is None else acc + row
        if acc is not None:
            yield pa.RecordBatch.from_arrays([pa.array([acc], pa.list_(pa.float64()))], ["part"])

    many = max(1, math.ceil(df.rdd.getNumPartitions() / MERGE))
    one = df.repartition(many).mapInArrow(total, "part array<double>")
    got = one.repartition(1).mapInArrow(total, "part array<double>").first()
    return np.array(got[0])


def _gram(rows: DataFrame, d: int, make) -> np.ndarray:
    """Sum over rows of q q^T, q = make(x); one matrix per task."""
    def part(batches):
        acc = None
        for b in batches:
            for _, x in _strips(b, d):
                q = make(x)
                g = q.T @ q
                acc = g if acc is None else acc + g
        if acc is not None:
            yield pa.RecordBatch.from_arrays([pa.array([acc.ravel()], pa.list_(pa.float64()))], ["part"])
    out = rows.select("x").mapInArrow(part, "part array<double>")
    g = _add(out)
    side = math.isqrt(len(g))
    return g.reshape(side, side)


def _solve(r: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Rows of y R^-1 for an upper triangular R: forward substitution by column
    blocks, in place of an inverse."""
    d, q = len(r), np.array(y.T)
    for at in range(0, d, 32):
        to = min(d, at + 32)
        if at:
            q[at:to] -= r[:at, at:to].T @ q[:at]
        q[at:to] = np.linalg.solve(r[at:to, at:to].T, q[at:to])
    return q.T


def shifted_cholesky_qr(gram, d: int, n: int) -> np.ndarray:
    """R of Y = QR. gram(factors) gives the Gram matrix of the rows of Y after
    solving against each upper triangular factor in turn."""
    unit = np.finfo(float).eps / 2
    close = 64 * d * unit
    factors: list[np.ndarray] = []
    r = np.eye(d)
    for step in range(PASSES):
        g = gram(factors)
        g = (g + g.T) / 2
        size = np.trace(g)
        if size == 0:                                        # no direction varies
            return np.zeros((d, d))
        if step:
            e = np.linalg.eigvalsh(g)
            if (np.abs(e - 1) < close).all():                # the solved rows are orthonormal
                break
            if step > 3 and ((np.abs(e - 1) < close) | (np.abs(e) < close)).all():
                break                                        # and nothing is left in the other directions
        shift = min(11 * (n * d + d * (d + 1)) * unit, 1e-8) * size if step == 0 else 0.0
        while True:
            try:
                factor = np.linalg.cholesky(g + shift * np.eye(d)).T
                break
            except np.linalg.LinAlgError:                    # dependent dimensions
                shift = max(10 * shift, 8 * d * unit * size)
        factors.append(factor)
        r = factor @ r
    return r


@dataclass
class Whitening:
    n: int
    sums: np.ndarray          # exact sums per dimension
    axes: np.ndarray          # unit eigenvectors, one per row
    values: np.ndarray        # eigenvalues of the covariance, falling
    explained: np.ndarray
    error: float = 0.0

    def apply(self, x: np.ndarray) -> np.ndarray:
        return (centred(x, self.n, self.sums) @ self.axes.T) / np.sqrt(self.values)

    def deviation(self, x: np.ndarray) -> pa.Array:
        """Sum of (n x - S)^2, exact; null beyond a long."""
        low, high = x.min(axis=0, initial=OFFSET), x.max(axis=0, initial=OFFSET)
        most = max((abs(self.n * int(v) - int(s)) for e in (low, high) for v, s in zip(e, self.sums)), default=0)
        if most * most * max(len(self.sums), 1) < 1 << 63:
            near = self.n * x - self.sums
            return pa.array((near * near).sum(axis=1), pa.int64())
        sums = [int(s) for s in self.sums]
        whole = [sum((self.n * int(v) - s) ** 2 for v, s in zip(row, sums)) for row in x]
        return pa.array([v if v < 1 << 63 else None for v in whole], pa.int64())


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """rows: what fit_rows() gives. None where nothing can be whitened."""
    head = rows.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("d")).first()
    n, d = int(head.n), int(head.d or 0)
    if not n or not d:
        return None
    # exact: sums of (x - OFFSET) per dimension and task, then per dimension
    def add(batches):
        acc = np.zeros(d, np.int64)
        for b in batches:
            for _, x in _strips(b, d):
                acc += (x - OFFSET).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array(acc)], ["dim", "s"])

    by_dim = rows.select("x").mapInArrow(add, "dim int, s long").groupBy("dim").agg(F.sum("s").alias("s")).collect()
    sums = np.zeros(d, np.int64)
    for r in by_dim:
        sums[r.dim] = r.s
    sums += n * OFFSET

    def gram(factors):
        def make(x):
            q = centred(x, n, sums)
            for f in factors:
                q = _solve(f, q)
            return q
        return _gram(rows, d, make)

    r = shifted_cholesky_qr(gram, d, n)
    _, s, axes = np.linalg.svd(r)
    keep = s > s[0] * d * 1e-12 if s[0] > 0 else np.zeros(d, bool)
    values = s ** 2 / n
    k = min(int(keep.sum()), components)
    if not k:
        return None
    model = Whitening(n, sums, axes[:k], values[:k], values[:k] / values[keep].sum())
    cov = _gram(rows, d, model.apply) / n           # whitened rows have mean 0 up to rounding
    model.error = float(np.abs(cov - np.eye(k)).max())
    return model


def whiten(embeddings: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per vector and component: vec_id, component, n, deviation,
    whitened, explained, identity_error."""
    rows = fit_rows(embeddings, vec_id, embedding)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    model = fit(rows, components)
    if model is None:
        return rows.sparkSession.createDataFrame([], schema)
    held = rows.sparkSession.sparkContext.broadcast(model)         # components x dimensions

    def apply(batches):
        m = held.value
        k, d = m.axes.shape
        for b in batches:
            for part, x in _strips(b, d):
                w = m.apply(x)
                take = pa.array(np.repeat(np.arange(len(x)), k))
                yield pa.RecordBatch.from_arrays(
                    [part["vec_id"].take(take), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                     pa.array(np.full(len(x) * k, m.n)), m.deviation(x).take(take), pa.array(w.ravel()),
                     pa.array(np.tile(m.explained, len(x))), pa.array(np.full(len(x) * k, m.error))],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(apply, schema)
