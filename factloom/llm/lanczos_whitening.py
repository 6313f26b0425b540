"""Embedding whitening: matrix-free block Lanczos with full reorthogonalisation.

An entry c becomes the integer floor(64 c) + 1000000. Sums S and the count n are exact; a row centred is (n x - S) / n, whose
numerator is an exact integer, so nothing is lost before multiplying. The covariance is never formed: a pass over the rows gives
V Q for a block of d x b orthonormal columns, as the sum of Xc^T (Xc Q) over tasks, added up by Spark.

Block Lanczos: the next block is V Q less its parts along all earlier blocks (twice), orthonormalised. Where its rank breaks down
(an invariant subspace is found), fresh random directions orthogonal to all earlier ones restart it. Ritz pairs come from
Q^T V Q; it ends when the residual |V y - e y| of each of the first ``k`` is below ``tolerance`` times the largest eigenvalue,
or when Q spans the whole space. The driver holds d x m numbers, m the columns so far (a few times ``k``), never rows.

deviation sums (n x - S)^2; trace(V) is the sum of the deviations over n^3, so the shares explained need no covariance either.

Defined results: rows whose vector is null or empty or holds null or non-finite entries, or entries of 2^40 and more (x would leave exact
numbers), are dropped; so are vectors of another length than most have (the smaller, if tied); a null id, repeated rows and zero vectors
stay as rows of their own; with fewer than k dimensions there are that many components; a component whose eigenvalue is zero to
rounding can't be whitened and gives no rows (so equal vectors, or one vector, give none); a deviation beyond a long is null; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import mapped, table
from factloom.session import Scratch

SHIFT, SCALE = 1_000_000, 64.0
OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
ROWS = 1 << 20  # numbers of a slice of rows that is multiplied at once


def whole(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, x): the rows that remain, as integers."""
    v = F.col(vec_col).cast("array<double>")
    fine = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float(1 << 40)))
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.when(fine, v).alias("v")).where("v is not null and size(v) > 0")
    sizes = rows.groupBy(F.size("v").alias("k")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "k").limit(1).collect()
    x = F.transform("v", lambda c: F.floor(c * SCALE).cast("long") + SHIFT)
    return rows.where(F.size("v") == (sizes[0].k if sizes else 0)).select("vec_id", x.alias("x"))


def matrix(column: pa.Array, d: int) -> Iterator[tuple[int, np.ndarray]]:
    """Slices of rows, with where each begins."""
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
    step = max(1, ROWS // d)
    for lo in range(0, len(x), step):
        yield lo, x[lo : lo + step]


def centred(x: np.ndarray, n: int, s: np.ndarray) -> np.ndarray:
    return (n * x - s) / float(n)


def summed(df: DataFrame, each, size: int) -> np.ndarray:
    """Sum over tasks of the ``size`` numbers that each makes of its rows; added up by Spark, one row for each number comes back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for b in batches:
            total += each(b)
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["part"])

    parts = mapped(df.select("x"), run, "part array<double>").select(F.posexplode("part").alias("at", "value"))
    out = np.zeros(size)
    for r in parts.groupBy("at").agg(F.sum("value").alias("value")).collect():
        out[r["at"]] = r["value"]
    return out


def product(df: DataFrame, q: np.ndarray, n: int, s: np.ndarray) -> np.ndarray:
    """V Q in one pass over the rows."""

    def each(b: pa.RecordBatch) -> np.ndarray:
        total = np.zeros(q.shape)
        for _, x in matrix(b.column(0), len(s)):
            c = centred(x, n, s)
            total += c.T @ (c @ q)
        return total.ravel()

    return summed(df, each, q.size).reshape(q.shape) / n


def orthonormal(w: np.ndarray, q: np.ndarray, g: np.random.Generator) -> np.ndarray:
    """An orthonormal block for the part of w that is orthogonal to q; where w adds no direction, a random one restarts it."""
    out = np.zeros((len(w), 0))
    for col in w.T:
        size = np.linalg.norm(col)
        for _ in range(8):
            before = np.concatenate([q, out], axis=1)
            if before.shape[1] >= len(w):
                return out
            v = col
            for _ in range(3):
                v = v - before @ (before.T @ v)
            left = np.linalg.norm(v)
            if left > 1e-10 * max(size, 1e-300):
                out = np.concatenate([out, (v / left)[:, None]], axis=1)
                break
            col = g.standard_normal(len(w))
            size = np.linalg.norm(col)
    return out


def lanczos(times, d: int, k: int, block: int, tolerance: float, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues, falling, and unit eigenvectors (columns) of the symmetric d x d matrix that ``times`` multiplies by."""
    g = np.random.default_rng(seed)
    q, vq = np.zeros((d, 0)), np.zeros((d, 0))
    new = orthonormal(g.standard_normal((d, min(block, d))), q, g)
    while True:
        w = times(new)
        q, vq = np.concatenate([q, new], axis=1), np.concatenate([vq, w], axis=1)
        t = q.T @ vq
        e, y = np.linalg.eigh((t + t.T) / 2)
        e, y = e[::-1][:k], y[:, ::-1][:, :k]
        residual = np.linalg.norm(vq @ y - (q @ y) * e, axis=0)
        if q.shape[1] >= d or (q.shape[1] >= 2 * k and residual.max() <= tolerance * max(abs(e[0]), 1e-300)):
            vectors = q @ y
            return e, vectors / np.linalg.norm(vectors, axis=0)
        new = orthonormal(w, q, g)


def deviations(x: np.ndarray, n: int, s: np.ndarray) -> list[int | None]:
    """Exact sums of squares; null beyond a long."""
    far = (n * x - s).astype(np.int64)
    most = int(np.abs(far).max(initial=0))
    if most * most * x.shape[1] < 1 << 63:
        return (far * far).sum(axis=1).tolist()
    sums = ((far.astype(object)) ** 2).sum(axis=1)
    return [int(v) if v < 1 << 63 else None for v in sums]


def whiten(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 32, block: int = 16, tolerance: float = 1e-13) -> DataFrame:
    """A row for each remaining vector and component."""
    spark = df.sparkSession
    none = spark.createDataFrame([], OUT)
    rows = Scratch(spark, "whitening").keep(whole(df, id_col, vec_col))
    sums = {r["at"]: (r["n"], r["s"]) for r in rows.select(F.posexplode("x").alias("at", "c")).groupBy("at").agg(F.count("*").alias("n"), F.sum("c").alias("s")).collect()}
    if not sums:
        return none
    n, d = sums[0][0], len(sums)
    s = np.array([sums[i][1] for i in range(d)], np.int64)
    e, vectors = lanczos(partial(product, rows, n=n, s=s), d, min(k, d), min(block, d), tolerance)
    fine = e > 64 * d * np.finfo(float).eps * max(e[0], 0)
    if not fine.any():
        return none
    e, vectors = e[fine], vectors[:, fine]
    scaled = vectors / np.sqrt(e)
    m = len(e)

    def moments(b: pa.RecordBatch) -> np.ndarray:
        """Sums of whitened rows and of their products, and of the squared deviations over n^2."""
        total = np.zeros(m * m + m + 1)
        for _, x in matrix(b.column(0), d):
            c = centred(x, n, s)
            w = c @ scaled
            total += np.concatenate([(w.T @ w).ravel(), w.sum(axis=0), [(c * c).sum()]])
        return total

    found = summed(rows, moments, m * m + m + 1) / n
    mean, trace = found[m * m : -1], found[-1]
    error = float(np.abs(found[: m * m].reshape(m, m) - np.outer(mean, mean) - np.eye(m)).max())
    share = e / trace

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0)
            for lo, x in matrix(b.column(1), d):
                own, w = len(x), centred(x, n, s) @ scaled
                again = pa.array(np.repeat(np.arange(lo, lo + own), m))
                columns = [
                    ids.take(again),
                    pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), own)),
                    pa.array(np.full(own * m, n, np.int64)),
                    pa.array(deviations(x, n, s), pa.int64()).take(pa.array(np.repeat(np.arange(own), m))),
                    pa.array(w.ravel()),
                    pa.array(np.tile(share, own)),
                    pa.array(np.full(own * m, error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return mapped(rows, each, OUT)


def op13_lanczos_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
