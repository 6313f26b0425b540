"""Embedding near-dedup by an exact metric range join.

Unit vectors with cosine c are sqrt(2 - 2c) apart. Pivots from a bounded sample cut the space into cells of nearest pivot. A vector goes to
its own cell, and also to each cell where the triangle inequality lets a member be within the radius r: not farther from
that pivot than the cell's radius plus r, and not farther than r from the plane between both pivots. So all partners of a
cell's own vectors are in the cell, and cells are joined independently. A cell is cut into tiles of bounded size, so that a
crowded one is shared by many tasks.

Equal vectors are one class, weighted by its number of rows. Tiles count each own vector's links and give a spanning forest of them,
never the pairs; the forests' components are the result's. Products in single precision decide what is clearly over or
under the threshold, double precision the rest.

Defined results: vectors that are null, zero, or hold null or non-finite components, link with nothing (0 links, own
component, kept); so do those of another length than most have; a null id takes no part (component null, kept false); rows of an id that repeat
count as rows, and come back each, with the most links and the smallest component of the id's vectors; an empty table gives an empty result;
other columns, labels too, are ignored. ``most`` bounds the pivots that go to all tasks; cells that grow beyond a tile are joined by tiles.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from factloom.llm.common import components, sampled, table
from factloom.llm.vectors import stacked, usable
from factloom.session import Scratch, ship

CELL, OWN, OTHER = 4096, 8192, 16384  # rows aimed at in a cell; rows in a tile's sides
ROWS = 4096  # vectors compared with all pivots at once, and rows of a batch that goes back to Spark
COUNTED = "cell int, own long, n long, d double"


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64, copy=False)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def choose_pivots(x: np.ndarray, k: int, seed: int = 1) -> np.ndarray:
    """k pivots of the sample, each the farthest from those before among a random few."""
    g = np.random.default_rng(seed)
    x = np.unique(unit(x), axis=0)
    out = [int(g.integers(len(x)))]
    far = np.linalg.norm(x - x[out[0]], axis=1)
    while len(out) < min(k, len(x)):
        some = g.choice(len(x), min(len(x), 32), replace=False)
        best = int(some[far[some].argmax()])
        if far[best] <= 1e-9:
            break
        out.append(best)
        far = np.minimum(far, np.linalg.norm(x - x[best], axis=1))
    return x[out]


def nearest(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Squared distances to the pivots, their roots, and the number of the nearest."""
    d2 = np.maximum(2 - 2 * x @ pivots.T, 0)
    d = np.sqrt(d2)
    return d2, d, d.argmin(1)


def seen(x: np.ndarray, pivots: np.ndarray, gap: np.ndarray, reach: float, radii: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each vector and cell whether it must be there; the own cell, and the distance to its pivot."""
    d2, d, own = nearest(x, pivots)
    at = np.arange(len(x))
    out = ((d2 - d2[at, own][:, None]) / np.maximum(2 * gap[own], 1e-12) <= reach) & (d <= radii[None] + reach)
    out[at, own] = True
    return out, own, d[at, own]


def gaps(pivots: np.ndarray) -> np.ndarray:
    return np.linalg.norm(pivots[:, None] - pivots[None], axis=2)


def useful(x: np.ndarray, pivots: np.ndarray, reach: float, n: int) -> int:
    """How many of the pivots to take: the number under which the sample x says that least is compared and moved for n vectors. Where cells
    don't part the vectors, each vector goes to all of them, so that many cells only mean many copies."""
    x, gap = unit(x), gaps(pivots)
    best, at = math.inf, len(pivots)
    k = len(pivots)
    while k:
        own = nearest(x, pivots[:k])
        radii = np.full(k, -np.inf)
        np.maximum.at(radii, own[2], own[1].min(1))
        copies = sum(seen(x[i : i + ROWS], pivots[:k], gap[:k, :k], reach, radii)[0].sum() for i in range(0, len(x), ROWS)) / len(x)
        others = n * copies / k
        # a tile's row is compared with the other side's rows; to move it to a tile costs about as much as so many comparisons
        cost = others + 2048 * (max(1.0, others / OTHER) + copies * max(1.0, n / k / OWN))
        if cost < best:
            best, at = cost, k
        k //= 2
    return at


def counted(pivots: np.ndarray, reach: float, radii: np.ndarray | None):
    """By cell: own vectors, their greatest distance, and with ``radii`` (of the cells) how many vectors must be seen in it; one row a cell and task."""
    gap = gaps(pivots)

    def each(batches):
        own_n, n, far = np.zeros(len(pivots), np.int64), np.zeros(len(pivots), np.int64), np.full(len(pivots), -np.inf)
        for b in batches:
            for lo in range(0, len(b), ROWS):
                x = unit(stacked(b["v"].iloc[lo : lo + ROWS]))
                if radii is None:
                    _, d, own = nearest(x, pivots)
                    d = d.min(1)
                else:
                    there, own, d = seen(x, pivots, gap, reach, radii)
                    n += there.sum(0)
                own_n += np.bincount(own, minlength=len(pivots))
                np.maximum.at(far, own, d)
        hit = np.flatnonzero(own_n + n)
        yield pd.DataFrame({"cell": hit.astype(np.int32), "own": own_n[hit], "n": n[hit], "d": far[hit]})

    return each


def placed(pivots: np.ndarray, reach: float, radii: np.ndarray):
    """Rows once for each cell that they must be seen in. Batches stay bounded however many cells that is."""
    gap = gaps(pivots)

    def each(batches):
        for b in batches:
            for lo in range(0, len(b), ROWS):
                some = b.iloc[lo : lo + ROWS]
                there = seen(unit(stacked(some["v"])), pivots, gap, reach, radii)[0]
                i, c = np.nonzero(there)
                for at in range(0, len(i), ROWS):
                    rows, cells = i[at : at + ROWS], c[at : at + ROWS]
                    yield some.iloc[rows].assign(cell=cells.astype(np.int32))

    return each


def homed(pivots: np.ndarray):
    """Rows with their own cell."""

    def each(batches):
        for b in batches:
            for lo in range(0, len(b), ROWS):
                some = b.iloc[lo : lo + ROWS]
                yield some.assign(cell=nearest(unit(stacked(some["v"])), pivots)[2].astype(np.int32))

    return each


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest label reachable for nodes 0..n-1 by links a-b."""
    label = np.arange(n)
    while True:
        old = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == old).all():
            return label


def tiled(cosine: float, step: int = 1024, wide: int = 4096):
    def each(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"rep": pd.Series(dtype="int64"), "n": pd.Series(dtype="int64"), "b": pd.Series(dtype="int64")})
        if not len(left) or not len(right):
            return none
        x, y = unit(stacked(left["v"])), unit(stacked(right["v"]))
        xs, ys = x.astype(np.float32), y.astype(np.float32)
        xi, yi, m = left["rep"].to_numpy(), right["rep"].to_numpy(), right["m"].to_numpy()
        nodes, at = np.unique(np.concatenate([xi, yi]), return_inverse=True)
        xa, ya = at[: len(xi)], at[len(xi) :]
        links = np.zeros(len(xi), np.int64)
        label = np.arange(len(nodes))
        for i in range(0, len(xi), step):
            for j in range(0, len(yi), wide):
                s = xs[i : i + step] @ ys[j : j + wide].T
                p, q = np.nonzero(s >= cosine - 1e-4)
                if not len(p):
                    continue
                close = np.flatnonzero(np.abs(s[p, q] - cosine) <= 1e-4)
                ok = np.ones(len(p), bool)
                for lo in range(0, len(close), 100_000):
                    own = close[lo : lo + 100_000]
                    ok[own] = (x[i + p[own]] * y[j + q[own]]).sum(1) >= cosine
                ok &= xi[i + p] != yi[j + q]
                p, q = i + p[ok], j + q[ok]
                links += np.bincount(p, weights=m[q], minlength=len(xi)).astype(np.int64)
                u, v = label[xa[p]], label[ya[q]]
                if (u != v).any():
                    label = forest(u[u != v], v[u != v], len(nodes))[label]
        hit = np.flatnonzero(links)
        far = np.flatnonzero(label != np.arange(len(nodes)))
        return pd.concat([pd.DataFrame({"rep": xi[hit], "n": links[hit], "b": xi[hit]}), pd.DataFrame({"rep": nodes[far], "n": 0, "b": nodes[label[far]]})])

    return each


def near_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", cosine: float = 0.9, sample: int = 4096, most: int = 512) -> DataFrame:
    """One row per vector: number of other vectors linked directly, smallest id reachable, whether that is its own."""
    spark = df.sparkSession
    ship(spark)
    scratch = Scratch(spark, "metric")
    good = usable(df, id_col, vec_col)
    if df.schema[vec_col].dataType.elementType == FloatType():  # half the bytes moved, and nothing lost: products are of doubles
        good = good.withColumn("v", F.col("v").cast("array<float>"))
    good = scratch.keep(good)
    classes = scratch.keep(good.groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("m")).select("rep", "m", "v"))
    n = classes.count()
    ids = df.select(F.col(id_col).cast("long").alias("vec_id"))
    if not n:
        return ids.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    some = stacked(sampled(classes.select("rep", "v"), sample, "rep", n=n).toPandas().sort_values("rep")["v"])
    pivots = choose_pivots(some, min(most, -(-n // CELL)))
    reach = math.sqrt(2 - 2 * cosine) + 1e-6
    pivots = pivots[: useful(some, pivots, reach, n)]
    vectors = classes.select("v")
    radii = np.full(len(pivots), -np.inf)
    for c in vectors.mapInPandas(counted(pivots, reach, None), COUNTED).groupBy("cell").agg(F.max("d").alias("d")).collect():
        radii[c.cell] = c.d
    sizes = {r.cell: (-(-int(r.own) // OWN), -(-r.n // OTHER)) for r in vectors.mapInPandas(counted(pivots, reach, radii), COUNTED).groupBy("cell").agg(F.sum("own").alias("own"), F.sum("n").alias("n")).collect()}
    count = lambda k: F.create_map(*[F.lit(x) for c, s in sizes.items() for x in (c, max(1, s[k]))])[F.col("cell")]
    part = lambda k: F.pmod(F.xxhash64("rep", F.lit(k)), count(k)).cast("int")
    each = lambda k: F.explode(F.sequence(F.lit(0), count(k) - 1))
    kind = dict(classes.dtypes)["v"]
    left = classes.select("rep", "v").mapInPandas(homed(pivots), f"rep long, v {kind}, cell int").select("rep", "v", "cell", part(0).alias("i"), each(1).alias("j"))
    right = classes.mapInPandas(placed(pivots, reach, radii), f"rep long, m long, v {kind}, cell int").select("rep", "m", "v", "cell", part(1).alias("j"), each(0).alias("i"))
    found = scratch.keep(left.groupBy("cell", "i", "j").cogroup(right.groupBy("cell", "i", "j")).applyInPandas(tiled(cosine), "rep long, n long, b long"))
    links = found.where("n > 0").groupBy("rep").agg(F.sum("n").alias("n"))
    labels = components(found.where("rep != b").select(F.col("rep").alias("a"), "b"), scratch)
    of_class = classes.join(links, "rep", "left").join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("v", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("label", "rep").alias("component_id"))
    of_class = scratch.keep(of_class)
    linked = good.join(of_class, "v").groupBy("vec_id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    scratch.only(good, of_class)
    out = ids.join(linked, "vec_id", "left")
    c = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), c.alias("component_id"), F.coalesce(c == F.col("vec_id"), F.lit(False)).alias("kept"))


def op10_metric_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
