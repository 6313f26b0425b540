"""Approximate nearest neighbours by multi-index hashing of learned rotated binary codes.

Largest inner products become smallest angles: a row x gets one more coordinate sqrt(M^2 - |x|^2), with M the largest norm, a
query a zero. Codes are signs of several rotations, each learned on a bounded sample by alternating between signs and the
orthogonal matrix that fits them best. A code of b bits is cut into bytes, each indexed: for a Hamming radius r, byte i
is probed within t_i bits where the t_i + 1 add up to r + 1, so by the pigeonhole principle every code within r is retrieved.
Those retrieved are checked on all bits and reranked on the original vectors in double precision.

The radius comes from the sample: it covers ``cover`` of the pairs that are as near there as the k nearest are in the whole
table. A query that finds fewer than k in a block widens its radius there. Every row is indexed. Blocks of rows and
blocks of queries have bounded size and meet by their numbers; a query's best of each block are merged.

Defined results: vectors that are null, zero, of another length than most have, or hold null or non-finite components, and null ids, take no part; repeated
rows of an id are one, its smallest vector in order; ties go to the smaller vec_id; an empty table, or a query without candidates, gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.llm.common import sampled, table
from factloom.llm.vectors import stacked, usable
from factloom.session import Scratch, ship

ROWS, ASKING = 8192, 2048  # in a block of rows, of queries
OUT = "query_id long, vec_id long, score double"
NEAR = np.bitwise_count(np.arange(256, dtype=np.uint8)[:, None] ^ np.arange(256, dtype=np.uint8)[None])


def lifted(x: np.ndarray, most: float) -> np.ndarray:
    """Rows with the coordinate that makes all norms ``most``."""
    return np.concatenate([x, np.sqrt(np.maximum(most * most - (x * x).sum(1, keepdims=True), 0))], 1)


def rotations(x: np.ndarray, bits: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    """d x bits: learned rotations of the (zero-padded) sample, side by side."""
    g, d, out = np.random.default_rng(seed), x.shape[1], []
    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    while sum(m.shape[1] for m in out) < bits:
        r = np.linalg.qr(g.standard_normal((d, d)))[0]
        for _ in range(rounds):
            u, _, vt = np.linalg.svd(x.T @ np.sign(x @ r))
            r = u @ vt
        out.append(r)
    return np.concatenate(out, 1)[:, :bits]


def codes(x: np.ndarray, r: np.ndarray) -> np.ndarray:
    return np.packbits(x @ r > 0, axis=1)


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a.view(np.uint64) ^ b.view(np.uint64)).sum(-1, dtype=np.int32)


def radius(x: np.ndarray, r: np.ndarray, most: float, n: int, k: int, cover: float) -> int:
    """The Hamming radius that covers so large a share of the sample's nearest pairs, at the rank that k of n rows are there."""
    c, q = codes(lifted(x, most), r), codes(np.pad(x, ((0, 0), (0, 1))), r)
    rank, far = int(np.clip(round(k * len(x) / max(1, n)), 1, max(1, len(x) - 1))), []
    for lo in range(0, len(x), 512):
        ask = np.arange(lo, min(lo + 512, len(x)))
        ip = x[ask] @ x.T
        ip[np.arange(len(ask)), ask] = -np.inf
        near = np.argpartition(-ip, min(rank, len(x) - 1), axis=1)[:, :rank]
        far.append(hamming(q[ask][:, None], c[near]).ravel())
    return int(np.quantile(np.concatenate(far), cover))


def budgets(r: int, parts: int) -> np.ndarray:
    """Bits allowed in each substring: the sums of one more are r + 1; -1 for one not probed."""
    low, more = divmod(r + 1, parts)
    return np.minimum(np.array([low + (i < more) for i in range(parts)]) - 1, 8)


class Index:
    """Bitmaps of a block's rows by the value of each byte of their codes, and their unions over balls."""

    def __init__(self, c: np.ndarray):
        self.c, self.n = c, len(c)
        self.maps = [np.packbits(c[:, i][None] == np.arange(256, dtype=np.uint8)[:, None], axis=1) for i in range(c.shape[1])]
        self.balls: dict[tuple[int, int, int], np.ndarray] = {}

    def ball(self, i: int, value: int, t: int) -> np.ndarray:
        key = (i, value, t)
        if key not in self.balls:
            self.balls[key] = np.bitwise_or.reduce(self.maps[i][NEAR[value] <= t], axis=0)
        return self.balls[key]

    def within(self, code: np.ndarray, r: int) -> np.ndarray:
        """Rows within Hamming radius r, by probing every substring's buckets."""
        hit = np.bitwise_or.reduce([self.ball(i, int(code[i]), int(t)) for i, t in enumerate(budgets(r, len(code))) if t >= 0], axis=0)
        at = np.flatnonzero(np.unpackbits(hit, count=self.n))
        return at[hamming(self.c[at], code[None]) <= r]


def searched(rot: np.ndarray, most: float, r: int, k: int):
    bits = rot.shape[1]

    def each(key: tuple, rows: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        out: list[pd.DataFrame] = []
        if len(rows) and len(ask):
            rows = rows.sort_values("vec_id")
            ids, x, q = rows["vec_id"].to_numpy(), stacked(rows["v"]), stacked(ask["v"])
            index = Index(codes(lifted(x, most), rot))
            for who, v, code in zip(ask["vec_id"].to_numpy(), q, codes(np.pad(q, ((0, 0), (0, 1))), rot), strict=True):
                now = r
                at = index.within(code, now)
                while len(at) < min(k + 1, len(ids)) and now < bits:
                    now = min(bits, now + max(4, bits // 32))
                    at = index.within(code, now)
                at = at[ids[at] != who]
                score = (x[at] * v).sum(1)
                best = np.lexsort((ids[at], -score))[:k]
                out.append(pd.DataFrame({"query_id": who, "vec_id": ids[at][best], "score": score[best]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})

    return each


def nearest(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", every: int = 20, k: int = 20, bits: int = 256, sample: int = 4096, cover: float = 0.985) -> DataFrame:
    """The k nearest rows by inner product of each row whose id is divisible by ``every``."""
    spark = df.sparkSession
    ship(spark)
    scratch = Scratch(spark, "mih")
    rows = scratch.keep(usable(df, id_col, vec_col).groupBy("vec_id").agg(F.min("v").alias("v")))
    asks = rows.where(F.pmod("vec_id", F.lit(every)) == 0)
    n, asked, norm = rows.agg(F.count("*"), F.sum((F.pmod("vec_id", F.lit(every)) == 0).cast("long")), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).first()
    if not n or not asked:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    some = sampled(rows, sample, "vec_id", n=n).toPandas().sort_values("vec_id")
    x, most = stacked(some["v"]), float(np.sqrt(norm))
    rot = rotations(lifted(x, most), bits)
    r = radius(x, rot, most, n, k, cover) if len(x) > 1 else bits
    nb, nq = -(-n // ROWS), -(-asked // ASKING)
    place = lambda count, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(count)).cast("int")
    left = rows.withColumn("b", place(nb, 1)).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(nq - 1))))
    right = asks.withColumn("q", place(nq, 2)).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(nb - 1))))
    found = left.groupBy("b", "q").cogroup(right.groupBy("b", "q")).applyInPandas(searched(rot, most, r, k), OUT)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
