"""What the text operators share: batches in and out, hashing, components of a link graph."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from contextlib import suppress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.session import Scratch, ship

U64 = np.uint64
MASK = (1 << 64) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Remembered(dict):
    """Values of words, each computed once and remembered up to about ``most`` bytes; then all are forgotten. Long words are never kept."""

    def __init__(self, of: Callable, most: int = 24_000_000, each: int = 200):
        super().__init__()
        self.of, self.most, self.each, self.held = of, most, each, 0

    def __missing__(self, word):
        x = self.of(word)
        if len(word) < 64:
            self.held += len(word) + self.each
            if self.held > self.most:
                self.clear()
                self.held = len(word) + self.each
            self[word] = x
        return x


def tidy() -> None:
    """Give a worker's freed memory back to the system: workers are reused, and what one operator leaves would add to the next one's."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def tidied(each: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    def run(batches: Iterator) -> Iterator:
        try:
            yield from each(batches)
        finally:
            gc.enable()
            tidy()

    return run


def mapped(df: DataFrame, each: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with this package shipped to the executors; a worker gives memory back at the end of each partition."""
    ship(df.sparkSession)
    return df.mapInArrow(tidied(each), schema)


def filtered(df: DataFrame, text_col: str, keep: Callable[[Iterator[pa.Array]], Iterator[pa.Array]]) -> DataFrame:
    """Rows for which ``keep`` says true of the text (null: empty). Only texts go to the Python worker, and only flags come back."""
    ship(df.sparkSession)

    @F.arrow_udf("boolean")
    def flags(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from tidied(keep)(batches)

    return df.where(flags(F.col(text_col).cast("string")))


def bucket10(id_col: str, n: int) -> Column:
    """crc32 of the id's decimal text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % F.lit(n)


def sampled(df: DataFrame, about: int, *keys: str, n: int | None = None, but: Column | None = None) -> DataFrame:
    """About so many of the rows (those with ``but``, of which there are n), the same ones for the same rows, by hash of the key columns;
    twice as many at most. No task sends more than its share."""
    n = df.count() if n is None else n
    if n > about:
        df = df.where(F.pmod(F.xxhash64(*keys, F.lit(17)), F.lit(1 << 40)) < F.lit(int(about * (1 << 40) / n)))
    return (df if but is None else df.where(but)).limit(2 * about)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64, elementwise."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def components(edges: DataFrame, scratch: Scratch, most: int = 60) -> DataFrame:
    """Connected components of undirected edges (a long, b long) by alternating large-star and small-star.

    Returns (node, label) for every node with an edge, label the smallest node reachable. Each round is two
    shuffles with per-node minima; no neighbourhood is gathered. Raises if rounds run out.
    """
    e = scratch.keep(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    tasks = max(8, -(-e.count() // 100_000))  # no round has more than a few rows for each edge
    last = None
    for _ in range(most):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = scratch.keep(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), tasks=tasks)
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = scratch.keep(large.where("u != v").distinct(), tasks=tasks)
        low2 = scratch.keep(large.groupBy("u").agg(F.min("v").alias("m")), tasks=tasks)
        small = large.join(low2, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v")
        new = scratch.keep(small.where("u != v").distinct(), tasks=tasks)
        mark = new.coalesce(tasks).agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        scratch.drop(e, low, large, low2)
        e = new
        if mark == last:
            break
        last = mark
    else:
        raise RuntimeError(f"components did not settle in {most} rounds")
    roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("label"))
    return scratch.keep(e.select(F.col("u").alias("node"), F.col("v").alias("label")).union(roots), tasks=tasks)
