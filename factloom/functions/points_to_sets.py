"""Algebra of points-to sets held as rows (node, obj)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("node", "obj").union(b.select("node", "obj")).distinct()


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("node", "obj").distinct().join(b.select("node", "obj").distinct(), ["node", "obj"], "left_semi")


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("node", "obj").distinct().join(b.select("node", "obj"), ["node", "obj"], "left_anti")


def may_alias(pts: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (a, b) with may_alias: whether their sets share an object."""
    own = lambda c: pts.select(F.col("node").alias(c), "obj")
    hit = pairs.join(own("a"), "a").join(own("b"), ["b", "obj"]).select("a", "b").distinct().withColumn("may_alias", F.lit(True))
    return pairs.distinct().join(hit, ["a", "b"], "left").select("a", "b", F.coalesce("may_alias", F.lit(False)).alias("may_alias"))


def singletons(pts: DataFrame) -> DataFrame:
    """Nodes (node) with one object: those that allow strong updates."""
    return pts.groupBy("node").agg(F.count("obj").alias("n")).where("n = 1").select("node")


def size_classes(pts: DataFrame, nodes: DataFrame) -> DataFrame:
    """(size_class, n): nodes by the size of their sets: 0, 1, 2-5, 6-10, 11-50, 51+."""
    n = nodes.select("node").distinct().join(pts.groupBy("node").agg(F.count("obj").alias("k")), "node", "left").select(F.coalesce("k", F.lit(0)).alias("k"))
    k = F.col("k")
    return n.groupBy(F.when(k == 0, "0").when(k == 1, "1").when(k <= 5, "2-5").when(k <= 10, "6-10").when(k <= 50, "11-50").otherwise("51+").alias("size_class")).agg(F.count("*").alias("n"))


def statistics(pts: DataFrame, nodes: DataFrame, large: int = 10) -> DataFrame:
    """One row: nodes, objects, average and greatest size, empty, singleton and large sets."""
    n = nodes.select("node").distinct().join(pts.groupBy("node").agg(F.count("obj").alias("k")), "node", "left").select(F.coalesce("k", F.lit(0)).alias("k"))
    objects = pts.select("obj").distinct().select(F.lit(None).cast("long").alias("k"))
    rows = n.select(F.col("k").cast("long").alias("k"), F.lit(0).alias("o")).union(objects.select("k", F.lit(1)))
    count = lambda c: F.sum(F.when(c & (F.col("o") == 0), 1).otherwise(0))
    k = F.col("k")
    return rows.agg(count(F.lit(True)).alias("nodes"), F.avg("k").alias("avg_size"), F.max("k").alias("max_size"), count(k == 0).alias("empty"), count(k == 1).alias("singletons"), count(k > large).alias("large"), F.sum("o").alias("objects"))
