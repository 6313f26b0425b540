"""Chains of scopes and the variables stored in them, as relations.

A scope sees its own names and those of the scopes around it, the nearest first; names of a class are seen by the class itself only. A chain has a row
for each scope and scope around it, found by doubling: rounds grow with the logarithm of the nesting. A lookup is an equi-join on (scope
around, name) and one aggregate, so no group holds more than a name's holders around one scope.

Memory has one value for a context, scope and name. A context without a value of its own sees what the chain holds without a context.
Rows with a null in their key are never found and hold nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions import abstract as av
from factloom.operators.fixpoint import union
from factloom.session import Scratch

KEY = ["ctx", "scope", "name"]
VALUE = list(av.MERGE)


def chains(scopes: DataFrame) -> DataFrame:
    """(scope, around, depth, seen) from (scope, parent, kind): the scopes around each, itself at 0. Parents that aren't scopes end a chain; a
    scope that is around itself raises."""
    scratch = Scratch(scopes.sparkSession, "chains")
    known = scratch.keep(scopes.where("scope is not null").select("scope", "parent", "kind").distinct())
    hop = scratch.keep(known.join(known.select(F.col("scope").alias("parent")), "parent").select("scope", F.col("parent").alias("up")))
    parts, step, most = [known.select("scope", F.col("scope").alias("around"), F.lit(0).cast("long").alias("depth"))], 1, known.count()
    while not hop.isEmpty():
        if step > most:
            raise ValueError("a scope is around itself")
        above = hop.select(F.col("scope").alias("around"), "up")
        parts.append(scratch.keep(union(parts).join(above, "around").select("scope", F.col("up").alias("around"), (F.col("depth") + step).alias("depth"))))
        hop, step = scratch.keep(hop.join(hop.select(F.col("scope").alias("up"), F.col("up").alias("far")), "up").select("scope", F.col("far").alias("up"))), 2 * step
    kinds = known.select(F.col("scope").alias("around"), "kind")
    return scratch.keep(union(parts).join(kinds, "around").select("scope", "around", "depth", ((F.col("depth") == 0) | F.coalesce(F.col("kind") != "class", F.lit(True))).alias("seen")))


def lookup(wanted: DataFrame, chain: DataFrame, held: DataFrame) -> DataFrame:
    """(scope, name, holder, ...held's other columns): the nearest scope that holds each wanted (scope, name). held: (scope, name, ...), one row for each.
    Names that no scope in sight holds have no row."""
    more = [c for c in held.columns if c not in ("scope", "name")]
    at = wanted.select("scope", "name").distinct().join(chain.where("seen").select("scope", "around", "depth"), "scope")
    hit = at.join(held.withColumnRenamed("scope", "around"), ["around", "name"])
    near = hit.groupBy("scope", "name").agg(F.min_by(F.struct("around", *more), "depth").alias("x"))
    return near.select("scope", "name", F.col("x.around").alias("holder"), *[F.col("x")[c].alias(c) for c in more])


def get(memory: DataFrame, chain: DataFrame, wanted: DataFrame) -> DataFrame:
    """(ctx, scope, name, holder, types, lo, hi): what each wanted (ctx, scope, name) sees. memory: (ctx, scope, name, types, lo, hi)."""
    wanted = wanted.select(*KEY).distinct()
    own = wanted.join(memory, KEY).select(*KEY, F.col("scope").alias("holder"), *VALUE)
    rest = wanted.join(memory.select(*KEY), KEY, "left_anti")
    far = lookup(rest, chain, memory.where("ctx = ''").select("scope", "name", *VALUE))
    return own.union(rest.join(far, ["scope", "name"]).select(*KEY, "holder", *VALUE))


def joined(rows: DataFrame) -> DataFrame:
    """One value for each key."""
    return rows.groupBy(*KEY).agg(*[f(c).alias(c) for c, f in av.MERGE.items()])


def put(memory: DataFrame, rows: DataFrame) -> DataFrame:
    """Memory after the rows are stored: they replace what their key held; several rows of one key are joined."""
    return memory.select(*KEY, *VALUE).join(rows.select(*KEY).distinct(), KEY, "left_anti").union(joined(rows).select(*KEY, *VALUE))


def merge(memory: DataFrame, chain: DataFrame, rows: DataFrame) -> DataFrame:
    """Memory after the rows are joined with what their keys see, which is stored under the keys themselves."""
    return put(memory, rows.select(*KEY, *VALUE).union(get(memory, chain, rows).select(*KEY, *VALUE)))
