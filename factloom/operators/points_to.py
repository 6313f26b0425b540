"""Inclusion-based points-to analysis without contexts: allocation, copy, field load and store, subscripts.

Nodes are (node, field): a variable has field '', an object's field its name. Rules, to the least fixpoint:

    pts(t, '', o)  <- alloc(t, o)
    pts(t, '', x)  <- copy(s, t), pts(s, '', x)
    pts(o, f, x)   <- store(b, f, s), pts(b, '', o), pts(s, '', x)
    pts(t, '', x)  <- load(b, f, t), pts(b, '', o), pts(o, f, x)

Subscripts are fields: a constant key k is ``[k]``, any other ``[]``; loads of a key read ``[]`` too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators.chains import BOTH, FED, FLOWN, Chains, chains
from factloom.operators.fixpoint import fixpoint, union
from factloom.session import Scratch


def subscripts(df: DataFrame, key: str = "key") -> DataFrame:
    """Rows of a subscript access (key null: unknown) as rows with a field; a load of a known key gets both fields."""
    return df.withColumn("field", F.when(F.col(key).isNull(), "[]").otherwise(F.concat(F.lit("["), F.col(key), F.lit("]"))))


def with_unknown_elements(load: DataFrame) -> DataFrame:
    """Loads of a known key read the elements stored under unknown keys too."""
    return load.union(load.where("field like '[%' and field <> '[]'").withColumn("field", F.lit("[]")).select(*load.columns)).distinct()


def points_to(alloc: DataFrame, copy: DataFrame, load: DataFrame | None = None, store: DataFrame | None = None, widen: int | None = None, max_rounds: int = 10_000, log: list | None = None) -> DataFrame:
    """(node, field, obj). alloc(node, obj), copy(src, tgt), load(base, field, tgt), store(base, field, src).

    Variables whose one inflow is a copy are solved as the root of their chain and get its rows at the end.
    ``widen``: variables whose sets exceed that size at the end get one object -1 instead (TOP).
    """
    pts, chained = _ends(alloc, copy, load, store, max_rounds, log)
    pts = pts.where("field <> ''").union(chained.down(pts.where("field = ''"), FED, FLOWN, BOTH))
    if widen is None:
        return pts
    big = pts.groupBy("node", "field").agg(F.count("*").alias("n")).where(F.col("n") > widen).select("node", "field")
    top = big.select("node", "field", F.lit(-1).cast(dict(pts.dtypes)["obj"]).alias("obj"))
    return pts.join(big, ["node", "field"], "left_anti").select("node", "field", "obj").union(top)


def set_sizes(alloc: DataFrame, copy: DataFrame) -> DataFrame:
    """(node, n): the sizes of the sets of ``points_to``, of variables that hold something. They are counted where chains end; no set is expanded."""
    pts, chained = _ends(alloc, copy, None, None, 10_000, None)
    return chained.down(Scratch(alloc.sparkSession, "sizes").keep(pts.groupBy("node").agg(F.count("*").alias("n"))), FED, FLOWN, BOTH)


def _ends(alloc: DataFrame, copy: DataFrame, load: DataFrame | None, store: DataFrame | None, max_rounds: int, log: list | None) -> tuple[DataFrame, Chains]:
    """The rows of nodes that end chains, and the chains."""
    scratch = Scratch(alloc.sparkSession, "fields")
    others = alloc.select("node") if load is None else alloc.select("node").union(load.select("tgt"))
    chained = chains(copy, others)
    same = chained.followers()
    named = lambda d, c: d.join(same.select(F.col("node").alias(c), F.col("root").alias("_root"), F.lit(True).alias("_same")), c, "left").withColumn(c, F.when(F.col("_same"), F.col("_root")).otherwise(F.col(c))).where(F.col(c).isNotNull()).drop("_root", "_same")
    copy = scratch.keep(named(chained.rest, "src").select("src", "tgt").distinct())
    load = load if load is None else scratch.keep(named(load, "base").select("base", "field", "tgt").distinct())
    store = store if store is None else scratch.keep(named(named(store, "base"), "src").select("base", "field", "src").distinct())
    init = alloc.select("node", F.lit("").alias("field"), "obj")
    move = copy.select(F.col("src").alias("node"), "tgt")
    edges: dict[str, list[DataFrame]] = {"store": [], "load": []}

    def resolved(kind: str, new: DataFrame) -> tuple[DataFrame, DataFrame | None]:
        """Field edges (o, f, v) that this round's variables give, and those of the rounds before: a base that holds o reads or feeds o's field f."""
        old = edges[kind]
        if len(old) > 8:  # no plan reads the parts any more: the round before is written
            one = scratch.keep(union(old))
            scratch.drop(*old)
            old[:] = [one]
        before = union(old) if old else None
        new = scratch.keep(new.distinct())
        old.append(new)
        return new, before

    def step(d: DataFrame, known: DataFrame) -> DataFrame:
        """New edges meet all that is known, older ones only what is new."""
        dv, kv = d.where("field = ''"), known.where("field = ''")
        out = [dv.join(move, "node").select(F.col("tgt").alias("node"), "field", "obj")]
        bases = dv.select(F.col("node").alias("base"), F.col("obj").alias("o"))
        if store is not None:
            new, old = resolved("store", bases.join(store, "base").select("o", F.col("field").alias("f"), F.col("src").alias("v")))
            for e, values in ((new, kv), (old, dv)):
                if e is not None:
                    out.append(e.join(values.select(F.col("node").alias("v"), F.col("obj").alias("x")), "v").select(F.col("o").alias("node"), F.col("f").alias("field"), F.col("x").alias("obj")))
        if load is not None:
            df, kf = (x.where("field <> ''").select(F.col("node").alias("o"), F.col("field").alias("f"), F.col("obj").alias("x")) for x in (d, known))
            new, old = resolved("load", bases.join(load, "base").select("o", F.col("field").alias("f"), F.col("tgt").alias("v")))
            for e, values in ((new, kf), (old, df)):
                if e is not None:
                    out.append(e.join(values, ["o", "f"]).select(F.col("v").alias("node"), F.lit("").alias("field"), F.col("x").alias("obj")))
        return union(out)

    return fixpoint(init, step, max_rounds, log=log), chained


def first_base_wins(flow: DataFrame) -> DataFrame:
    """Inherited fields: of (node, priority, obj) keep each node's rows of its smallest priority that has any."""
    least = flow.groupBy("node").agg(F.min("priority").alias("priority"))
    return flow.join(least, ["node", "priority"], "left_semi").select("node", "obj").distinct()


def guarded(flow: DataFrame, keep) -> DataFrame:
    """A guard on the flow: only objects for which the condition holds pass."""
    return flow.where(keep)


def flow_statistics(copy: DataFrame, pts: DataFrame) -> DataFrame:
    """(src, tgt, flow): objects that pass each copy edge; 0 for dead edges."""
    return flow_of_sizes(copy, pts.where("field = ''").groupBy("node").agg(F.count("*").alias("n")))


def flow_of_sizes(copy: DataFrame, sizes: DataFrame) -> DataFrame:
    """The same from (node, n). Edges are dealt by src once, for telling them apart and for the join."""
    n = sizes.select(F.col("node").alias("src"), F.col("n").alias("flow"))
    return copy.repartition("src").distinct().join(n, "src", "left").select("src", "tgt", F.coalesce("flow", F.lit(0).cast("long")).alias("flow"))
