"""Strongly connected components, their order, and what can be merged before a flow is solved.

``strong_components`` trims nodes without predecessors or successors, then colours: each node takes the greatest node that reaches it, and a
colour's own node collects, backwards and within the colour, its component. What is left goes round again. All steps are joins and
aggregates over the edges; no component is gathered. Rounds follow the longest path among nodes left, not the number of nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators.chains import doubled
from factloom.operators.fixpoint import NotConverged, fixpoint, lattice_fixpoint, union
from factloom.operators.graph import topological_levels
from factloom.session import Scratch


def strong_components(edges: DataFrame, nodes: DataFrame | None = None, max_rounds: int = 10_000) -> DataFrame:
    """(node, comp, size, cyclic): each node's component, named by its greatest node. Edges (src, tgt); self-loops make a component cyclic."""
    scratch = Scratch(edges.sparkSession, "components")
    e = scratch.keep(edges.select("src", "tgt").distinct())
    ends = e.select(F.col("src").alias("node")).union(e.select(F.col("tgt").alias("node")))
    every = scratch.keep((ends if nodes is None else ends.union(nodes.select("node"))).distinct())
    left, done, work = every, [], scratch.keep(e.where("src <> tgt"))
    for _ in range(max_rounds):
        # trim: nodes on no cycle that still show it at once
        inner = scratch.keep(left.join(work.select(F.col("src").alias("node")).distinct(), "node", "left_semi").join(work.select(F.col("tgt").alias("node")).distinct(), "node", "left_semi"))
        alone = scratch.keep(left.join(inner, "node", "left_anti").select("node", F.col("node").alias("comp")))
        done.append(alone)
        if inner.isEmpty():
            break
        work = scratch.keep(_within(work, inner))
        if not alone.isEmpty():
            left = inner
            continue
        found = scratch.keep(_coloured(inner, work))
        done.append(found)
        left = scratch.keep(inner.join(found, "node", "left_anti"))
        work = scratch.keep(_within(work, left))
        if left.isEmpty():
            break
    else:
        raise NotConverged(f"no components in {max_rounds} rounds")
    comp = scratch.keep(union(done))
    size = comp.groupBy("comp").agg(F.count("*").alias("size"))
    loops = e.where("src = tgt").select(F.col("src").alias("node"), F.lit(True).alias("own"))
    out = scratch.keep(comp.join(size, "comp").join(loops, "node", "left").select("node", "comp", "size", ((F.col("size") > 1) | F.coalesce("own", F.lit(False))).alias("cyclic")))
    scratch.only(out)
    return out


def _within(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    n = nodes.select("node")
    return edges.join(n.withColumnRenamed("node", "src"), "src", "left_semi").join(n.withColumnRenamed("node", "tgt"), "tgt", "left_semi").select("src", "tgt")


def _coloured(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, comp) of the components that hold their colour's own node; at least one."""

    def raised(d: DataFrame, known: DataFrame) -> DataFrame:
        offer = d.join(edges, F.col("node") == F.col("src")).groupBy(F.col("tgt").alias("node")).agg(F.max("colour").alias("offer"))
        now = known.groupBy("node").agg(F.max("colour").alias("colour"))
        return offer.join(now, "node").where("offer > colour").select("node", F.col("offer").alias("colour"), F.lit(True).alias("rose"))

    colour = lattice_fixpoint(nodes.select("node", F.col("node").alias("colour")), ["node"], {"colour": F.max}, raised).select("node", "colour")
    same = edges.join(colour.select(F.col("node").alias("src"), F.col("colour").alias("c")), "src").join(colour.select(F.col("node").alias("tgt"), F.col("colour").alias("tc")), "tgt").where("c = tc").select(F.col("src").alias("to"), F.col("tgt").alias("node"), F.col("c").alias("comp"))
    same = Scratch(nodes.sparkSession, "colours").keep(same)
    return fixpoint(colour.where("node = colour").select("node", F.col("colour").alias("comp")), lambda d, _: d.join(same, ["node", "comp"]).select(F.col("to").alias("node"), "comp"))


def condensation(edges: DataFrame, comp: DataFrame) -> DataFrame:
    """(src, tgt): distinct edges between different components."""
    a, b = comp.select(F.col("node").alias("src"), F.col("comp").alias("a")), comp.select(F.col("node").alias("tgt"), F.col("comp").alias("b"))
    return edges.select("src", "tgt").join(a, "src").join(b, "tgt").where("a <> b").select(F.col("a").alias("src"), F.col("b").alias("tgt")).distinct()


def component_order(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node, comp, size, cyclic, level): callees before callers when edges go from caller to callee: level 0 calls nothing outside its
    component, any other is one above the highest that it calls."""
    comp = strong_components(edges, nodes)
    between = condensation(edges, comp)
    level = topological_levels(between.select(F.col("tgt").alias("src"), F.col("src").alias("tgt")))
    return comp.join(level.withColumnRenamed("node", "comp"), "comp", "left").select("node", "comp", "size", "cyclic", F.coalesce("level", F.lit(0).cast("long")).alias("level"))


STRAIGHT = 8  # links of a chain that are followed one by one, each round over what is left only


def followers(copy: DataFrame, sources: DataFrame) -> DataFrame:
    """(node, root): a node whose one inflow is a copy edge holds what the root of its chain holds. copy: (src, tgt); ``sources`` (node) have
    other inflows and stay. Members of a cycle that nothing flows into hold nothing; their root is null."""
    return merged(copy, sources)[0]


def merged(copy: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The followers, and the copy edges (src, tgt) into all other nodes."""
    scratch = Scratch(copy.sparkSession, "followers")
    edges = copy.where("src <> tgt")
    into = edges.groupBy(F.col("tgt").alias("node")).agg(F.min("src").alias("up"), F.max("src").alias("last"))
    into = scratch.keep(into.join(sources.select("node").distinct().withColumn("fed", F.lit(True)), "node", "left").select("node", "up", F.col("fed").isNotNull().alias("fed"), (F.col("up") == F.col("last")).alias("one")))
    many = edges.join(into.where("not one").select(F.col("node").alias("tgt")), "tgt", "left_semi").select("src", "tgt")
    return _roots(into.where("one and not fed").select("node", "up"), scratch), into.where("one and fed").select(F.col("up").alias("src"), F.col("node").alias("tgt")).union(many)


def _roots(up: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) of the chains (node, up). The first links are followed from the roots on; what is left of longer chains is doubled,
    so that rounds follow the logarithm of the longest."""
    root = F.col("root")
    now = scratch.keep(up.join(up.select(F.col("node").alias("up"), F.lit(True).alias("inner")), "up", "left").select("node", "up", F.when(F.col("inner").isNull(), F.col("up")).alias("root")))
    done: list[DataFrame] = []
    for _ in range(STRAIGHT):
        last, left = now.where(root.isNotNull()).select("node", "root"), now.where(root.isNull()).select("node", "up")
        done.append(last)
        if left.isEmpty():
            return union(done)
        now = scratch.keep(left.join(last.withColumnRenamed("node", "up"), "up", "left").select("node", "up", "root"))
    last, left = now.where(root.isNotNull()).select("node", "root"), now.where(root.isNull()).select("node", "up")
    ends = doubled(left, scratch).join(last.select(F.col("node").alias("end"), "root"), "end", "left").select("node", "root")
    return union([*done, last, scratch.keep(ends)])
