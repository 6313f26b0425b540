"""Chains of nodes with one inflow, contracted where they lie.

A node with edges from one node only, which isn't among the sources, is an inner node; every other node ends chains. Rows are dealt by ranges of nodes and
sorted, so that a batch holds nodes that lie near each other; links inside a batch are followed there, and only chains that leave it are joined.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.session import Scratch, ship

# An inner node by what its chain's end has: nothing, being a source, inflows, both; OPEN: the head lies in another batch. Nodes with inflows that end chains.
FREE, FED, FLOWN, BOTH, OPEN, ENTERED, MANY, MANY_FED = range(8)
CUT = 64  # links of a chain whose nodes a row lists at most, before others are joined to it
SMALL = 200_000  # so many heads are sent to all tasks


def follow(b: pa.RecordBatch, paths: bool) -> pa.RecordBatch:
    """(node, head, state) of a batch's nodes with an inflow, and above with ``paths``: the nodes over an inner one up to its head, nearest first."""
    node, up, last = b.column("node"), b.column("up"), b.column("last")
    fed, some, n = b.column("fed").to_numpy(zero_copy_only=False), up.is_valid().to_numpy(zero_copy_only=False), b.num_rows
    many = some & ~pc.fill_null(pc.equal(up, last), True).to_numpy(zero_copy_only=False)
    inner, here = some & ~many & ~fed, np.arange(n)
    at = pc.fill_null(pc.index_in(up, value_set=node, skip_nulls=True), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    at[~inner] = -1

    def stops() -> tuple[np.ndarray, np.ndarray]:
        jump, links = np.where(at >= 0, at, here), (at >= 0).astype(np.int64)
        for _ in range(n.bit_length()):
            links, jump = np.minimum(links + links[jump], n + 1), jump[jump]
        return jump, links

    stop, links = stops()
    around = at[stop] >= 0  # a cycle, or behind one: left to the joins
    cut = around | ((links > 0) & (links % CUT == 0)) if paths else around
    if cut.any():
        at[cut] = -1
        stop, _ = stops()
    closed = ~inner[stop]
    head = pc.if_else(pa.array(inner & closed), node.take(pa.array(stop)), up.take(pa.array(stop)))
    head = pc.if_else(pa.array(many), pa.scalar(None, head.type), head)
    state = np.where(inner, np.where(closed, fed[stop] + 2 * some[stop], OPEN), np.where(many, np.where(fed, MANY_FED, MANY), ENTERED))
    out = {"node": node, "head": head, "state": pa.array(state.astype(np.int32))}
    if paths:
        onward = np.where((at >= 0) & inner[at], at, -1)
        own = row = here[inner]
        owners, rows = [own], [row]
        while len(row):
            own, row = own[onward[row] >= 0], onward[row][onward[row] >= 0]
            owners.append(own)
            rows.append(row)
        own, row = np.concatenate(owners), np.concatenate(rows)
        offsets = np.concatenate([[0], np.cumsum(np.bincount(own, minlength=n))]).astype(np.int32)
        out["above"] = pa.ListArray.from_arrays(pa.array(offsets), up.take(pa.array(row[np.argsort(own, kind="stable")])))
    return pa.RecordBatch.from_pydict(out).filter(pa.array(some))


@dataclass
class Chains:
    """near(node, head, state[, above]); far(head, root[, above]) of heads in other batches that are inner nodes themselves, root null on a cycle and behind
    one; rest(src, tgt): the edges into nodes that end chains."""

    near: DataFrame
    far: DataFrame | None
    rest: DataFrame

    def with_far(self, rows: DataFrame) -> DataFrame:
        """Rows of near with the end of the chain as root, null for cycles; nodes above go on to it."""
        listed = "above" in rows.columns
        if self.far is None:
            return rows.withColumn("root", F.col("head"))
        far = self.far.select("head", F.col("root").alias("_root"), F.lit(True).alias("_far"), *([F.col("above").alias("_above")] if listed else []))
        out = rows.where(F.col("state") == OPEN).join(far, "head", "left").withColumn("root", F.when(F.col("_far"), F.col("_root")).otherwise(F.col("head")))
        if listed:
            out = out.withColumn("above", F.when(F.col("_above").isNull(), F.col("above")).otherwise(F.concat("above", "_above")))
        return out.select(*rows.columns, "root").union(rows.where(F.col("state") != OPEN).select(*rows.columns, F.col("head").alias("root")))

    def followers(self) -> DataFrame:
        """(node, root) of inner nodes."""
        return self.with_far(self.near.where(F.col("state") <= OPEN).select("node", "head", "state")).select("node", "root")

    def down(self, rows: DataFrame, *states: int) -> DataFrame:
        """Rows with a node, which ends chains, for all inner nodes behind it too whose end has one of the states; OPEN ones always."""
        cols = [c for c in rows.columns if c != "node"]
        of_head = rows.select(F.col("node").alias("head"), *cols)
        if self.far is not None:
            of_head = of_head.union(rows.join(self.far.select("head", F.col("root").alias("node")), "node").select("head", *cols))
        return rows.union(self.near.where(F.col("state").isin(*states, OPEN)).select("node", "head").join(of_head, "head").select(*rows.columns))


def chains(edges: DataFrame, sources: DataFrame, paths: bool = False) -> Chains:
    """The chains of edges (src, tgt), self-loops apart, numbers or strings. ``sources`` (node) end chains whatever flows into them."""
    ship(edges.sparkSession)
    scratch = Scratch(edges.sparkSession, "chains")
    kind = dict(edges.dtypes)["tgt"]
    e, none = edges.where("src <> tgt"), F.lit(None).cast(kind)
    every = e.select(F.col("tgt").alias("node"), F.col("src").alias("up"), F.lit(False).alias("fed")).union(sources.select("node", none, F.lit(True))).union(e.select("src", none, F.lit(False)))
    dealt = every.repartitionByRange("node").groupBy("node").agg(F.min("up").alias("up"), F.max("up").alias("last"), F.max("fed").alias("fed")).sortWithinPartitions("node")
    schema = f"node {kind}, head {kind}, state int" + (f", above array<{kind}>" if paths else "")
    near = scratch.keep(dealt.mapInArrow(lambda batches: (follow(b, paths) for b in batches if b.num_rows), schema))
    rest = near.where(F.col("state") == ENTERED).select(F.col("head").alias("src"), F.col("node").alias("tgt"))
    many = near.where(F.col("state") >= MANY).select(F.col("node").alias("tgt"))
    if not many.isEmpty():
        rest = rest.union(e.join(many, "tgt", "left_semi").select("src", "tgt").distinct())
    return Chains(near, _far(near, scratch), rest)


def _far(near: DataFrame, scratch: Scratch) -> DataFrame | None:
    heads = scratch.keep(near.where(F.col("state") == OPEN).select(F.col("head").alias("node")).distinct())
    n = heads.count()
    if not n:
        return None
    links = scratch.keep(near.where(F.col("state") <= OPEN).join(F.broadcast(heads) if n <= SMALL else heads, "node", "left_semi").select(*near.columns))
    ends = scratch.keep(doubled(links.select("node", F.col("head").alias("up")), scratch))
    if "above" not in near.columns:
        return ends.select(F.col("node").alias("head"), F.col("end").alias("root"))
    straight = ends.where("end is not null")
    lists = scratch.keep(links.join(straight, "node").select("node", F.col("head").alias("up"), "above", (F.col("head") == F.col("end")).alias("ended")))
    while not lists.where("not ended").isEmpty():
        on = lists.select(F.col("node").alias("up"), F.col("up").alias("next"), F.col("above").alias("more"), F.col("ended").alias("last"))
        new = lists.where("not ended").join(on, "up").select("node", F.col("next").alias("up"), F.concat("above", "more").alias("above"), F.col("last").alias("ended"))
        lists = scratch.keep(lists.where("ended").union(new))
    return scratch.keep(lists.select(F.col("node").alias("head"), F.col("up").alias("root"), "above").unionByName(ends.where("end is null").select(F.col("node").alias("head"), F.col("end").alias("root"), F.array().cast(dict(near.dtypes)["above"]).alias("above"))))


def doubled(up: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, end): the node that a chain (node, up) ends with, null for members of a cycle."""
    now = scratch.keep(up.withColumn("ended", F.lit(False)))
    for _ in range(now.count().bit_length() + 1):
        if now.where("not ended").isEmpty():
            break
        above = now.select(F.col("node").alias("up"), F.col("up").alias("next"), F.col("ended").alias("above"))
        new = scratch.keep(now.join(above, "up", "left").select("node", F.when(F.col("ended"), F.col("up")).otherwise(F.coalesce("next", "up")).alias("up"), (F.col("ended") | F.col("next").isNull() | F.col("above")).alias("ended")))
        scratch.drop(now)
        now = new
    return now.select("node", F.when(F.col("ended"), F.col("up")).alias("end"))
