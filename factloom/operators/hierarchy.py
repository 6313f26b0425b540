"""Class hierarchies: ancestors, linearisation (C3), attribute lookup. class_base: (cls, base, base_idx)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators.fixpoint import fixpoint
from factloom.session import Scratch, ship


def ancestors(class_base: DataFrame) -> DataFrame:
    """(cls, ancestor, depth): transitive superclasses with the fewest steps to each."""
    up = class_base.select(F.col("cls").alias("ancestor"), F.col("base").alias("nxt"))

    def step(d: DataFrame, known: DataFrame) -> DataFrame:
        new = d.join(up, "ancestor").select("cls", F.col("nxt").alias("ancestor"), (F.col("depth") + 1).alias("depth")).distinct()
        return new.join(known.select("cls", "ancestor").distinct(), ["cls", "ancestor"], "left_anti")

    first = class_base.select("cls", F.col("base").alias("ancestor"), F.lit(1).cast("long").alias("depth"))
    return fixpoint(first, step).groupBy("cls", "ancestor").agg(F.min("depth").alias("depth"))


def subclasses(class_base: DataFrame) -> DataFrame:
    """(cls, subclass, depth): transitive subclasses."""
    return ancestors(class_base).select(F.col("ancestor").alias("cls"), F.col("cls").alias("subclass"), "depth")


def linearise(cls: str, bases: dict[str, list[str]], strict: bool = False) -> list[str]:
    """C3 linearisation of a class; on a conflict, a cycle too, ValueError if strict, else the class and its first base's order. A base
    that leads back is left out."""
    done: dict[str, list[str]] = {}
    open_: set[str] = set()

    def order(c: str) -> list[str]:
        if c in done:
            return done[c]
        open_.add(c)
        own = [b for b in bases.get(c, []) if b not in open_ or b in done]
        if strict and len(own) < len(bases.get(c, [])):
            raise ValueError(f"{c} is among its own ancestors")
        rest = [list(order(b)) for b in own] + [list(own)]
        out = [c]
        while rest := [r for r in rest if r]:
            tails = {x for r in rest for x in r[1:]}
            head = next((r[0] for r in rest if r[0] not in tails), None)
            if head is None:
                if strict:
                    raise ValueError(f"no consistent order of the bases of {c}")
                out = [c, *order(own[0])]
                break
            out.append(head)
            rest = [[x for x in r if x != head] for r in rest]
        done[c] = out
        return out

    return order(cls)


GROUP = 20_000  # rows of ancestors' bases that a group holds, about


def _mros(pdf: pd.DataFrame) -> pd.DataFrame:
    rows = []
    for root, own in pdf.groupby("root", sort=False):
        bases: dict[str, list[str]] = {}
        for cls, base, _ in sorted(own.loc[own["base"].notna(), ["cls", "base", "base_idx"]].itertuples(index=False), key=lambda r: (r[0], r[2], r[1])):
            bases.setdefault(cls, []).append(base)
        rows.append((root, linearise(root, bases)))
    return pd.DataFrame(rows, columns=["root", "mro"])


def c3_mro(class_base: DataFrame, classes: DataFrame) -> DataFrame:
    """(cls, pos, ancestor) for each of the classes (cls), itself at 0.

    What stands behind a class that no other has as a base depends on its bases alone, so of such classes with the same bases in the same order one is
    linearised. A group holds the ancestors of several classes, not the hierarchy.
    """
    ship(class_base.sparkSession)
    scratch = Scratch(class_base.sparkSession, "mro")
    edges = scratch.keep(class_base.select(F.col("cls").cast("string").alias("cls"), F.col("base").cast("string").alias("base"), F.col("base_idx").cast("long").alias("base_idx")).distinct())
    names = classes.select(F.col("cls").cast("string").alias("cls")).distinct()
    above = edges.select(F.col("base").alias("cls"), F.lit(True).alias("above")).distinct()
    own = edges.groupBy("cls").agg(F.array_sort(F.collect_list(F.struct("base_idx", "base")))["base"].alias("bases"))
    asked = scratch.keep(names.join(own, "cls", "left").join(above, "cls", "left").withColumn("bases", F.coalesce("bases", F.array().cast("array<string>"))))
    alike = F.col("above").isNull()
    first = asked.where(alike).groupBy("bases").agg(F.min("cls").alias("root"))
    as_root = scratch.keep(asked.where(alike).join(first, "bases").select("cls", "root").union(asked.where(~alike).select("cls", F.col("cls").alias("root"))))
    up = edges.select("cls", "base").distinct()
    roots = as_root.select("root").distinct()
    reach = fixpoint(roots.select("root", F.col("root").alias("cls")), lambda d, _: d.join(up, "cls").select("root", F.col("base").alias("cls")))
    rows = reach.join(edges, "cls", "left")
    groups = reach.count() // GROUP + 1
    mro = rows.groupBy(F.pmod(F.hash("root"), F.lit(groups)).alias("part")).applyInPandas(_mros, "root string, mro array<string>")
    out = as_root.join(mro, "root").select("cls", F.posexplode("mro").alias("pos", "ancestor"))
    return out.select("cls", F.col("pos").cast("long").alias("pos"), F.when(F.col("pos") == 0, F.col("cls")).otherwise(F.col("ancestor")).alias("ancestor"))


def resolve_attribute(mro: DataFrame, defines: DataFrame) -> DataFrame:
    """(cls, attr, definer): the first class in order that defines the attribute. defines: (cls, attr)."""
    return mro.join(defines.select(F.col("cls").alias("ancestor"), "attr"), "ancestor").groupBy("cls", "attr").agg(F.min_by("ancestor", "pos").alias("definer"))
