"""Semi-naive least fixpoint of monotone rules over a relation: the one place that loops on the driver."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.session import Scratch


class NotConverged(RuntimeError):
    """The rounds allowed ran out; nothing is returned, for it would be incomplete."""


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def fixpoint(init: DataFrame, step: Callable[[DataFrame, DataFrame], DataFrame], max_rounds: int = 10_000, compact: int = 8, log: list | None = None) -> DataFrame:
    """All rows derivable from ``init`` by ``step(delta, known)``.

    A rule with two recursive atoms has to join delta with known and known with delta. Columns are the row's identity and
    must not be null. Each round writes its new rows to the shared folder and rereads them, which cuts the lineage
    and survives lost executors; every ``compact`` rounds the written parts become one. ``log`` gets (round, new rows).
    """
    scratch = Scratch(init.sparkSession, "fixpoint")
    columns = init.columns
    delta = scratch.keep(init.distinct())
    parts = [delta]
    for turn in range(1, max_rounds + 1):
        known = union(parts)
        new = scratch.keep(step(delta, known).select(*columns).distinct().join(known, columns, "left_anti").select(*columns))
        if log is not None:
            log.append((turn, new.count()))
        if new.isEmpty():
            return known
        parts.append(new)
        delta = new
        if len(parts) > compact:
            one = scratch.keep(union(parts))
            scratch.drop(*parts[:-1])
            parts = [one]
    raise NotConverged(f"no fixpoint in {max_rounds} rounds")


def lattice_fixpoint(init: DataFrame, keys: list[str], merge: dict[str, Callable[[str], Column]], step: Callable[[DataFrame, DataFrame], DataFrame], max_rounds: int = 100_000, compact: int = 8, log: list | None = None) -> DataFrame:
    """The least values by key that ``step`` can't raise further: a fixpoint over a lattice, not over sets.

    ``merge`` gives each value column's join as an aggregate; all of ``init`` is joined by key first. ``step(delta, known)`` returns
    values joined with the key's old one, and ``rose``, whether that is more than the old one; ``delta`` holds the last rises. ``known`` may hold several versions
    of a key: as values only rise, their join is the latest, and how many there are tells how often it rose (for widening). Column ``rises`` counts them.
    Rows are written before those that rose are picked, so that the optimizer doesn't repeat a large step in a filter below it.
    """
    scratch = Scratch(init.sparkSession, "lattice")
    joined = lambda d: d.groupBy(*keys).agg(*[f(c).alias(c) for c, f in merge.items()], F.sum("rises").alias("rises"))
    once = F.lit(1).cast("long").alias("rises")
    delta = scratch.keep(joined(init.select(*keys, *merge, once)).withColumn("rises", once))
    parts = [delta]
    for turn in range(1, max_rounds + 1):
        known = union(parts)
        new = scratch.keep(step(delta, known).select(*keys, *merge, "rose", once)).where("rose").drop("rose")
        n = new.count()
        if log is not None:
            log.append((turn, n))
        if not n:
            out = scratch.keep(joined(known))
            scratch.only(out)
            return out
        parts.append(new)
        delta = new
        if len(parts) > compact:
            one = scratch.keep(joined(union(parts)))
            scratch.drop(*parts[:-1])
            parts = [one]
    raise NotConverged(f"no fixpoint in {max_rounds} rounds")
