"""Abstract values as columns: joins of numbers, strings and containers; truth, comparison, len and int of them.

A null bound means unbounded. A number's exact set is kept only while every joined value has one.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = "struct<exact:array<double>,lo:double,hi:double,zero:boolean,neg:boolean,pos:boolean>"


def number(exact: Column) -> Column:
    """The value of a known set of numbers (array<double>): bounds and signs follow (normalisation)."""
    return F.struct(
        F.array_sort(F.array_distinct(exact)).alias("exact"), F.array_min(exact).alias("lo"), F.array_max(exact).alias("hi"),
        F.exists(exact, lambda x: x == 0).alias("zero"), F.exists(exact, lambda x: x < 0).alias("neg"), F.exists(exact, lambda x: x > 0).alias("pos"),
    )


def interval(lo: Column, hi: Column) -> Column:
    """The value of an interval; signs follow from the bounds."""
    low, high = F.coalesce(lo, F.lit(float("-inf"))), F.coalesce(hi, F.lit(float("inf")))
    return F.struct(
        F.array().cast("array<double>").alias("exact"), lo.cast("double").alias("lo"), hi.cast("double").alias("hi"),
        ((low <= 0) & (high >= 0)).alias("zero"), (low < 0).alias("neg"), (high > 0).alias("pos"),
    )


def join_numbers(v: str) -> Column:
    """Aggregate: the least number value that covers the group's."""
    x = F.col(v)
    known = F.bool_and(F.size(x["exact"]) > 0)
    both = F.array_sort(F.array_distinct(F.flatten(F.collect_set(x["exact"]))))
    open_lo, open_hi = F.bool_or(x["lo"].isNull()), F.bool_or(x["hi"].isNull())
    return F.struct(
        F.when(known, both).otherwise(F.array().cast("array<double>")).alias("exact"), F.when(~open_lo, F.min(x["lo"])).alias("lo"), F.when(~open_hi, F.max(x["hi"])).alias("hi"),
        F.bool_or(x["zero"]).alias("zero"), F.bool_or(x["neg"]).alias("neg"), F.bool_or(x["pos"]).alias("pos"),
    )


def join_strings(s: str) -> Column:
    """Aggregate of strings: exact set, one-character prefixes and suffixes, least and greatest length."""
    x = F.col(s)
    return F.struct(
        F.array_sort(F.collect_set(x)).alias("exact"), F.array_sort(F.collect_set(F.left(x, F.lit(1)))).alias("prefixes"), F.array_sort(F.collect_set(F.right(x, F.lit(1)))).alias("suffixes"),
        F.min(F.length(x)).cast("long").alias("min_len"), F.max(F.length(x)).cast("long").alias("max_len"),
    )


def join_containers(types: str, lo: str, hi: str) -> Column:
    """Aggregate of containers: element types (array<string>), and the interval of sizes (null hi: unbounded)."""
    return F.struct(F.array_sort(F.array_distinct(F.flatten(F.collect_set(types)))).alias("types"), F.min(lo).alias("min_size"), F.when(~F.bool_or(F.col(hi).isNull()), F.max(hi)).alias("max_size"))


def store_element(types: Column, lo: Column, hi: Column, tag: Column) -> Column:
    """A container after an element of a type was stored in it."""
    return F.struct(F.array_sort(F.array_union(types, F.array(tag))).alias("types"), F.greatest(lo, F.lit(1)).alias("min_size"), (hi + 1).alias("max_size"))


def truth(n: Column) -> Column:
    """Of a number: true, false, or null if either may be."""
    may_true, may_false = n["neg"] | n["pos"], n["zero"]
    return F.when(may_true & ~may_false, True).when(may_false & ~may_true, False)


def truth_of_size(lo: Column, hi: Column) -> Column:
    return F.when(lo > 0, True).when(hi == 0, False)


def compare(op: str, a: Column, b: Column) -> Column:
    """Of two numbers: true or false if it holds, or fails, for all pairs of values; else null."""
    alo, ahi = F.coalesce(a["lo"], F.lit(float("-inf"))), F.coalesce(a["hi"], F.lit(float("inf")))
    blo, bhi = F.coalesce(b["lo"], F.lit(float("-inf"))), F.coalesce(b["hi"], F.lit(float("inf")))
    same = (alo == ahi) & (blo == bhi) & (alo == blo)
    apart = (ahi < blo) | (alo > bhi) | ((F.size(a["exact"]) > 0) & (F.size(b["exact"]) > 0) & ~F.arrays_overlap(a["exact"], b["exact"]))
    pick = {"<": (ahi < blo, alo >= bhi), "<=": (ahi <= blo, alo > bhi), ">": (alo > bhi, ahi <= blo), ">=": (alo >= bhi, ahi < blo), "==": (same, apart), "!=": (apart, same)}
    yes, no = pick[op]
    return F.when(yes, True).when(no, False)


def len_of(lo: Column, hi: Column) -> Column:
    """len() of a string or container by its size bounds."""
    return interval(F.greatest(lo, F.lit(0)).cast("double"), hi.cast("double"))


def int_of_number(n: Column) -> Column:
    """int() of a number: truncation towards zero."""
    cut = lambda x: F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("double")
    return F.when(F.size(n["exact"]) > 0, number(F.transform(n["exact"], cut))).otherwise(interval(cut(n["lo"]), cut(n["hi"])))


def int_of_strings(exact: Column) -> Column:
    """int() of known strings: those that parse; an unbounded number if none is known to."""
    ok = F.transform(F.filter(exact, lambda s: F.trim(s).rlike("^[+-]?[0-9]+$")), lambda s: F.trim(s).cast("double"))
    return F.when(F.size(ok) > 0, number(ok)).otherwise(interval(F.lit(None).cast("double"), F.lit(None).cast("double")))


def widen(lo: Column, hi: Column, old_lo: Column, old_hi: Column) -> tuple[Column, Column]:
    """A bound that still moves becomes unbounded."""
    return F.when(lo >= old_lo, old_lo), F.when(hi <= old_hi, old_hi)
