"""Merging the objects that a value may be: one row for each identity, properties joined, unknown yielding to known."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("constant", "builtin", "function", "class", "instance", "external_function", "external_class", "external_instance", "unknown")


def merge_objects(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, kind, ident, lo, hi, elements, attributes): the objects of each key's value.

    rows: keys, kind (of ``KINDS``), ident (a constant's or container's type, else a qualified name), lo and hi (bounds of numbers or sizes,
    null: open), element (type name), attribute (name); the last two may be null. Objects of one kind and identity are one: bounds are joined,
    element types and attributes united. Other kinds or identities stay apart. An unknown object stays only where nothing is known. Both
    steps are aggregates with map-side sums; no value's objects are gathered.
    """
    open_ = lambda c: F.bool_or(F.col(c).isNull())
    names = lambda c: F.array_sort(F.collect_set(c))
    ident = F.when(F.col("kind") == "unknown", "").otherwise(F.coalesce("ident", F.lit("")))
    one = rows.withColumn("ident", ident).groupBy(*keys, "kind", "ident").agg(
        F.when(~open_("lo"), F.min("lo")).alias("lo"), F.when(~open_("hi"), F.max("hi")).alias("hi"), names("element").alias("elements"), names("attribute").alias("attributes"),
    )
    known = rows.where("kind <> 'unknown'").groupBy(*keys).agg(F.lit(True).alias("known"))
    lost = rows.where("kind = 'unknown'").select(*keys).distinct().join(known.select(*keys), list(keys), "left_semi").withColumn("kind", F.lit("unknown"))
    return one.join(lost, [*keys, "kind"], "left_anti").select(*keys, "kind", "ident", "lo", "hi", "elements", "attributes")
