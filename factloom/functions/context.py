"""Context-sensitivity policies as column expressions on array<string> contexts.

Policies: k-cfa, k-obj, k-type, k-rcv, k-param with k in 1..3 (0-cfa: insensitive), and hybrids 1c1o, 2c1o, 1c2o.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

POLICIES = ("0-cfa", *(f"{k}-{p}" for p in ("cfa", "obj", "type", "rcv", "param") for k in (1, 2, 3)), "1c1o", "2c1o", "1c2o")


def parse(policy: str) -> tuple[str, int, int]:
    """(kind, k, d) of a policy's name; ValueError if unknown."""
    if policy not in POLICIES:
        raise ValueError(f"unknown policy {policy}")
    if m := re.fullmatch(r"(\d)c(\d)o", policy):
        return "hybrid", int(m[1]), int(m[2])
    k, kind = policy.split("-")
    return kind, int(k), 0


def append(ctx: Column, element: Column, k: int) -> Column:
    """ctx with the element behind it, cut to the last k."""
    own = F.array(element)
    return own if k == 1 else F.concat(F.slice(ctx, F.greatest(F.size(ctx) - (k - 2), F.lit(1)), F.lit(k - 1)), own)


def sites_of(ctx: Column) -> Column:
    return F.filter(ctx, lambda x: x.startswith("c:"))


def objects_of(ctx: Column) -> Column:
    return F.filter(ctx, lambda x: x.startswith("o:"))


def call_context(policy: str, ctx: Column, site: Column, recv: Column, recv_class: Column, recv_site: Column, args: Column, sites: Column | None = None, objects: Column | None = None) -> Column:
    """Context of a callee. recv, recv_class and recv_site are null without a receiver; args: array<string> of argument variables.

    Hybrids keep call sites (prefix ``c:``) and objects (``o:``) in one array, each limited on its own; without a receiver the objects stay.
    ``sites`` and ``objects``: those of ctx, where a caller of many policies has them as columns, so that each is found once a row.
    """
    kind, k, d = parse(policy)
    if k == 0:
        return F.array().cast("array<string>")
    if kind == "cfa":
        return append(ctx, site, k)
    if kind == "obj":
        return append(ctx, F.coalesce(recv, site), k)
    if kind == "type":
        return append(ctx, F.coalesce(recv_class, recv, site), k)
    if kind == "rcv":
        return append(ctx, F.coalesce(recv_site, site), k)
    if kind == "param":
        return F.when(F.size(args) > 0, append(ctx, F.array_join(F.sort_array(F.array_distinct(args)), "+"), k)).otherwise(ctx)
    objs = objects_of(ctx) if objects is None else objects
    return F.concat(append(sites_of(ctx) if sites is None else sites, F.concat(F.lit("c:"), site), k), F.when(recv.isNotNull(), append(objs, F.concat(F.lit("o:"), recv), d)).otherwise(objs))


def alloc_context(policy: str, ctx: Column, site: Column) -> Column:
    """Heap context of an object allocated in ctx: object, type and hybrid policies append the site."""
    kind, k, d = parse(policy)
    if kind in ("obj", "type"):
        return append(ctx, site, k)
    if kind == "hybrid":
        return F.concat(sites_of(ctx), append(objects_of(ctx), F.concat(F.lit("o:"), site), d))
    return ctx
