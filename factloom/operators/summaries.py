"""What an analysis leaves open, and what modules give to others: unknown records and module summaries, as relations over a pointer result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators.pointer import WRITTEN, Result, bound_arguments

UNKNOWN_KINDS = ("empty_callee", "non_callable", "external_call", "missing_argument", "surplus_argument", "unexpected_keyword")


def unknowns(r: Result) -> DataFrame:
    """(kind, scope, site, what): calls whose callee holds nothing, or only objects that can't be called, or objects of modules not given;
    parameters without a default that a resolved call gives no argument for; arguments and keywords that the function called doesn't take. Calls of builtins by name are known."""
    return r.of_all(_unknowns)


def _unknowns(r: Result) -> DataFrame:
    v = r.pts.where("field = ''").select("node", "obj")
    node = F.concat_ws("|", F.lit(""), "bo", "b")
    calls = r.program.call.where(f"bo <> '' and {WRITTEN}").select("scope", "site", F.col("b").alias("what"), node.alias("node"))
    held = r.program.callable(calls.join(v, "node", "left")).groupBy("scope", "site", "what").agg(F.count("obj").alias("n"), F.bool_or("ok").alias("ok"), F.coalesce(F.bool_or(F.col("obj").startswith("ext:")), F.lit(False)).alias("ext"))
    kind = F.when(F.col("n") == 0, "empty_callee").when(F.col("ok"), None).when(F.col("ext"), "external_call").otherwise("non_callable")
    callee = held.select(kind.alias("kind"), "scope", "site", "what").where("kind is not null")
    sites = r.resolved.where(WRITTEN)
    needed = r.program.param.where("not has_default and kind in ('posonly', 'pos', 'kwonly')").select("fn", "name", "pos")
    given = bound_arguments(r.program, sites).where("how <> 'surplus'").select("site", "fn", "name").distinct()
    missing = sites.join(needed, "fn").where("pos >= off").join(given, ["site", "fn", "name"], "left_anti")
    takes = lambda kind: r.program.param.where(F.col("kind") == kind).select("fn").distinct()
    places = r.program.param.where("kind in ('posonly', 'pos')").groupBy("fn").agg(F.count("*").alias("n_pos"))
    names = r.program.param.where("kind in ('pos', 'kwonly')").select("fn", F.col("name").alias("kw"))
    args = sites.join(r.program.arg.select("site", "role", F.col("pos").alias("k"), "kw"), "site")
    surplus = args.where("role = 'pos'").join(takes("star"), "fn", "left_anti").join(places, "fn", "left").where("k + off >= coalesce(n_pos, 0)")
    odd = args.where("role = 'kw'").join(takes("kwstar"), "fn", "left_anti").join(names, ["fn", "kw"], "left_anti")
    record = lambda kind, d, what: d.select(F.lit(kind).alias("kind"), "scope", "site", F.concat("fn", F.lit("."), what).alias("what")).distinct()
    return callee.union(record("missing_argument", missing, "name")).union(record("surplus_argument", surplus, F.col("k").cast("string"))).union(record("unexpected_keyword", odd, "kw"))


def unknown_counts(u: DataFrame, *by: str) -> DataFrame:
    """(kind, by..., n)."""
    return u.groupBy("kind", *by).agg(F.count("*").alias("n"))


def module_summary(r: Result) -> DataFrame:
    """(module, export, obj): what each module-level name may hold."""
    mods = r.program.scopes.where("kind = 'module'").select(F.col("scope").alias("owner"))
    return r.variables().join(mods, "owner").where("not startswith(name, '$')").select(F.col("owner").alias("module"), F.col("name").alias("export"), "obj").distinct()


def merge_summaries(a: DataFrame, b: DataFrame) -> DataFrame:
    """Both summaries' rows, name by name."""
    return a.select("module", "export", "obj").union(b.select("module", "export", "obj")).distinct()


def apply_summary(summary: DataFrame, imports: DataFrame) -> DataFrame:
    """(module, name, obj): what the importing names get of a summary. imports: (module, name, tgt, item)."""
    s = summary.select(F.col("module").alias("tgt"), F.col("export").alias("item"), "obj")
    return imports.join(s, ["tgt", "item"]).select("module", "name", "obj").distinct()
