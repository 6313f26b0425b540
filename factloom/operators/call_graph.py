"""The call graph as a relation: edges with the contexts of both ends and a kind, and lookups from either end."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators import pointer
from factloom.sources import python_files

KINDS = ("instance", "static", "function", "class", "module", "other")


@dataclass
class CallGraph:
    edges: DataFrame  # (site, caller, ctx, callee, callee_ctx, kind); callee is null where none is known

    def callers(self, callee: str) -> DataFrame:
        """(site, caller, ctx, kind) of the calls of a function."""
        return self.edges.where(F.col("callee") == callee).select("site", "caller", "ctx", "kind")

    def callees(self, caller: str, ctx: str | None = None) -> DataFrame:
        """(site, callee, callee_ctx, kind) that a scope calls, in one context if that is given."""
        own = self.edges.where(F.col("caller") == caller)
        return (own if ctx is None else own.where(F.col("ctx") == ctx)).select("site", "callee", "callee_ctx", "kind")

    def kinds(self, *by: str) -> DataFrame:
        """Numbers of call sites by kind."""
        return self.edges.groupBy(*by, "kind").agg(F.count_distinct("site").alias("n"))


def call_graph(result: pointer.Result, facts: DataFrame) -> CallGraph:
    """Every call that the source has, with its kind.

    class: what is called is a class; static: a static method; instance: a method through an object (or a class); module: a function
    through its module; function: a function by name; other: builtins, external and unresolved calls.
    """
    p, col = result.program, F.col
    site = python_files.statements(facts).withColumn("site", F.concat_ws(":", "scope", col("idx").cast("string")))
    own = site.where("kind = 'Call'").select("scope", "site", "base", col("line"))
    held = result.pts.where("field = ''").select("node", "obj")
    made = p.call.where(pointer.WRITTEN).select("site", F.concat_ws("|", F.lit(""), "bo", "b").alias("node")).join(held.where("startswith(obj, 'cls:')"), "node").select("site").distinct().withColumn("makes", F.lit(True))
    through = p.recv.select("site", F.concat_ws("|", F.lit(""), "ro", "r").alias("node")).join(held, "node").groupBy("site").agg(F.bool_or(col("obj").startswith("mod:")).alias("by_module"), F.bool_or(~col("obj").startswith("mod:")).alias("by_object"))
    method = python_files.scopes(facts).where("kind = 'function'").select(col("scope").alias("callee"), F.coalesce("decorators", F.lit("")).rlike("(^|,)staticmethod").alias("is_static"), "parent")
    inside = python_files.scopes(facts).where("kind = 'class'").select(col("scope").alias("parent"), F.lit(True).alias("in_class"))
    method = method.join(inside, "parent", "left").drop("parent")
    cg = result.cg.where(pointer.WRITTEN).select("site", "ctx", "callee", "callee_ctx")
    e = own.join(cg, "site", "left").join(made, "site", "left").join(through, "site", "left").join(method, "callee", "left")
    kind = F.when(col("makes"), "class").when(col("callee").isNull(), "other").when(col("in_class") & col("is_static"), "static").when(col("in_class"), "instance").when(col("by_module"), "module").otherwise("function")
    return CallGraph(e.select("site", col("scope").alias("caller"), F.coalesce("ctx", F.lit("")).alias("ctx"), "callee", "callee_ctx", kind.alias("kind")).distinct())
