"""Modules that are alike: those that import nothing, that nothing imports, and whose records differ by the module's name only.

What an analysis finds for one of them holds for all under their own names. One of each class is analysed, under a mark that no source can hold, and rows
are given to all modules of the class.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.session import Scratch
from factloom.sources import python_files

CHUNK = 256  # modules of a class that get a row in one go
MARK = "\x01[0-9A-F]+\x02"
OWN = "rec in ('scope', 'var') or rec = 'stmt' and kind in ('FuncDef', 'ClassDef')"  # records whose base is a scope's name


@dataclass
class Alike:
    facts: DataFrame  # of one module of each class (a module that is like no other too), under its mark, and of those that import or are imported
    members: DataFrame  # (mark, chunk, module)

    def expand(self, rows: DataFrame) -> DataFrame:
        """Rows with a mark in a column of text, for all modules of the class; others as they are."""
        text = [c for c, kind in rows.dtypes if kind == "string"]
        named = rows.withColumn("_mark", F.regexp_extract(F.concat_ws("", *text), MARK, 0))
        chunks = self.members.select(F.col("mark").alias("_mark"), F.col("chunk").alias("_chunk"))
        to = self.members.select(F.col("mark").alias("_mark"), F.col("chunk").alias("_chunk"), F.col("module").alias("_module"))
        each = named.join(chunks.distinct(), "_mark").join(to, ["_mark", "_chunk"])
        out = each.select(*(F.replace(c, F.col("_mark"), F.col("_module")).alias(c) if c in text else F.col(c) for c in rows.columns))
        return named.where("_mark = ''").select(*rows.columns).union(out)


def renamed(f: DataFrame, name) -> DataFrame:
    """The records with the module's name replaced."""
    put = lambda c: F.concat(name, F.expr(f"substring({c}, length(module) + 1)"))
    own = F.expr(f"({OWN}) and (base = module or startswith(base, module || '.'))")
    return f.withColumn("scope", put("scope")).withColumn("base", F.when(own, put("base")).otherwise(F.col("base"))).withColumn("module", name)


def without_values(f: DataFrame) -> DataFrame:
    """The records without what a points-to analysis doesn't read: lines, and literals but for keys of subscripts and texts that calls are given."""
    st = f.where("rec = 'stmt'")
    used = st.where("kind in ('LoadSubscr', 'StoreSubscr')").select("module", F.get("args", F.lit(0))["var"].alias("target"), F.lit("").alias("name"))
    used = used.union(st.where("kind = 'Call'").select("module", F.explode("args.var"), F.lit("str"))).distinct()
    literal = F.expr("rec = 'stmt' and kind = 'Const'")
    kept = f.where(literal).join(used.where("name = ''").drop("name"), ["module", "target"], "left_semi").select(*f.columns)
    kept = kept.union(f.where(literal).join(used.where("name = 'str'"), ["module", "target", "name"], "left_semi").select(*f.columns)).select("module", "target", "name").distinct()
    marked = f.where(literal).join(kept.withColumn("_read", F.lit(True)), ["module", "target", "name"], "left")
    blank = marked.withColumn("label", F.when(F.col("_read"), F.col("label"))).select(*f.columns)
    return f.where(~literal).union(blank).withColumn("line", F.lit(0))


def alike(f: DataFrame, reads=None) -> Alike | None:
    """The classes of the facts' modules; None if no two are alike. ``reads``: what the analysis reads of the records, if not all."""
    scratch = Scratch(f.sparkSession, "alike")
    imp = python_files.imports(f).select("module", F.explode(F.array("name", F.concat_ws(".", "name", "item"), F.split("name", "\\.")[0])).alias("named"), "level")
    imp = scratch.keep(imp.distinct())
    if not imp.where("level > 0").isEmpty():  # relative names could be any module's
        return None
    bound = imp.select("module").union(imp.select("named")).distinct()
    alone = f.select("module").distinct().join(bound, "module", "left_anti")
    apart = scratch.keep(alone)
    if apart.isEmpty():
        return None
    free = f.join(apart, "module", "left_semi").select(*f.columns)
    row = [F.coalesce(F.col(c).cast("string"), F.lit("\x03")) if c != "args" else F.col(c) for c in f.columns if c != "module"]
    row += [F.transform("args", lambda x: F.concat_ws("", *(F.isnull(x[c]).cast("string") for c in ("role", "name", "var"))))]
    total = lambda seed: F.sum(F.xxhash64(F.lit(seed), *row).cast("decimal(38,0)"))
    named = (reads or (lambda d: d))(free).withColumn("_m", F.col("module"))
    plain = renamed(named, F.lit("\x01")).withColumn("module", F.col("_m")).drop("_m")
    sign = scratch.keep(plain.groupBy("module").agg(F.count("*").alias("n"), total(1).alias("a"), total(2).alias("b")))
    classes = sign.groupBy("n", "a", "b").agg(F.min("module").alias("first"), F.count("*").alias("size"))
    classes = scratch.keep(classes.withColumn("mark", F.concat(F.lit("\x01"), F.hex("first"), F.lit("\x02"))))
    if classes.where("size > 1").isEmpty():
        return None
    of = sign.join(classes, ["n", "a", "b"])
    members = scratch.keep(of.select("mark", F.expr(f"pmod(xxhash64(module), 1 + size div {CHUNK})").alias("chunk"), "module", (F.col("module") == F.col("first")).alias("is_first")))
    first = f.join(members.where("is_first").select("module", "mark"), "module").select(*f.columns, "mark")
    one = renamed(first, F.col("mark")).drop("mark").union(f.join(members.select("module"), "module", "left_anti").select(*f.columns))
    return Alike(scratch.keep(one), members.drop("is_first"))
