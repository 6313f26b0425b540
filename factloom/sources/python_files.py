"""Python files as fact tables: read and lowered one module per row, in parallel across modules."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import batched

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.session import ship
from factloom.sources.lowering import Lowering

RECORDS = 5_000  # in a batch that goes to Spark
COLUMNS = ("rec", "module", "scope", "idx", "kind", "target", "base", "name", "label", "args", "line")
SCHEMA = "rec string, module string, scope string, idx long, kind string, target string, base string, name string, label string, args array<struct<role:string,name:string,var:string>>, line int"
ARG = pa.struct([(c, pa.string()) for c in ("role", "name", "var")])
TYPES = [pa.string()] * 3 + [pa.int64()] + [pa.string()] * 5 + [pa.list_(ARG), pa.int32()]


def read_files(spark: SparkSession, *paths: str) -> DataFrame:
    """(path, text) of .py files below the paths; unreadable or missing single paths give no row.

    Spark's readers pass over names that begin with an underscore (packages' __init__ files); those are listed and read by the driver.
    """
    seen = spark.read.option("wholetext", True).option("pathGlobFilter", "*.py").option("recursiveFileLookup", True).option("ignoreMissingFiles", True).text(list(paths)).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    jvm, conf, hidden = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), []
    for p in paths:
        root = jvm.org.apache.hadoop.fs.Path(p)
        fs = root.getFileSystem(conf)
        files = fs.listFiles(root, True)
        while files.hasNext():
            at = files.next().getPath()
            if at.getName().startswith("_") and at.getName().endswith(".py"):
                stream = fs.open(at)
                hidden.append((at.toString(), jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
                stream.close()
    return seen.union(spark.createDataFrame(hidden, "path string, text string")) if hidden else seen


def module_names(files: DataFrame, root: str) -> DataFrame:
    """(module, text): dotted names relative to the root; a package is its __init__ file."""
    rel = F.regexp_replace(F.substring_index("path", root.rstrip("/") + "/", -1), "\\.py$", "")
    return files.select(F.regexp_replace(F.regexp_replace(rel, "(^|/)__init__$", ""), "/", ".").alias("module"), "path", "text")


def from_text(spark: SparkSession, modules: dict[str, str]) -> DataFrame:
    """(module, text) from memory."""
    return spark.createDataFrame(list(modules.items()), "module string, text string")


def _lowered(name: str, text: str) -> Iterator[tuple]:
    """The records one after the other: those of a large module would take gigabytes at once."""
    try:
        m = Lowering(name, text)
    except (SyntaxError, ValueError, RecursionError) as e:
        yield "unknown", name, name, -1, "parse", None, None, None, str(e)[:200], [], 0
        return
    at = 0
    for s in m.scopes:
        yield "scope", name, s.qualname, at, s.kind, None, s.parent.qualname if s.parent else None, ",".join(s.decorators), ("async " if s.is_async else "") + ("generator" if s.is_generator else ""), [], s.line
        for i, (p, kind, has) in enumerate(s.params):
            yield "param", name, s.qualname, i, kind, p, None, None, "default" if has else None, [], s.line
        for i, b in enumerate(s.bases):
            yield "base", name, s.qualname, i, None, None, b, None, None, [], s.line
        used: set[str] = set()
        for i, x in enumerate(s.body):
            yield "stmt", name, s.qualname, i, x.kind, x.target, x.base, x.name, x.label, [{"role": a, "name": n, "var": v} for a, n, v in x.args], x.line
            used |= x.loads() | ({x.target} if x.target else set()) | ({x.base} if x.kind == "Del" else set())
        names = sorted(used | {p[0] for p in s.params})
        for v in names:
            own, kind = m.owner(s, v)
            yield "var", name, s.qualname, -1, kind, v, own, None, None, [], 0
        at += 1 + len(s.params) + len(s.bases) + len(s.body) + len(names)
    yield from (("unknown", name, name, -1, what, None, None, None, text, [], line) for what, text, line in m.unknown)


def _each(batches: Iterator[pd.DataFrame]) -> Iterator[pa.RecordBatch]:
    """Records in batches of RECORDS, of many small modules or of a part of a large one."""
    modules = ((name, text) for b in batches for name, text in zip(b["module"], b["text"], strict=True))
    records = (r for name, text in modules for r in _lowered(name, text or ""))
    for part in batched(records, RECORDS):
        yield pa.RecordBatch.from_arrays([pa.array(c, type=kind) for c, kind in zip(zip(*part, strict=True), TYPES, strict=True)], names=list(COLUMNS))


def facts(modules: DataFrame) -> DataFrame:
    """All records of the modules (module, text): scope, param, base, stmt, var and unknown rows. A module that doesn't parse is one unknown row."""
    spark = modules.sparkSession
    ship(spark)
    apart = modules.select("module", "text").repartition(4 * spark.sparkContext.defaultParallelism, "module")  # by size Spark would give one task all of the texts
    return apart.mapInArrow(lambda batches: _each(b.to_pandas() for b in batches), SCHEMA)


def statements(f: DataFrame) -> DataFrame:
    return f.where("rec = 'stmt'").select("module", "scope", "idx", "kind", "target", "base", "name", "label", "args", "line")


def scopes(f: DataFrame) -> DataFrame:
    return f.where("rec = 'scope'").select("module", "scope", "kind", F.col("base").alias("parent"), F.col("name").alias("decorators"), F.col("label").alias("flags"), "line")


def parameters(f: DataFrame) -> DataFrame:
    return f.where("rec = 'param'").select("scope", F.col("idx").alias("pos"), "kind", F.col("target").alias("name"), F.col("label").isNotNull().alias("has_default"))


def variables(f: DataFrame) -> DataFrame:
    """(scope, name, owner, kind): where each name used in a scope lives."""
    return f.where("rec = 'var'").select("scope", F.col("target").alias("name"), F.col("base").alias("owner"), "kind")


def stores(f: DataFrame) -> DataFrame:
    return statements(f).where("target is not null").select("scope", F.col("idx").alias("node"), F.col("target").alias("var"))


def deletions(f: DataFrame) -> DataFrame:
    return statements(f).where("kind = 'Del'").select("scope", F.col("idx").alias("node"), F.col("base").alias("var"))


def loads(f: DataFrame) -> DataFrame:
    s = statements(f)
    own = s.where("base is not null and kind not in ('FuncDef', 'ClassDef', 'Import')").select("scope", F.col("idx").alias("node"), F.col("base").alias("var"))
    return own.union(s.select("scope", F.col("idx").alias("node"), F.explode("args.var").alias("var"))).distinct()


def code(f: DataFrame) -> DataFrame:
    """Statements in the form that the control-flow operators take."""
    return statements(f).select("scope", "idx", "kind", "label")


def imports(f: DataFrame) -> DataFrame:
    """(module, idx, form, name, item, level): form whole, top or from."""
    s = statements(f).where("kind = 'Import'")
    is_from = F.col("name").startswith("from:")
    return s.select("module", "scope", "idx", F.when(is_from, "from").otherwise(F.col("name")).alias("form"), F.col("base").alias("name"), F.when(is_from, F.expr("substring(name, 6)")).alias("item"), F.col("label").cast("int").alias("level"))
