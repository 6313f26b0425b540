"""Constraints for builtins. They are objects: a call by name has flows of its own, a call through a variable (``f = len``, an argument, a field)
reaches the object ``bi:<name>@<scope>`` of the scope that reads the name, whose fields hold arguments and result as a function's do. Both run
the same flow table. An object for each reading scope keeps programs apart that share nothing but the builtin.

Sites with ``/op`` are calls that the source doesn't write: of functions given to map, filter, sorted, min and max, and of special methods.
Builtins that iterate call ``__iter__`` and ``__next__`` of own classes. Rules for names that the program hasn't got add no rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.builtins_table import ALLOCATES, CALLBACKS, FLOWS, PAIRS, PROTOCOLS
from factloom.session import Scratch

ALLOC, COPY, LOAD = ("scope", "to", "t", "obj"), ("scope", "so", "s", "to", "t"), ("scope", "bo", "b", "field", "to", "t")
STORE, CALL, ARG = ("scope", "bo", "b", "field", "so", "s"), ("scope", "site", "bo", "b", "to", "t"), ("scope", "site", "role", "pos", "kw", "ao", "a")
READ = sorted({n for n in {x[0] for x in FLOWS} | set(ALLOCATES) | {x[0] for x in PROTOCOLS} if "." not in n})
col, lit = F.col, F.lit


def nil() -> Column:
    return lit("")


@dataclass
class Rows:
    """Lists of constraint tables. ``exact`` are stores of elements under a known key, which loads of other keys don't see."""

    alloc: list = field(default_factory=list)
    copy: list = field(default_factory=list)
    load: list = field(default_factory=list)
    store: list = field(default_factory=list)
    exact: list = field(default_factory=list)
    call: list = field(default_factory=list)
    arg: list = field(default_factory=list)

    def add(self, kind: str, rows: DataFrame, *columns: Column) -> None:
        head = {"alloc": ALLOC, "copy": COPY, "load": LOAD, "store": STORE, "exact": STORE, "call": CALL, "arg": ARG}[kind]
        getattr(self, kind).append(rows.select(*columns).toDF(*head))

    def own(self, rows: DataFrame, obj: Column) -> None:
        """A helper variable @<obj> that holds just the object."""
        self.add("alloc", rows, nil(), nil(), F.concat(lit("@"), obj), obj)

    def pair(self, rows: DataFrame, scope: Column, base: Column, key: Column, so: Column, s: Column) -> None:
        """Elements of a tuple: under their key, and among all elements."""
        for f in (key, lit("[]")):
            self.add("exact", rows, scope, nil(), base, f, so, s)


def _table(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    return spark.createDataFrame(sorted(set(rows)), schema)


def apart(rows: DataFrame, owner: str, name: str, *places: str) -> DataFrame:
    """Builtins that a row reads as a value, by the place that reads them: their name becomes <name>@<place>. The place is the first that isn't ''."""
    place = F.coalesce(*[F.when(col(p) != "", col(p)) for p in places], nil())
    return rows.withColumn(name, F.when((col(owner) == "") & col(name).isin(*READ), F.concat(name, lit("@"), place)).otherwise(col(name)))


def as_values(spark: SparkSession, scratch: Scratch, out: Rows, read: DataFrame, given: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Objects for the builtins read as values (var: <name>@<place>): sites bi:<var> and their arguments, which come out of the object's fields.
    given: the call arguments of the program, for the positions that occur."""
    last = given.where("role = 'pos'").agg(F.max("pos")).first()[0]
    obj = F.concat(lit("bi:"), "var")
    names = scratch.keep(read.distinct().withColumn("name", F.split("var", "@", 2)[0]))
    out.own(names, obj)
    out.add("alloc", names, nil(), nil(), col("var"), obj)
    result = F.concat(lit("@ret:"), obj)
    out.add("store", names, nil(), nil(), F.concat(lit("@"), obj), lit("ret"), nil(), result)
    at = names.select("name", "var", F.explode(F.sequence(lit(0), lit(last or 0))).alias("pos"))
    var = F.concat(lit("@"), obj, lit(":"), col("pos").cast("string"))
    out.add("load", at, nil(), nil(), F.concat(lit("@"), obj), F.concat(lit("arg"), col("pos").cast("string")), nil(), var)
    key, keys = F.concat(lit("@"), obj, lit(":key")), F.concat(lit("@"), obj, lit(":kw"))
    out.add("load", names, nil(), nil(), F.concat(lit("@"), obj), lit("kw:key"), nil(), key)
    out.add("load", names.where("name = 'dict'"), nil(), nil(), F.concat(lit("@"), obj), lit("kw*"), nil(), keys)
    no = lit(None).cast("string")
    args = at.select(nil(), obj, lit("pos"), "pos", no, nil(), var).union(names.select(nil(), obj, lit("kw"), lit(-1), lit("key"), nil(), key)).union(names.where("name = 'dict'").select(nil(), obj, lit("kw"), lit(-2), no, nil(), keys))
    return names.select(nil().alias("scope"), obj.alias("site"), nil().alias("to"), result.alias("t"), "name"), args.toDF(*ARG)


def functions(spark: SparkSession, scratch: Scratch, out: Rows, used: DataFrame, args: DataFrame, const: DataFrame, defined: DataFrame) -> None:
    """Flows of builtin functions at sites. used(scope, site, to, t, name), args as the program's, const(cv, cm, attr): names of attributes in constants,
    defined(method): methods of the program's classes."""
    args = args.select("site", "role", "pos", "kw", "ao", "a")
    thing = F.concat(col("site"), lit("/new"))
    makes = _table(spark, [(b, kind) for b, kind in ALLOCATES.items() if "." not in b], "name string, ckind string")
    made = scratch.keep(used.join(makes, "name"))
    out.add("alloc", made, col("scope"), col("to"), col("t"), thing)
    out.own(made, thing)
    two = F.concat(thing, lit("/pair"))
    paired = made.where(col("name").isin(*PAIRS))
    out.own(paired, two)
    out.add("store", paired, nil(), nil(), F.concat(lit("@"), thing), lit("[]"), nil(), F.concat(lit("@"), two))

    # values from arguments
    table = _table(spark, [x for x in FLOWS if "." not in x[0]], "name string, src string, sf string, dst string, df string")
    place = (col("role") == "pos") & ((col("src") == "any") | ((col("src") == "rest") & (col("pos") > 0)) | (col("src") == F.concat(lit("arg"), col("pos").cast("string")))) | (col("role") == "kw") & (col("src") == "kw")
    flow = used.join(table, "name").join(args, "site").where(place)
    tmp = F.concat(lit("@via:"), "site", lit(":"), "sf", col("pos").cast("string"))
    df = F.replace(F.replace("df", lit("#"), col("pos").cast("string")), lit("-"), (col("pos") - 1).cast("string"))
    src = scratch.keep(flow.select("scope", "site", "to", "t", "name", "sf", "dst", df.alias("df"), "pos", "ao", "a", F.when(col("sf") == "", col("ao")).otherwise("").alias("xo"), F.when(col("sf") == "", col("a")).otherwise(tmp).alias("x")))
    out.add("load", src.where("sf <> ''"), col("scope"), col("ao"), col("a"), col("sf"), nil(), col("x"))
    out.add("copy", src.where("dst = 'result' and df = ''"), col("scope"), col("xo"), col("x"), col("to"), col("t"))
    out.add("store", src.where("dst = 'result' and df <> ''"), col("scope"), nil(), F.concat(lit("@"), thing), col("df"), col("xo"), col("x"))
    out.pair(src.where("dst = 'pair'"), col("scope"), F.concat(lit("@"), two), col("df"), col("xo"), col("x"))

    # functions given
    back = _table(spark, CALLBACKS, "name string, at string, rf string")
    cb = used.join(back, "name").join(args, "site").where("role = 'pos' and concat('arg', pos) = at or role = 'kw' and kw = at").select("scope", "site", "rf", "ao", "a")
    cb = scratch.keep(cb)
    site, got = F.concat("site", lit("/op:call")), F.concat(lit("@call:"), "site")
    out.add("call", cb, col("scope"), site, col("ao"), col("a"), nil(), got)
    out.add("store", cb.where("rf <> ''"), col("scope"), nil(), F.concat(lit("@"), thing), col("rf"), nil(), got)
    out.add("arg", src.where("dst = 'call'").join(cb.select("site"), "site", "left_semi"), col("scope"), site, lit("pos"), F.substring("df", 4, 9).cast(dict(args.dtypes)["pos"]), lit(None).cast("string"), col("xo"), col("x"))

    # own iterators of what is iterated, and special methods
    each = scratch.keep(src.where("sf = '[]' and name not in ('next', 'anext')").select("scope", "site", "pos", "ao", "a", "x").distinct().withColumn("method", lit("__iter__")).join(defined, "method"))
    at = lambda tag: F.concat("site", lit(f"/op:{tag}"), col("pos").cast("string"))
    part = lambda tag: F.concat("x", lit(f":{tag}"))
    out.add("load", each, col("scope"), col("ao"), col("a"), lit("__iter__"), nil(), part("m"))
    out.add("call", each, col("scope"), at("iter"), nil(), part("m"), nil(), part("it"))
    for f, to in (("[]", col("x")), ("__next__", part("n"))):
        out.add("load", each, col("scope"), nil(), part("it"), lit(f), nil(), to)
    out.add("call", each, col("scope"), at("next"), nil(), part("n"), nil(), col("x"))
    asks = _table(spark, PROTOCOLS, "name string, method string, gives boolean").join(defined, "method")
    asks = scratch.keep(used.join(asks, "name").join(args.where("role = 'pos' and pos = 0").select("site", "ao", "a"), "site"))
    m = F.concat(lit("@ask:"), "site")
    out.add("load", asks, col("scope"), col("ao"), col("a"), col("method"), nil(), m)
    out.add("call", asks, col("scope"), F.concat("site", lit("/op:ask")), nil(), m, F.when(col("gives"), col("to")).otherwise(""), F.when(col("gives"), col("t")).otherwise(F.concat(m, lit(":r"))))

    # attributes by name
    arg = lambda k, o, a: args.where(f"role = 'pos' and pos = {k}").select("site", col("ao").alias(o), col("a").alias(a))
    named = used.where("name in ('getattr', 'setattr')").join(arg(0, "oo", "o"), "site").join(arg(1, "no", "n"), "site").join(const, (col("no") == col("cm")) & (col("n") == col("cv")))
    named = scratch.keep(named.select("name", "scope", "site", "to", "t", "oo", "o", "attr"))
    out.add("load", named.where("name = 'getattr'"), col("scope"), col("oo"), col("o"), col("attr"), col("to"), col("t"))
    out.add("store", named.where("name = 'setattr'").join(arg(2, "vo", "v"), "site"), col("scope"), col("oo"), col("o"), col("attr"), col("vo"), col("v"))


def methods(spark: SparkSession, scratch: Scratch, out: Rows, boxes: DataFrame, attrs: DataFrame) -> None:
    """Containers (scope, box, ckind, new) get the methods that the program names (name): a method is an object in the container's field, with
    flows between its arguments, its result and the container's elements."""
    flows = _table(spark, [(*x[0].split("."), *x[1:]) for x in FLOWS if "." in x[0]], "ckind string, m string, src string, sf string, dst string, df string")
    made = _table(spark, [tuple(b.split(".")) for b in ALLOCATES if "." in b], "ckind string, m string")
    known = flows.select("ckind", "m").union(made).distinct().join(attrs.withColumnRenamed("name", "m"), "m")
    box, obj = F.concat(lit("@"), "box"), F.concat(lit("bm:"), "box", lit("."), "m")
    bm = F.concat(lit("@"), obj)
    new, two = F.concat(obj, lit("/new")), F.concat(obj, lit("/pair"))
    bound = scratch.keep(boxes.join(known, "ckind"))
    out.add("alloc", boxes.where("not new"), col("scope"), nil(), box, col("box"))
    out.own(bound, obj)
    out.add("store", bound, nil(), nil(), box, col("m"), nil(), bm)
    fresh = bound.join(made, ["ckind", "m"])
    out.own(fresh, new)
    out.add("store", fresh, nil(), nil(), bm, lit("ret"), nil(), F.concat(lit("@"), new))
    f = scratch.keep(bound.join(flows, ["ckind", "m"]))
    pairs = f.where("dst = 'pair'").select("box", "m").distinct()
    out.own(pairs, two)
    out.add("store", pairs, nil(), nil(), F.concat(lit("@"), new), lit("[]"), nil(), F.concat(lit("@"), two))
    first = F.concat(bm, lit(":"), "src")
    last = F.when(col("sf") == "", first).otherwise(F.concat(bm, lit(":"), "src", "sf"))
    out.add("load", f.where("src <> 'recv'"), nil(), nil(), bm, col("src"), nil(), first)
    out.add("load", f.where("sf <> ''"), nil(), nil(), F.when(col("src") == "recv", box).otherwise(first), col("sf"), nil(), last)
    to = F.when(col("dst") == "recv", box).when(col("df") == "", bm).otherwise(F.concat(lit("@"), new))
    out.add("store", f.where("dst <> 'pair'"), nil(), nil(), to, F.when(col("df") == "", lit("ret")).otherwise(col("df")), nil(), last)
    out.pair(f.where("dst = 'pair'"), nil(), F.concat(lit("@"), two), col("df"), nil(), last)
