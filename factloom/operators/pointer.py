"""Points-to analysis of lowered Python with the call graph, and context sensitivity by cloning.

First pass (no contexts). Calls become field accesses of the callee's object, so the four rules of ``points_to`` are enough:

    call f(a0, k=a1) -> t     store(f, arg0, a0), store(f, kw:k, a1), load(f, ret, t)
    def f(p0, ...)            object fn:f; p0 reads fn:f's arg0 and kw:p0, fn:f's ret holds $return
    class C                   object cls:C; its attributes are fields; ret holds inst:C; arguments go to __init__ along the C3 order
    *a, **k at a call         fields star and kwstar; the callee's parameters read their elements, its *args and **kwargs packs too
    x + y, x[k], -x, x in y   a call of x's (or y's reflected) special method beside the builtin meaning
    super() in C, modules     objects super:C and mod:m with the fields visible above C, or of the module; modules not given are opaque, ext:m
    builtins                  objects bi:<name>@<scope> with flows of a table (operators.library); methods are fields of the container that they belong to
    o() of an instance        the instance's fields feed __call__'s parameters; ret holds its $return
    property                  the attribute holds what its function returns
    elements                  [] is any element, [k] one under a constant key, [?] one under a key unknown, {} a key. Only tuples' places and string
                              keys count as constant, as lists move theirs; a load of [k] reads [?] too

A static flow between a variable and an object's field goes through a helper variable ``@<obj>`` that holds just the object. Instances see
class attributes along the C3 order computed beforehand, which keeps the rules monotone.

Second pass, for other policies than 0-cfa: contexts of scopes are the fixpoint of the policy over the first pass's call
graph; constraints are cloned for each (scope, context) reached, arguments and results flow per call edge, and the same rules run again.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import context
from factloom.functions.builtins_table import ALLOCATES
from factloom.operators import hierarchy, library
from factloom.operators.alike import Alike, alike, without_values
from factloom.operators.fixpoint import fixpoint, union
from factloom.operators.points_to import points_to
from factloom.session import Scratch
from factloom.sources import python_files


CALLABLE = "^(fn|cls|bm|bi):"  # objects that can be called, beside instances with __call__
WRITTEN = "not contains(site, '/op')"  # calls that the source has, not those of special methods and by builtins
THROUGH = "bo <> '' or contains(site, '/op')"  # calls through an object's fields; a builtin's by its name has flows of its own


@dataclass
class Program:
    """Constraint tables. Variables are (owner, name); scope is where a constraint stands, '' for what has no context.

    alloc(scope, to, t, obj), copy(scope, so, s, to, t), load(scope, bo, b, field, to, t), store(scope, bo, b, field, so, s),
    call(scope, site, bo, b, to, t), arg(site, role, pos, kw, ao, a), param(fn, pos, kind, name, has_default, shift), init(cls, fn), act(cls, fn): __call__, recv(site, ro, r)
    """

    alloc: DataFrame
    copy: DataFrame
    load: DataFrame
    store: DataFrame
    call: DataFrame
    arg: DataFrame
    param: DataFrame
    init: DataFrame
    act: DataFrame
    recv: DataFrame
    scopes: DataFrame

    def callable(self, rows: DataFrame) -> DataFrame:
        """Rows with an obj, and whether it can be called: ok."""
        own = self.act.select(F.concat(F.lit("inst:"), "cls").alias("obj"), F.lit(True).alias("acts")).distinct()
        return rows.join(own, "obj", "left").withColumn("ok", F.coalesce(F.col("obj").rlike(CALLABLE) | F.coalesce("acts", F.lit(False)), F.lit(False))).drop("acts")


@dataclass
class Result:
    program: Program
    pts: DataFrame  # (node, field, obj); a variable's node is ctx|owner|name
    cg: DataFrame  # (site, ctx, caller, callee, callee_ctx)
    resolved: DataFrame  # (scope, site, fn, off) of the pass without contexts
    alike: Alike | None = None  # classes of modules that are alike, and
    ones: Result | None = None  # the result for one of each: what is small is derived from it first and given to all then

    def of_all(self, rows: Callable[[Result], DataFrame]) -> DataFrame:
        return rows(self) if self.ones is None else self.alike.expand(rows(self.ones))

    def variables(self) -> DataFrame:
        """(ctx, owner, name, obj), without helpers."""
        return self.of_all(Result._variables)

    def _variables(self) -> DataFrame:
        x = F.split("node", "\\|")
        v = self.pts.where("field = '' and not contains(node, '|@')")
        return v.select(x[0].alias("ctx"), x[1].alias("owner"), x[2].alias("name"), "obj")

    def of_variable(self, owner: str, name: str) -> DataFrame:
        return self.variables().where((F.col("owner") == owner) & (F.col("name") == name)).select("obj").distinct()

    def get_field(self, obj: str, field: str) -> DataFrame:
        return self.pts.where((F.col("node") == obj) & (F.col("field") == field)).select(F.col("obj").alias("value")).distinct()

    def may_alias(self, a: tuple[str, str], b: tuple[str, str]) -> bool:
        return not self.of_variable(*a).join(self.of_variable(*b), "obj", "left_semi").isEmpty()

    def plain_calls(self) -> DataFrame:
        return self.of_all(Result._plain_calls)

    def _plain_calls(self) -> DataFrame:
        return self.cg.select(F.when(F.col("caller") == "", F.split("site", "/")[0]).otherwise(F.col("caller")).alias("src"), F.col("callee").alias("tgt")).distinct()

    def failed_calls(self) -> DataFrame:
        """(scope, site): calls whose callee holds nothing that can be called; builtins apart."""
        return self.of_all(Result._failed_calls)

    def _failed_calls(self) -> DataFrame:
        c = self.program.call.where(f"bo <> '' and {WRITTEN}").select("scope", "site", _node("bo", "b").alias("node"))
        return c.join(self.program.callable(self.pts.where("field = ''")).where("ok").select("node"), "node", "left_anti").select("scope", "site")

    def statistics(self) -> DataFrame:
        is_var = F.col("field") == ""
        return self.pts.where("not contains(node, '|@')").agg(F.count_distinct(F.when(is_var, F.col("node"))).alias("variables"), F.count_distinct(F.when(~is_var, F.struct("node", "field"))).alias("heap_locations"), F.count_distinct("obj").alias("objects"))


def constraints(f: DataFrame) -> Program:
    """Translate the front end's facts."""
    spark = f.sparkSession
    scratch = Scratch(spark, "constraints")
    f = scratch.keep(f)
    lit, col = F.lit, F.col
    scope = python_files.scopes(f)
    st = python_files.statements(f).withColumn("site", F.concat_ws(":", "scope", col("idx").cast("string")))
    st, special = _special_calls(st)
    var = scratch.keep(python_files.variables(f).select(col("scope").alias("vs"), col("name").alias("vn"), "owner").union(special.select("scope", "target", "scope")))
    kinds = scope.select(col("scope").alias("owner"), "kind")

    def owned(df: DataFrame, name: str, out: str) -> DataFrame:
        j = df.join(var, (col("scope") == col("vs")) & (col(name) == col("vn")), "left").drop("vs", "vn")
        return j.withColumn(out, F.coalesce("owner", lit(""))).drop("owner")

    arg = st.select("scope", "site", "kind", col("name").alias("op"), "target", "base", F.exists("args", lambda x: x["role"] == "star").alias("loose"), F.posexplode("args").alias("pos", "x")).select("*", col("x.role").alias("role"), col("x.name").alias("kw"), col("x.var").alias("a")).drop("x")

    # objects
    what = F.when(col("kind") == "FuncDef", F.concat(lit("fn:"), "base")).when(col("kind") == "ClassDef", F.concat(lit("cls:"), "base")).when(col("kind").isin("Build", "Const", "BinOp", "UnaryOp", "Compare", "Format", "HasNext", "Match", "Unknown", "CatchBind"), F.concat_ws("/", "site", F.coalesce("name", "kind")))
    alloc = [owned(st.withColumn("obj", what).where("obj is not null and target is not null").select("scope", "target", "obj"), "target", "to").select("scope", "to", col("target").alias("t"), "obj")]
    helper = lambda obj: [lit("").alias("scope"), lit("").alias("to"), F.concat(lit("@"), obj).alias("t"), obj.alias("obj")]
    fn = F.concat(lit("fn:"), "scope")
    cls_rows = scope.where("kind = 'class'").select(col("scope").alias("cls"))
    alloc.append(scope.where("kind = 'function'").select(*helper(fn)))
    for tag in ("cls:", "inst:", "super:"):
        alloc.append(cls_rows.select(*helper(F.concat(lit(tag), "cls"))))
    mods = scope.where("kind = 'module'").select(col("scope").alias("m"))
    alloc.append(mods.select(*helper(F.concat(lit("mod:"), "m"))))

    # plain flows
    moves = arg.where("role = 'pos' and kind in ('Copy', 'Await')").select("scope", "target", "a")
    copy = [owned(owned(moves, "target", "to"), "a", "so").select("scope", "so", col("a").alias("s"), "to", col("target").alias("t"))]
    given = arg.where("kind = 'FuncDef' and role = 'default'").select("scope", "a", col("base").alias("to"), col("kw").alias("t"))
    copy.append(owned(given, "a", "so").select(lit("").alias("scope"), "so", col("a").alias("s"), "to", "t"))
    outs = arg.where("kind in ('Return', 'Yield') and role = 'pos'").select("scope", F.when(col("kind") == "Return", "$return").otherwise("$yield").alias("t"), "a")
    copy.append(owned(outs, "a", "so").select("scope", "so", col("a").alias("s"), col("scope").alias("to"), "t"))
    const = scratch.keep(st.where("kind = 'Const'").select(col("target").alias("cv"), col("module").alias("cm"), col("name").alias("ct"), col("label").alias("key")))
    key = F.when(((col("ct") == "int") & ~col("key").startswith("-")) | (col("ct") == "str"), F.concat(lit("["), "key", lit("]")))
    keyed = lambda d, *cs: d.withColumn("kv", F.get("args", lit(0))["var"]).join(const, (col("kv") == col("cv")) & (col("module") == col("cm")), "left").withColumn("exact", key).select("scope", "base", "exact", "ct", "kv", *cs)
    subl = keyed(st.where("kind = 'LoadSubscr'"), "target").select("scope", "base", F.explode(F.when(col("exact").isNull(), F.array(lit("[]"))).otherwise(F.array(col("exact"), lit("[?]")))).alias("field"), "target")
    get = union([st.where("kind = 'LoadAttr'").select("scope", "base", col("name").alias("field"), "target"), subl])
    load = [owned(owned(get, "base", "bo"), "target", "to").select("scope", "bo", col("base").alias("b"), "field", "to", col("target").alias("t"))]
    subs = scratch.keep(keyed(st.where("kind = 'StoreSubscr'"), F.get("args", lit(1))["var"].alias("a")))
    built = arg.where("kind = 'Build' and op in ('list', 'tuple', 'set', 'dict') and role in ('pos', 'value')")
    fixed = (col("op") == "tuple") & ~col("loose")
    keys = union([subs.select("scope", "base", lit("{}").alias("field"), col("kv").alias("a")), arg.where("kind = 'Build' and op = 'dict' and role = 'key'").select("scope", col("target").alias("base"), lit("{}").alias("field"), "a")])
    put = union([st.where("kind = 'StoreAttr'").select("scope", "base", col("name").alias("field"), F.get("args", lit(0))["var"].alias("a")), keys, subs.where("ct is null or ct <> 'str'").select("scope", "base", lit("[]").alias("field"), "a"), built.where(~fixed).select("scope", col("target").alias("base"), lit("[]").alias("field"), "a")])
    stored = lambda d: owned(owned(d, "base", "bo"), "a", "so").select("scope", "bo", col("base").alias("b"), "field", "so", col("a").alias("s"))
    store = [stored(put)]
    placed = union([subs.where("ct = 'str'").select("scope", "base", col("exact").alias("field"), "a"), built.where(fixed).select("scope", col("target").alias("base"), F.concat(lit("["), col("pos").cast("string"), lit("]")).alias("field"), "a")])
    exact = [stored(union([placed, placed.withColumn("field", lit("[]"))]))]
    spread = owned(owned(arg.where("kind = 'Build' and role = 'star'").select("scope", "site", "pos", "target", "a"), "target", "bo"), "a", "ao")
    loose = F.concat(lit("@star:"), "site", lit(":"), col("pos").cast("string"))
    load.append(spread.select("scope", col("ao").alias("bo"), col("a").alias("b"), lit("[]").alias("field"), lit("").alias("to"), loose.alias("t")))
    store.append(spread.select("scope", "bo", col("target").alias("b"), lit("[]").alias("field"), lit("").alias("so"), loose.alias("s")))

    # static flows between variables and fields of known objects
    reads = lambda obj, field, to, t: [lit("").alias("scope"), lit("").alias("bo"), F.concat(lit("@"), obj).alias("b"), field.alias("field"), to.alias("to"), t.alias("t")]
    writes = lambda obj, field, so, s: [lit("").alias("scope"), lit("").alias("bo"), F.concat(lit("@"), obj).alias("b"), field.alias("field"), so.alias("so"), s.alias("s")]
    held = python_files.stores(f).select("scope", "var").distinct()
    store.append(held.join(cls_rows, col("scope") == col("cls")).select(*writes(F.concat(lit("cls:"), "cls"), col("var"), col("cls"), col("var"))))
    store.append(held.join(mods, col("scope") == col("m")).select(*writes(F.concat(lit("mod:"), "m"), col("var"), col("m"), col("var"))))
    named = st.where("kind = 'ClassDef'").select(col("scope").alias("in"), col("target").alias("cn"), col("base").alias("bcls"))
    bases = f.where("rec = 'base'").select(col("scope").alias("cls"), col("idx").alias("base_idx"), col("base").alias("bn")).join(scope.select(col("scope").alias("cls"), col("parent").alias("scope")), "cls")
    bases = scratch.keep(owned(bases, "bn", "bown").join(named, (col("bown") == col("in")) & (col("bn") == col("cn"))).select("cls", col("bcls").alias("base"), "base_idx"))
    mro = scratch.keep(hierarchy.c3_mro(bases, cls_rows))
    defines = held.join(cls_rows, col("scope") == col("cls")).select("cls", col("var").alias("attr"))
    cattr = scratch.keep(hierarchy.resolve_attribute(mro, defines))
    above = scratch.keep(hierarchy.resolve_attribute(mro.where("pos > 0"), defines))
    store.append(cls_rows.select(*writes(F.concat(lit("cls:"), "cls"), lit("ret"), lit(""), F.concat(lit("@inst:"), "cls"))))

    # parameters: methods get the receiver first, so their arguments are shifted by one
    fdef = st.where("kind = 'FuncDef'").select(col("base").alias("fn"), col("scope").alias("in"), col("target").alias("fname"))
    fkind = scope.where("kind = 'function'").select(col("scope").alias("fn"), "decorators", "flags")
    method = fdef.join(cls_rows, col("in") == col("cls")).join(fkind, "fn").select("fn", "cls", "fname", F.when(col("decorators").rlike("(^|,)staticmethod"), "static").when(col("decorators").rlike("(^|,)classmethod"), "class").otherwise("plain").alias("mk"))
    method = scratch.keep(method)
    prop = method.join(fkind, "fn").where("rlike(decorators, '(^|,)(functools[.])?(cached_)?property(,|$)')").select(col("cls").alias("definer"), col("fname").alias("attr"), col("fn").alias("getter"))
    for tag, rows in (("inst:", cattr), ("super:", above), ("cls:", cattr.where("cls <> definer"))):
        rows = rows.join(prop, ["definer", "attr"], "left") if tag != "cls:" else rows.withColumn("getter", lit(None).cast("string"))
        store.append(rows.select(*writes(F.concat(lit(tag), "cls"), col("attr"), F.coalesce("getter", "definer"), F.when(col("getter").isNotNull(), "$return").otherwise(col("attr")))))
    param = python_files.parameters(f).select(col("scope").alias("fn"), "pos", "kind", "name", "has_default").join(method.where("mk <> 'static'").select("fn", lit(1).alias("shift")), "fn", "left")
    param = scratch.keep(param.withColumn("shift", F.coalesce("shift", lit(0))))
    special_of = lambda name: scratch.keep(cattr.where(col("attr") == name).join(method.where(col("fname") == name).select(col("cls").alias("definer"), "fn"), "definer").select("cls", "fn"))
    init, act = special_of("__init__"), special_of("__call__")
    first = param.where("pos = 0 and kind in ('posonly', 'pos')").select("fn", "name")
    seen = method.join(cattr.select(col("cls").alias("c"), col("attr").alias("fname"), col("definer").alias("cls")), ["cls", "fname"]).join(first, "fn")
    receiver = seen.where("mk <> 'static'").select(lit("").alias("scope"), lit("").alias("so"), F.concat(F.when(col("mk") == "class", "@cls:").otherwise("@inst:"), "c").alias("s"), col("fn").alias("to"), col("name").alias("t"))
    copy.append(receiver)

    # builtins, by the callee's name or as objects, and container methods
    call = owned(owned(st.where("kind = 'Call'").select("scope", "site", "base", "target"), "base", "bo"), "target", "to").select("scope", "site", "bo", col("base").alias("b"), "to", col("target").alias("t"))
    call = scratch.keep(call)
    args = scratch.keep(owned(arg.where("kind = 'Call'").select("scope", "site", "role", "pos", "kw", "a"), "a", "ao").select("scope", "site", "role", "pos", "kw", "ao", "a"))
    via = st.where("kind = 'LoadAttr'").select("scope", col("target").alias("b"), col("base").alias("r"), col("name").alias("attr"))
    via = scratch.keep(owned(call.join(via, ["scope", "b"]).select("scope", "site", "to", "t", "r", "attr"), "r", "ro"))
    copy = [library.apart(union(copy), "so", "s", "scope", "to")]
    store, exact = ([library.apart(union(d), "so", "s", "scope")] for d in (store, exact))
    args = scratch.keep(library.apart(args, "ao", "a", "scope"))
    rows = library.Rows(alloc, copy, load, store, exact)
    read = [d.where(f"{o} = '' and rlike({v}, '^[a-z]+@')").select(col(v).alias("var")) for d, o, v in ((copy[0], "so", "s"), (store[0], "so", "s"), (exact[0], "so", "s"), (args, "ao", "a"))]
    used = scratch.keep(call.where("bo = '' and not contains(site, '/op')").select("scope", "site", "to", "t", col("b").alias("name")))
    sites, given = library.as_values(spark, scratch, rows, union(read), args)
    attr = const.where("ct = 'str'").select("cv", "cm", F.regexp_extract("key", "^'(\\w+)'$", 1).alias("attr")).where("attr <> ''")
    defined = scratch.keep(defines.select(col("attr").alias("method")).distinct())
    library.functions(spark, scratch, rows, used.union(sites), args.union(given), attr, defined)
    call, args = scratch.keep(union([call, *rows.call])), scratch.keep(union([args, *rows.arg]))
    makes = spark.createDataFrame(sorted((b, kind) for b, kind in ALLOCATES.items() if "." not in b and kind != "const"), "name string, ckind string")
    containers = st.where("kind = 'Build' and name in ('list', 'dict', 'set')").select("scope", F.concat_ws("/", "site", "name").alias("box"), col("name").alias("ckind"), lit(False).alias("new"))
    containers = containers.union(used.union(sites).join(makes, "name").select("scope", F.concat("site", lit("/new")), "ckind", lit(True)))
    library.methods(spark, scratch, rows, containers, st.where("kind = 'LoadAttr'").select("name").distinct())
    inside = scope.where("kind = 'function'").select("scope", col("parent").alias("cls")).join(cls_rows, "cls")
    alloc.append(used.where("name = 'super'").join(inside, "scope").select("scope", "to", "t", F.concat(lit("super:"), "cls").alias("obj")))

    # imports and generators
    imp = python_files.imports(f).join(st.select("scope", "idx", "target"), ["scope", "idx"]).where("target is not null")
    imp = owned(imp, "target", "to")
    whole = imp.where("form <> 'from'").join(mods, F.when(col("form") == "top", F.split("name", "\\.")[0]).otherwise(col("name")) == col("m"))
    alloc.append(whole.select("scope", "to", col("target").alias("t"), F.concat(lit("mod:"), "m").alias("obj")))
    absent = imp.join(mods, F.when(col("form") == "top", F.split("name", "\\.")[0]).otherwise(col("name")) == col("m"), "left_anti")
    alloc.append(absent.select("scope", "to", col("target").alias("t"), F.concat(lit("ext:"), F.when(col("form") == "from", F.concat_ws(".", "name", "item")).when(col("form") == "top", F.split("name", "\\.")[0]).otherwise(col("name"))).alias("obj")))
    copy.append(imp.where("form = 'from'").join(mods, col("name") == col("m")).select("scope", col("m").alias("so"), col("item").alias("s"), "to", col("target").alias("t")))
    gen = fkind.where("contains(flags, 'generator')").select("fn", F.concat(lit("gen:"), "fn").alias("obj"))
    alloc += [gen.select(*helper(col("obj"))), gen.select(col("fn").alias("scope"), col("fn").alias("to"), lit("$return").alias("t"), "obj")]
    store.append(gen.select(*writes(col("obj"), lit("[]"), col("fn"), lit("$yield"))))

    recv = via.select("site", "ro", "r").distinct()
    keep = lambda rows: scratch.keep(union(rows).distinct())
    loose = union(store)
    store = [loose, loose.where("field = '[]'").withColumn("field", lit("[?]")), *exact]
    return Program(keep(alloc), keep(copy), keep(load), keep(store), call, args, param, init, act, scratch.keep(recv), scratch.keep(scope.select("scope", "kind")))


SPECIAL = {"BinOp": {op: f"__{op}__" for op in ("add", "sub", "mul", "truediv", "floordiv", "mod", "pow", "matmul", "lshift", "rshift", "and", "or", "xor")}, "UnaryOp": {op: f"__{op}__" for op in ("neg", "pos", "invert")}, "Compare": {op: f"__{op}__" for op in ("eq", "ne", "lt", "le", "gt", "ge")}}


def _special_calls(st: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The statements with a method load and a call for each operator and subscript, of the left operand and reflected; the loads."""
    op = {kind: F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[F.col("name")] for kind, names in SPECIAL.items()}
    arg, none, kind = F.col("args"), F.lit(None).cast("string"), F.col("kind")
    a, b = F.get(arg, F.lit(0))["var"], F.get(arg, F.lit(1))["var"]
    form = lambda recv, name, *xs: F.struct(recv.alias("r"), name.alias("m"), F.array(*xs).cast("array<string>").alias("xs"))
    swapped = F.concat(F.lit("__r"), F.substring(op["BinOp"], 3, 100))
    every = F.array(
        F.when(kind == "BinOp", form(a, op["BinOp"], b)), F.when(kind == "BinOp", form(b, swapped, a)), F.when(kind == "UnaryOp", form(a, op["UnaryOp"])), F.when(kind == "Compare", form(a, op["Compare"], b)),
        F.when((kind == "Compare") & F.col("name").isin("in", "notin"), form(b, F.lit("__contains__"), a)), F.when(kind == "LoadSubscr", form(F.col("base"), F.lit("__getitem__"), a)),
        F.when(kind == "StoreSubscr", form(F.col("base"), F.lit("__setitem__"), a, b)), F.when(kind == "DelSubscr", form(F.col("base"), F.lit("__delitem__"), a)),
    )
    rows = st.select("*", F.posexplode(F.array_compact(every)).alias("nth", "x")).where("x.m is not null")
    at, held = F.concat(F.col("site"), F.lit("/op"), F.col("nth").cast("string")), F.concat(F.lit("$op"), F.col("idx").cast("string"), F.lit("_"), F.col("nth").cast("string"))
    empty = F.array().cast("array<struct<role:string,name:string,var:string>>")
    get = rows.select("module", "scope", "idx", F.lit("LoadAttr").alias("kind"), held.alias("target"), F.col("x.r").alias("base"), F.col("x.m").alias("name"), none.alias("label"), empty.alias("args"), "line", at.alias("site"))
    call = rows.select("module", "scope", "idx", F.lit("Call"), F.when(kind.isin("StoreSubscr", "DelSubscr"), none).otherwise(F.col("target")), held, none, none, F.transform("x.xs", lambda v: F.struct(F.lit("pos").alias("role"), none.alias("name"), v.alias("var"))), "line", at)
    return st.select(*get.columns).union(get).union(call), get


def bound_arguments(p: Program, sites: DataFrame) -> DataFrame:
    """(site, fn, ao, a, name, extra): arguments of call sites (site, fn, off) and the parameters that they reach; extra is the element of a
    *args or **kwargs parameter that takes a surplus argument."""
    off = F.col("off")
    j = sites.join(p.arg.select("site", "role", "pos", "kw", "ao", "a").withColumnRenamed("pos", "k"), "site").join(p.param, "fn")
    n_pos = p.param.where("kind in ('posonly', 'pos')").groupBy("fn").agg(F.count("*").alias("n_pos"))
    names = p.param.where("kind in ('pos', 'kwonly')").groupBy("fn").agg(F.collect_set("name").alias("names"))
    j = j.join(n_pos, "fn", "left").join(names, "fn", "left").withColumn("n_pos", F.coalesce("n_pos", F.lit(0)))
    at = F.col("k") + off
    plain = ((F.col("role") == "pos") & F.col("kind").isin("posonly", "pos") & (F.col("pos") == at)) | ((F.col("role") == "kw") & F.col("kind").isin("pos", "kwonly") & (F.col("name") == F.col("kw")))
    surplus = ((F.col("role") == "pos") & (F.col("kind") == "star") & (at >= F.col("n_pos"))) | ((F.col("role") == "kw") & (F.col("kind") == "kwstar") & ~F.coalesce(F.array_contains("names", F.col("kw")), F.lit(False)))
    spread = ((F.col("role") == "star") & F.col("kind").isin("posonly", "pos") & (F.col("pos") >= at)) | ((F.col("role") == "kwstar") & F.col("kind").isin("pos", "kwonly"))
    how = F.when(plain, "plain").when(surplus, "surplus").when(spread, "spread")
    return j.withColumn("how", how).where("how is not null").select("site", "fn", "ao", "a", "name", "how").distinct()


def _calls(p: Program, pts: DataFrame) -> DataFrame:
    """(scope, site, fn, off): functions that each site may call, by what its callee holds; off: positions taken by the receiver."""
    v = pts.where("field = ''").select(F.col("node"), "obj")
    c = p.call.withColumn("node", F.concat_ws("|", F.lit(""), "bo", "b")).join(v, "node").select("scope", "site", "obj")
    shift = p.param.select("fn", "shift").distinct()
    direct = c.where("startswith(obj, 'fn:')").select("scope", "site", F.expr("substring(obj, 4)").alias("fn"))
    made = c.where("startswith(obj, 'cls:')").select("scope", "site", F.expr("substring(obj, 5)").alias("cls")).join(p.init, "cls").select("scope", "site", "fn")
    acts = c.where("startswith(obj, 'inst:')").select("scope", "site", F.expr("substring(obj, 6)").alias("cls")).join(p.act, "cls").select("scope", "site", "fn")
    return union([direct, made, acts]).distinct().join(shift, "fn", "left").select("scope", "site", "fn", F.coalesce("shift", F.lit(0)).alias("off"))


def _node(owner: str, name: str, ctx: Column | None = None) -> Column:
    return F.concat_ws("|", ctx if ctx is not None else F.lit(""), owner, name)


def _solve(p: Program, policy: str, contexts: DataFrame | None, edges: DataFrame | None, max_rounds: int, log: list | None, built: DataFrame | None = None) -> DataFrame:
    """Run the four rules. Constraints are cloned for contexts (scope, ctx); those without a scope aren't. edges: (site, fn, off, ctx, nctx),
    built: (site) of calls that may reach builtins."""
    if contexts is None:
        cl = lambda d: d.withColumn("ctx", F.lit(""))
    else:
        every = contexts.union(contexts.sparkSession.createDataFrame([("", "")], "scope string, ctx string"))
        cl = lambda d: d.join(every, "scope")
    own = lambda o: F.when(F.col(o) == F.col("scope"), F.col("ctx")).otherwise(F.lit(""))
    parts = F.when(F.col("ctx") == "", F.array().cast("array<string>")).otherwise(F.split("ctx", ","))
    heap = F.array_join(context.alloc_context(policy, parts, F.col("obj")), ",")
    is_data = (F.col("scope") != "") & ~F.col("obj").rlike("^(fn|cls|inst|super|mod|gen):") & ~F.col("obj").endswith("/new")
    obj = F.when(is_data & (heap != ""), F.concat("obj", F.lit("^"), heap)).otherwise(F.col("obj"))
    alloc = cl(p.alloc).select(_node("to", "t", own("to")).alias("node"), obj.alias("obj"))
    copy = cl(p.copy).select(_node("so", "s", own("so")).alias("src"), _node("to", "t", own("to")).alias("tgt"))
    load = cl(p.load).select(_node("bo", "b", own("bo")).alias("base"), "field", _node("to", "t", own("to")).alias("tgt"))
    store = cl(p.store).select(_node("bo", "b", own("bo")).alias("base"), "field", _node("so", "s", own("so")).alias("src"))
    if contexts is not None:
        # what has no context of its own (receivers, yields) reaches the scope's variables in all contexts
        per = lambda d, o: d.where("scope = ''").join(contexts.withColumnRenamed("scope", o), o).where("ctx <> ''")
        copy = copy.union(per(p.copy, "to").select(_node("so", "s").alias("src"), _node("to", "t", F.col("ctx")).alias("tgt")))
        store = store.union(per(p.store, "so").select(_node("bo", "b").alias("base"), "field", _node("so", "s", F.col("ctx")).alias("src")))
    if edges is None:
        # calls as fields of the callee's object
        c = p.call.where(THROUGH).select("site", F.col("bo"), F.col("b"), "scope", "to", "t")
        a = p.arg.join(c.select("site", "bo", "b"), "site")
        slot = F.when(F.col("role") == "kw", F.concat(F.lit("kw:"), "kw")).when(F.col("role") == "pos", F.concat(F.lit("arg"), F.col("pos").cast("string")))
        store = store.union(a.where("role in ('pos', 'kw')").select(_node("bo", "b").alias("base"), slot.alias("field"), _node("ao", "a").alias("src")))
        load = load.union(c.where("t is not null").select(_node("bo", "b").alias("base"), F.lit("ret").alias("field"), _node("to", "t").alias("tgt")))
        store = store.union(a.where("role in ('star', 'kwstar')").select(_node("bo", "b").alias("base"), F.col("role").alias("field"), _node("ao", "a").alias("src")))
        store = store.union(a.where("role = 'kw'").select(_node("bo", "b").alias("base"), F.lit("kw*").alias("field"), _node("ao", "a").alias("src")))
        # (owner, fn, off): the object whose fields hold a function's arguments, and the positions that its receiver takes
        offs = p.param.select("fn", F.explode(F.array(F.lit(0), "shift")).alias("off")).distinct()
        owner = offs.select(F.concat(F.lit("||@fn:"), "fn").alias("owner"), "fn", "off").union(p.init.select(F.concat(F.lit("||@cls:"), "cls"), "fn", F.lit(1))).union(p.act.select(F.concat(F.lit("||@inst:"), "cls"), "fn", F.lit(1)))
        own_param = owner.join(p.param, "fn")
        var, strewn, named = _node("fn", "name"), F.concat("owner", F.lit("*")), F.concat("owner", F.lit("**"))
        slot = F.concat(F.lit("arg"), (F.col("pos") - F.col("off")).cast("string"))
        read = lambda d, base, field, tgt: d.select(base.alias("base"), field.alias("field"), tgt.alias("tgt"))
        plain, keyed = own_param.where("kind in ('posonly', 'pos')"), own_param.where("kind in ('pos', 'kwonly')")
        takers = own_param.where("kind in ('posonly', 'pos', 'star', 'kwonly', 'kwstar')").select("owner").distinct()
        load = union([load, read(plain.where("pos >= off"), F.col("owner"), slot, var), read(keyed, F.col("owner"), F.concat(F.lit("kw:"), "name"), var)])
        load = union([load, read(takers, F.col("owner"), F.lit("star"), strewn), read(takers, F.col("owner"), F.lit("kwstar"), named)])
        load = union([load, read(plain.where("pos >= off"), strewn, F.lit("[]"), var), read(keyed, named, F.lit("[]"), var)])
        # packs: surplus positions that any call uses, elements of spread arguments, keywords (those of named parameters too)
        pack, inside = F.concat(F.lit("pack:"), "fn", F.lit("."), "name"), F.concat("owner", F.lit(">"), "name")
        packs = own_param.where("kind in ('star', 'kwstar')")
        alloc = union([alloc, packs.select(var.alias("node"), pack.alias("obj"))])
        n_pos = p.param.where("kind in ('posonly', 'pos')").groupBy("fn").agg(F.count("*").alias("n_pos"))
        used = p.arg.where("role = 'pos'").select(F.col("pos").alias("at")).distinct()
        surplus = packs.where("kind = 'star'").join(n_pos, "fn", "left").join(used, F.col("at") + F.col("off") >= F.coalesce("n_pos", F.lit(0)))
        load = union([load, read(surplus, F.col("owner"), F.concat(F.lit("arg"), F.col("at").cast("string")), inside), read(packs.where("kind = 'star'"), strewn, F.lit("[]"), inside), read(packs.where("kind = 'kwstar'"), named, F.lit("[]"), inside), read(packs.where("kind = 'kwstar'"), F.col("owner"), F.lit("kw*"), inside)])
        store = union([store, *(packs.select(var.alias("base"), F.lit(f).alias("field"), inside.alias("src")) for f in ("[]", "[?]"))])
        store = store.union(p.act.select(F.concat(F.lit("||@inst:"), "cls"), F.lit("ret"), F.concat(F.lit("|"), "fn", F.lit("|$return"))))
        store = store.union(p.scopes.where("kind = 'function'").select(F.concat(F.lit("||@fn:"), "scope").alias("base"), F.lit("ret").alias("field"), F.concat_ws("|", F.lit(""), "scope", F.lit("$return")).alias("src")))
    else:
        b = bound_arguments(p, edges.select("site", "fn", "off").distinct()).join(edges.select("site", "fn", "ctx", "nctx", "scope"), ["site", "fn"])
        src, tgt = _node("ao", "a", F.when(F.col("ao") == F.col("scope"), F.col("ctx")).otherwise(F.lit(""))), _node("fn", "name", F.col("nctx"))
        pack = F.concat(F.lit("pack:"), "fn", F.lit("."), "name", F.lit("^"), "nctx")
        copy = copy.union(b.where("how = 'plain'").select(src.alias("src"), tgt.alias("tgt")))
        load = load.union(b.where("how = 'spread'").select(src.alias("base"), F.lit("[]").alias("field"), tgt.alias("tgt")))
        alloc = alloc.union(b.where("how = 'surplus'").select(tgt.alias("node"), pack.alias("obj")))
        for f in ("[]", "[?]"):
            store = store.union(b.where("how = 'surplus'").select(tgt.alias("base"), F.lit(f).alias("field"), src.alias("src")))
        # builtins and container methods take their arguments from fields, in all contexts of the calls that may reach them
        taken = p.arg.where("role in ('pos', 'kw')").join(p.call.where(THROUGH).join(built, "site", "left_semi").select("scope", "site", "bo", "b"), ["scope", "site"])
        slot = F.when(F.col("role") == "kw", F.concat(F.lit("kw:"), "kw")).otherwise(F.concat(F.lit("arg"), F.col("pos").cast("string")))
        store = store.union(cl(taken).select(_node("bo", "b", own("bo")).alias("base"), slot.alias("field"), _node("ao", "a", own("ao")).alias("src")))
        store = store.union(cl(taken.where("role = 'kw'")).select(_node("bo", "b", own("bo")).alias("base"), F.lit("kw*").alias("field"), _node("ao", "a", own("ao")).alias("src")))
        r = edges.join(p.call.select("site", "to", "t").where("t is not null"), "site").where("not is_init")
        back = _node("to", "t", F.when(F.col("to") == F.col("scope"), F.col("ctx")).otherwise(F.lit("")))
        copy = copy.union(r.select(F.concat_ws("|", "nctx", "fn", F.lit("$return")).alias("src"), back.alias("tgt")))
        load = load.union(cl(p.call.where(f"t is not null and ({THROUGH})")).select(_node("bo", "b", own("bo")).alias("base"), F.lit("ret").alias("field"), _node("to", "t", own("to")).alias("tgt")))
    scratch = Scratch(p.call.sparkSession, "solve")
    return points_to(*(scratch.keep(d.distinct()) for d in (alloc, copy, load, store)), max_rounds=max_rounds, log=log)


def call_contexts(p: Program, pts: DataFrame, found: DataFrame, policy: str, roots: DataFrame, max_rounds: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """Contexts that scopes run in, from the roots (scope) on, and calls between them: (scope, ctx) and (scope, site, fn, off, ctx, nctx)."""
    scratch = Scratch(found.sparkSession, "contexts")
    held = pts.where("field = ''").select("node", F.col("obj").alias("recv"))
    recv = p.recv.withColumn("node", _node("ro", "r")).join(held, "node").select("site", "recv").where("startswith(recv, 'inst:')")
    names = p.arg.groupBy("site").agg(F.collect_set("a").alias("names"))
    calls = scratch.keep(found.join(recv, "site", "left").join(names, "site", "left"))
    ctx = F.when(F.col("ctx") == "", F.array().cast("array<string>")).otherwise(F.split("ctx", ","))
    new = F.array_join(context.call_context(policy, ctx, F.col("site"), F.col("recv"), F.col("recv"), F.col("recv"), F.coalesce("names", F.array().cast("array<string>"))), ",")
    reach = scratch.keep(fixpoint(roots.select("scope", F.lit("").alias("ctx")), lambda d, _: d.join(calls, "scope").select(F.col("fn").alias("scope"), new.alias("ctx")), max_rounds))
    return reach, scratch.keep(reach.join(calls, "scope").select("scope", "site", "fn", "off", "ctx", new.alias("nctx")).distinct())


def analyse(f: DataFrame, policy: str = "0-cfa", entries: str = "all", max_rounds: int = 1_000_000, log: list | None = None) -> Result:
    """Points-to sets and call graph of the modules' facts. ``entries``: scopes that run without a caller: 'all', or 'modules' (with class bodies).
    Of modules that are alike one is solved."""
    same = alike(f, without_values)
    if same is None:
        return _analyse(f, policy, entries, max_rounds, log)
    one = _analyse(same.facts, policy, entries, max_rounds, log)
    program = Program(**{x.name: same.expand(getattr(one.program, x.name)) for x in fields(Program)})
    return Result(program, *(same.expand(d) for d in (one.pts, one.cg, one.resolved)), same, one)


def _analyse(f: DataFrame, policy: str, entries: str, max_rounds: int, log: list | None) -> Result:
    scratch = Scratch(f.sparkSession, "pointer")
    p = constraints(f)
    pts = _solve(p, "0-cfa", None, None, max_rounds, log)
    found = scratch.keep(_calls(p, pts))
    if policy == "0-cfa":
        return Result(p, pts, found.select("site", F.lit("").alias("ctx"), F.col("scope").alias("caller"), F.col("fn").alias("callee"), F.lit("").alias("callee_ctx")), found)
    roots = p.scopes.where("kind in ('module', 'class')" if entries == "modules" else "true").select("scope").union(f.sparkSession.createDataFrame([("",)], "scope string"))
    library_objects = pts.where("field = '' and rlike(obj, '^(bm|bi):')").select("node")
    built = scratch.keep(p.call.where(THROUGH).select("site", _node("bo", "b").alias("node")).join(library_objects, "node").select("site").distinct())
    reach, edges = call_contexts(p, pts, found, policy, roots, max_rounds)
    inits = p.init.select("fn").distinct().withColumn("is_init", F.lit(True))
    edges = scratch.keep(edges.join(inits, "fn", "left").withColumn("is_init", F.coalesce("is_init", F.lit(False))))
    pts = _solve(p, policy, reach, edges, max_rounds, log, built)
    return Result(p, pts, edges.select("site", "ctx", F.col("scope").alias("caller"), F.col("fn").alias("callee"), F.col("nctx").alias("callee_ctx")), found)
