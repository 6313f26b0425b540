"""Call graph by assignments between access paths, without points-to sets of instances: a class stands for its instances.

A path is a variable (owner.name), a member of a class or module (its qualname.name), a member of a container or generator (``box:``,
``gen:`` its site, then ``[key]``, ``[?]`` under a key unknown, ``[]`` any) or what a function returns (its qualname.<ret>). One relation (kind, a, b) grows to a fixpoint:

    v  path a may be the definition b (fn:, cls:, mod:, box:, gen:, ext: a module not given)
    e  b is assigned to a
    m  call site a calls what path b holds
    q  member b of class a is asked for
    c  call site a calls function b

The substitution of prefixes is the rule for ``t = p.x``: if p may be the definition d, then the path d.x is assigned to t; so ``a.b['c']`` is followed one member at
a time, and paths never grow longer than a definition and one member. Members that a class doesn't define come from its bases; a method's first parameter is
its class and those of the receivers it is called through (through super() the caller's own). What container methods
(``append`` and the like) move isn't followed; ``operators.pointer`` does that. The pass before the fixpoint resolves calls of names that a def or class statement binds.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.operators.alike import alike
from factloom.operators.fixpoint import fixpoint, union
from factloom.session import Scratch
from factloom.sources import modules, python_files


@dataclass
class Calls:
    before: DataFrame  # (site, caller, callee): calls by names that a def or class statement binds
    after: DataFrame  # (site, caller, callee): calls by any path, at the fixpoint
    values: DataFrame  # (path, definition)


def member(d: Column, name: Column) -> Column:
    """The path of a definition's member."""
    return F.concat_ws(".", F.when(d.rlike("^(cls|mod):"), F.substring(d, 5, 1 << 30)).otherwise(d), name)


def call_graph(f: DataFrame) -> Calls:
    """Both passes over the front end's facts; modules that they import and that are not among them are external. Of modules that are alike one is followed."""
    same = alike(f)
    if same is None:
        return _call_graph(f)
    one = _call_graph(same.facts)
    return Calls(same.expand(one.before), same.expand(one.after), same.expand(one.values))


def _call_graph(f: DataFrame) -> Calls:
    spark, col, lit = f.sparkSession, F.col, F.lit
    scratch = Scratch(spark, "assignments")
    f = scratch.keep(f)
    st = python_files.statements(f).withColumn("site", F.concat_ws(":", "scope", col("idx").cast("string")))
    var = python_files.variables(f).where("owner <> ''").select(col("scope").alias("vs"), col("name").alias("vn"), F.concat_ws(".", "owner", "name").alias("path"))

    def path(d: DataFrame, name: str, out: str) -> DataFrame:
        """With the path of the variable that column ``name`` holds; null for builtins."""
        return d.join(var, (col("scope") == col("vs")) & (col(name) == col("vn")), "left").drop("vs", "vn").withColumnRenamed("path", out)

    st = scratch.keep(path(path(st, "target", "t"), "base", "p"))
    args = st.select("module", "scope", "idx", "site", "kind", "base", "name", "t", F.posexplode("args").alias("at", "x")).select("*", col("x.role").alias("role"), col("x.name").alias("kw"), col("x.var").alias("v")).drop("x")
    args = scratch.keep(path(args, "v", "a"))
    row = lambda kind, d, a, b: d.select(lit(kind).alias("kind"), a.alias("a"), b.alias("b")).where("a is not null and b is not null")
    box, ret, gen = F.concat(lit("box:"), "site"), F.concat(col("scope"), lit(".<ret>")), F.concat(lit("gen:"), "scope")

    # Scopes: methods and their class, generators, classes and their bases.
    scopes = python_files.scopes(f)
    cls = scopes.where("kind = 'class'").select(col("scope").alias("cls"))
    own_class = scopes.where("kind = 'function' and not coalesce(decorators, '') rlike '(^|,)staticmethod'").join(cls, col("parent") == col("cls")).select("scope", "cls")
    bases = args.where("kind = 'ClassDef' and role = 'base'").select(F.concat(lit("cls:"), "base").alias("cls"), col("a").alias("base_path")).where("base_path is not null")
    own = python_files.stores(f).join(cls, col("scope") == col("cls")).select(F.concat(lit("cls:"), "cls").alias("cls"), col("var").alias("name")).distinct()
    par = python_files.parameters(f).join(own_class, "scope", "left").withColumn("k", col("pos") - col("cls").isNotNull().cast("long"))
    places = par.where("kind in ('posonly', 'pos') and k >= 0").groupBy("scope").agg(F.count("*").alias("n"))
    par = scratch.keep(par.join(places, "scope", "left").select(F.concat(lit("fn:"), "scope").alias("fn"), "scope", "kind", "name", "k", "cls", F.coalesce("n", lit(0)).alias("n"), F.concat_ws(".", "scope", "name").alias("to")))
    pack = F.concat(lit("box:"), "to")

    # Keys: literals of one type each; a slice or variable is unknown.
    literal = st.where("kind = 'Const' and name in ('int', 'str')").select(col("module").alias("lm"), col("target").alias("lv"), F.concat(lit("["), "label", lit("]")).alias("key"))
    keyed = args.where("role = 'key'").join(literal, (col("module") == col("lm")) & (col("v") == col("lv")), "left").select("site", col("at").alias("key_at"), F.coalesce("key", lit("[?]")).alias("key"))
    keyed = scratch.keep(keyed)

    built = args.where("kind = 'Build' and name in ('list', 'tuple', 'set', 'dict')")
    pairs = built.where("role = 'value'").join(keyed.withColumn("at", col("key_at") + 1), ["site", "at"]).select("site", "key", "a")
    items = built.where("role = 'pos'").select("site", F.when(col("name").isin("list", "tuple"), F.concat(lit("["), col("at").cast("string"), lit("]"))).otherwise(lit("[?]")).alias("key"), "a").union(pairs)
    stars = args.where("role in ('star', 'kwstar')").withColumn("helper", F.concat(col("site"), lit(".<star"), col("at").cast("string"), lit(">")))
    spread = F.explode(F.array(lit("[]"), lit("[?]"))).alias("key")

    known = f.select("module").distinct()
    imports = modules.resolve(python_files.imports(f), known, known.limit(0)).join(st.select("scope", "idx", "t"), ["scope", "idx"], "left")
    whole = imports.where("tgt is not null and (form <> 'from' or is_submodule)")
    named = imports.where("tgt is not null and form = 'from' and not is_submodule and item <> '*'")
    public = python_files.stores(f).join(known, col("scope") == col("module")).where("not startswith(var, '_') and not startswith(var, '$')").select(col("scope").alias("tgt"), "var").distinct()
    starred = imports.where("item = '*' and tgt is not null").join(public, "tgt")

    called = st.where("kind = 'Call'")
    by_path, walked, nexted = called.where("p is not null"), called.where("p is null and base in ('iter', 'aiter')"), called.where("p is null and base in ('next', 'anext')")
    first = args.where("kind = 'Call' and at = 0 and role = 'pos'").select("site", "a")
    own_method = lambda d, name: d.join(first, "site").select("site", "t", "a", F.concat(col("site"), lit(f".<{name}>")).alias("helper"), lit(name).alias("name"))
    protocol = own_method(walked, "__iter__").union(own_method(nexted, "__next__"))
    above = called.where("p is null and base = 'super'").join(own_class, "scope").join(bases.withColumn("cls", F.substring("cls", 5, 1 << 30)), "cls")

    load = union([
        st.where("kind = 'LoadAttr'").select("p", "name", "t"),
        st.where("kind = 'LoadSubscr'").join(keyed, "site").select("p", F.explode(F.when(col("key") == "[?]", F.array(lit("[]"))).otherwise(F.array("key", lit("[?]")))).alias("name"), "t"),
        stars.where("role <> 'kwstar' or kind = 'Call'").select(col("a").alias("p"), lit("[]").alias("name"), col("helper").alias("t")),
        nexted.join(first, "site").select(col("a").alias("p"), lit("[]").alias("name"), "t"),
        protocol.select(col("a").alias("p"), "name", col("helper").alias("t")),
        args.where("kind = 'Yield' and name = 'from'").select(col("a").alias("p"), lit("[]").alias("name"), F.concat(gen, lit(".[]")).alias("t")),
    ]).where("p is not null and t is not null").distinct()
    store = union([
        args.where("kind = 'StoreAttr'").join(st.select("site", "p"), "site").select("p", "name", "a"),
        args.where("kind = 'StoreSubscr' and role = 'value'").join(st.select("site", "p"), "site").join(keyed, "site").select("p", F.explode(F.array_distinct(F.array("key", lit("[]")))).alias("name"), "a"),
    ]).where("p is not null and a is not null").distinct()
    target = called.select("site", "t").where("t is not null")
    self_path = par.where("k = -1 and kind in ('posonly', 'pos')").select("scope", col("to").alias("self"))
    through = by_path.select("site", "p").join(st.where("kind = 'LoadAttr'").select(col("t").alias("p"), col("p").alias("receiver")), "p")
    receiver = through.select("site", "receiver").union(through.join(above.select(col("t").alias("receiver"), "scope"), "receiver").join(self_path, "scope").select("site", "self")).where("receiver is not null").distinct()
    given = args.where("kind = 'Call'").select("site", "role", col("at").cast("long").alias("at"), "kw", F.when(col("role").isin("star", "kwstar"), F.concat(col("site"), lit(".<star"), col("at").cast("string"), lit(">"))).otherwise(col("a")).alias("a")).where("a is not null")
    load, store, target, given, receiver, bases, own = map(scratch.keep, (load, store, target, given, receiver, bases, own))

    seeds = union([
        row("v", st.where("kind = 'FuncDef'"), col("t"), F.concat(lit("fn:"), "base")),
        row("v", st.where("kind = 'ClassDef'"), col("t"), F.concat(lit("cls:"), "base")),
    ])
    init = union([
        seeds,
        row("v", st.where("kind = 'Build' and name in ('list', 'tuple', 'set', 'dict')"), col("t"), box),
        row("v", scopes.where("flags like '%generator%'"), ret, gen),
        row("v", par.where("k = -1 and kind in ('posonly', 'pos')"), col("to"), F.concat(lit("cls:"), "cls")),
        row("v", par.where("kind in ('star', 'kwstar')"), col("to"), pack),
        row("v", whole, col("t"), F.concat(lit("mod:"), "tgt")),
        row("v", imports.where("tgt is null"), col("t"), F.concat(lit("ext:"), "full")),
        row("e", named, col("t"), F.concat_ws(".", "tgt", "item")),
        row("e", starred, F.concat_ws(".", "src", "var"), F.concat_ws(".", "tgt", "var")),
        row("e", args.where("kind in ('Copy', 'Await') and at = 0"), col("t"), col("a")),
        row("e", args.where("kind = 'Return'"), ret, col("a")),
        row("e", args.where("kind = 'Yield' and name is null"), F.concat(gen, lit(".[]")), col("a")),
        row("e", args.where("kind = 'FuncDef' and role = 'default'"), F.concat_ws(".", "base", "kw"), col("a")),
        row("e", items.select("site", "a", F.explode(F.array_distinct(F.array("key", lit("[]")))).alias("key")), member(box, col("key")), col("a")),
        row("e", stars.where("kind = 'Build' and role = 'star'").select("site", "helper", spread), member(box, col("key")), col("helper")),
        row("e", walked.join(first, "site"), col("t"), col("a")),
        row("e", above, col("t"), col("base_path")),
        row("m", by_path, col("site"), col("p")),
        row("m", protocol, col("site"), col("helper")),
    ])
    init = scratch.keep(init.distinct())

    def step(delta: DataFrame, known: DataFrame) -> DataFrame:
        of = lambda d, kind, a, b: d.where(col("kind") == kind).select(col("a").alias(a), col("b").alias(b))
        dv, kv = of(delta, "v", "at", "d"), of(known, "v", "at", "d")
        de, ke = of(delta, "e", "to", "at"), of(known, "e", "to", "at")
        flows = row("v", dv.join(ke, "at").union(kv.join(de, "at")), col("to"), col("d"))
        ext, is_cls = col("d").startswith("ext:"), col("d").startswith("cls:")
        read = dv.join(load.withColumnRenamed("p", "at"), "at")
        wrote = dv.join(store.withColumnRenamed("p", "at"), "at").where(~ext)
        got = [row("v", read.where(ext), col("t"), col("d")), row("e", read.where(~ext), col("t"), member(col("d"), col("name"))), row("q", read.where(is_cls), col("d"), col("name")), row("e", wrote, member(col("d"), col("name")), col("a"))]
        up = bases.withColumnRenamed("base_path", "at")
        asked = of(delta, "q", "cls", "name").join(up, "cls").join(kv, "at").union(of(known, "q", "cls", "name").join(up, "cls").join(dv, "at").select("at", "cls", "name", "d"))
        asked = asked.join(own, ["cls", "name"], "left_anti")
        got += [row("v", asked.where(ext), member(col("cls"), col("name")), col("d")), row("e", asked.where(is_cls), member(col("cls"), col("name")), member(col("d"), col("name"))), row("q", asked.where(is_cls), col("d"), col("name"))]
        reached = of(delta, "m", "site", "at").join(kv, "at").union(of(known, "m", "site", "at").join(dv, "at").select("at", "site", "d"))
        made = reached.where(ext | is_cls).join(target, "site")
        got += [row("c", reached.where("startswith(d, 'fn:')"), col("site"), col("d")), row("v", made, col("t"), col("d")), row("m", reached.where(is_cls), col("site"), member(col("d"), lit("__init__"))), row("q", reached.where(is_cls), col("d"), lit("__init__"))]
        calls = of(delta, "c", "site", "fn")
        bound = calls.join(given, "site").join(par, "fn")
        positional, surplus = "kind in ('posonly', 'pos') and k >= 0", "kind = 'star' and (role = 'star' or role = 'pos' and at >= n)"
        direct = bound.where(f"role = 'pos' and {positional} and k = at or role = 'star' and {positional} or role = 'kw' and name = kw and kind in ('pos', 'kwonly') or role = 'kwstar' and kind in ('pos', 'kwonly') and k >= 0")
        names = par.where("kind in ('pos', 'kwonly')").select("fn", col("name").alias("kw"))
        odd = bound.where("kind = 'kwstar' and role = 'kw'").join(names, ["fn", "kw"], "left_anti").withColumn("key", F.concat(lit("['"), "kw", lit("']")))
        more = bound.where(f"{surplus} or kind = 'kwstar' and role = 'kwstar'").withColumn("key", lit("[?]")).unionByName(odd.select(*bound.columns, "key")).withColumn("key", F.explode(F.array("key", lit("[]"))))
        me = calls.join(par.where("k = -1 and kind in ('posonly', 'pos')").select("fn", "to"), "fn")
        got += [row("e", me.join(receiver, "site"), col("to"), col("receiver")), row("e", me.where("endswith(fn, '.__init__')").join(target, "site"), col("to"), col("t"))]
        got += [row("e", calls.join(target, "site"), col("t"), F.concat(F.substring("fn", 4, 1 << 30), lit(".<ret>"))), row("e", direct, col("to"), col("a")), row("e", more, member(pack, col("key")), col("a"))]
        return union([flows, *got])

    all_rows = fixpoint(init, step)
    caller = st.select("site", col("scope").alias("caller"))
    edges = lambda d: d.select("site", "fn").distinct().join(caller, "site").select("site", "caller", F.substring("fn", 4, 1 << 30).alias("callee"))
    bound_by = seeds.select(col("a").alias("p"), col("b").alias("d"))
    by_name = by_path.select("site", "p").join(bound_by, "p")
    started = by_name.where("startswith(d, 'cls:')").select("site", member(col("d"), lit("__init__")).alias("p")).join(bound_by, "p")
    before = by_name.where("startswith(d, 'fn:')").select("site", col("d").alias("fn")).union(started.select("site", col("d").alias("fn")))
    return Calls(edges(before), edges(all_rows.where("kind = 'c'").select(col("a").alias("site"), col("b").alias("fn"))), all_rows.where("kind = 'v'").select(col("a").alias("path"), col("b").alias("definition")))
