"""Abstract values across calls: a value-flow graph of the whole program, solved as a fixpoint over lattice-valued rows.

Nodes are definitions (a statement's target), parameters, returns, names that other scopes read, attributes of abstract objects, literals, and blocks
(reached or not). ``flow`` rows say whose values meet in an operand of which node; ``ops`` rows say what a node makes of its operands. All of it
is built by joins from the front end's facts and the points-to result, which restricts callees and attributes:

    local names      the definitions that reach the use; a single definition without asking (sparse, so straight code costs nothing)
    names of others  a node for the name, fed by all its definitions; so are names that several scopes assign
    calls            actuals to formals, defaults where nothing binds, receivers; returns to the call's target; instances for classes
    attributes       a node for (object, attribute) fed by every store that may reach the object; a load reads those of all objects its base holds.
                     An object of multiplicity one has strong updates: within a scope its stores kill each other as definitions of a name do
    branches         a block is reached over an edge whose test is not definitely otherwise; definitions in blocks not reached have no value
    contexts         nodes of a scope are cloned for each context that the policy reaches; attributes and names of others are shared by all

A value is (types, lo, hi) of ``functions.abstract``. The delta of a round is the nodes whose joined value rose; a node that rose ``widen_after``
times gets open bounds where they still move, so loops and recursion end without a cap. What unknown code may call or change is unknown.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import abstract as av
from factloom.functions import abstract_arrays as aa
from factloom.operators import cfg, dataflow, pointer
from factloom.operators.alike import MARK, Alike
from factloom.operators.fixpoint import fixpoint, lattice_fixpoint, union
from factloom.session import Scratch, ship
from factloom.sources import python_files

#: Builtins that neither call nor change what they are given.
TAME = (*av.CALLED, "print", "range", "id", "type", "repr", "hash", "round", "sum", "ord", "chr", "super", "object", "property", "staticmethod", "classmethod", "callable", "bytes", "enumerate", "zip", "reversed")
#: What values of builtin types have, special methods apart.
BUILTIN_ATTRIBUTES = sorted({a for t in (int, float, bool, str, bytes, type(None), list, tuple, dict, set, range) for a in dir(t) if not a.startswith("__")})
OPS = ["scope", "tgt", "op", "name", "n", "guarded", "types", "lo", "hi", "what", "idx", "var"]
FLOW = ["ss", "src", "ts", "tgt", "pos"]
LARGEST = 20_000  # nodes of a module's graph that one group may hold
CELLS = 500_000  # values of nodes and modules that one group holds, about
col, lit = F.col, F.lit


@dataclass
class Values:
    rows: DataFrame  # (ctx, scope, what, idx, var, types, lo, hi); what: def, param, return, var, attr, block
    rounds: int

    def _shown(self, what: str, *keys: str) -> DataFrame:
        bound = lambda c: F.when(F.abs(c) < av.INF, col(c))
        r = self.rows.where(col("what") == what)
        return r.select(*keys, av.names(col("types")).alias("types"), bound("lo").alias("lo"), bound("hi").alias("hi"))

    def definitions(self) -> DataFrame:
        """(ctx, scope, idx, var, types, lo, hi) of named targets; a bound is null if open, or if the types have none."""
        return self._shown("def", "ctx", "scope", "idx", "var").where("var is not null and not startswith(var, '$')")

    def parameters(self) -> DataFrame:
        return self._shown("param", "ctx", "scope", "var")

    def returns(self) -> DataFrame:
        return self._shown("return", "ctx", "scope")

    def names(self) -> DataFrame:
        """(scope, var, ...): all that a name ever holds, over contexts."""
        return self._shown("var", "scope", "var").where("not startswith(var, '$')")

    def attributes(self) -> DataFrame:
        """(obj, attr, ...)"""
        return self._shown("attr", "scope", "var").withColumnsRenamed({"scope": "obj", "var": "attr"})

    def reached(self) -> DataFrame:
        """(ctx, scope, blk) of the blocks that may run."""
        return self.rows.where("what = 'block' and types <> 0").select("ctx", "scope", col("idx").alias("blk"))


class _Graph:
    """Collects ops and flow rows."""

    def __init__(self) -> None:
        self.ops: list[DataFrame] = []
        self.flows: list[DataFrame] = []

    def op(self, df: DataFrame, scope: Column, tgt: Column, op: str | Column = "join", static: av.Value | None = None, guarded: bool = False, name: Column | None = None, n: Column | None = None, what: str = "", idx: Column | None = None, var: Column | None = None) -> None:
        none = lit(None).cast("string")
        t, lo, hi = static or av.value(0)
        as_ = lit(op) if isinstance(op, str) else op
        self.ops.append(df.select(scope.alias("scope"), tgt.alias("tgt"), as_.alias("op"), (none if name is None else name).alias("name"), (lit(0) if n is None else n).cast("int").alias("n"), lit(guarded).alias("guarded"), t.cast("long").alias("types"), lo.cast("double").alias("lo"), hi.cast("double").alias("hi"), lit(what).alias("what"), (lit(None) if idx is None else idx).cast("long").alias("idx"), (none if var is None else var).alias("var")))

    def flow(self, df: DataFrame, ss: Column, src: Column, ts: Column, tgt: Column, pos: int | Column = 0) -> None:
        self.flows.append(df.select(ss.alias("ss"), src.alias("src"), ts.alias("ts"), tgt.alias("tgt"), (lit(pos) if isinstance(pos, int) else pos).cast("int").alias("pos")))


def _at(scope: str = "scope", idx: str = "idx") -> Column:
    return F.concat_ws(":", col(scope), col(idx).cast("string"))


def _block(scope: str = "scope", blk: str = "blk") -> Column:
    return F.concat_ws("#", col(scope), col(blk).cast("string"))


def _name(owner: Column, name: Column) -> Column:
    return F.concat(lit("|"), owner, lit("|"), name)


def _heap(obj: Column, attr: Column) -> Column:
    return F.concat(lit("^"), obj, lit("."), attr)


def escaping(r: pointer.Result, st: DataFrame) -> DataFrame:
    """(obj): objects that calls of unknown code are given, and all that is reachable from them through fields."""
    held = r.pts.where("field = ''").select("node", "obj")
    callee = r.program.call.select("scope", "site", "bo", "b", F.concat_ws("|", lit(""), "bo", "b").alias("node")).join(held, "node", "left")
    tame = F.coalesce((col("bo") == "") & col("b").isin(*TAME) | F.regexp_extract("obj", "^bi:([^@]*)", 1).isin(*TAME), lit(False))
    wild = callee.where(~tame & F.expr("obj is null or not rlike(obj, '^(fn|cls|bm):')")).select("site").distinct()
    given = r.program.arg.join(wild, "site", "left_semi").select(F.concat_ws("|", lit(""), "ao", "a").alias("node")).join(held, "node").select("obj")
    inside = r.pts.where("field <> ''").select(col("node").alias("obj"), col("obj").alias("held"))
    return fixpoint(given.distinct(), lambda d, _: d.join(inside, "obj").select(col("held").alias("obj")))


def analyse(f: DataFrame, result: pointer.Result | None = None, policy: str = "0-cfa", widen_after: int = 4, log: list | None = None) -> Values:
    """Abstract values of the modules' facts. ``result``: the points-to result without contexts, solved here if not given. Of modules that are alike
    one has its graph built; tasks solve it for many modules at once, each with its own literals."""
    r = pointer.analyse(f) if result is None else result
    scratch, kept = Scratch(f.sparkSession, "values"), Scratch(f.sparkSession, "values-result")
    out = None
    if r.alike is not None:
        ops, flow = _graph(r.alike.facts, r.ones, policy, scratch)
        out = _solve_alike(f, r.alike, ops, flow, kept, widen_after, log)
    if out is None:
        ops, flow = _graph(f, r, policy, scratch)
        solved, rounds = solve(ops, flow, widen_after, log)
        out = kept.keep(_rows(_keys(ops), solved)), rounds
    scratch.only()
    return Values(*out)


def _keys(ops: DataFrame) -> DataFrame:
    """(node, ctx, scope, what, idx, var) of the nodes that are shown."""
    names = F.split("var", "\\|")
    parts = F.when(col("what") == "var", names[0]).when(col("what") == "attr", col("name")).otherwise(col("scope"))
    return ops.where("what <> ''").select(col("tgt").alias("node"), "ctx", parts.alias("scope"), "what", "idx", F.when(col("what") == "var", names[1]).otherwise(col("var")).alias("var"))


def _rows(keys: DataFrame, solved: DataFrame) -> DataFrame:
    return keys.join(solved, "node").select("ctx", "scope", "what", "idx", "var", "types", "lo", "hi")


def _solve_alike(f: DataFrame, same: Alike, ops: DataFrame, flow: DataFrame, kept: Scratch, widen_after: int, log: list | None) -> tuple[DataFrame, int] | None:
    """All modules' rows from the graphs of one of each class, and the rounds of the modules that aren't alone or large; None if modules of a class are
    large or tied to others by more than nodes that are what they are."""
    scratch = Scratch(f.sparkSession, "values-alike")
    mark = lambda c: F.regexp_extract(c, MARK, 0)
    flow = scratch.keep(flow.withColumn("mark", mark("tgt")).withColumn("_from", mark("src")))
    each = scratch.keep(_nodes(ops).withColumn("mark", mark("tgt")))
    ties = flow.where("_from <> mark").select("src", "mark", "_from").distinct()
    moved = ties.where("_from <> ''").select("src").union(ties.join(flow.select(col("tgt").alias("src")), "src", "left_semi").select("src"))
    members = same.members.groupBy("mark").agg(F.count("*").alias("size"))
    size = scratch.keep(each.where("mark <> ''").groupBy("mark").agg(F.count("*").alias("nodes")).join(members, "mark"))
    if not moved.isEmpty() or not size.where(f"nodes > {LARGEST} and size > 1").isEmpty():
        return None
    size = size.where(f"nodes <= {LARGEST}")
    plain, by_rounds = (scratch.keep(d.join(size, "mark", "left_anti")) for d in (each, flow))
    solved, rounds = (None, 0) if plain.where("types <> 0").isEmpty() else solve(plain.drop("mark"), by_rounds.select("src", "tgt", "pos"), widen_after, log)

    outer = ties.select("mark", col("src").alias("tgt")).join(plain.drop("mark"), "tgt").select(*each.columns)
    each, flow = (d.join(size, "mark", "left_semi") for d in (each, flow))
    literal = F.regexp_extract("tgt", f"^~\\|{MARK}\\|(.*)$", 1)
    none, number = lit(None).cast("string"), lit(None).cast("int")
    graph = each.select(*outer.columns).union(outer).select("mark", "tgt", "op", "name", "n", "guarded", "types", "lo", "hi", literal.alias("literal"), none.alias("src"), number.alias("pos"))
    steps = flow.select("mark", "tgt", none.alias("op"), none.alias("name"), number.alias("n"), lit(None).cast("boolean").alias("guarded"), lit(None).cast("long").alias("types"), lit(None).cast("double").alias("lo"), lit(None).cast("double").alias("hi"), none.alias("literal"), "src", "pos")
    graph = scratch.keep(graph.union(steps))
    chunks = size.select("mark", F.expr(f"1 + size * nodes div {CELLS}").alias("chunks"))
    members = scratch.keep(same.members.join(chunks, "mark").select("mark", "module", F.expr("pmod(xxhash64(module), chunks)").alias("chunk")))
    const = python_files.statements(f).where("kind = 'Const'").select("module", "target", *(c.alias(n) for c, n in zip(av.constant(col("name"), col("label")), ("types", "lo", "hi"), strict=True)))
    own = members.join(const, "module", "left").select(col("mark").alias("mark"), col("chunk").alias("chunk"), "module", "target", "types", "lo", "hi")
    sent = members.select("mark", "chunk").distinct().join(graph, "mark")
    ship(f.sparkSession)
    found = sent.groupBy("mark", "chunk").cogroup(own.groupBy("mark", "chunk")).applyInPandas(_alike_solver(widen_after), "mark string, node string, module string, types long, lo double, hi double")
    found = kept.keep(found)

    keys = scratch.keep(_keys(ops))
    marked = kept.keep(keys.withColumn("mark", mark("node")).where("mark <> ''"))
    put = lambda c: F.replace(c, col("mark"), col("module")).alias(c)
    rows = marked.join(found, ["mark", "node"]).select(put("ctx"), put("scope"), "what", "idx", put("var"), "types", "lo", "hi")
    if solved is not None:
        rows = rows.union(kept.keep(same.expand(_rows(keys, solved))))
    scratch.only()
    return rows, rounds


def _alike_solver(widen_after: int):
    """Rounds as ``solve`` has them, for a class's graph and the literals of some of its modules; arrays hold a node's values in all of these modules."""

    def each(graph: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        nodes, flows = graph[graph["src"].isna()], graph[graph["src"].notna()]
        names, modules = list(nodes["tgt"]), sorted(set(own["module"]))
        at, n = {x: i for i, x in enumerate(names)}, len(modules)
        into: list[dict[int, list[int]]] = [{0: [], 1: [], 2: []} for _ in names]
        out: list[set[int]] = [set() for _ in names]
        for src, tgt, pos in flows[["src", "tgt", "pos"]].itertuples(index=False):
            if src in at and tgt in at:
                into[at[tgt]][int(pos)].append(at[src])
                out[at[src]].add(at[tgt])
        where = pd.Series(range(n), index=modules)
        given = {t: (where[d["module"]].to_numpy(), d[["types", "lo", "hi"]]) for t, d in own[own["target"].notna()].groupby("target")}
        node, risen, delta = [], np.zeros((len(names), n), np.int64), set()
        ops = list(nodes[["op", "name", "n", "guarded", "types", "lo", "hi", "literal"]].itertuples(index=False))
        static = []
        for i, x in enumerate(ops):
            v = aa.value(n, int(x.types), x.lo, x.hi)
            if x.literal in given:
                place, d = given[x.literal]
                for k, c in enumerate(("types", "lo", "hi")):
                    v[k][place] = d[c].to_numpy()
            static.append(v)
            first = (v[0] != 0) & (not x.guarded)
            node.append(aa.where(first, v, aa.value(n, 0)))
            risen[i] = first
            if first.any():
                delta.add(i)

        def joined(sources: list[int]) -> aa.Value:
            return reduce(aa.join, (node[s] for s in sources)) if sources else aa.value(n, 0)

        while delta:
            new = {}
            for i in {t for s in delta for t in out[s]}:
                x, old = ops[i], node[i]
                v = aa.join(aa.join(aa.made(x.op, x.name, int(x.n), joined(into[i][0]), joined(into[i][1])), static[i]), old)
                rose = (v[0] != 0) & ((v[0] != old[0]) | (v[1] < old[1]) | (v[2] > old[2]))
                if x.guarded:
                    rose &= joined(into[i][2])[0] != 0
                if rose.any():
                    late = risen[i] >= widen_after
                    wide = v[0], np.where(late & (v[1] < old[1]), -av.INF, v[1]), np.where(late & (v[2] > old[2]), av.INF, v[2])
                    new[i] = aa.where(rose, wide, old)
                    risen[i] += rose
            for i, v in new.items():
                node[i] = v
            delta = set(new)
        parts = []
        for name, (types, lo, hi) in zip(names, node, strict=True):
            ok = types != 0
            parts.append(pd.DataFrame({"node": name, "module": np.array(modules, object)[ok], "types": types[ok], "lo": lo[ok], "hi": hi[ok]}))
        return pd.concat(parts).assign(mark=graph["mark"].iloc[0])[["mark", "node", "module", "types", "lo", "hi"]]

    return each


def _graph(f: DataFrame, r: pointer.Result, policy: str, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(ctx, scope, tgt, op, ...) and (src, tgt, pos): the value-flow graph of the facts."""
    spark, g = f.sparkSession, _Graph()
    f = scratch.keep(f)
    p = r.program
    st = scratch.keep(python_files.statements(f).withColumn("site", _at()))
    scope = scratch.keep(python_files.scopes(f))
    var = python_files.variables(f).select("scope", col("name").alias("v"), "owner", col("kind").alias("vkind"))
    held = scratch.keep(r.pts.where("field = ''").select("node", "obj"))
    blocked = scratch.keep(cfg.blocks(st.select("scope", "idx", "kind", "label")).select("scope", "idx", "kind", "label", "blk"))
    args = scratch.keep(st.select("scope", "idx", "site", "kind", "name", "target", "base", F.posexplode("args").alias("p", "x")).select("*", col("x.role").alias("role"), col("x.name").alias("kw"), col("x.var").alias("v")).drop("x"))

    # which code runs unseen
    out = scratch.keep(escaping(r, st))
    called = r.resolved.select("scope", "site", "fn", "off").distinct()
    special = scope.where("kind = 'function' and (rlike(scope, '[.]__[a-z]+__$') and not endswith(scope, '.__init__') or rlike(decorators, 'property|setter|getter|deleter'))").select(col("scope").alias("fn"))
    wild = out.where("startswith(obj, 'fn:')").select(F.expr("substring(obj, 4)").alias("fn")).union(special).union(called.where("contains(site, '/op')").select("fn"))
    fns = scope.where("kind = 'function'").select(col("scope").alias("fn"))
    calls = called.where("not contains(site, '/op')")
    wild = scratch.keep(wild.union(fns.join(calls.select("fn").distinct(), "fn", "left_anti")).distinct())

    # definitions and what a use of a name reads
    params = p.param.select(col("fn").alias("scope"), col("name").alias("v"), lit(-1).cast("long").alias("idx"), F.concat(col("fn"), lit("@"), col("name")).alias("node"))
    defs = st.where("target is not null and kind <> 'Const'").select("scope", col("target").alias("v"), "idx", col("site").alias("node")).union(params)
    defs = scratch.keep(defs.join(var, ["scope", "v"]).select("scope", "v", "idx", "node", "owner"))
    shared = defs.where("scope <> owner").select("owner", "v").distinct()
    used = args.where("kind <> 'Const'").select("scope", "idx", "v").distinct().join(var, ["scope", "v"], "left").withColumn("owner", F.coalesce("owner", lit("")))
    used = used.join(shared.withColumn("many", lit(True)), ["owner", "v"], "left").withColumn("own", (col("owner") == col("scope")) & col("many").isNull() & ~col("v").startswith("$c"))
    used = scratch.keep(used.select("scope", "idx", "v", "owner", "own"))
    n_defs = defs.where("scope = owner").groupBy("scope", "v").agg(F.count("*").alias("n"))
    loose = st.where("kind = 'Catch'").select("scope").distinct().withColumn("loose", lit(True))
    local = used.where("own").select("scope", "idx", "v").join(n_defs, ["scope", "v"]).join(loose, "scope", "left")
    direct = local.where("n = 1 or loose").join(defs.select("scope", "v", "node"), ["scope", "v"]).select("scope", "idx", "v", col("scope").alias("ss"), col("node").alias("src"))
    several = scratch.keep(local.where("n > 1 and loose is null").select("scope", "idx", "v"))
    twice = defs.join(several.select("scope", "v").distinct(), ["scope", "v"], "left_semi").select("scope", col("idx").alias("node"), col("node").alias("item"), col("v").alias("cls"), lit(True).alias("kills"))
    heap, weak = _heap_flows(g, r, st, scope, blocked, held, out, scratch)
    reach = scratch.keep(_reaching(st, scratch.keep(twice.union(weak))))
    flowed = several.join(reach.select("scope", col("node").alias("idx"), col("cls").alias("v"), col("item").alias("src")), ["scope", "idx", "v"]).select("scope", "idx", "v", col("scope").alias("ss"), "src")
    others = used.where("not own").select("scope", "idx", "v", lit("").alias("ss"), _name(col("owner"), col("v")).alias("src"))
    reads = scratch.keep(union([direct, flowed, others]))  # (scope, idx, v, ss, src)

    # names that other scopes read, literals, builtins
    g.op(defs.where("not startswith(v, '$')").select("owner", "v").distinct(), lit(""), _name(col("owner"), col("v")), what="var", idx=None, var=F.concat(col("owner"), lit("|"), col("v")))
    g.flow(defs.where("not startswith(v, '$')"), col("scope"), col("node"), lit(""), _name(col("owner"), col("v")))
    literal = st.where("kind = 'Const'")
    g.op(literal, lit(""), _name(col("module"), col("target")), static=av.constant(col("name"), col("label")))
    g.op(used.where("owner = ''").select("v").distinct(), lit(""), _name(lit(""), col("v")), static=av.unknown())

    # statements
    n_args = F.size("args")
    star = F.exists("args", lambda a: a["role"].isin("star", "kwstar"))
    built = av.pick(((col("name") == "tuple") & ~star, (lit(av.BIT["tuple"]).cast("long"), n_args.cast("double"), n_args.cast("double"))), (col("name") == "tuple", av.value(av.BIT["tuple"], 0.0, av.INF)), (col("name") == "list", av.value(av.BIT["list"], 0.0, av.INF)), (col("name") == "dict", av.value(av.BIT["dict"], 0.0, av.INF)), (col("name") == "set", av.value(av.BIT["set"], 0.0, av.INF)), other=av.unknown())
    prop = scope.where("rlike(decorators, 'property|setter|getter|deleter')").select(col("scope").alias("base"), lit(True).alias("prop"))
    plain = st.where("target is not null and kind not in ('Const', 'Call', 'LoadAttr', 'Import')").join(prop, "base", "left")
    k = col("kind")
    static = av.pick(
        (k.isin("Copy", "BinOp", "UnaryOp", "Compare"), av.value(0)), (k == "Build", built), (k == "Format", av.value(av.BIT["str"], 0.0, av.INF)), (k.isin("HasNext", "Match"), av.value(av.BIT["bool"], 0.0, 1.0)),
        ((k == "FuncDef") & col("prop").isNull(), av.value(av.BIT["function"])), (k == "ClassDef", av.value(av.BIT["class"])), other=av.unknown(),
    )
    g.op(plain, col("scope"), col("site"), F.when(k.isin("BinOp", "UnaryOp", "Compare"), k).otherwise("join"), static, True, col("name"), what="def", idx=col("idx"), var=col("target"))
    g.op(st.where("kind = 'Return'"), col("scope"), col("site"), "join", av.pick((n_args == 0, av.value(av.BIT["NoneType"])), other=av.value(0)), True)
    g.op(st.where("kind = 'StoreAttr'"), col("scope"), col("site"), guarded=True)
    operand = args.where("kind in ('Copy', 'BinOp', 'UnaryOp', 'Compare', 'Return', 'StoreAttr') and p < 2").select("scope", "idx", "site", "v", "p")
    g.flow(operand.join(reads, ["scope", "idx", "v"]), col("ss"), col("src"), col("scope"), col("site"), col("p"))

    # blocks
    own = blocked.select("scope", "blk").distinct().union(scope.select("scope", lit(0).cast("long"))).distinct()
    mods = scope.where("kind = 'module'").select("scope")
    start = mods.union(wild.select("fn")).withColumn("start", lit(True)).withColumn("blk", lit(0).cast("long"))
    hit = lit(av.BIT["int"]).cast("long"), lit(av.INF), lit(-av.INF)
    g.op(own.join(start, ["scope", "blk"], "left"), col("scope"), _block(), static=av.pick((F.coalesce("start", lit(False)), hit), other=av.value(0)), what="block", idx=col("blk"))
    last = blocked.groupBy("scope", "blk").agg(F.max("idx").alias("idx"), F.max_by("kind", "idx").alias("last"))
    test = args.where("kind in ('JumpIfFalse', 'JumpIfTrue') and p = 0").select("scope", "idx", "v")
    edge = scratch.keep(cfg.block_edges(blocked).join(last.select("scope", col("blk").alias("src"), "idx", "last"), ["scope", "src"]))
    cond = col("last").startswith("JumpIf") & col("kind").isin("If", "Normal")
    g.flow(edge.where(~cond), col("scope"), _block(blk="src"), col("scope"), _block(blk="tgt"))
    branch = edge.where(cond).withColumn("e", F.concat(_block(blk="src"), lit(">"), col("tgt").cast("string"), "kind")).withColumn("when", F.when((col("last") == "JumpIfTrue") == (col("kind") == "If"), "true").otherwise("false"))
    g.op(branch, col("scope"), col("e"), "edge", None, True, col("when"))
    g.flow(branch, col("scope"), _block(blk="src"), col("scope"), col("e"), 2)
    g.flow(branch, col("scope"), col("e"), col("scope"), _block(blk="tgt"))
    g.flow(branch.select("scope", "idx", "e").join(test, ["scope", "idx"]).join(reads, ["scope", "idx", "v"]), col("ss"), col("src"), col("scope"), col("e"))
    where = blocked.select("scope", "idx", "blk")
    g.flow(st.where("target is not null and kind <> 'Const' or kind in ('Return', 'StoreAttr')").select("scope", "idx", "site").join(where, ["scope", "idx"]), col("scope"), _block(), col("scope"), col("site"), 2)
    inner = scope.where("kind = 'class'").select(col("scope").alias("base")).join(st.where("kind = 'ClassDef'").select("scope", "site", "base"), "base")
    g.flow(inner, col("scope"), col("site"), col("base"), F.concat("base", lit("#0")))

    # attributes and imports
    g.op(heap["loads"], col("scope"), col("site"), "join", av.pick((col("open"), av.unknown()), other=av.value(0)), True, what="def", idx=col("idx"), var=col("target"))
    g.flow(heap["fed"], lit(""), col("src"), col("scope"), col("site"))
    g.flow(heap["strong"].join(reach.select("scope", col("node").alias("idx"), "cls", col("item").alias("src")), ["scope", "idx", "cls"]), F.when(col("src").startswith("^"), lit("")).otherwise(col("scope")), col("src"), col("scope"), col("site"))
    imp = python_files.imports(f).join(st.select("scope", "idx", "site", "target"), ["scope", "idx"]).where("target is not null").join(mods.select(col("scope").alias("name"), lit(True).alias("known")), "name", "left")
    known = F.coalesce("known", lit(False))
    g.op(imp, col("scope"), col("site"), "join", av.pick((known & (col("form") == "from"), av.value(0)), (known, av.value(av.BIT["module"])), other=av.unknown()), True, what="def", idx=col("idx"), var=col("target"))
    g.flow(imp.where(known & (col("form") == "from")), lit(""), _name(col("name"), col("item")), col("scope"), col("site"))

    # calls
    callee = p.call.where(pointer.WRITTEN).select("site", "bo", "b", F.concat_ws("|", lit(""), "bo", "b").alias("node")).join(held, "node", "left")
    kinds = callee.groupBy("site").agg(F.first("bo").alias("bo"), F.first("b").alias("b"), F.bool_or(F.coalesce(col("obj").startswith("cls:"), lit(False))).alias("makes"), F.bool_or(F.coalesce(~col("obj").rlike("^(fn|cls):"), lit(False))).alias("other"), F.bool_and(col("obj").isNull()).alias("none"))
    site = st.where("kind = 'Call'").join(kinds, "site", "left").withColumn("simple", F.forall("args", lambda a: a["role"] == "pos"))
    site = site.withColumn("builtin", F.coalesce(col("none") & (col("bo") == "") & col("b").isin(*av.CALLED) & col("simple"), lit(False)))
    site = scratch.keep(site.withColumn("lost", ~col("builtin") & F.coalesce(col("other") | col("none"), lit(True))))
    result = av.pick((col("lost"), av.unknown()), (F.coalesce("makes", lit(False)), av.value(av.BIT["instance"])), other=av.value(0))
    g.op(site, col("scope"), col("site"), F.when(col("builtin"), "builtin").otherwise("join"), result, True, col("b"), n_args, what="def", idx=col("idx"), var=col("target"))
    given = args.where("kind = 'Call'").join(site.where("builtin").select("site"), "site", "left_semi")
    g.flow(given.join(reads, ["scope", "idx", "v"]), col("ss"), col("src"), col("scope"), col("site"))
    lazy = scope.where("contains(flags, 'generator') or contains(flags, 'async')").select("scope").withColumn("lazy", lit(True))
    ret = F.concat("scope", lit("$return"))
    g.op(fns.select(col("fn").alias("scope")).join(lazy, "scope", "left"), col("scope"), ret, static=av.pick((F.coalesce("lazy", lit(False)), av.unknown()), other=av.value(0)), what="return")
    g.flow(st.where("kind = 'Return'"), col("scope"), col("site"), col("scope"), ret)
    falls = own.groupBy("scope").agg(F.max("blk").alias("blk")).join(last.select("scope", "blk", "last"), ["scope", "blk"], "left").where("last is null or last not in ('Return', 'Raise', 'Goto')")
    end = F.concat("scope", lit("$end"))
    g.op(falls, col("scope"), end, static=av.value(av.BIT["NoneType"]), guarded=True)
    g.flow(falls, col("scope"), _block(), col("scope"), end, 2)
    g.flow(falls, col("scope"), end, col("scope"), ret)

    # parameters
    bound = scratch.keep(pointer.bound_arguments(p, calls.select("site", "fn", "off").distinct()))
    spread = bound.where("how = 'spread'").select("fn", "name").distinct().withColumn("spread", lit(True))
    klass = scope.where("rlike(decorators, '(^|,)classmethod')").select(col("scope").alias("fn")).withColumn("klass", lit(True))
    par = p.param.join(spread, ["fn", "name"], "left").join(wild.withColumn("wild", lit(True)), "fn", "left").join(klass, "fn", "left")
    unseen = F.coalesce("wild", lit(False)) | F.coalesce("spread", lit(False))
    first = (col("pos") == 0) & (col("shift") == 1)
    taken = av.pick((first & col("klass").isNotNull(), av.value(av.BIT["class"])), (first, av.value(av.BIT["instance"])), (col("kind") == "star", av.value(av.BIT["tuple"], 0.0, av.INF)), (col("kind") == "kwstar", av.value(av.BIT["dict"], 0.0, av.INF)), (unseen, av.unknown()), other=av.value(0))
    formal = F.concat("fn", lit("@"), "name")
    g.op(par, col("fn"), formal, static=taken, what="param", var=col("name"))
    preset = F.concat(lit("="), "fn", lit("|"), "name")
    given = args.where("kind = 'FuncDef' and role = 'default'").select("scope", "idx", "v", col("base").alias("fn"), col("kw").alias("name"))
    g.op(given, lit(""), preset)
    g.flow(given.join(reads, ["scope", "idx", "v"]), col("ss"), col("src"), lit(""), preset)

    # contexts, and the edges between them
    if policy == "0-cfa":
        ctx = scope.select("scope", lit("").alias("ctx"))
        edges = calls.select("scope", "site", "fn", "off", lit("").alias("ctx"), lit("").alias("nctx"))
    else:
        roots = scope.where("kind <> 'function'").select("scope").union(wild.select("fn"))
        ctx, edges = pointer.call_contexts(p, r.pts, called, policy, roots)
        edges = edges.where(pointer.WRITTEN)
    edges = scratch.keep(edges.join(st.select("site", "idx"), "site").join(where, ["scope", "idx"]))
    ctx = scratch.keep(ctx)
    full = lambda c, x: F.concat(c, lit("~"), x)
    between = [(edges, full(col("ctx"), _block()), full(col("nctx"), F.concat("fn", lit("#0"))))]
    value = bound.where("how = 'plain'").join(edges.select("site", "fn", "scope", "idx", "ctx", "nctx"), ["site", "fn"]).join(reads.withColumnRenamed("v", "a"), ["scope", "idx", "a"])
    between.append((value, full(F.when(col("ss") == "", lit("")).otherwise(col("ctx")), col("src")), full(col("nctx"), formal)))
    inits = p.init.select("fn").distinct()
    made = site.where("makes").select("site")
    backs = edges.join(inits.join(edges.join(made, "site", "left_semi").select("fn").distinct(), "fn", "left_semi").withColumn("init", lit(True)), "fn", "left").join(made.withColumn("made", lit(True)), "site", "left").where("init is null or made is null")
    between.append((backs, full(col("nctx"), F.concat("fn", lit("$return"))), full(col("ctx"), col("site"))))
    free = edges.join(p.param.where("has_default and kind in ('posonly', 'pos', 'kwonly')").select("fn", "name"), "fn").join(bound.where("how = 'plain'").select("site", "fn", "name").distinct(), ["site", "fn", "name"], "left_anti")
    between.append((free, full(lit(""), preset), full(col("nctx"), formal)))

    each = ctx.union(spark.createDataFrame([("", "")], "scope string, ctx string"))
    flows = union(g.flows).distinct()
    home = F.when(col("ss") != "", col("ss")).otherwise(col("ts"))
    flows = flows.withColumn("scope", home).join(each, "scope")
    side = lambda s, x: full(F.when(col(s) == "", lit("")).when((col(s) == col("scope")), col("ctx")).otherwise(lit("")), col(x))
    rows = [flows.select(side("ss", "src").alias("src"), side("ts", "tgt").alias("tgt"), "pos")]
    rows += [d.select(s.alias("src"), t.alias("tgt"), lit(0).alias("pos")) for d, s, t in between]
    flow = scratch.keep(union(rows).distinct())
    ops = scratch.keep(union(g.ops).join(each, "scope").select("ctx", *[c for c in OPS if c != "tgt"], full(col("ctx"), col("tgt")).alias("tgt")))
    return ops, flow


def _reaching(st: DataFrame, gens: DataFrame) -> DataFrame:
    """(scope, node, item, cls): definitions that reach a statement's entry, in scopes that have some; node -1 is the entry."""
    scopes = gens.select("scope").distinct()
    code = st.join(scopes, "scope", "left_semi")
    enter = code.groupBy("scope").agg(F.min("idx").alias("tgt")).select("scope", lit(-1).cast("long").alias("src"), "tgt")
    edges = cfg.stmt_edges(code.select("scope", "idx", "kind", "label")).select("scope", "src", "tgt").union(enter)
    return dataflow.solve(dataflow.Dataflow(edges, gens.select("scope", "node", "item", "cls"), gens.where("kills").select("scope", "node", "cls")), "in")


def _loops(edges: pd.DataFrame) -> pd.DataFrame:
    """Nodes of a scope that are on a cycle: of the strong components (Tarjan's, without recursion) those of several nodes or with an edge to itself."""
    succ: dict[int, list[int]] = {}
    for src, tgt in edges[["src", "tgt"]].itertuples(index=False):
        succ.setdefault(src, []).append(tgt)
    found = {src for src, out in succ.items() if src in out}
    seen: dict[int, int] = {}
    low: dict[int, int] = {}
    stack, on = [], set()
    for root in succ:
        if root in seen:
            continue
        work = [(root, iter(succ[root]))]
        seen[root] = low[root] = len(seen)
        stack.append(root)
        on.add(root)
        while work:
            v, rest = work[-1]
            w = next(rest, None)
            if w is None:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[v])
                if low[v] == seen[v]:
                    part = [stack.pop()]
                    while part[-1] != v:
                        part.append(stack.pop())
                    on.difference_update(part)
                    found.update(part if len(part) > 1 else ())
            elif w not in seen:
                seen[w] = low[w] = len(seen)
                stack.append(w)
                on.add(w)
                work.append((w, iter(succ.get(w, ()))))
            elif w in on:
                low[v] = min(low[v], seen[w])
    return pd.DataFrame({"scope": edges["scope"].iloc[0], "blk": sorted(found)})


def once_objects(r: pointer.Result, st: DataFrame, scope: DataFrame, blocked: DataFrame, held: DataFrame, out: DataFrame) -> DataFrame:
    """(obj): instances whose class is called at one place only, in a module's own code and in no loop, and by no unknown code."""
    edges = cfg.block_edges(blocked).join(scope.where("kind = 'module'").select("scope"), "scope", "left_semi").select("scope", "src", "tgt").distinct()
    ship(st.sparkSession)
    loop = edges.groupBy("scope").applyInPandas(_loops, "scope string, blk long").select(_block().alias("node"))
    made = r.program.call.select("scope", "site", F.concat_ws("|", lit(""), "bo", "b").alias("node")).join(held.where("startswith(obj, 'cls:')"), "node").select("scope", "site", F.expr("substring(obj, 5)").alias("cls"))
    one = made.groupBy("cls").agg(F.count("*").alias("n"), F.first("scope").alias("scope"), F.first("site").alias("site")).where("n = 1")
    place = st.select("site", "scope", "idx").join(blocked.select("scope", "idx", "blk"), ["scope", "idx"]).select("site", _block().alias("node"))
    one = one.join(scope.where("kind = 'module'").select("scope"), "scope", "left_semi").join(place, "site").join(loop, "node", "left_anti")
    return one.select(F.concat(lit("inst:"), "cls").alias("obj")).join(out.select(F.regexp_replace("obj", "^cls:", "inst:").alias("obj")), "obj", "left_anti")


def _heap_flows(g: _Graph, r: pointer.Result, st: DataFrame, scope: DataFrame, blocked: DataFrame, held: DataFrame, out: DataFrame, scratch: Scratch) -> tuple[dict, DataFrame]:
    """Nodes and flows of attributes; loads with what feeds them; definitions of attributes of objects of multiplicity one, as of names."""
    own = r.program.store.where("not startswith(b, '@')")
    written = st.where("kind = 'StoreAttr'").select("scope", "idx", "site", "base", col("name").alias("attr"))
    owners = own.select("scope", "bo", "b").distinct()
    at = written.join(owners, (written["scope"] == owners["scope"]) & (written["base"] == owners["b"])).select(written["scope"], "idx", "site", "attr", F.concat_ws("|", lit(""), "bo", "b").alias("node"))
    into = scratch.keep(at.join(held, "node").select("scope", "idx", "site", "attr", "obj").distinct())
    fixed = r.program.store.where("rlike(b, '^@(inst|cls|super|mod):') and so <> ''").select(F.expr("substring(b, 2)").alias("obj"), col("field").alias("attr"), "so", "s").distinct()
    every = scratch.keep(into.select("obj", "attr").union(fixed.select("obj", "attr")).distinct())
    g.op(every.join(out.withColumn("open", lit(True)), "obj", "left"), lit(""), _heap(col("obj"), col("attr")), static=av.pick((F.coalesce("open", lit(False)), av.unknown()), other=av.value(0)), name=col("obj"), what="attr", var=col("attr"))
    g.flow(into, col("scope"), col("site"), lit(""), _heap(col("obj"), col("attr")))
    g.flow(fixed, lit(""), _name(col("so"), col("s")), lit(""), _heap(col("obj"), col("attr")))

    read = st.where("kind = 'LoadAttr'").select("scope", "idx", "site", "target", "base", col("name").alias("attr"))
    bases = r.program.load.select("scope", "bo", "b").distinct()
    on = read.join(bases, (read["scope"] == bases["scope"]) & (read["base"] == bases["b"])).select(read["scope"], "idx", "site", "attr", F.concat_ws("|", lit(""), "bo", "b").alias("node"))
    on = scratch.keep(on.join(held, "node", "left").join(every.withColumn("there", lit(True)), ["obj", "attr"], "left").select("scope", "idx", "site", "attr", "obj", "there").distinct())
    # Builtin objects have no attributes but their types', so a load of another name from one raises; it adds no value.
    raises = F.coalesce(F.contains("obj", lit("/")) & ~col("attr").isin(*BUILTIN_ATTRIBUTES), lit(False))
    state = on.groupBy("site").agg((F.bool_or(col("there").isNull() & ~raises) | (F.count("there") == 0)).alias("open"), F.count("obj").alias("many"), F.first("obj", ignorenulls=True).alias("one"))
    loads = read.join(state, "site", "left").withColumn("open", F.coalesce("open", lit(True)))

    # strong updates: an attribute of one object, stored in this scope through bases that hold nothing else
    once = once_objects(r, st, scope, blocked, held, out)
    sure = into.groupBy("scope", "idx", "site", "attr").agg(F.count("obj").alias("many"), F.first("obj").alias("obj")).where("many = 1").join(once, "obj", "left_semi")
    both = F.concat_ws(".", lit("^"), "obj", "attr")
    kept = scratch.keep(sure.select("scope", "obj", "attr").distinct())
    strong = scratch.keep(loads.where("not open and many = 1").select("scope", "idx", "site", col("one").alias("obj"), "attr").join(kept, ["scope", "obj", "attr"], "left_semi").select("scope", "idx", "site", both.alias("cls")))
    gens = into.join(kept, ["scope", "obj", "attr"], "left_semi").join(sure.select("site", lit(True).alias("kills")), "site", "left").select("scope", col("idx").alias("node"), col("site").alias("item"), both.alias("cls"), F.coalesce("kills", lit(False)).alias("kills"))
    abroad = into.select(col("scope").alias("by"), "obj", "attr").distinct().union(fixed.select(lit(" ").alias("by"), "obj", "attr"))
    foreign = kept.join(abroad, ["obj", "attr"]).where("by <> scope").select("scope", "obj", "attr").distinct()
    entry = foreign.select("scope", lit(-1).cast("long").alias("node"), _heap(col("obj"), col("attr")).alias("item"), both.alias("cls"), lit(False).alias("kills"))
    may = st.where("kind in ('Call', 'BinOp', 'UnaryOp', 'Compare', 'LoadSubscr', 'StoreSubscr', 'HasNext', 'Import', 'ClassDef')").select("scope", "idx").join(foreign, "scope")
    between = may.select("scope", col("idx").alias("node"), _heap(col("obj"), col("attr")).alias("item"), both.alias("cls"), lit(False).alias("kills"))
    fed = on.where("there").join(strong.select("site"), "site", "left_anti").select("scope", "site", _heap(col("obj"), col("attr")).alias("src"))
    return {"loads": loads, "fed": scratch.keep(fed), "strong": strong}, union([gens, entry, between])


def _nodes(ops: DataFrame) -> DataFrame:
    """A row for each node."""
    return ops.groupBy("tgt").agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("op", "name", "n", "guarded")], F.bit_or("types").alias("types"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def solve(ops: DataFrame, flow: DataFrame, widen_after: int = 4, log: list | None = None) -> tuple[DataFrame, int]:
    """(node, types, lo, hi) of all nodes with a value, and the rounds. ops: a row for each node; flow: (src, tgt, pos): pos 0 and 1 are operands, 2 the guard."""
    spark = ops.sparkSession
    scratch, log = Scratch(spark, "flow"), [] if log is None else log
    ops = scratch.keep(_nodes(ops))
    into = scratch.keep(flow.union(ops.select(col("tgt"), col("tgt"), lit(8))).distinct())
    moves = into.where("pos < 8").select("src", "tgt")

    # The columns are made once: they are the same in each round.
    part = lambda p: [fn(F.when(col("pos") == p, col(c))).alias(f"{c}{p}") for c, fn in av.MERGE.items()]
    operands = [*part(0), *part(1), *part(8), F.count(F.when(col("pos") == 2, 1)).alias("guards"), F.coalesce(F.sum(F.when(col("pos") == 8, col("rises"))), lit(0)).alias("risen")]
    full = lambda p: av.struct((F.coalesce(col(f"types{p}"), lit(0)), F.coalesce(col(f"lo{p}"), lit(av.INF)), F.coalesce(col(f"hi{p}"), lit(-av.INF))))
    rows = [*map(col, ("tgt", "op", "name", "n", "types", "lo", "hi", "risen")), full(0).alias("a"), full(1).alias("b"), full(8).alias("old")]
    a, b, old, m, new = (av.fields(c) for c in ("a", "b", "old", "made", "new"))
    there, both, name, op = a[0] != 0, (a[0] != 0) & (b[0] != 0), col("name"), col("op")
    edge = (name == "true") & F.coalesce("t", lit(True)) | (name == "false") & F.coalesce(~col("t"), lit(True))
    made = F.when(op == "join", col("a")).when((op == "BinOp") & both, col("binary")).when((op == "Compare") & both, av.struct(av.flag(col("cmp")))).when((op == "UnaryOp") & there, av.struct(av.unary(name, a)))
    made = made.when((op == "builtin") & (there | (col("n") == 0)), av.struct(av.called(name, col("n"), a))).when((op == "edge") & there & edge, av.struct(av.value(av.BIT["int"]))).otherwise(av.struct(av.value(0)))
    raised = av.struct((m[0].bitwiseOR(col("types")).bitwiseOR(old[0]), F.least(m[1], col("lo"), old[1]), F.greatest(m[2], col("hi"), old[2])))
    stages = [{"t": av.truth(a), "cmp": av.compare(name, a, b)}, *av.binary_stages(), {"made": made}, {"new": raised}]
    late, wide = col("risen") >= widen_after, av.widened(new, old)
    rose = (new[0] != 0) & ((new[0] != old[0]) | (new[1] < old[1]) | (new[2] > old[2]))
    result = [col("tgt").alias("node"), rose.alias("rose"), new[0].alias("types"), F.when(late, wide[1]).otherwise(new[1]).alias("lo"), F.when(late, wide[2]).otherwise(new[2]).alias("hi")]
    node, same, runs = col("node").alias("src"), col("src") == col("node"), ~col("guarded") | (col("guards") > 0)

    def step(delta: DataFrame, known: DataFrame) -> DataFrame:
        hit = delta.select(node).join(moves, "src").select("tgt").distinct()
        got = hit.join(into, "tgt").join(known, same).groupBy("tgt").agg(*operands).join(ops, "tgt").where(runs).select(*rows)
        for stage in stages:
            got = got.withColumns(stage)
        return got.select(*result)

    init = ops.where("not guarded and types <> 0").select(col("tgt").alias("node"), "types", "lo", "hi")
    return lattice_fixpoint(init, ["node"], av.MERGE, step, log=log), len(log)
