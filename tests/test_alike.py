from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from factloom.functions import abstract as av
from factloom.functions import abstract_arrays as aa
from factloom.operators import alike, assignments, pointer, summaries, values
from factloom.sources import python_files

TEXT = """class A:
    def run(self, x):
        return x
def f(x, y=None):
    return x
a = A()
b = a.run(a)
d = {{}}
d['k'] = a
got = d[{key}]
n = {n} + 1
w = f(a, 1, 2)
z = getattr(a, {attr})(b)
t = (a, f)
u = t[{n}]
"""


def rows(d):
    return sorted(map(tuple, d.select(*sorted(d.columns)).distinct().collect()), key=str)


def texts():
    one = lambda n=0, key="'k'", attr="'run'": TEXT.format(n=n, key=key, attr=attr)
    return {"m": one(), "m1": one(), "m.m1": one(), "a": one(n=1), "k": one(key="'j'"), "r": one(attr="'no'"), "i": one() + "from m1 import a as other\n", "g": one()}


def test_modules_alike_get_the_results_that_they_have_alone(spark):
    f = python_files.facts(python_files.from_text(spark, texts())).localCheckpoint()
    same = alike.alike(f, alike.without_values)
    assert {r["module"] for r in same.members.collect()} == {"m", "m.m1", "g"}
    got, plain = pointer.analyse(f), pointer._analyse(f, "0-cfa", "all", 1000, None)
    for name in ("pts", "cg", "resolved"):
        assert rows(getattr(got, name)) == rows(getattr(plain, name))
    for call in (pointer.Result.variables, pointer.Result.plain_calls, pointer.Result.failed_calls, summaries.unknowns):
        assert rows(call(got)) == rows(call(plain))
    for name in ("call", "arg", "param", "store", "scopes"):
        assert rows(getattr(got.program, name)) == rows(getattr(plain.program, name))


def test_literals_that_no_key_needs_do_not_part_modules(spark):
    f = python_files.facts(python_files.from_text(spark, {f"v{i}": f"x = {i + 5} + 1\ny = max(x, {i + 90})\ns = 'n' + '{i}'\n" for i in range(4)})).localCheckpoint()
    assert {r["module"] for r in alike.alike(f, alike.without_values).members.collect()} == {"v0", "v1", "v2", "v3"}
    assert alike.alike(f) is None


def test_assignments_of_modules_alike(spark):
    f = python_files.facts(python_files.from_text(spark, {k: v for k, v in texts().items() if k in ("m", "g", "a")})).localCheckpoint()
    got, plain = assignments.call_graph(f), assignments._call_graph(f)
    assert got.before.count() and rows(got.before) == rows(plain.before) and rows(got.after) == rows(plain.after) and rows(got.values) == rows(plain.values)


VALUES = """class A:
    def __init__(self, v):
        self.v = v
def f(x, least={b}):
    if x < least:
        return least
    return f(x - 1)
a = A({a})
h = a.v
a.w = {a}
a.w = {b}
w = a.w
i = 0
while i < {a}:
    i = i + {b}
p = (i, h)
n = len(p)
s = 'n' + '{a}'
r = f({a})
m = max({a}, {b})
"""


def test_values_of_modules_alike_are_those_that_they_have_alone(spark, monkeypatch):
    texts = {f"v{i}": VALUES.format(a=a, b=b) for i, (a, b) in enumerate([(17, 4), (3, 9), (1000, 1), (5, 5), (0, 77)])}
    f = python_files.facts(python_files.from_text(spark, texts | {"w": "import v4\nx = v4.i\n"})).localCheckpoint()
    monkeypatch.setattr(values, "CELLS", 100)  # a group a module
    r = pointer.analyse(f)
    got, plain = values.analyse(f, r), values.analyse(f, replace(r, alike=None, ones=None))
    assert {x["module"] for x in r.alike.members.collect()} == {"v0", "v1", "v2", "v3"}
    assert rows(got.rows) == rows(plain.rows) and got.rows.count() == plain.rows.count()


def test_values_in_arrays_are_those_in_columns(spark):
    rng, inf = np.random.default_rng(5), float("inf")
    ends, n = [-inf, -(2.0**54), -3.5, -1.0, 0.0, 1.0, 2.0, 7.25, 2.0**60, inf], 150
    names = [("BinOp", x) for x in ("add", "sub", "mul", "mod", "pow", "truediv", "and")] + [("Compare", x) for x in ("lt", "le", "gt", "ge", "eq", "ne", "is", "isnot", "in")] + [("UnaryOp", x) for x in ("not", "neg", "pos", "invert")]
    names += [("builtin", x) for x in (*av.CALLED, "open")] + [("edge", "true"), ("edge", "false"), ("join", "x")]
    types = np.array([0, *av.BIT.values(), 3, 5, 7, 9, 65, 40, 1 << 6 | 8])
    d = pd.DataFrame({"k": np.arange(n), "at": rng.choice(types, n), "bt": rng.choice(types, n)})
    for v in "ab":
        pair = np.sort(rng.choice(ends, (n, 2)), axis=1)
        bare = np.isin(d[f"{v}t"], [0, av.BIT["NoneType"], av.BIT["function"], av.BIT["class"], av.BIT["instance"], av.BIT["module"]])
        d[f"{v}lo"], d[f"{v}hi"] = np.where(bare, inf, pair[:, 0]), np.where(bare, -inf, pair[:, 1])
    of = lambda v: tuple(d[f"{v}{c}"].to_numpy() for c in ("t", "lo", "hi"))
    grid = spark.createDataFrame(d).crossJoin(spark.createDataFrame([(op, name, m) for op, name in names for m in (0, 1, 2)], "op string, name string, n int")).withColumn("guarded", F.lit(True))
    key = F.concat_ws(":", "op", "name", "n", "k")
    none = F.lit(0).cast("long"), F.lit(inf), F.lit(-inf)
    ops = grid.select(key.alias("tgt"), "op", "name", "n", "guarded", none[0].alias("types"), none[1].alias("lo"), none[2].alias("hi"))
    fixed = lambda v: grid.select(F.concat(F.lit(v), key).alias("tgt"), F.lit("join").alias("op"), F.lit("").alias("name"), F.lit(0).alias("n"), F.lit(False).alias("guarded"), F.col(f"{v}t").cast("long").alias("types"), F.col(f"{v}lo").alias("lo"), F.col(f"{v}hi").alias("hi"))
    on = grid.select(F.concat(F.lit("g"), key).alias("tgt"), F.lit("join"), F.lit(""), F.lit(0), F.lit(False), F.lit(1).cast("long"), F.lit(0.0), F.lit(0.0))
    flow = grid.select(F.explode(F.array(*(F.struct(F.concat(F.lit(v), key).alias("src"), key.alias("tgt"), F.lit(p).alias("pos")) for v, p in (("a", 0), ("b", 1), ("g", 2))))).alias("x")).select("x.*")
    solved, _ = values.solve(ops.union(fixed("a")).union(fixed("b")).union(on), flow)
    want = {r["node"]: (r["types"], r["lo"], r["hi"]) for r in solved.where("not rlike(node, '^[abg](BinOp|Compare|UnaryOp|builtin|edge|join):')").collect()}
    got = {}
    for op, name in names:
        for m in (0, 1, 2):
            t, lo, hi = aa.made(op, name, m, of("a"), of("b"))
            got |= {f"{op}:{name}:{m}:{k}": (t[k], lo[k], hi[k]) for k in range(n) if t[k]}
    assert got and got == want


def test_lines_of_pieces_are_those_of_the_text(monkeypatch):
    """Every tree of a piece was walked to move its lines, a third of a large module's time."""
    import ast

    from factloom.sources import lowering

    text = "".join(f"x{i} = f({i})\ndef g{i}(a):\n    return [\n        a, {i}]\n\n" for i in range(40)) + "y = yield_(x1)\n"
    shown = lambda m: [(s.qualname, s.line, [(i.kind, i.target, i.line) for i in s.body]) for s in m.scopes]
    want = shown(lowering.Lowering("m", text))
    monkeypatch.setattr(lowering, "PIECE", 50)
    monkeypatch.setattr(ast, "increment_lineno", None)
    assert shown(lowering.Lowering("m", text)) == want
