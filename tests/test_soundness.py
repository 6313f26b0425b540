"""Programs that an unsound analysis gets wrong, and the relations around the analyses."""

import pytest

from factloom.operators import hierarchy, pointer, summaries
from factloom.plans.analyses import Manager
from factloom.sources import export, python_files

PROGRAM = """
import os
from json import loads
class A: pass
class Q:
    def append(self, x):
        self.held = x
    def __add__(self, o):
        return o
    def __getitem__(self, k):
        return A()
def d(x=A()): return x
p = d()
def g(*xs): return xs[0]
q = g(A())
def h(k, j=None): return k
kw = {"k": A()}
r = h(**kw)
z = [*[A()]]
u = z[0]
s = Q()
s.append(A())
add = s + A()
item = s["k"]
l = []
l.append(A())
e = l.pop()
ext = loads
osx = os
def c(a, b): return b
t = c(*[A(), A()])
def kk(**o): return o["v"]
w = kk(v=A())
bad = s()
open1 = os.nothing()
short = c(A())
"""


@pytest.fixture(scope="module")
def result(spark):
    return pointer.analyse(python_files.facts(python_files.from_text(spark, {"m": PROGRAM})).cache())


def test_arguments_displays_operators_and_methods(result):
    held = {}
    for row in result.variables().where("owner = 'm'").collect():
        held.setdefault(row.name, set()).add(row.obj)
    for name in ("p", "q", "r", "u", "item", "e", "t", "w"):
        assert held[name] == {"inst:m.A"}, name
    assert "inst:m.A" in held["add"] and held["ext"] == {"ext:json.loads"} and held["osx"] == {"ext:os"}
    assert [x.value for x in result.get_field("inst:m.Q", "[]").collect()] == [] and [x.value for x in result.get_field("inst:m.Q", "held").collect()] == ["inst:m.A"]


def test_unknown_records_and_summaries(result, spark):
    u = summaries.unknowns(result).collect()
    assert sorted((r.kind, r.what) for r in u if not r.what.startswith("$")) == [("missing_argument", "m.c.b"), ("non_callable", "s")]
    assert sum(r.kind == "empty_callee" for r in u) == 1 and {r.kind: r.n for r in summaries.unknown_counts(summaries.unknowns(result)).collect()} == {"missing_argument": 1, "non_callable": 1, "empty_callee": 1}
    s = summaries.module_summary(result)
    assert {r.obj for r in s.where("export = 'p'").collect()} == {"inst:m.A"}
    got = summaries.apply_summary(s, spark.createDataFrame([("n", "mine", "m", "p")], "module string, name string, tgt string, item string"))
    assert [tuple(r) for r in got.collect()] == [("n", "mine", "inst:m.A")]
    assert summaries.merge_summaries(s, s).count() == s.count()


VALUES = {
    "rebound": ("def f():\n    global x\n    x = 1\nx = 0\nf()\nif x:\n    y = 1\nelse:\n    y = 2\ny\n", (1, 2)),
    "alias": ("d = {}\ne = d\ne['k'] = 1\nif d:\n    y = 1\nelse:\n    y = 2\ny\n", (1, 2)),
    "base": ("x = int('10', 16)\nif x > 12:\n    y = 1\nelse:\n    y = 2\ny\n", (1, 2)),
    "shadow": ("def len(x):\n    return 0\nif len([1]):\n    y = 1\nelse:\n    y = 2\ny\n", (1, 2)),
    "operator": ("def f():\n    global x\n    x = 1\nx = 0\nz = a + a\nif x:\n    y = 1\nelse:\n    y = 2\ny\n", (1, 2)),
    "pruned": ("x = 0\nif x:\n    y = 1\nelse:\n    y = 2\ny\n", (2, 2)),
    "in_place": ("l = [1]\nm = l\nm += [2]\nif len(l) > 1:\n    y = 1\nelse:\n    y = 2\ny\n", (1, 2)),
    "large": ("if 9007199254740993 == 9007199254740992:\n    y = 1\nelse:\n    y = 2\ny\n", (1, 2)),
    "large_less": ("if 9007199254740992 < 9007199254740993:\n    y = 1\nelse:\n    y = 2\ny\n", (1, 2)),
    "returned": ("def f():\n    try:\n        return 1\n    finally:\n        g()\ny = 2\ny\n", (2, 2)),
    "handled": ("y = 0\ntry:\n    y = 1\n    g()\n    y = 2\nexcept E:\n    pass\nif y > 5:\n    y = 3\ny\n", (None, None)),
    "after_loop": ("y = 1\nfor i in x:\n    try:\n        break\n    finally:\n        y = 2\ny\n", (1, 2)),
    "len": ("x = [1, 2]\nif len(x) > 1:\n    y = 1\nelse:\n    y = 2\ny\n", (1, 1)),
}


def test_values_are_sound(spark):
    f = python_files.facts(python_files.from_text(spark, {k: t + "end = y\n" for k, (t, _) in VALUES.items()})).cache()
    at = python_files.statements(f).where("target = 'end'").select("scope", "idx")
    got = {r.scope: (r.lo, r.hi) for r in Manager(f).run("values")["values"].join(at, ["scope", "idx"]).where("var = 'y'").collect()}
    assert got == {k: v for k, (_, v) in VALUES.items()}


TYPES = {"2 ** -1": "float,int", "2 ** 3": "int", "True & False": "bool", "True | 2": "int", "-True": "int", "True + True": "int", "(-8.0) ** 0.5": "unknown"}


def test_types_of_operators_are_sound(spark):
    f = python_files.facts(python_files.from_text(spark, {f"t{k}": f"y = {e}\nend = y\n" for k, e in enumerate(TYPES)})).cache()
    at = python_files.statements(f).where("target = 'end'").select("scope", "idx")
    got = {r.scope: r.types for r in Manager(f).run("values")["values"].join(at, ["scope", "idx"]).where("var = 'y'").collect()}
    assert got == {f"t{k}": t for k, t in enumerate(TYPES.values())}


def test_cyclic_hierarchy():
    bases = {"a": ["b"], "b": ["c"], "c": ["a"]}
    assert hierarchy.linearise("a", bases) == ["a", "b", "c"]
    with pytest.raises(ValueError):
        hierarchy.linearise("a", bases, strict=True)


def test_exports(spark, tmp_path):
    e = spark.createDataFrame([("m", 1, 2, "Normal"), ("m", 2, 3, "If"), ("n", 1, 2, "Goto")], "scope string, src int, tgt int, kind string")
    dots = {r.group: r.dot for r in export.dot(e, "scope").collect()}
    assert dots["n"] == 'digraph {\n"1" -> "2" [label="Goto"];\n}' and dots["m"].count("->") == 2
    assert {(r.kind, r.scope): r.n for r in export.count_events(export.filter_events(e, kind="If"), "scope").collect()} == {("If", "m"): 1}
    assert [r.json for r in export.call_report(spark.createDataFrame([("f", 1, 0)], "node string, in_degree int, out_degree int")).collect()] == ['{"node":"f","in_degree":1,"out_degree":0}']
    export.write_json(e, f"{tmp_path}/j")
    export.write_csv(e, f"{tmp_path}/c")
    assert spark.read.json(f"{tmp_path}/j").count() == 3 and spark.read.option("header", True).csv(f"{tmp_path}/c").columns == e.columns
