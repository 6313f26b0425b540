"""Builtins as objects, functions given to them, special methods, tuples by place, under contexts too."""

import pytest

from factloom.operators import pointer, summaries
from factloom.sources import python_files

PROGRAM = """
class A: pass
class B: pass
class It:
    def __iter__(self): return self
    def __next__(self): return A()
class Gen:
    def __iter__(self):
        yield B()
class C:
    def __call__(self, x): return x
class K:
    def __init__(self): self.v = A()
    @property
    def val(self): return self.v
    def m(self): return B()
    def __len__(self): return 1
def wrap(x): return B()
def ident(x): return x
def two(x, y): return y
a = A()
b = B()
for i in It():
    own = i
for g in Gen():
    gen = g
listed = list(Gen())
inlist = listed[0]
d = {"k": a, "l": b}
for k, v in d.items():
    key = k
    val = v
d2 = {}
d2["x"] = a
d2["y"] = b
x1 = d2["x"]
for n, e in enumerate([a]):
    el = e
for p, q in zip([a], [b]):
    zp = p
    zq = q
called = C()(a)
got = getattr(K(), 'm')()
prop = K().val
mapped = map(wrap, [a])
first = next(mapped)
mapped2 = next(map(two, [a], [b]))
fl = len
fl(K())
mk = list
boxed = mk([a])
inbox = boxed[0]
hm = map
hmr = next(hm(wrap, [a]))
s = sorted([a], key=ident)
t = (a, b)
t0 = t[0]
t1 = t[-1]
ks = next(iter(d.keys()))
setattr(b, 'w', a)
w = b.w
many = ident(a, b)
odd = ident(x=a, z=b)
nm = next(map(K, [a])).v
"""
HELD = {
    "i": "A", "own": "A", "g": "B", "gen": "B", "inlist": "B", "val": "AB", "x1": "A", "e": "A", "el": "A", "p": "A", "q": "B", "called": "A", "got": "B", "prop": "A", "first": "B", "mapped2": "B",
    "inbox": "A", "hmr": "B", "t0": "A", "t1": "AB", "w": "A", "many": "A", "odd": "A", "nm": "A",
}


def held(r: pointer.Result) -> dict:
    out: dict[str, set] = {}
    for x in r.variables().where("owner = 'm'").collect():
        out.setdefault(x.name, set()).add(x.obj)
    return out


@pytest.fixture(scope="module")
def result(spark):
    return pointer.analyse(python_files.facts(python_files.from_text(spark, {"m": PROGRAM})).cache())


def test_names_hold_what_builtins_give(result):
    got = held(result)
    assert {k: got.get(k) for k in HELD} == {k: {f"inst:m.{c}" for c in v} for k, v in HELD.items()}
    assert got["fl"] == {"bi:len@m"} and got["ks"] == got["key"] and all(o.endswith("/str") for o in got["ks"]) and len(got["ks"]) == 2


def test_builtins_call(result):
    calls = {tuple(x) for x in result.plain_calls().collect()}
    assert {("bi:len@m", "m.K.__len__"), ("bi:map@m", "m.wrap"), ("m", "m.wrap"), ("m", "m.C.__call__"), ("m", "m.It.__next__"), ("m", "m.Gen.__iter__"), ("m", "m.ident"), ("m", "m.K.__init__")} <= calls


def test_arguments_that_nothing_takes_are_recorded(result):
    assert sorted((x.kind, x.what) for x in summaries.unknowns(result).collect()) == [("surplus_argument", "m.ident.1"), ("unexpected_keyword", "m.ident.z")]
    assert result.failed_calls().count() == 0


CONTEXTS = """
class A: pass
class B: pass
def put(x):
    box = []
    box.append(x)
    return box
def ident(x): return x
p = put(A())
q = put(B())
one = p[0]
r = ident(A())
s = ident(B())
m = next(map(ident, [A()]))
"""


def test_containers_and_callbacks_under_contexts(spark):
    r = pointer.analyse(python_files.facts(python_files.from_text(spark, {"m": CONTEXTS})).cache(), "1-cfa", "modules")
    got = held(r)
    assert got["r"] == {"inst:m.A"} and got["s"] == {"inst:m.B"} and "inst:m.A" in got["one"] and got["m"] == {"inst:m.A"}
