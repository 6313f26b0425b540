"""Chains of scopes and memory against brute force."""

import random

import pytest

from factloom.functions import abstract as av
from factloom.operators import memory
from factloom.sources import python_files

INT, STR = av.BIT["int"], av.BIT["str"]


def nearest(parent, kind, held, scope, name):
    at, first = scope, True
    while at is not None:
        if (at, name) in held and (first or kind[at] != "class"):
            return at
        at, first = parent[at], False
    return None


def test_lookup_equals_brute_force(spark):
    g = random.Random(3)
    parent, kind = {"s0": None}, {"s0": "module"}
    for i in range(1, 60):  # one long chain and many short ones
        parent[f"s{i}"] = f"s{i - 1}" if i < 25 else f"s{g.randrange(i)}"
        kind[f"s{i}"] = g.choice(["function", "class"])
    held = {(s, n): i for i, s in enumerate(parent) for n in "xyz" if g.random() < 0.15}
    rows = spark.createDataFrame([(s, p, kind[s]) for s, p in parent.items()] + [("o", "gone", "function"), (None, "s0", "class")], "scope string, parent string, kind string")
    chain = memory.chains(rows.union(rows.limit(3)))
    wanted = spark.createDataFrame([(s, n) for s in [*parent, "o"] for n in "xyzw"] * 2 + [(None, "x"), ("s3", None)], "scope string, name string")
    got = memory.lookup(wanted, chain, spark.createDataFrame([(s, n, v) for (s, n), v in held.items()] + [("s3", None, 1)], "scope string, name string, value long"))
    want = {(s, n): h for s in parent for n in "xyzw" if (h := nearest(parent, kind, held, s, n)) is not None}
    found = got.collect()
    assert {(r.scope, r.name): r.holder for r in found} == want and len(found) == len(want)
    assert all(r.value == held[r.holder, r.name] for r in found)


def test_scopes_around_themselves_raise_and_no_scopes_have_no_chain(spark):
    schema = "scope string, parent string, kind string"
    with pytest.raises(ValueError):
        memory.chains(spark.createDataFrame([("a", "b", "function"), ("b", "a", "function")], schema))
    assert memory.chains(spark.createDataFrame([], schema)).count() == 0


def test_owners_of_a_module_are_found(spark):
    text = "x = 1\ndef f(a):\n    y = a\n    class C:\n        y = 2\n        def g(self):\n            return y, x, a\n    return C\n"
    f = python_files.facts(python_files.from_text(spark, {"m": text})).cache()
    held = python_files.stores(f).select("scope", "var").union(python_files.parameters(f).select("scope", "name")).distinct().toDF("scope", "name")
    used = python_files.variables(f).where("owner <> '' and not startswith(name, '$')")
    got = memory.lookup(used.select("scope", "name"), memory.chains(python_files.scopes(f)), held)
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in used.select("scope", "name", "owner").collect()}


def test_contexts_see_their_own_values_first(spark):
    chain = memory.chains(spark.createDataFrame([("m", None, "module"), ("m.f", "m", "function")], "scope string, parent string, kind string"))
    schema = "ctx string, scope string, name string, types long, lo double, hi double"
    rows = lambda *r: spark.createDataFrame(list(r), schema)
    seen = lambda m, *k: {tuple(r) for r in memory.get(m, chain, spark.createDataFrame(list(k), "ctx string, scope string, name string")).collect()}
    m = memory.put(rows(), rows(("", "m", "x", INT, 1.0, 1.0), ("", "m", "x", INT, 4.0, 4.0)))
    assert seen(m, ("7", "m.f", "x"), ("7", "m.f", "w")) == {("7", "m.f", "x", "m", INT, 1.0, 4.0)}
    m = memory.merge(m, chain, rows(("7", "m.f", "x", STR, 9.0, 9.0)))
    assert seen(m, ("7", "m.f", "x"), ("", "m.f", "x")) == {("7", "m.f", "x", "m.f", INT | STR, 1.0, 9.0), ("", "m.f", "x", "m", INT, 1.0, 4.0)}
    m = memory.put(m, rows(("7", "m.f", "x", INT, 0.0, 0.0)))
    assert seen(m, ("7", "m.f", "x"), ("8", "m.f", "x")) == {("7", "m.f", "x", "m.f", INT, 0.0, 0.0), ("8", "m.f", "x", "m", INT, 1.0, 4.0)}
