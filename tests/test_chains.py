"""Chains contracted in batches, and what is solved through them, against plain Python on small graphs with cycles, forks and joins."""

import random
from collections import Counter

import pytest
from factloom.operators import chains, graph
from factloom.operators.points_to import points_to, set_sizes

COLS = "src long, tgt long"


def descendants(pairs):
    out = {}
    for a, b in pairs:
        out.setdefault(a, set()).add(b)
    found = set()
    for a in out:
        seen, todo = set(), list(out[a])
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += out.get(x, ())
        found |= {(a, x) for x in seen}
    return found


def simple(pairs, roots, targets, depth):
    out, hop = [], {}
    for a, b in set(pairs):
        hop.setdefault(a, []).append(b)

    def walk(path):
        if path[-1] in targets:
            out.append(">".join(map(str, path)))
        if len(path) <= depth:
            for b in hop.get(path[-1], ()):
                if b not in path:
                    walk([*path, b])

    for r in set(roots):
        walk([r])
    return sorted(out)


FORKED = [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (6, 6), (6, 7), (8, 9), (9, 10), (20, 21), (21, 20), (21, 22), (9, 30), (5, 30), (30, 31)]


def forest():
    r = random.Random(5)
    return [(a, b) for b in range(1, 40) for a in [r.randrange(b)]]


@pytest.mark.parametrize("pairs, roots", [(FORKED, [8, 4]), (forest(), [0, 7, 9])])
def test_closure_reach_paths_and_copies_against_plain_python(spark, pairs, roots):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, 3)  # most chains leave their batch
    try:
        e, root = spark.createDataFrame(pairs, COLS), spark.createDataFrame([(x,) for x in roots], "node long")
        want = descendants(pairs)
        assert sorted(tuple(r) for r in graph.closure(e).collect()) == sorted(want)
        held = {(x, x) for x in roots} | {(b, a) for a, b in want if a in roots}
        assert sorted(r.node for r in graph.reachable(e, root).collect()) == sorted({n for n, _ in held})
        alloc = root.selectExpr("node", "node as obj")
        assert sorted((r.node, r.obj) for r in points_to(alloc, e).collect()) == sorted(held)
        assert {r.node: r.n for r in set_sizes(alloc, e).collect()} == Counter(n for n, _ in held)
        goals = {b for _, b in pairs if b % 2} | {roots[0]}
        got = graph.simple_paths(e, root, spark.createDataFrame([(x,) for x in goals], "node long"), 6)
        assert sorted(r.path for r in got.collect()) == simple(pairs, roots, goals, 6)
    finally:
        spark.conf.set(name, before)


def test_chains_of_names_and_their_ends(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "c2"), ("y", "c2"), ("c2", "d")], "src string, tgt string")
    c = chains.chains(e, spark.createDataFrame([("a",)], "node string"))
    assert {r.node: r.root for r in c.followers().collect()} == {"b": "a", "c": "a", "d": "c2"}
    assert sorted(tuple(r) for r in c.rest.collect()) == [("x", "c2"), ("y", "c2")]


def test_chains_alone_take_no_rounds(spark, monkeypatch):
    def no_rounds(*a, **k):
        raise AssertionError("a round for each link")

    monkeypatch.setattr(graph, "fixpoint", no_rounds)
    pairs = [(100 * c + i, 100 * c + i + 1) for c in range(8) for i in range(9)] + [(300, 400), (400, 100)]
    e, root = spark.createDataFrame(pairs, COLS), spark.createDataFrame([(300,), (400,)], "node long")
    assert graph.closure(e).count() == len(descendants(pairs))
    assert graph.reachable(e, root).count() == 30
    ends = spark.createDataFrame([(100 * c + 9,) for c in range(8)], "node long")
    kept = []
    keep = graph.Scratch.keep
    monkeypatch.setattr(graph.Scratch, "keep", lambda self, df, *a, **k: kept.append(self) or keep(self, df, *a, **k))
    assert sorted(r.path for r in graph.simple_paths(e, spark.createDataFrame([(0,)], "node long"), ends).collect()) == [">".join(map(str, range(10)))]
    assert len(kept) < 9  # a table for each edge of the longest path before
