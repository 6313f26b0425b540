"""The analysis engine's operators on small inputs."""

import random

import pytest

from factloom.functions import context, lattice, points_to_sets
from factloom.operators import cfg, components, dataflow, graph, hierarchy
from factloom.operators.fixpoint import NotConverged, fixpoint
from factloom.operators.points_to import first_base_wins, points_to
from factloom.plans import flow_queries
from pyspark.sql import functions as F


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src long, tgt long")


def test_closure_of_a_cycle(spark):
    got = rows(graph.closure(edges(spark, [(1, 2), (2, 3), (3, 1), (3, 4)])), "src", "tgt")
    assert got == sorted((a, b) for a in (1, 2, 3) for b in (1, 2, 3, 4))


def test_fixpoint_raises_when_rounds_run_out(spark):
    e = edges(spark, [(k, k + 1) for k in range(6)])
    with pytest.raises(NotConverged):
        graph.closure(e, max_rounds=2)


def test_reachability_levels_peeling(spark):
    e = edges(spark, [(1, 2), (2, 3), (1, 3), (5, 6), (6, 5), (7, 5)])
    root = spark.createDataFrame([(1,)], "node long")
    assert rows(graph.reachable(e, root), "node") == [(1,), (2,), (3,)]
    assert rows(graph.peel(e, root), "node") == [(1,), (2,), (3,), (5,), (6,)]
    assert rows(graph.topological_levels(e.where("src < 5")), "node", "level") == [(1, 0), (2, 1), (3, 2)]
    with pytest.raises(graph.CycleError):
        graph.topological_levels(e)
    assert rows(graph.distances(e, root, 1), "node", "depth") == [(1, 0), (2, 1), (3, 1)]


def test_paths_and_degrees(spark):
    e = edges(spark, [(1, 2), (2, 3), (1, 3), (3, 1)])
    n = lambda x: spark.createDataFrame([(x,)], "node long")
    assert rows(graph.simple_paths(e, n(1), n(3)), "path") == [("1>2>3",), ("1>3",)]
    assert rows(graph.degrees(e, n(9)), "node", "in_degree", "out_degree") == [(1, 1, 2), (2, 1, 1), (3, 2, 1), (9, 0, 0)]
    with pytest.raises(graph.TooManyPaths):
        graph.simple_paths(e, n(1), n(3), most=1)


def test_dominators_of_a_diamond(spark):
    e = spark.createDataFrame([("s", 0, 1), ("s", 0, 2), ("s", 1, 3), ("s", 2, 3), ("s", 3, 1)], "scope string, src long, tgt long")
    dom = graph.dominators(e, spark.createDataFrame([("s", 0)], "scope string, node long")).cache()
    assert rows(graph.immediate_dominators(dom), "node", "idom") == [(1, 0), (2, 0), (3, 0)]
    assert rows(graph.dominance_frontier(e, dom), "node", "frontier") == [(1, 3), (2, 3), (3, 1)]


def test_grouped_and_loop_dataflow_agree(spark):
    e = spark.createDataFrame([("s", k, k + 1) for k in range(1, 6)] + [("s", 5, 2)], "scope string, src long, tgt long")
    stores = spark.createDataFrame([("s", 1, "x"), ("s", 3, "x"), ("s", 4, "y")], "scope string, node long, var string")
    loads = spark.createDataFrame([("s", 2, "x"), ("s", 6, "y")], "scope string, node long, var string")
    grouped = dataflow.reaching_definitions(stores, e)
    assert rows(grouped, "var", "d", "n") == rows(dataflow.reaching_definitions(stores, e, largest=1), "var", "d", "n")
    assert ("x", 3, 2) in rows(grouped, "var", "d", "n")
    assert rows(dataflow.liveness(stores, loads, e), "node", "var") == rows(dataflow.liveness(stores, loads, e, largest=1), "node", "var")
    assert rows(dataflow.def_use(grouped, loads), "d", "u") == [(1, 2), (3, 2), (4, 6)]


def test_definitions_used_are_those_of_the_whole_relation(spark, monkeypatch):
    e = spark.createDataFrame([(s, i, i + 1) for s in "ab" for i in range(12)] + [("a", 9, 2), ("b", 5, 1)], "scope string, src long, tgt long")
    stores = spark.createDataFrame([(s, i, "xyz"[i % 3]) for s in "ab" for i in range(0, 13, 2)], "scope string, node long, var string")
    loads = spark.createDataFrame([(s, i, v) for s in "ab" for i, v in ((1, "x"), (4, "y"), (7, "z"), (7, "x"), (12, "w"))], "scope string, node long, var string")
    want = rows(dataflow.def_use(dataflow.reaching_definitions(stores, e), loads), "scope", "var", "d", "u")
    assert want
    for largest in (20_000, 1):
        assert rows(dataflow.used_definitions(stores, loads, e, largest), "scope", "var", "d", "u") == want
    monkeypatch.setattr(dataflow, "TASK", 5)
    spread = dataflow.used_definitions(stores, loads, e)
    assert rows(spread, "scope", "var", "d", "u") == want
    assert spread.rdd.getNumPartitions() > 4  # tasks follow the rows, not the session's number of partitions


def test_large_scopes_have_the_same_must_facts_and_dominators(spark):
    g = random.Random(6)
    e = spark.createDataFrame(sorted({(s, g.randint(0, 8), g.randint(1, 8)) for s in "abc" for _ in range(13)}), "scope string, src long, tgt long")
    gen = spark.createDataFrame([(s, n, v, v[0]) for s in "abc" for n in range(9) for v in ("x1", "x2", "y1") if g.random() < 0.3], "scope string, node long, item string, cls string")
    kill = spark.createDataFrame([(s, g.randint(0, 8), "x") for s in "abc"], "scope string, node long, cls string")
    for direction in ("forward", "backward"):
        problem = dataflow.Dataflow(e, gen, kill, direction, "must")
        for side in ("in", "out"):
            want = rows(dataflow.solve(problem, side), "scope", "node", "item", "cls")
            assert want and want == rows(dataflow.solve(problem, side, 1), "scope", "node", "item", "cls")
    entries = spark.createDataFrame([("a", 0), ("b", 0), ("b", 3), ("c", 0), ("d", 5)], "scope string, node long")
    assert rows(graph.dominators(e, entries), "scope", "node", "dom") == rows(graph.dominators(e, entries, 1), "scope", "node", "dom")


def test_nothing_is_assigned_where_a_scope_begins(spark, tmp_path):
    events = [(1, k, k, what, '{"k": 1}') for k, what in enumerate(("signup", "view", "error", "click"), 1)]
    spark.createDataFrame(events, "user_id long, ts long, event_id long, event_type string, props string").write.parquet(f"{tmp_path}/events.parquet")
    got = rows(flow_queries.definitely_assigned(spark, str(tmp_path)), "node", "var")
    assert got == [(2, "signup"), (3, "signup"), (3, "view"), (4, "signup"), (4, "view")]


def test_closure_variables(spark):
    s = spark.createDataFrame([("m", None), ("m.f", "m"), ("m.f.g", "m.f")], "scope string, parent string")
    v = lambda *p: spark.createDataFrame(list(p), "scope string, var string")
    got = dataflow.closure_variables(s, v(("m.f.g", "x"), ("m.f.g", "y")), v(("m.f", "x"), ("m.f.g", "y")), v(("m", "f")))
    assert rows(got, "scope", "var") == [("m.f", "x")]


def test_blocks_and_edges(spark):
    code = spark.createDataFrame([("s", 0, "Assign", None), ("s", 1, "JumpIfFalse", "e"), ("s", 2, "Pass", None), ("s", 3, "Goto", "e"), ("s", 4, "Label", "e"), ("s", 5, "Return", None), ("s", 6, "Assign", None)], "scope string, idx long, kind string, label string")
    b = cfg.blocks(code).cache()
    assert rows(b, "idx", "blk") == [(0, 0), (1, 0), (2, 1), (3, 1), (4, 2), (5, 2), (6, 3)]
    assert rows(cfg.block_edges(b), "src", "tgt", "kind") == [(0, 1, "Normal"), (0, 2, "If"), (1, 2, "Goto")]
    assert (2, "Pass") not in rows(cfg.drop_nops(code), "idx", "kind")


def test_c3(spark):
    assert hierarchy.linearise("D", {"D": ["B", "C"], "B": ["A"], "C": ["A"]}) == ["D", "B", "C", "A"]
    with pytest.raises(ValueError):
        hierarchy.linearise("X", {"X": ["A", "B"], "B": ["A"]}, strict=True)
    base = spark.createDataFrame([("D", "B", 0), ("D", "C", 1), ("B", "A", 0), ("C", "A", 0)], "cls string, base string, base_idx long")
    mro = hierarchy.c3_mro(base, spark.createDataFrame([("D",), ("A",)], "cls string"))
    assert rows(mro, "cls", "pos", "ancestor") == [("A", 0, "A"), ("D", 0, "D"), ("D", 1, "B"), ("D", 2, "C"), ("D", 3, "A")]


def test_c3_linearises_one_of_classes_with_the_same_bases(spark, monkeypatch):
    own = [(f"{c}{i}", b, n) for i in range(9) for c, bs in (("d", ("B", "C")), ("e", ("C", "B")), ("x", ("A", "B"))) for n, b in enumerate(bs)]
    base = spark.createDataFrame([*own, ("B", "A", 0), ("C", "A", 0), ("p", "q", 0), ("q", "p", 0), ("r", "p", 0)], "cls string, base string, base_idx long")
    asked = [*{c for c, _, _ in own}, "B", "p", "q", "r", "lone", "mate"]
    kept = []
    monkeypatch.setattr(hierarchy, "fixpoint", lambda init, step: (kept.append(init.count()), fixpoint(init, step))[1])
    mro = hierarchy.c3_mro(base, spark.createDataFrame([(c,) for c in asked], "cls string"))
    bases: dict = {}
    for c, b, _ in base.orderBy("cls", "base_idx").collect():
        bases.setdefault(c, []).append(b)
    assert rows(mro, "cls", "pos", "ancestor") == sorted((c, i, a) for c in asked for i, a in enumerate(hierarchy.linearise(c, bases)))
    assert kept == [8]  # three kinds of bases, r, one without bases; B, p and q are bases themselves


def test_block_stores_and_loads_join_nothing(spark):
    rows_ = [("s", 0, 0, "a", "b"), ("s", 1, 0, "a", None), ("s", 2, 1, "c", "a"), ("s", 3, 1, "b", "c")]
    blocked = spark.createDataFrame(rows_, "scope string, idx long, blk long, var string, lvar string")
    out = cfg.block_stores_loads(blocked)
    assert rows(out, "blk", "stores", "loads") == [(0, "a", "b"), (1, "b,c", "a,c")]
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()


def test_chains_longer_than_are_followed_link_by_link(spark):
    copy = [*((i, i + 1) for i in range(40)), (5, 100), (100, 101), (200, 201), (201, 202), (202, 201), (300, 301), (301, 300), (401, 402), (402, 403), (7, 403), (20, 20)]
    same, rest = components.merged(edges(spark, copy), spark.createDataFrame([(0,), (30,)], "node long"))
    want = {i: 0 for i in range(1, 30)} | {i: 30 for i in range(31, 41)} | {100: 0, 101: 0, 202: 201, 300: None, 301: None, 402: 401}
    assert dict(tuple(r) for r in same.select("node", "root").collect()) == want
    assert rows(rest, "src", "tgt") == [(7, 403), (29, 30), (200, 201), (202, 201), (402, 403)]


def test_a_chain_whose_root_is_found_is_not_moved_again(spark, monkeypatch):
    moved, keep = [], components.Scratch.keep

    def counted(self, df, *a, **k):
        out = keep(self, df, *a, **k)
        moved.append(out.count())
        return out

    monkeypatch.setattr(components.Scratch, "keep", counted)
    short = edges(spark, [(100 * c + i, 100 * c + i + 1) for c in range(10) for i in range(6)])
    same = components.followers(short, spark.createDataFrame([], "node long"))
    assert moved == [60, 60, 50, 40, 30, 20, 10]
    assert {(r.node % 100, r.node - r.root) for r in same.collect()} == {(i, i) for i in range(1, 7)}


def test_points_to_rules(spark):
    t = lambda cols, *r: spark.createDataFrame(list(r), cols)
    pts = points_to(
        t("node string, obj string", ("b", "o1"), ("x", "o2")),
        t("src string, tgt string", ("b", "c"), ("x", "y")),
        t("base string, field string, tgt string", ("c", "f", "z")),
        t("base string, field string, src string", ("b", "f", "y")),
    )
    assert rows(pts.where("node = 'z'"), "obj") == [("o2",)]
    assert rows(points_to_sets.may_alias(pts.where("field = ''"), t("a string, b string", ("x", "z"), ("b", "z"))), "a", "b", "may_alias") == [("b", "z", False), ("x", "z", True)]
    flow = t("node string, priority int, obj string", ("n", 1, "late"), ("n", 0, "early"))
    assert rows(first_base_wins(flow), "obj") == [("early",)]


@pytest.mark.parametrize("policy,want", [("0-cfa", ""), ("1-cfa", "s"), ("2-cfa", "b,s"), ("2-obj", "b,r"), ("1-type", "k"), ("1-rcv", "a"), ("2-param", "b,u+v"), ("1c1o", "c:s,o:r")])
def test_contexts(spark, policy, want):
    row = spark.range(1).select(F.array(F.lit("a"), F.lit("b")).alias("c"))
    got = context.call_context(policy, F.col("c"), F.lit("s"), F.lit("r"), F.lit("k"), F.lit("a"), F.array(F.lit("v"), F.lit("u")))
    assert row.select(F.array_join(got, ",").alias("x")).first().x == want


def test_unknown_policy():
    with pytest.raises(ValueError):
        context.parse("9-cfa")


def test_lattice(spark):
    df = spark.createDataFrame([("v", [1.0, 2.0]), ("v", [-3.0])], "var string, xs array<double>")
    v = df.select("var", lattice.number(F.col("xs")).alias("n")).groupBy("var").agg(lattice.join_numbers("n").alias("n"))
    r = v.select("n.*", lattice.truth(F.col("n")).alias("t"), lattice.compare("<", F.col("n"), lattice.interval(F.lit(5.0), F.lit(None).cast("double"))).alias("lt")).first()
    assert (r.exact, r.lo, r.hi, r.zero, r.neg, r.pos, r.t, r.lt) == ([-3.0, 1.0, 2.0], -3.0, 2.0, False, True, True, True, True)


def test_dominator_trees_make_no_pairs_and_agree_with_them(spark):
    """Trees and frontiers of random graphs, several entries and unreachable nodes among them, against the pairs; straight code gives a row for each node."""
    import random

    import pandas as pd
    from factloom.operators import graph

    draw = random.Random(7)
    edges = [(s, draw.randrange(12), draw.randrange(12)) for s in range(12) for _ in range(18)]
    entries = [(s, n) for s in range(12) for n in range(1 + s % 3)]
    e, n = spark.createDataFrame(edges, "scope long, src long, tgt long").distinct(), spark.createDataFrame(entries, "scope long, node long")
    dom = graph.dominators_loop(e, n)
    got = {k: sorted(map(tuple, d.collect())) for k, d in (("tree", graph.immediate(e, n)), ("front", graph.frontiers(e, n)), ("huge", graph.frontiers(e, n, 20)))}
    assert got["tree"] == sorted(map(tuple, graph.immediate_dominators(dom).collect()))
    assert got["front"] == got["huge"] == sorted(map(tuple, graph.dominance_frontier(e, dom).distinct().collect()))
    line = pd.DataFrame({"scope": 1, "src": range(3000), "tgt": range(1, 3001), "entry": False})
    assert len(graph._parents(pd.concat([line, pd.DataFrame({"scope": [1], "src": [0], "tgt": [-1], "entry": [True]})]))) == 3000


def test_contexts_are_computed_in_a_projection(spark, tmp_path):
    from factloom.plans import graph_queries

    line = [(7, 3, 4, float(q), flag, status) for q, flag, status in ((0, "R", "O"), (1, "A", "F"), (2, "N", "O"), (3, "A", "O"))]
    spark.createDataFrame(line, "l_orderkey long, l_suppkey long, l_partkey long, l_quantity double, l_returnflag string, l_linestatus string").write.parquet(f"{tmp_path}/lineitem.parquet")
    out = graph_queries.call_contexts(spark, str(tmp_path))
    got = sorted((r.policy, r.ctx) for r in out.where("policy in ('2-cfa', '3-obj', '2-param', '1c2o')").collect())
    assert got == sorted([("2-cfa", "s7"), ("2-cfa", "c:3|s7"), ("2-cfa", "o:4|s7"), ("2-cfa", "c:0|s7"), ("3-obj", "s7"), ("3-obj", "c:3|x4"), ("3-obj", "c:3|o:4|x4"), ("3-obj", "o:4|c:0|x4"),
        ("2-param", "v3+v4"), ("2-param", "c:3"), ("2-param", "o:4|v3+v4"), ("2-param", "c:0|v3+v4"), ("1c2o", "c:s7"), ("1c2o", "c:s7|o:x4"), ("1c2o", "c:s7|o:4|o:x4"), ("1c2o", "c:s7|o:4|o:x4")])
    assert "explode(rows#" in out._jdf.queryExecution().executedPlan().toString()  # a generator computes what policies share again for each
