"""Vector operators against brute force."""

import numpy as np
import pytest

from factloom.llm import metric_join, multi_index_hashing


@pytest.fixture(scope="module")
def vectors(spark):
    g = np.random.default_rng(1)
    x = g.standard_normal((500, 16))
    x[100:180] = x[100] + 0.15 * g.standard_normal((80, 16))
    x[200:220] = x[200]
    rows = [(i, [float(v) for v in r], i % 3) for i, r in enumerate(x)]
    rows += [(600, None, 0), (601, [0.0] * 16, 0), (602, [float("nan")] + [1.0] * 15, 0), (603, [None] + [1.0] * 15, 0), (None, [1.0] * 16, 0), (620, [float("inf")] * 16, 1)]
    return x, spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").cache()


def test_recall_and_scores(vectors):
    x, df = vectors
    got = {}
    for r in multi_index_hashing.nearest(df).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    assert sorted(got) == list(range(0, 500, 20))
    hits = 0
    for q, own in got.items():
        s = x @ x[q]
        s[q] = -np.inf
        best = np.lexsort((np.arange(500), -s))[:20]
        assert sorted(own) == list(range(1, 21)) and all(np.isclose(s[v], score) for v, score in own.values())
        hits += len({v for v, _ in own.values()} & set(best.tolist()))
    assert hits / (20 * len(got)) >= 0.9


def test_pigeonhole_budgets_retrieve_all():
    g = np.random.default_rng(2)
    c = g.integers(0, 256, (400, 8), dtype=np.uint8)
    index = multi_index_hashing.Index(c)
    for r in (0, 3, 11, 20, 31):
        want = np.flatnonzero(multi_index_hashing.hamming(c, c[:1]) <= r)
        assert index.within(c[0], r).tolist() == want.tolist()


def test_metric_join_equals_brute_force(vectors, monkeypatch):
    monkeypatch.setattr(metric_join, "CELL", 64)
    monkeypatch.setattr(metric_join, "OWN", 50)
    x, df = vectors
    got = {r.vec_id: r for r in metric_join.near_vectors(df).collect() if r.vec_id is not None}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    label = np.arange(500)
    while True:
        new = np.minimum(label, np.where(near, label[None], 999).min(1))
        if (new == label).all():
            break
        label = new
    assert [got[i].n_links for i in range(500)] == near.sum(1).tolist()
    assert [got[i].component_id for i in range(500)] == label.tolist()
    assert all(got[i].n_links == 0 and got[i].kept for i in (600, 601, 602, 603, 620))


def test_repeated_ids_ties_and_odd_lengths(spark):
    """An id's smallest vector searches and is found; ties go to the smaller id; each row of a join comes back, with the id's most links."""
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (20, [0.0, 1.0]), (20, [-1.0, 5.0]), (3, [2.0, 0.0]), (2, [2.0, 0.0]), (5, [1.0, 2.0, 3.0]), (None, [1.0, 0.0]), (4, [0.0, 9.0])]
    df = spark.createDataFrame([(i, v, "x", 0.5) for i, v in rows], "vec_id long, embedding array<double>, score string, rank double")
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in multi_index_hashing.nearest(df).collect()}
    assert [got[0, k] for k in range(1, 5)] == [(2, 2.0), (3, 2.0), (4, 0.0), (20, -1.0)]
    assert got[20, 1] == (4, 45.0) and len(got) == 8
    out = sorted((r.vec_id if r.vec_id is not None else -1, r.n_links, r.component_id, r.kept) for r in metric_join.near_vectors(df).collect())
    assert out == [(-1, 0, None, False), (0, 3, 0, True), (0, 3, 0, True), (2, 3, 0, False), (3, 3, 0, False), (4, 2, 4, True), (5, 0, 5, True), (20, 2, 4, False), (20, 2, 4, False)]


def test_empty(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert multi_index_hashing.nearest(none).count() == 0 and metric_join.near_vectors(none).count() == 0


def test_vectors_that_every_cell_must_see_leave_in_bounded_batches():
    """Random directions part into no cells: nearly each vector goes to all 40, in batches no larger than ROWS, and the sample says that fewer cells do."""
    import pandas as pd

    g = np.random.default_rng(4)
    x = metric_join.unit(g.standard_normal((metric_join.ROWS, 64)))
    pivots, reach = x[:40], float(np.sqrt(0.2))
    b = pd.DataFrame({"rep": np.arange(len(x)), "m": 1, "v": list(x)})
    sizes = [len(p) for p in metric_join.placed(pivots, reach, np.full(40, 2.0))(iter([b]))]
    assert sum(sizes) > 30 * len(x) and max(sizes) <= metric_join.ROWS
    assert metric_join.useful(x, pivots, reach, 40 * metric_join.CELL) <= 20


def test_vectors_of_floats_move_as_floats(spark, monkeypatch):
    """The same rows as from doubles, over several cells and tiles."""
    monkeypatch.setattr(metric_join, "CELL", 32)
    monkeypatch.setattr(metric_join, "OWN", 40)
    x = np.random.default_rng(5).standard_normal((200, 8)).astype(np.float32)
    x[50:] = x[:150] + np.float32(0.2) * x[50:]
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<float>")
    out = {n: sorted(map(tuple, metric_join.near_vectors(d).collect())) for n, d in (("float", df), ("double", df.withColumn("embedding", df.embedding.cast("array<double>"))))}
    assert out["float"] == out["double"] and any(r[1] for r in out["float"])
