"""Ranked search, quality and whitening against brute force, and what they do with odd tables."""

import math
import re
from zlib import crc32

import duckdb
import numpy as np
import pytest

from factloom.llm import additive_quality, lanczos_whitening, wavelet_ranking

SF = "/root/testdata/sf0.001"
DOCS, ITEMS = "doc_id long, text string, rank int, score string, term int", "item_id long, text string, terms int"


def ranked(docs, items, k=20):
    """All scores written out, over whole texts."""
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    docs = [(i, cut(t)) for i, t in docs]
    docs = [(i, ws) for i, ws in docs if ws]
    n, total, out = len(docs), sum(len(ws) for _, ws in docs), {}
    for item, text in items:
        found = []
        for i, ws in docs:
            m, score = 75 + 25 * len(ws) * n // total, 0
            for t in cut(text):
                df, tf = sum(t in own for _, own in docs), ws.count(t)
                score += math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1))) * (1_000_000_000 * tf // (1000 * tf + 12 * m)) if tf else 0
            if score > 0:
                found.append((-score, math.inf if i is None else i))
        out[item] = [(i, -s) for s, i in sorted(found)[:k]]
    return out


def got_of(df):
    out = {}
    for r in sorted(df.collect()):
        out.setdefault(r.item_id, []).append((math.inf if r.doc_id is None else r.doc_id, r.score))
        assert r["rank"] == len(out[r.item_id])
    return out


@pytest.fixture(scope="module")
def corpus():
    g = np.random.default_rng(4)
    words = [f"W{i}" for i in range(60)] + ["école", "ÉCOLE", "naïve", "x_y", "a.b"]
    docs = [(int(i), " ".join(g.choice(words, int(g.integers(1, 60))) if i % 7 else g.choice(words[:12], 30))) for i in g.permutation(400)]
    docs += [(1000 + i, "w1 w2 w3 W59 w59") for i in range(60)]  # equal scores
    docs += [(None, "w1 w2 w3 w59 w59"), (2000, None), (2001, ""), (2002, "_ . -"), (2003, "w58 " * 5000), (2004, "w7 w8"), (2004, "w7 w8")]
    items = [(1, "w1 W2 w2 w59"), (2, "ÉCOLE école"), (3, None), (4, ""), (5, "nowhere"), (6, "x_y w7 w8 w58"), (None, "w1"), (7, "w2"), (7, "w1"), (8, " ".join(f"w{i}" for i in range(60)))]
    return docs, items


def test_ranking_equals_brute_force(spark, monkeypatch, corpus):
    """Over many small shards: ties by id, repeated rows and items, null ids, long texts, other columns."""
    monkeypatch.setattr(wavelet_ranking, "CHARS", 3000)
    docs, items = corpus
    found = wavelet_ranking.search(spark.createDataFrame([(i, t, 1, "x", 2) for i, t in docs], DOCS).repartition(5), spark.createDataFrame([(i, t, 9) for i, t in items], ITEMS))
    one = [x for x in items if x[0] is not None and x != (7, "w2")]
    want = {i: rows for i, rows in ranked(docs, one).items() if rows}
    assert got_of(found) == want and len(want[1]) == 20 and len(want) == 5


def test_ranking_in_blocks_of_items(spark, monkeypatch, corpus):
    docs, items = corpus
    monkeypatch.setattr(wavelet_ranking, "ASKED", 20)
    one = [x for x in items if x[0] is not None and x[0] != 7]
    found = wavelet_ranking.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(one, "item_id long, text string"), k=3)
    assert got_of(found) == {i: rows for i, rows in ranked(docs, one, 3).items() if rows}


def test_tree_ranges_follow_lists():
    """At every node a range holds its term's postings below the node, by falling impact."""
    g = np.random.default_rng(2)
    term, docs = np.divmod(np.unique(g.integers(0, 5 * 37, 120)), 37)
    impact = g.integers(1, 9, len(docs))
    t = wavelet_ranking.Tree(docs, impact, term, 5, 37)
    for k in range(5):
        nodes = [(0, 0, int(t.starts[k]), int(t.starts[k + 1]))]
        while nodes:
            level, prefix, lo, hi = nodes.pop()
            want = sorted(impact[(term == k) & (docs >> (t.height - level) == prefix)], reverse=True)
            assert t.best[level * t.size + lo : level * t.size + hi].tolist() == want
            if level < t.height:
                a, b, c, d = (int(x[0]) for x in t.opened(*(np.array([x]) for x in (level, lo, hi))))
                nodes += [(level + 1, 2 * prefix, a, b), (level + 1, 2 * prefix + 1, c, d)]


def test_bounds_prune(corpus):
    """Best first opens few of the nodes when one document stands out."""
    docs = [(i, "common words here") for i in range(1000)] + [(1000 + i, f"common rare{i % 3} rare") for i in range(30)]
    shard = wavelet_ranking.shard_of(*map(list, zip(*docs, strict=True)))
    terms, sizes = shard.column(2)[0].as_py(), np.array(shard.column(3)[0].as_py())
    n, tf = len(docs), np.frombuffer(shard.column(5)[0].as_py(), "<u4").astype(np.int64)
    tree = wavelet_ranking.Tree(np.frombuffer(shard.column(4)[0].as_py(), "<u4").astype(np.int64), wavelet_ranking.impacts(tf, np.full(len(tf), 100)), np.repeat(np.arange(len(terms)), sizes), len(terms), n)
    best = wavelet_ranking.Best(1, 5)
    opened = wavelet_ranking.best_first(tree, list(range(n)), [(0, np.array([terms.index("common"), terms.index("rare1"), terms.index("rare")]), np.array([1, 5000, 3000]))], best)
    assert sorted(-d for _, d in best.heaps[0]) == [1001, 1004, 1007, 1010, 1013] and opened < 80


def test_ranking_of_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    for d, i in ((docs.limit(0), items), (docs, items.limit(0)), (docs, items.selectExpr("item_id", "'zz' as text")), (docs.selectExpr("doc_id", "'.' as text"), items)):
        assert wavelet_ranking.search(d, i).collect() == []


def test_quality_query_equals_brute_force(spark):
    """The query's rows from the learned tables, cell by cell."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    m = additive_quality.learn(docs, labels, "doc_id", "text", 6000, 5, 0)
    got = {r.doc_id: r for r in additive_quality.op12_additive_quality(spark, SF).collect()}
    rows = dict(duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall())
    assert set(got) == set(rows) and m.pairs
    for i, text in rows.items():
        x = additive_quality.measures(text or "")
        place = lambda j, edges, x=x: sum(e <= x[j] for e in edges[j])
        margin = m.intercept + sum(t[place(j, m.edges)] for j, t in enumerate(m.tables)) + sum(t[place(a, m.coarse)][place(b, m.coarse)] for (a, b), t in m.pairs.items())
        assert abs(got[i].score - 1 / (1 + math.exp(-margin))) < 1e-9 and got[i].predicted == int(got[i].score >= 0.3)
        assert got[i].held_out == (crc32(str(i).encode()) % 5 == 0)


def test_quality_on_the_held_out_fold(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in additive_quality.op12_additive_quality(spark, sf).collect()}
    held = [(q, got[i].predicted) for i, q in duckdb.sql(f"SELECT doc_id, quality FROM '{sf}/labels.parquet'").fetchall() if i in got and got[i].held_out]
    assert len(held) > 40 and sum(p for q, p in held if q) >= 0.98 * sum(q for q, _ in held)
    assert sum(not p for q, p in held if not q) >= 0.9 * sum(not q for q, _ in held)


def test_pairs_learn_what_single_measures_cannot():
    g = np.random.default_rng(3)
    x = g.uniform(0, 1, (3000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    alone, both = additive_quality.fit(x[:2000], y[:2000], pairs=0), additive_quality.fit(x[:2000], y[:2000], pairs=1)
    right = [((m.score(x[2000:]) > 0.5) == y[2000:]).mean() for m in (alone, both)]
    assert list(both.pairs) == [(0, 1)] and right[0] < 0.65 and right[1] > 0.9


def test_measures_count_what_they_say():
    x = dict(zip(additive_quality.MEASURES, additive_quality.measures("The cat, the Dog.\nThe cat, the Dog.\n$x 12"), strict=True))
    assert x["words"] == pytest.approx(math.log1p(10)) and x["repeated_lines"] == pytest.approx(1 / 3)
    assert x["function_words"] == pytest.approx(0.4) and x["digits"] == pytest.approx(2 / 41) and x["different_words"] == pytest.approx(0.6)
    assert additive_quality.measures("") and np.isfinite(additive_quality.measures("")).all() and np.isfinite(additive_quality.measures("\ud800 \n\n")).all()


def test_long_texts_are_measured_in_pieces(monkeypatch):
    text = "some words and 12 more, in lines.\n" * 300
    whole = additive_quality.measures(text)
    monkeypatch.setattr(additive_quality, "PIECE", 34 * 7)
    assert np.allclose(additive_quality.measures(text), whole, atol=0.01)


def test_quality_of_odd_tables(spark, odd_docs):
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 0), (3, 1, 0), (4, 1, 0), (5, None, 0), (None, 0, 0), (6, 1, 1)], "doc_id long, quality int, toxic int")
    clash = odd_docs.selectExpr("*", "1 as i", "2 as y", "3 as x", "4 as held_out", "5 as quality")
    got = additive_quality.score_quality(clash, labels).collect()
    assert sorted(r.doc_id or -1 for r in got) == [-1, 1, 2, 3, 4, 4, 5, 6] and all(0 < r.score < 1 for r in got)
    assert all(r.held_out is False for r in got if r.doc_id is None)
    assert {r.score for r in additive_quality.score_quality(clash, labels.limit(0)).collect()} == {0.5}
    assert len({r.score for r in additive_quality.score_quality(clash, labels.where("quality = 1")).collect()}) == 1
    assert additive_quality.score_quality(clash.limit(0), labels).collect() == []


def whitened_of(x, k=32):
    """Whole eigenvectors of the covariance of the integers."""
    x = np.floor(64 * np.asarray(x, float)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(0)
    c = (n * x - s) / n
    v = c.T @ c / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    keep = e > 1e-9 * e[0]
    return (c @ u / np.sqrt(np.abs(e)))[:, keep], (e / np.trace(v))[keep], ((n * x - s) ** 2).sum(1)


def same(df, x, ids):
    w, share, dev = whitened_of(x)
    rows = {(r.vec_id, r.component): r for r in df.collect()}
    assert len(rows) == w.size and {c for _, c in rows} == set(range(1, w.shape[1] + 1))
    got = np.array([[rows[i, c + 1].whitened for c in range(w.shape[1])] for i in ids])
    assert np.allclose(got * np.sign((got * w).sum(0)), w, atol=1e-7)
    assert all(abs(rows[ids[0], c + 1].explained / share[c] - 1) < 1e-6 for c in range(w.shape[1]))
    assert [rows[i, 1].deviation for i in ids] == dev.tolist() and {r.n for r in rows.values()} == {len(x)}
    assert max(r.identity_error for r in rows.values()) < 1e-6 and len({r.identity_error for r in rows.values()}) == 1


def test_whitening_query_equals_eigenvectors(spark):
    rows = duckdb.sql(f"SELECT vec_id, embedding FROM '{SF}/embeddings.parquet' WHERE embedding IS NOT NULL").fetchall()
    same(lanczos_whitening.op13_lanczos_whitening(spark, SF), [v for _, v in rows], [i for i, _ in rows])


@pytest.mark.parametrize("d", [3, 40, 150])
def test_whitening_of_other_sizes(spark, d):
    g = np.random.default_rng(d)
    x = g.standard_normal((300, d)) * 3 * 0.97 ** np.arange(d) + g.standard_normal(d)
    df = spark.createDataFrame([(i, [float(c) for c in v], "clash") for i, v in enumerate(x)], "vec_id long, embedding array<double>, component string")
    same(lanczos_whitening.whiten(df), x, list(range(300)))


def test_lanczos_restarts_on_breakdown():
    """Few distinct eigenvalues: the first block's space is invariant at once, fresh directions find the rest."""
    g = np.random.default_rng(1)
    u = np.linalg.qr(g.standard_normal((60, 60)))[0]
    e = np.repeat([9.0, 4.0, 1.0, 0.0], 15)
    passes = []
    v = (u * e) @ u.T
    got, y = lanczos_whitening.lanczos(lambda q: passes.append(q.shape[1]) or v @ q, 60, 32, 16, 1e-13)
    assert np.allclose(got, e[:32], atol=1e-12) and np.allclose(y.T @ y, np.eye(32), atol=1e-12) and np.allclose(v @ y, y * got, atol=1e-11)
    assert sum(passes) == 60


def test_whitening_stops_before_the_whole_space():
    g = np.random.default_rng(1)
    u = np.linalg.qr(g.standard_normal((400, 400)))[0]
    e = 1000 * 0.8 ** np.arange(400.0)
    passes = []
    got, _ = lanczos_whitening.lanczos(lambda q: passes.append(q.shape[1]) or (u * e) @ (u.T @ q), 400, 8, 8, 1e-13)
    assert np.allclose(got, e[:8]) and sum(passes) < 200


def test_whitening_of_odd_tables(spark):
    """Which rows take part; rank one has one component; equal vectors, one vector and empty tables have none; far deviations are null."""
    rows = [(1, [1.0, 2.0]), (2, [2.0, 4.0]), (None, [3.0, 6.0]), (2, [2.0, 4.0]), (5, None), (6, [float("nan"), 1.0]), (7, [None, 1.0]), (8, [float("inf"), 1.0]), (9, [1.0, 2.0, 3.0]), (10, []), (11, [1e300, 1.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, n string")
    got = lanczos_whitening.whiten(df).collect()
    assert sorted((r.vec_id or -1, r.component, r.n) for r in got) == [(-1, 1, 4), (1, 1, 4), (2, 1, 4), (2, 1, 4)]
    assert all(abs(r.explained - 1) < 1e-9 and r.identity_error < 1e-9 for r in got)
    assert lanczos_whitening.whiten(df.where("vec_id = 2")).collect() == lanczos_whitening.whiten(df.where("vec_id = 1")).collect() == lanczos_whitening.whiten(df.limit(0)).collect() == []
    zero = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert {r.vec_id for r in lanczos_whitening.whiten(zero).collect()} == {1, 2, 3}
    far = spark.createDataFrame([(1, [1e11]), (2, [-1e11]), (3, [0.0])], "vec_id long, embedding array<double>")
    assert {r.vec_id: r.deviation for r in lanczos_whitening.whiten(far).collect()} == {1: None, 2: None, 3: 0}


def test_shards_are_written_in_small_row_groups(spark):
    """A reader or writer holds a whole row group, and Spark's own has room for hundreds of shards of megabytes."""
    import os
    from urllib.parse import urlparse

    import pyarrow.parquet as pq
    from pyspark.sql import functions as F

    from factloom.llm import wavelet_ranking
    from factloom.session import Scratch

    scratch = Scratch(spark, "groups")
    rows = spark.range(0, 12, 1, 1).select("id", F.expr("cast(array_join(transform(sequence(1, 60000), i -> uuid()), '') as binary)").alias("docs"))
    found = scratch.keep(rows, options=wavelet_ranking.GROUPED)
    at = urlparse(scratch.at[id(found)][1]).path
    files = [pq.ParquetFile(f"{at}/{f}").metadata for f in os.listdir(at) if f.endswith(".parquet")]
    assert sum(m.num_rows for m in files) == 12 and max(m.row_group(g).total_byte_size for m in files for g in range(m.num_row_groups)) < 16 << 20
