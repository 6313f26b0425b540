"""Whole rows of queries against brute force, and what every operator and stage does with odd tables."""

from hashlib import sha256
from zlib import crc32

import corpus_pipeline
import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from factloom.llm import bpe_queue, common, hmm_scoring, hyperminhash, language_segments, license_join, packing, queries, secret_crf, toxicity_ordinal

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def rows():
    return dict(duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall())


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(1, 40)], LABELS)


def operators(labels):
    return {
        "hmm": hmm_scoring.hmm_score,
        "secrets": secret_crf.scan_secrets,
        "redaction": secret_crf.redact_secrets,
        "bpe": bpe_queue.bpe_digest,
        "licenses": license_join.scan_licenses,
        "packing": packing.pack,
        "toxicity": lambda d: toxicity_ordinal.score_toxicity(d, labels),
        "toxic_gone": lambda d: toxicity_ordinal.drop_toxic(d, labels),
        "near": hyperminhash.near_duplicates,
        "near_gone": hyperminhash.drop_near_duplicates,
        "language": language_segments.identify,
        "language_gone": language_segments.keep_known_languages,
    }


NAMES = list(operators(None))


def test_packing_query_equals_brute_force(spark, rows):
    t = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    want = {}
    for i, text in rows.items():
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 2048):
            part = ids[k : k + 2048]
            want[i, k // 2048] = (k, len(part), crc32(np.array(part, "<u4").tobytes()))
    got = packing.op5_packing(spark, SF).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == want and len(got) == len(want)
    layout = {}
    for r in got:
        layout.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in layout.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 2048
    assert 0 <= len(layout) - -(-sum(n for _, n, _ in want.values()) // 2048) <= 1


def test_bpe_query_equals_tiktoken(spark, rows):
    e = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe_queue.codec(public_tokenizers.path(bpe_queue.VOCABULARY)).ranks, special_tokens={})
    got = {r.doc_id: r for r in bpe_queue.op3_bpe_queue(spark, SF).collect()}
    assert set(got) == set(rows)
    for i, text in rows.items():
        ids = e.encode_ordinary(text or "")
        assert got[i].n_tokens == len(ids) and got[i].ids_sha256 == sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == sha256((text or "").encode()).hexdigest()


def test_word_caches_forget(monkeypatch, rows):
    """Encoding stays right when the remembered words are dropped again and again, and caches keep to their bytes."""
    monkeypatch.setattr(packing, "KEPT", 20_000)
    w, t = packing.Words(public_tokenizers.path(packing.VOCABULARY)), Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    texts = [x for x in rows.values() if x][:60]
    for k in range(0, 60, 10):
        assert [np.frombuffer(b, "<u4").tolist() for b in w.encode(texts[k : k + 10])] == [t.encode(x, add_special_tokens=False).ids for x in texts[k : k + 10]]
    known = common.Remembered(len, 10_000)
    assert all(known[f"word{i}"] == len(f"word{i}") for i in range(1000)) and len(known) <= 10_000 // 200 and known["x" * 100] == 100 and "x" * 100 not in known


def test_toxicity_query_equals_brute_force(spark, rows):
    """Scores of the query's rows from the fitted weights: the cumulative links written out."""
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    m = toxicity_ordinal.learn(spark.read.parquet(f"{SF}/documents.parquet"), labels, "doc_id", "text", 1000, 1024)
    got = {r.doc_id: r for r in toxicity_ordinal.op6_toxicity_ordinal(spark, SF).collect()}
    assert set(got) == set(rows)
    for i, text in rows.items():
        margin = 0.0
        counted: dict[str, int] = {}
        for w in toxicity_ordinal.LETTERS.findall((text or "").lower()):
            counted[w] = counted.get(w, 0) + 1
        for w, n in counted.items():
            hashed = {crc32(x.encode()) % toxicity_ordinal.DIM for x in (f"w{w}", f"p{w[:4]}", f"q{w[:5]}")}
            margin += np.log1p(n) * sum(m.weights.get(f, 0.0) for f in hashed)
        over = [1 / (1 + np.exp(-(margin - c))) for c in m.cuts]
        grades = [1 - over[0], over[0] - over[1], over[1] - over[2], over[2]]
        assert abs(got[i].expected_severity - sum(over)) < 1e-6 and abs(got[i].p_toxic - over[0]) < 1e-6
        assert got[i].severity == int(np.argmax(grades)) or sorted(grades)[-1] - sorted(grades)[-2] < 1e-9


def test_language_query_equals_brute_force(spark, rows):
    """Every row of the query, from the learned probabilities and sums over segmentations character by character."""
    path = public_tokenizers.path(language_segments.VOCABULARY)
    langs, prior, p = language_segments.learn(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id", "text", "lang", path, 400, 3)
    index = language_segments.pieces(path)
    longest = max(map(len, index))
    logs: dict[str, np.ndarray] = {}

    def word(w: str) -> np.ndarray:
        t = language_segments.MARK + w
        f = [np.zeros(len(langs)) - np.inf for _ in range(len(t) + 1)]
        f[0] = np.zeros(len(langs))
        for j in range(1, len(t) + 1):
            for i in range(max(0, j - longest), j):
                k = index.get(t[i:j], -1 if j == i + 1 else None)
                if k is not None:
                    f[j] = np.logaddexp(f[j], f[i] + np.log(p[k]))
        return f[-1]

    got = {r.doc_id: r for r in language_segments.op9_language_segments(spark, SF).collect()}
    assert set(got) == set(rows)
    for i, text in list(rows.items())[:80]:
        parts = ["".join(c if c.isalpha() else " " for c in x).split() for x in [(text or "").lower()]][0]
        assert got[i].held_out == (crc32(str(i).encode()) % 4 == 2)
        if not parts:
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        for w in parts:
            if w not in logs:
                logs[w] = word(w)
        x = sum(logs[w] for w in parts) + prior
        q = np.exp(x - x.max())
        assert got[i].lang_pred == langs[int(x.argmax())] and abs(got[i].score - q.max() / q.sum()) < 1e-6


@pytest.mark.parametrize("text", ["½ ²", "Ⅷ ①", "12 34 !", "", None])
def test_no_letter_is_und(spark, text):
    df = spark.createDataFrame([(1, text, "en"), (2, "the cat and the dog of this house", "en"), (4, "le chat et le chien de la maison", "fr"), (5, "the dog", "en")], "doc_id long, text string, lang string")
    r = language_segments.identify(df).where("doc_id = 1").first()
    assert (r.lang_pred, r.score) == ("und", 0.0)


def test_numbers_inside_words_cut_them():
    assert language_segments.words_of("abc½Def Ⅷ x1y") == ["abc", "def", "x", "y"]


def test_segment_uses_of_long_words():
    """Sums in logs give what plain sums give, and don't underflow."""
    path = public_tokenizers.path(language_segments.VOCABULARY)
    index = language_segments.pieces(path)
    q = np.random.default_rng(1).uniform(1e-5, 1e-3, max(index.values()) + 2).tolist()
    for word in ("thehouse" * 7, "thehouse" * 8, "x" * 3000):
        uses = list(language_segments.piece_uses(language_segments.spans("▁" + word, index, max(map(len, index))), len(word) + 1, q))
        covered = sum(v * (1 if k < 0 else len(next(s for s, i in index.items() if i == k))) for k, v in uses if v > 1e-9) if len(word) < 100 else None
        assert all(np.isfinite(v) for _, v in uses) and sum(v for _, v in uses) > 0
        assert covered is None or abs(covered - len(word) - 1) < 1e-6


def test_nothing_learned_keeps_texts_with_letters(spark):
    df = spark.createDataFrame([(1, "some words here", None), (2, "12 34", None), (3, None, None)], "doc_id long, text string, lang string")
    assert [r.doc_id for r in language_segments.keep_known_languages(df).collect()] == [1]


@pytest.mark.parametrize("name", NAMES)
def test_empty_tables(spark, labels, name):
    assert operators(labels)[name](spark.createDataFrame([], DOCS)).collect() == []


@pytest.mark.parametrize("name", NAMES)
def test_rows_stay_whole(spark, labels, odd_docs, name):
    """Nulls, repeated rows, long texts and clashing columns: rows come back each, and no operator crashes on them."""
    clash = odd_docs.selectExpr("*", "1 as rep", "2 as key", "3 as n", "'x' as h", "'y' as fold", "4 as _gone", "5 as a", "6 as b", "7 as piece", "8 as grp", "9 as held", "10 as label", "11 as component_id", "12 as kept")
    got = operators(labels)[name](clash).collect()
    ids = sorted(r.doc_id or -1 for r in got)
    if name == "packing":
        assert set(ids) == {-1, 1, 2, 3, 4, 5, 6} and sum(r.doc_id == 4 for r in got) == 2
    elif name == "language_gone":
        assert 1 not in ids and 2 not in ids and ids.count(4) == 2
    else:
        assert ids == sorted([1, 2, -1, 3, 4, 4, 5, 6])
    if name.endswith("gone") or name == "redaction":
        assert got[0].asDict().keys() == dict.fromkeys(clash.columns).keys()


@pytest.mark.parametrize("stage", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_tables(spark, tmp_path, stage):
    """Each stage alone: empty tables, null ids and texts, repeated rows, and no labels."""
    spark.createDataFrame([], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    f = dict(corpus_pipeline.STAGES)[stage]
    assert f(spark, spark.createDataFrame([], DOCS), str(tmp_path)).collect() == []
    docs = spark.createDataFrame([(1, None, None, None, None), (None, "the cat", "en", "s", 7), (2, "", "en", "s", 0), (3, "one two three four five", "en", "s", 23), (3, "one two three four five", "en", "s", 23), (7, "one two three four five", "en", "s", 23)], DOCS)
    got = f(spark, docs, str(tmp_path)).collect()
    ids = sorted(r.doc_id or -1 for r in got)
    assert ids == {"language": [-1, 3, 3, 7], "near_duplicates": [-1, 1, 2, 3, 3]}.get(stage, [-1, 1, 2, 3, 3, 7])
    if stage != "packing":
        assert got[0].asDict().keys() == dict.fromkeys(docs.columns).keys()


def test_every_query_without_sql_is_tested_by_brute_force():
    """Which queries have SQL; the others' brute-force tests are named here."""
    tests = {
        "op1_hmm_scoring": "test_hmm_base_score_and_gain",
        "op2_secret_crf": "test_secret_query_equals_brute_force",
        "op3_bpe_queue": "test_bpe_query_equals_tiktoken",
        "op5_packing": "test_packing_query_equals_brute_force",
        "op6_toxicity_ordinal": "test_toxicity_query_equals_brute_force",
        "op7_multi_index_hashing": "test_recall_and_scores",
        "op9_language_segments": "test_language_query_equals_brute_force",
        "op12_additive_quality": "test_quality_query_equals_brute_force",
        "op13_lanczos_whitening": "test_whitening_query_equals_eigenvectors",
    }
    assert set(tests) | set(queries.ORACLE_SQL) == set(queries.QUERIES) and not set(tests) & set(queries.ORACLE_SQL)
