"""The corpus pipeline's stages take effect."""

import random

import corpus_pipeline
from factloom.session import Scratch


def test_stages(spark, tmp_path):
    g = random.Random(1)
    bad = "vile nasty rotten vile"
    en = lambda: " ".join(g.choice("the cat and a dog of this house with that more words it".split()) for _ in range(30))
    docs = [(i, f"{en()} " + (bad if i % 4 == 0 else ""), "en", f"s{i % 3}", 10) for i in range(60)]
    docs += [(100, docs[1][1], "en", "s", 10), (101, "12 34", "en", "s", 10), (102, f"{en()} password = abcdefgh12345 z y x w", "en", "s", 10)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    scratch, now = Scratch(spark, "test"), spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        now = scratch.keep(stage(spark, now, str(tmp_path)))
        seen[name] = now
    ids = lambda n: {r.doc_id for r in seen[n].collect()}
    assert ids("toxicity") == {i for i in (*range(60), 100, 101, 102) if i > 59 or i % 4}
    assert 101 not in ids("language") and len(ids("language")) == len(ids("toxicity")) - 1
    assert 100 not in ids("near_duplicates")
    assert not any("abcdefgh12345" in r.text for r in seen["secrets"].collect())
    assert seen["secrets"].columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert ids("packing") == ids("near_duplicates")
