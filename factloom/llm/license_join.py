"""License scans by an exact set-similarity join of text blocks with license templates, in DataFrame functions only.

A block is a line of the text, as its set of words (A-Z lower-cased), or, for notices that are wrapped, a run of consecutive
words over any line breaks, half as many again as the template has. A template holds a block if the block has at least
``threshold`` of the template's words. Words stand in one global order, rarest in the corpus first. With t the words
needed of a template of n, a block that qualifies has one of the template's first n - t + 1 words (prefix filter), has t
or more words (length filter), and a pair that meets at places i and j of both orders can still reach t only if
1 + min(n - i, |block| - j) >= t (positional filter). Pairs left are verified on the sets. Only words of templates matter to
an overlap, so blocks carry those alone, and the block's length filter counts them. Templates are a fixed list of bounded
size, so they are broadcast; blocks are neither shuffled nor collected, only word counts and per-document results of the few
documents with a candidate block are.

Of most templates of a dozen words or less that threshold needs every word. With ``near``, a lower share is enough for those in
NAMED, if the block has the words there that name the license and none that name a sibling one word away (CC BY-NC is not a
near CC BY-SA). Their names are needed words, so the rarest of them is one more word of the prefix, without a place to filter by.

Runs are looked for only around the words of prefixes: any run that qualifies has one, so it
lies within its own length of such a word.

Defined results: a null text is the empty text (no words, no labels, score 0); a null id comes back null; repeated rows are
scanned each; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import table
from factloom.session import Scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
APART = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
# Phrases of the base labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
# License notices by label. A line is held against each.
TEMPLATES = [
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "licensed under the gnu lesser general public license version 2 1"),
    ("agpl", "licensed under the gnu affero general public license version 3"),
    ("apache", "licensed under the apache license version 2 0"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work cc0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]

# Words that name the license of a short template, and words that name a sibling of it.
NAMED = {
    "this work is licensed under the gnu general public license version 3": ("gnu general license", "lesser affero"),
    "licensed under the gnu lesser general public license version 2 1": ("gnu lesser license", "affero"),
    "licensed under the gnu affero general public license version 3": ("gnu affero license", "lesser"),
    "licensed under the apache license version 2 0": ("apache license", ""),
    "released under the mit license": ("mit license", ""),
    "licensed under cc by nc 4 0": ("cc by nc", "sa nd"),
    "licensed under cc by sa 4 0": ("cc by sa", "nc nd"),
    "licensed under cc by 4 0": ("cc by", "nc sa nd"),
    "this is free and unencumbered software released into the public domain": ("unencumbered domain", ""),
}


def need(n: int, threshold: float) -> int:
    """Words that a block must share with a template of n words."""
    return max(1, math.ceil(threshold * n - 1e-9))


def span(template: str) -> int:
    """Words of the runs that are held against a template: half as many again as it has, repeated ones counted."""
    return len(template.split()) * 3 // 2


def base_starts(words: Column, lead: Column, phrase: str) -> Column:
    """Places where the phrase's words stand consecutively; ``lead``: 1 if the text began with what parts words."""
    parts = phrase.split()
    hit = lambda w, i: F.when(w == parts[0], F.when(F.array_join(F.slice(words, i + 1, len(parts)), " ") == phrase, i - lead))
    return F.filter(F.transform(words, hit), lambda x: x.isNotNull())


def ordered(rows: DataFrame, templates: list[tuple[str, str]]) -> list[str]:
    """The templates' words, rarest in the corpus first: by the number of documents with the word, then by the word."""
    vocabulary = sorted({w for _, t in templates for w in (t, *NAMED.get(t, ())) for w in w.split()})
    own = F.array_distinct(F.filter("ws", lambda w: w.isin(vocabulary)))
    n = {r.w: r.n for r in rows.select(F.explode(own).alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()}
    return sorted(vocabulary, key=lambda w: (n.get(w, 0), w))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.92, templates: list[tuple[str, str]] | None = None, near: float | None = None) -> DataFrame:
    """One row per document: words, base places and labels, labels with the join's, and the highest containment of a template."""
    spark = docs.sparkSession
    templates = templates or TEMPLATES
    text = F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), UPPER, LOWER)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("low")).withColumn("ws", F.split("low", APART))
    order = ordered(rows, templates)
    rank = {w: i + 1 for i, w in enumerate(order)}

    sets = [(k, label, sorted({rank[w] for w in t.split()})) for k, (label, t) in enumerate(templates)]
    # Rows (word, template, label, place, words, words needed if near, words needed, run, words, names, siblings), the place -1 for a name.
    prefix = []
    for k, label, rs in sets:
        t = need(len(rs), threshold)
        names, others = (sorted(rank[w] for w in ws.split()) for ws in NAMED.get(templates[k][1], ("", "")))
        low = min(t, need(len(rs), near)) if near and names else t
        rest = (len(rs), low, t, span(templates[k][1]), rs, names, others)
        prefix += [(r, k, label, i, *rest) for i, r in enumerate(rs[: len(rs) - t + 1])]
        prefix += [(names[0], k, label, -1, *rest)] if low < t else []
    rare = sorted({order[r - 1] for r, *_ in prefix})

    lead = F.when(F.get("ws", F.lit(0)) == "", 1).otherwise(0)
    tail = F.when((F.size("ws") > 1) & (F.get("ws", F.size("ws") - 1) == ""), 1).otherwise(0)
    none = F.array().cast("array<int>")
    starts = {label: F.when(F.col("low").rlike(APART.join(phrase.split())), base_starts(F.col("ws"), lead, phrase)).otherwise(none) for phrase, label in PHRASES.items()}
    place = lambda w: F.array_position(F.array(*map(F.lit, order)), w).cast("int")
    ranks = lambda line: F.array_sort(F.array_distinct(F.filter(F.transform(F.split(line, APART), place), lambda r: r > 0)))
    maybe = f"(?:^|[^0-9a-z])(?:{'|'.join(rare)})"
    lines = F.filter(F.transform(F.filter(F.split("low", "\n"), lambda x: x.rlike(maybe)), ranks), lambda x: F.size(x) > 0)
    # Around each word of a prefix, as far as the longest run reaches: the word and the words there, 0 for those of no template.
    far = max(span(t) for _, t in templates)
    hits = F.filter(F.transform("ws", lambda w, i: F.when(w.isin(rare), i)), lambda i: i.isNotNull())
    about = lambda i: F.slice("ws", F.greatest(i - far + 2, F.lit(1)), F.least(i, F.lit(far - 1)) + far)
    near_hits = F.transform(F.array_distinct(F.transform(hits, lambda i: F.struct(F.get("ws", i).alias("w"), about(i).alias("around")))), lambda x: F.struct(place(x["w"]).alias("r"), F.transform(x["around"], place).alias("around")))
    scratch = Scratch(spark, "licenses")
    kept = scratch.keep(
        rows.select("doc_id", F.monotonically_increasing_id().alias("row"), (F.size("ws") - lead - tail).cast("long").alias("n_words"), *(x.alias(f"at_{k}") for k, x in enumerate(starts.values())), F.when(F.col("low").rlike(maybe), lines).alias("blocks"), F.when(F.col("low").rlike(maybe), near_hits).alias("near"))
    )

    # The join: tokens of blocks against the templates' prefixes, a table of bounded size.
    small = spark.createDataFrame(prefix, "r int, template int, label string, i int, n int, low int, t int, span int, ranks array<int>, names array<int>, others array<int>")
    tokens = kept.where("blocks is not null").select("row", F.posexplode("blocks").alias("line", "block")).select("row", "line", "block", F.posexplode("block").alias("j", "r"))
    size, t = F.size("block"), F.col("t")
    reaches = (size >= t) & (F.col("j") <= size - t) & (1 + F.least(F.col("n") - 1 - F.col("i"), size - 1 - F.col("j")) >= t)
    pairs = tokens.join(F.broadcast(small), "r").where(F.when(F.col("i") < 0, size >= F.col("low")).otherwise(reaches))

    def shared(block: Column) -> Column:
        """Words of the template in the block; 0 if they are too few."""
        n = F.size(F.array_intersect(block, "ranks"))
        named = (F.size(F.array_except("names", block)) == 0) & ~F.arrays_overlap("others", block)
        return F.when((n >= t) | (n >= F.col("low")) & named, n).otherwise(0)

    held = pairs.select("row", "label", "n", shared(F.col("block")).alias("both"))

    # Runs: the most of the template's words that any run around a word of its prefix has.
    around = kept.where("near is not null").select("row", F.explode("near").alias("x")).select("row", "x.*").join(F.broadcast(small), "r")
    around = around.where(F.size(F.array_intersect("around", "ranks")) >= F.col("low"))
    starts_at = F.sequence(F.lit(1), F.greatest(F.size("around") - F.col("span") + 1, F.lit(1)))
    most = F.array_max(F.transform(starts_at, lambda k: shared(F.slice("around", k, F.col("span")))))
    wrapped = around.select("row", "label", "n", most.alias("both"))
    both = F.col("both")
    found = held.unionByName(wrapped).where("both > 0").groupBy("row").agg(F.collect_set("label").alias("found"), F.max(both / F.col("n")).alias("score"))

    at = [f"at_{k}" for k in range(len(starts))]
    every = F.concat(*at)
    base = F.array_compact(F.array(*(F.when(F.size(c) > 0, F.lit(label)) for c, label in zip(at, starts, strict=True))))
    return kept.drop("blocks", "near").join(found, "row", "left").select(
        "doc_id",
        "n_words",
        F.size(every).cast("long").alias("n_base"),
        F.array_min(every).cast("long").alias("first_word"),
        F.array_max(every).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, F.coalesce("found", F.array().cast("array<string>")))), ",").alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def op4_license_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"), near=0.8)
