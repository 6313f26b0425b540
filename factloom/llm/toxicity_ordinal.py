"""Toxicity: cumulative-link ordinal regression on sparse text features.

Severity grades 0..3: P(grade > k) = sigmoid(w . x - t_k), with one weight vector for all ordered thresholds
t_0 < t_1 < t_2. Features are words and their prefixes of four and five letters, hashed; those that part toxic from
clean rows in the training sample are kept, and x is the logarithm of one plus a word's count. The labels say only
toxic or not, so grade 0 is a row labelled clean, and toxic rows get grade 1, 2 or 3 by thirds of how many words the
kept features mark in them (sum of logarithms of counts).

It learns from a bounded sample of labelled rows: about ``sample`` toxic and twice as many clean ones, by hash of id; ``features`` bounds the
model to those that part best. Scoring is one pass; a word's contribution is a number, remembered by each worker.

Defined results: a null text is the empty text, scored by the thresholds alone; a null id comes back null; a document with
several labels is toxic if one says so; without labels, with labels of one kind, or without a feature that parts them, every document gets grade 0;
repeated rows are scored each; an empty table gives an empty result; other columns of either table are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import Remembered, filtered, mapped, sampled, table

DIM = 1 << 18
GRADES = 4
LETTERS = re.compile(r"[^\W\d_]+")
NAMES = ("doc_id", "severity", "expected_severity", "p_toxic", "toxic")
SCHEMA = "doc_id long, severity int, expected_severity double, p_toxic double, toxic boolean"


@dataclass
class Ordinal:
    weights: dict[int, float]
    cuts: np.ndarray

    def word(self, w: str) -> float:
        get = self.weights.get
        return sum(get(f, 0.0) for f in word_features(w))


def crc(w: str) -> int:
    return crc32(w.encode())


def word_features(w: str) -> tuple[int, ...]:
    """Hashed features of a word: itself and its prefixes."""
    return tuple({crc32(x.encode()) % DIM for x in (f"w{w}", f"p{w[:4]}", f"q{w[:5]}")})


def counts(text: str) -> Counter:
    return Counter(LETTERS.findall(text.lower()))


def fit(texts: list[str], toxic: np.ndarray, most: int = 1024, steps: int = 250) -> Ordinal:
    """Choose features by log odds, grade the toxic rows, and fit by gradient steps (Adam) on the ordinal log likelihood."""
    none = Ordinal({}, np.array([20.0, 21.0, 22.0]))
    if not toxic.any() or toxic.all():
        return none
    rows, once = [counts(t) for t in texts], {}
    for i, t in enumerate(texts):  # copies of a document count once: the least three-word runs by two hashes tell them
        ws = LETTERS.findall(t.lower())
        runs = [" ".join(ws[k : k + 3]) for k in range(max(1, len(ws) - 2))]
        once.setdefault((min(map(crc, runs)), min(crc(r[::-1]) for r in runs), bool(toxic[i])), i)
    rows, toxic = [rows[i] for i in once.values()], toxic[list(once.values())]
    features = Remembered(word_features, each=300)
    hashed = [{f for w in r for f in features[w]} for r in rows]
    pos, neg = Counter(), Counter()
    for fs, t in zip(hashed, toxic, strict=True):
        (pos if t else neg).update(fs)
    n1, n0 = int(toxic.sum()), int((~toxic).sum())
    odds = {f: np.log((n + 0.25) / (n1 + 0.5)) - np.log((neg[f] + 0.25) / (n0 + 0.5)) for f, n in pos.items() if n >= max(3, n1 // 66)}
    chosen = sorted((f for f, x in odds.items() if x > 3), key=lambda f: (-odds[f] * np.sqrt(pos[f]), f))[:most]
    if not chosen:
        return none
    at = {f: i for i, f in enumerate(chosen)}
    x = np.zeros((len(rows), len(chosen)), np.float32)
    amount = np.zeros(len(rows))
    for i, r in enumerate(rows):
        for w, n in r.items():
            if own := [at[f] for f in features[w] if f in at]:
                x[i, own] += np.log1p(n)
                amount[i] += np.log1p(n)
    grade = np.where(toxic, 1 + np.searchsorted(np.quantile(amount[toxic], [1 / 3, 2 / 3]), amount, "left").clip(0, 2), 0)
    w, gaps = np.zeros(x.shape[1]), np.array([1.0, 0.0, 0.0])  # cuts: gaps[0], then plus softplus of the others
    m, v = np.zeros(len(w) + 3), np.zeros(len(w) + 3)
    weight = np.where(toxic, n0 / n1, 1.0) / (2 * n0)
    for step in range(1, steps + 1):
        soft = np.log1p(np.exp(gaps[1:]))
        cuts = np.array([gaps[0], gaps[0] + soft[0], gaps[0] + soft[0] + soft[1]])
        s = (x @ w.astype(np.float32)).astype(float)
        c = 1 / (1 + np.exp(-np.clip(s[:, None] - cuts, -40, 40)))  # P(grade > k)
        upper = np.concatenate([np.ones((len(s), 1)), c], 1)[np.arange(len(s)), grade]
        lower = np.concatenate([c, np.zeros((len(s), 1))], 1)[np.arange(len(s)), grade]
        p = np.maximum(upper - lower, 1e-9)
        du, dl = upper * (1 - upper) / p, lower * (1 - lower) / p  # of log p by the two margins
        ds = (du - dl) * weight
        dc = np.zeros(3)
        np.add.at(dc, np.maximum(grade - 1, 0), -(du * weight) * (grade > 0))
        np.add.at(dc, np.minimum(grade, 2), (dl * weight) * (grade < 3))
        sig = 1 / (1 + np.exp(-gaps[1:]))
        g = np.concatenate([x.T @ ds.astype(np.float32) - 2e-4 * w, [dc.sum(), (dc[1] + dc[2]) * sig[0], dc[2] * sig[1]]])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, gaps = w + move[:-3], gaps + move[-3:]
    soft = np.log1p(np.exp(gaps[1:]))
    return Ordinal({f: float(w[i]) for f, i in at.items() if w[i]}, np.array([gaps[0], gaps[0] + soft[0], gaps[0] + soft[0] + soft[1]]))


def learn(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, sample: int, features: int) -> Ordinal:
    """Fit on the sample. The ids chosen are at most 6 x ``sample``, so they are broadcast."""
    marks = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("i")).agg(F.max("toxic").alias("y"))
    ids = sampled(marks.where("y > 0"), sample, "i").union(sampled(marks.where("y <= 0"), 2 * sample, "i")).collect()
    if not ids:
        return fit([], np.zeros(0, bool))
    spark = docs.sparkSession
    chosen = spark.createDataFrame([(r.i, r.y > 0) for r in ids], "i long, y boolean")
    rows = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("text")).where("text is not null").join(F.broadcast(chosen), "i").toPandas()
    rows = rows.sort_values(["i", "text"]).drop_duplicates("i")
    return fit(rows["text"].tolist(), rows["y"].to_numpy(bool), features)


def scorer(m: Ordinal):
    known = Remembered(m.word)

    def margin(text: str) -> float:
        """w . x of a text."""
        some = [w for w, x in ((w, known[w]) for w in LETTERS.findall(text.lower())) if x]
        return sum(np.log1p(n) * known[w] for w, n in sorted(Counter(some).items())) if some else 0.0

    def score(text: str) -> tuple[int, float, float]:
        """Most likely grade, expected grade, probability of a grade over 0."""
        c = 1 / (1 + np.exp(-np.clip(margin(text) - m.cuts, -700, 700)))
        p = np.append(1, c) - np.append(c, 0)
        return int(p.argmax()), float(c.sum()), float(c[0])

    return score


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = 1000, threshold: float = 0.25, features: int = 1024) -> DataFrame:
    """Grade, expected severity and probability of being toxic for each document."""
    m = learn(docs, labels, id_col, text_col, sample, features)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer(m)
        for b in batches:
            out = [score(t.as_py() or "") for t in b.column(1)]
            p = [x[2] for x in out]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.float64()), pa.array(p, pa.float64()), pa.array([x >= threshold for x in p], pa.bool_())], names=list(NAMES))

    return mapped(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), each, SCHEMA)


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = 1000, threshold: float = 0.25, features: int = 1024) -> DataFrame:
    """The rows whose probability of being toxic is under the threshold, with all their columns."""
    m = learn(docs, labels, id_col, text_col, sample, features)

    def keep(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        score = scorer(m)
        for b in batches:
            yield pa.array([score(t.as_py() or "")[2] < threshold for t in b], pa.bool_())

    return filtered(docs, text_col, keep)


def op6_toxicity_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
