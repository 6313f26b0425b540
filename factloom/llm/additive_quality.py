"""Quality classifier: a generalised additive model with pairwise interactions (cyclic boosted shallow trees).

``measures`` turns a whole text into the numbers ``MEASURES``: amounts, shares of kinds of characters, word and line lengths, repetition.
Each is cut into at most ``BINS`` bins at quantiles of the training rows. Boosting goes round the measures: for each, a tree of at most
three cuts over its bins is fitted to the gradients of the logistic likelihood, and a small step of it is added to the measure's
lookup table. Then the pairs whose best 2 x 2 cut explains most of what is left get tables over two coarser binnings, boosted likewise. A
score is the sigmoid of the intercept and the looked-up values of all tables; it is the probability of label 1, not reweighted.

It learns from a bounded sample, about ``sample`` labelled rows by hash of id (twice as many at most); scoring covers every row.

Defined results: a null text is the empty text, which is scored like any; a null id comes back null and isn't held out; a document with several
labels counts as 0 if one says so; a repeated id in the training sample gives its smallest text; null labels are ignored; without labels every score
is 0.5, with labels of one kind (r + 0.5) / (n + 1) of r ones among n; texts are measured in pieces of ``PIECE`` characters, a word across two of
them counts in both; repeated rows are scored each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import bucket10, mapped, sampled, table

BINS, COARSE, PIECE = 32, 8, 1 << 20
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"
MEASURES = ("characters", "words", "word_length", "upper", "digits", "symbols", "sentence_ends", "commas", "line_breaks", "other_letters", "different_words", "top_word", "top_ten_words", "short_words", "long_words", "marked_words", "words_a_sentence", "repeated_lines", "equal_neighbours", "character_entropy", "function_words", "words_a_line")
#: Common function words of English, German, French and Spanish.
FUNCTION_WORDS = frozenset("the of and to in is that it for on with as was are be this der die und das den von zu mit ist des ein eine nicht auf für im le la les et des un une du en que est pour dans de el los las y del se por con para su".split())
#: Kinds of characters, by code; 0 lower, 1 upper, 2 digit, 3 space, 4 line break, 5 ends a sentence, 6 comma and the like, 7 other symbol, 8 beyond ASCII.
KIND = np.full(129, 7, np.uint8)
for _kind, _chars in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\r\x0b\x0c", "\n", ".!?", ",;:'\"-()")):
    KIND[[ord(c) for c in _chars]] = _kind
KIND[128] = 8


def measures(text: str) -> list[float]:
    """The numbers ``MEASURES`` of a text."""
    kinds, shape, codes = np.zeros(9, np.int64), np.zeros(4, np.int64), np.zeros(129, np.int64)
    words: Counter[str] = Counter()
    lines: Counter[int] = Counter()
    for lo in range(0, len(text), PIECE):
        piece = text[lo : lo + PIECE]
        c = np.minimum(np.frombuffer(piece.encode("utf-32-le", "replace"), "<u4"), 128)
        k = KIND[c]
        codes += np.bincount(c, minlength=129)
        gap = (k == 3) | (k == 4)
        ends = np.flatnonzero(np.diff(np.concatenate([[True], gap, [True]]).astype(np.int8)))
        length = ends[1::2] - ends[::2]
        last = k[ends[1::2] - 1]
        shape += [(length <= 3).sum(), (length >= 12).sum(), (last == 7).sum(), (c[1:] == c[:-1]).sum()]
        words.update(piece.split())
        lines.update(hash(x) for x in piece.split("\n") if x.strip()) if "\n" in piece else lines.update([hash(piece)])
    kinds = np.bincount(KIND, weights=codes, minlength=9)
    n, many, different = max(1, len(text)), max(1, sum(words.values())), len(words)
    top = [x for _, x in words.most_common(10)] or [0]
    letters, all_lines = max(1.0, kinds[0] + kinds[1] + kinds[8]), max(1, sum(lines.values()))
    p = codes[codes > 0] / n
    function = sum(x for w, x in words.items() if w.strip(".,;:!?").lower() in FUNCTION_WORDS)
    return [
        float(np.log1p(len(text))),
        float(np.log1p(sum(words.values()))),
        (n - kinds[3] - kinds[4]) / many,
        kinds[1] / letters,
        kinds[2] / n,
        kinds[7] / n,
        kinds[5] / many,
        kinds[6] / many,
        kinds[4] / many,
        kinds[8] / n,
        different / many,
        top[0] / many,
        sum(top) / many,
        shape[0] / many,
        shape[1] / many,
        shape[2] / many,
        float(np.log1p(many / max(1.0, kinds[5]))),
        (all_lines - len(lines)) / all_lines,
        shape[3] / n,
        float(-(p * np.log(p)).sum()),
        function / many,
        float(np.log1p(many / all_lines)),
    ]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -700, 700)))


def cuts(x: np.ndarray, bins: int) -> np.ndarray:
    """Inner edges at quantiles; a value's bin is the number of edges that are at most it."""
    return np.unique(np.quantile(x, np.arange(1, bins) / bins)) if len(x) else np.zeros(0)


def binned(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    return np.searchsorted(edges, x, side="right")


@dataclass
class Additive:
    """Lookup tables by measure, and by pairs of measures."""

    intercept: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Sum of looked-up values for each row of measures."""
        out = np.full(len(x), self.intercept)
        for j, t in enumerate(self.tables):
            out += t[binned(x[:, j], self.edges[j])]
        for (a, b), t in self.pairs.items():
            out += t[binned(x[:, a], self.coarse[a]), binned(x[:, b], self.coarse[b])]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.margin(x))


def gain(g: np.ndarray, h: np.ndarray, ridge: float) -> np.ndarray:
    return g * g / (h + ridge)


def tree(g: np.ndarray, h: np.ndarray, n: np.ndarray, leaves: int, least: int, ridge: float) -> np.ndarray:
    """Values by bin of a tree over ordered bins: the cut of most gain first, until there are so many leaves."""
    ends = [0, len(g)]
    cg, ch, cn = (np.concatenate([[0], np.cumsum(x)]) for x in (g, h, n))
    while len(ends) <= leaves:
        best = (1e-9, 0)
        for lo, hi in zip(ends, ends[1:], strict=False):
            mid = np.arange(lo + 1, hi)
            mid = mid[(cn[mid] - cn[lo] >= least) & (cn[hi] - cn[mid] >= least)]
            if len(mid):
                x = gain(cg[mid] - cg[lo], ch[mid] - ch[lo], ridge) + gain(cg[hi] - cg[mid], ch[hi] - ch[mid], ridge) - gain(cg[hi] - cg[lo], ch[hi] - ch[lo], ridge)
                best = max(best, (float(x.max()), int(mid[x.argmax()])))
        if not best[1]:
            break
        ends = sorted({*ends, best[1]})
    out = np.zeros(len(g))
    for lo, hi in zip(ends, ends[1:], strict=False):
        out[lo:hi] = (cg[hi] - cg[lo]) / (ch[hi] - ch[lo] + ridge)
    return out


def quarters(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """The best cut in both directions of a table of gradients: its gain and its values."""
    cg, ch = (np.pad(x.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for x in (g, h))
    best = (0.0, 1, 1)
    for i in range(1, len(g)):
        for j in range(1, g.shape[1]):
            x = sum(gain(a, b, ridge) for a, b in zip(_corners(cg, i, j), _corners(ch, i, j), strict=True))
            best = max(best, (float(x), i, j))
    total, i, j = best
    values = np.array([a / (b + ridge) for a, b in zip(_corners(cg, i, j), _corners(ch, i, j), strict=True)])
    out = np.zeros(g.shape)
    out[:i, :j], out[:i, j:], out[i:, :j], out[i:, j:] = values
    return total - float(gain(cg[-1, -1], ch[-1, -1], ridge)), out


def _corners(c: np.ndarray, i: int, j: int) -> tuple:
    return c[i, j], c[i, -1] - c[i, j], c[-1, j] - c[i, j], c[-1, -1] - c[i, -1] - c[-1, j] + c[i, j]


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 120, pair_rounds: int = 40, pairs: int = 6, step: float = 0.1, leaves: int = 4, ridge: float = 2.0) -> Additive:
    """Boost the measures in turn, then the pairs."""
    if not len(y):
        return Additive()
    p0 = (y.sum() + 0.5) / (len(y) + 1)
    m = Additive(float(np.log(p0 / (1 - p0))))
    if y.min() == y.max():
        return m
    many = x.shape[1]
    m.edges = [cuts(x[:, j], BINS) for j in range(many)]
    at = [binned(x[:, j], e) for j, e in enumerate(m.edges)]
    m.tables = [np.zeros(len(e) + 1) for e in m.edges]
    out, least = np.full(len(y), m.intercept), max(2, len(y) // 200)
    count = [np.bincount(b, minlength=len(t)) for b, t in zip(at, m.tables, strict=True)]
    for _ in range(rounds):
        for j, t in enumerate(m.tables):
            p = sigmoid(out)
            move = step * tree(np.bincount(at[j], y - p, len(t)), np.bincount(at[j], p * (1 - p), len(t)), count[j], leaves, least, ridge)
            t += move
            out += move[at[j]]
    m.coarse = [cuts(x[:, j], COARSE) for j in range(many)]
    small = [binned(x[:, j], e) for j, e in enumerate(m.coarse)]

    def grads(a: int, b: int, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        shape = (len(m.coarse[a]) + 1, len(m.coarse[b]) + 1)
        key, cells = small[a] * shape[1] + small[b], shape[0] * shape[1]
        return np.bincount(key, y - p, cells).reshape(shape), np.bincount(key, p * (1 - p), cells).reshape(shape)

    p = sigmoid(out)
    able = [j for j in range(many) if len(m.coarse[j])]
    found = sorted(((quarters(*grads(a, b, p), ridge)[0], -a, -b) for a, b in combinations(able, 2)), reverse=True)[:pairs]
    m.pairs = {(-a, -b): np.zeros((len(m.coarse[-a]) + 1, len(m.coarse[-b]) + 1)) for _, a, b in found}
    for _ in range(pair_rounds):
        for (a, b), t in m.pairs.items():
            move = step * quarters(*grads(a, b, sigmoid(out)), ridge)[1]
            t += move
            out += move[small[a], small[b]]
    return m


def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [measures(t.as_py()) for t in b.column(1)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(rows, pa.list_(pa.float64()))], names=["i", "y", "x"])


def learn(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, sample: int, folds: int, held: int) -> Additive:
    """Fit on the sample of labelled rows outside the held-out fold. At most 2 x ``sample`` ids are broadcast, and as many rows of measures come back."""
    marks = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("i")).agg((F.min("quality") > 0).cast("int").alias("y"))
    chosen = sampled(marks.where(bucket10("i", folds) != held), sample, "i").collect()
    if not chosen:
        return fit(np.zeros((0, len(MEASURES))), np.zeros(0))
    ids = docs.sparkSession.createDataFrame([(r.i, r.y) for r in chosen], "i long, y int")
    rows = docs.select(F.col(id_col).cast("long").alias("i"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.join(F.broadcast(ids), "i").groupBy("i").agg(F.min("text").alias("text"), F.min("y").alias("y"))
    got = sorted(mapped(rows.select("i", "text", "y"), measured, "i long, y int, x array<double>").collect())
    return fit(np.array([r.x for r in got], float).reshape(-1, len(MEASURES)), np.array([r.y for r in got], float))


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = 6000, threshold: float = 0.3, folds: int = 5, held: int = 0) -> DataFrame:
    """Probability of label 1 for each document, and whether it reaches the threshold."""
    m = learn(docs, labels, id_col, text_col, sample, folds, held)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([measures(t.as_py() or "") for t in b.column(1)]).reshape(-1, len(MEASURES))
            ids, score = b.column(0), m.score(x)
            out = [i is not None and crc32(str(i).encode()) % folds == held for i in ids.to_pylist()]
            yield pa.RecordBatch.from_arrays([ids, pa.array(out, pa.bool_()), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return mapped(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), each, SCHEMA)


def op12_additive_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
