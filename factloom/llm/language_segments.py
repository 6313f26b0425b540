"""Language ID by segmentation-marginalised unigrams.

Each language has probabilities of the pieces of a fixed public vocabulary. A word's probability is the sum over all its
segmentations into pieces of their products, by a forward recursion; a text's words are independent given the language.
Pieces never reach across words, so a word is a lower-cased run of letters behind the vocabulary's word mark, and the
words' sum is the text's. A character that no piece has counts as one unknown piece.

Training (expectation-maximisation of the same sum): for each language, words of a bounded random sample of rows (about
``sample`` rows, chosen by hash of id against the language's number of rows), counted; each round's expected uses are
summed over partitions, and the result is one number per piece and language, so the model grows with the number of languages only. Rows whose
crc32(id) mod 4 is 2 are held out; lang, source and id are never inputs of a prediction.

Defined results: a null text or one without a letter is ``und`` with score 0; so is every text if nothing was learned; a null
id comes back null; ties go to the language first in order; repeated rows are scored each; very long texts are scored whole, in portions; very
long words too, with sums scaled; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import gc
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import bucket10, filtered, mapped, table
from factloom.session import Scratch

VOCABULARY = "piece_bpe_32k.model"
LETTERS = re.compile(r"[^\W\d_]+")
MARK = "▁"
KEPT = 72_000_000  # bytes, about, of words and their scores that a worker remembers
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"


def words_of(text: str | None) -> list[str]:
    """Runs of letters (by str.isalpha) of the lower-cased text. The pattern also takes numbers that aren't decimal digits, such as fractions, so runs that hold some are cut there."""
    out = LETTERS.findall(text.lower()) if text else []
    if out and not "".join(out).isalpha():
        out = [p for w in out for p in "".join(c if c.isalpha() else " " for c in w).split()]
    return out


@lru_cache(2)
def pieces(path: str) -> dict[str, int]:
    """Pieces of letters, with or without the word mark, by id."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    return {s: i for i in range(p.get_piece_size()) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i)) and LETTERS.fullmatch((s := p.id_to_piece(i)).removeprefix(MARK) or "a")}


def spans(word: str, index: dict[str, int], longest: int) -> list[tuple[int, int, int]]:
    """(from, to, piece) of all pieces in a marked word; unknown characters as piece -1."""
    n, out = len(word), []
    for i in range(n):
        some = False
        for j in range(i + 1, min(n, i + longest) + 1):
            k = index.get(word[i:j])
            if k is not None:
                out.append((i, j, k))
                some |= j == i + 1
        if not some:
            out.append((i, i + 1, -1))
    return out


def log_words(words: list[str], index: dict[str, int], longest: int, p: np.ndarray) -> np.ndarray:
    """Log probability of each word (rows) in each language (columns). The last row of p is the unknown piece's."""
    out = np.zeros((len(words), p.shape[1]))
    by_size = defaultdict(list)
    for i, w in enumerate(words):
        by_size[len(w)].append(i)
    get = index.get
    for n, at in by_size.items():
        for lo in range(0, len(at), max(1, 20_000 // (n + 1))):
            own = at[lo : lo + max(1, 20_000 // (n + 1))]
            some = [words[i] for i in own]
            alpha = np.zeros((n + 2, len(own), p.shape[1]))
            alpha[0] = 1
            shift = np.zeros((len(own), p.shape[1]))
            ring: list[np.ndarray] = [alpha[0]]
            for j in range(1, n + 2):
                now = np.zeros((len(own), p.shape[1]))
                for i in range(max(0, j - longest), j):
                    ids = np.fromiter([get(MARK + w[: j - 1] if i == 0 else w[i - 1 : j - 1], -1) for w in some], np.int64, len(own))
                    if i == j - 1:
                        now += ring[i - j] * p[ids]
                    else:
                        hit = np.flatnonzero(ids >= 0)
                        if len(hit):
                            now[hit] += ring[i - j][hit] * p[ids[hit]]
                ring.append(now)
                if len(ring) > longest:
                    ring.pop(0)
                if j % 16 == 0:
                    s = np.maximum(now, 1e-300)
                    shift += np.log(s)
                    ring = [x / s for x in ring]
            out[own] = shift + np.log(np.maximum(ring[-1], 1e-300))
    return out


def piece_uses(lattice: list[tuple[int, int, int]], n: int, q: list[float]) -> Iterator[tuple[int, float]]:
    """Expected uses of pieces over all segmentations of a word of n characters, its mark counted; in logs if it is too long for plain sums."""
    fwd, bwd = [0.0] * (n + 1), [0.0] * (n + 1)
    fwd[0] = bwd[n] = 1.0
    if n <= 60:  # no piece is under 1e-5 by much, so nothing underflows
        for i, j, x in lattice:
            fwd[j] += fwd[i] * q[x]
        for i, j, x in reversed(lattice):
            bwd[i] += bwd[j] * q[x]
        if fwd[n] > 1e-280:
            yield from ((x, fwd[i] * q[x] * bwd[j] / fwd[n]) for i, j, x in lattice)
            return
    # Scaled by place: a[i] is the sum up to i divided by exp(s[i]).
    lf, lb, logs = [-np.inf] * (n + 1), [-np.inf] * (n + 1), [(i, j, x, np.log(q[x])) for i, j, x in lattice]
    lf[0] = lb[n] = 0.0
    for i, j, _, w in logs:
        lf[j] = np.logaddexp(lf[j], lf[i] + w)
    for i, j, _, w in reversed(logs):
        lb[i] = np.logaddexp(lb[i], lb[j] + w)
    yield from ((x, float(np.exp(lf[i] + w + lb[j] - lf[n]))) for i, j, x, w in logs)


def expected(path: str, langs: list[str], p: np.ndarray):
    """Expected uses of each piece, of a partition's (lang, word, n), by forward and backward sums over segmentations."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = pieces(path)
        longest = max(map(len, index))
        seen: list[dict[int, float]] = [defaultdict(float) for _ in langs]
        own = [p[:, k].tolist() for k in range(len(langs))]
        for b in batches:
            for lang, word, count in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                k = langs.index(lang)
                for x, v in piece_uses(spans(MARK + word, index, longest), len(word) + 1, own[k]):
                    seen[k][x] += count * v
        rows = [(k, x, v) for k, uses in enumerate(seen) for x, v in uses.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.float64()))], names=["lang", "piece", "v"])

    return each


def learn(docs: DataFrame, id_col: str, text_col: str, lang_col: str, path: str, sample: int, rounds: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, log priors, piece probabilities (pieces and the unknown one x languages)."""
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), F.xxhash64(F.col(id_col).cast("string"), F.lit("lang")).alias("h"), bucket10(id_col, 4).alias("fold")).where("fold != 2 and lang is not null and text is not null")
    n = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(n)
    if not langs:
        return [], np.zeros(0), np.zeros((1, 0))
    share = F.create_map(*[F.lit(x) for k, v in n.items() for x in (k, min(1 << 20, -(-(sample << 20) // v)))])
    chosen = rows.where(F.pmod("h", F.lit(1 << 20)) < share[F.col("lang")]).select("lang", "text")

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c: dict[str, Counter] = defaultdict(Counter)
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                c[lang].update(words_of(text))
            for lang, own in c.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own), pa.string()), pa.array(list(own), pa.string()), pa.array(list(own.values()), pa.int64())], names=["lang", "word", "n"])

    counted = Scratch(docs.sparkSession, "language").keep(mapped(chosen, words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")))
    p = np.full((1 + max(pieces(path).values()) + 1, len(langs)), 1e-4)
    for _ in range(rounds):
        new = np.full_like(p, 1e-3)
        for r in mapped(counted, expected(path, langs, p), "lang int, piece int, v double").groupBy("lang", "piece").agg(F.sum("v").alias("v")).collect():
            new[r.piece, r.lang] += r.v
        p = new / new.sum(0)
    return langs, np.log(np.array([n[x] for x in langs]) / sum(n.values())), p


def scorer(langs: list[str], prior: np.ndarray, p: np.ndarray, path: str):
    """Texts of a batch to (language, score)."""
    index = pieces(path)
    longest = max(map(len, index))
    at: dict[str, int] = {}
    logs = np.zeros((0, len(langs)))

    def score(texts: list[str | None]) -> list[tuple[str, float]]:
        nonlocal logs
        split = [words_of(t) for t in texts]
        new = list(set().union(*split).difference(at))
        if (len(at) + len(new)) * (180 + 8 * len(langs)) > KEPT:
            at.clear()
            logs = np.zeros((0, len(langs)))
            new = list(set().union(*split))
        if new and langs:
            at.update(zip(new, range(len(logs), len(logs) + len(new)), strict=True))
            logs = np.concatenate([logs, log_words(new, index, longest, p)])
        out = []
        for ws in split:
            if not ws or not langs:
                out.append(("und", 0.0))
                continue
            x = logs[np.fromiter(map(at.__getitem__, ws), np.int64, len(ws))].sum(0) + prior
            q = np.exp(x - x.max())
            k = int(x.argmax())
            out.append((langs[k], float(q[k] / q.sum())))
        return out

    return score


def portions(texts: pa.Array, most: int = 1_000_000) -> Iterator[list[str | None]]:
    own: list[str | None] = []
    size = 0
    for x in texts:
        t = x.as_py()
        own.append(t)
        size += len(t or "")
        if size >= most:
            yield own
            own, size = [], 0
    if own:
        yield own


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", path: str | None = None, sample: int = 400, rounds: int = 3) -> DataFrame:
    """Predicted language of each text, with its posterior probability."""
    path = path or public_tokenizers.path(VOCABULARY)
    model = learn(docs, id_col, text_col, lang_col, path, sample, rounds)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer(*model, path)
        gc.disable()  # what is remembered is no garbage
        for b in batches:
            out = [x for own in portions(b.column(2)) for x in score(own)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x for x, _ in out], pa.string()), pa.array([x for _, x in out], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return mapped(docs.select(F.col(id_col).cast("long").alias("doc_id"), (bucket10(id_col, 4) == 2).alias("held_out"), F.col(text_col).cast("string").alias("text")), each, SCHEMA)


def keep_known_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", path: str | None = None, sample: int = 400, rounds: int = 3, least: float = 0.5) -> DataFrame:
    """The rows whose text has a language with at least so much posterior probability; rows without a letter go. If no language could be
    learned, every row with a letter stays."""
    path = path or public_tokenizers.path(VOCABULARY)
    model = learn(docs, id_col, text_col, lang_col, path, sample, rounds)

    def keep(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        score = scorer(*model, path)
        gc.disable()  # what is remembered is no garbage
        for b in batches:
            if model[0]:
                yield pa.array([lang != "und" and x >= least for own in portions(b) for lang, x in score(own)], pa.bool_())
            else:
                yield pa.array([bool(words_of(t.as_py())) for t in b], pa.bool_())

    return filtered(docs, text_col, keep)


def op9_language_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
