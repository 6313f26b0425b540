"""LM scoring by a hidden Markov language model.

A text is its tokens (words between white space, A-Z lower-cased) and one end token. Words fall into a fixed
number of hash classes; a hidden state emits a class, a class emits a word by its smoothed training count:

    P(text) = sum over state paths of prod A[s', s] * B[s, class(w)] * (c(w) + 0.1) / (N_class + 0.1 * (V_class + 1))

so every text, unseen words included, has a proper probability. The end token is a class of its own.

Plan: one pass cuts the corpus into chunks of token ids (written to the shared folder) and hash-partitioned
vocabularies; counts of words meet per hash bucket and come back to the chunks that hold the word; Baum-Welch
expected counts are vectors of fixed length, summed over partitions by Spark. Word counts grow with the corpus
and never reach the driver; the model (states x classes) is bounded and is broadcast in the closures.

Defined results: null text is the empty text (one end token); a null id is hashed as empty text and comes back
null; repeated rows are scored (and counted) each; very long texts are scored whole; an empty table gives an empty result; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import count
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import bucket10, mapped, table
from factloom.session import Scratch, ship

CLASSES = 4096  # word classes; class CLASSES is the end token
COARSE = 128  # coarser classes of the matrix that initialises training
CHUNK = 24_000_000  # bytes of text in a chunk
SCHEMA = "kind int, chunk string, bucket int, a binary, b binary, c binary, d binary, e binary"
OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


@dataclass
class Model:
    start: np.ndarray  # K
    move: np.ndarray  # K x K
    emit: np.ndarray  # K x (CLASSES + 1)


def packed(x: np.ndarray) -> bytes:
    return zstandard.compress(x.tobytes(), 1)


def unpacked(b: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(b), kind)


def chunked(buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Texts to chunk rows (kind 0: ids, lengths, doc ids, flags, word classes) and vocabulary rows (kind 1)."""

    def rows(part: int, k: int, vocab: dict, ids: list, lens: list, docs: list, held: list) -> pa.RecordBatch:
        name = f"{part}-{k}"
        words = list(vocab)
        every = np.concatenate(ids) if ids else np.zeros(0, np.int32)
        lens, held = np.array(lens, np.int32), np.array(held, bool)
        n = np.bincount(every[np.repeat(~held, lens)], minlength=len(words)).astype(np.int64)
        code = np.fromiter(map(crc32, words), np.int64, len(words))
        where = (code >> 12) % buckets
        flags = held + 2 * np.array([d is None for d in docs])
        out = [(0, name, -1, packed(every), packed(lens), packed(np.array([d or 0 for d in docs], np.int64)), packed(flags.astype(np.int8)), packed((code % CLASSES).astype(np.uint16)))]
        order = np.argsort(where, kind="stable")
        there, cuts = np.unique(where[order], return_index=True)
        for b, own in zip(there.tolist(), np.split(order, cuts[1:]), strict=False):
            if len(own):
                out.append((1, name, b, zstandard.compress(b" ".join([words[i] for i in own]), 1), packed(n[own].astype(np.int32)), packed(own.astype(np.int32)), None, None))
        return pa.RecordBatch.from_pylist([dict(zip(("kind", "chunk", "bucket", "a", "b", "c", "d", "e"), r, strict=True)) for r in out], schema=pa.schema([("kind", pa.int32()), ("chunk", pa.string()), ("bucket", pa.int32()), *((x, pa.binary()) for x in "abcde")]))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k = TaskContext.get().partitionId(), 0
        fresh = lambda: (defaultdict(count().__next__), [], [], [], [])
        vocab, ids, lens, docs, held = fresh()
        size = 0
        for batch in batches:
            for doc, text, out in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                raw = (text or "").encode().lower()
                words = raw.split()
                ids.append(np.fromiter(map(vocab.__getitem__, words), np.int32, len(words)))
                lens.append(len(words))
                docs.append(doc)
                held.append(out)
                size += len(raw)
                if size >= CHUNK:
                    yield rows(part, k, vocab, ids, lens, docs, held)
                    vocab, ids, lens, docs, held = fresh()
                    size, k = 0, k + 1
        if docs:
            yield rows(part, k, vocab, ids, lens, docs, held)

    return each


def merged(group: pd.DataFrame) -> pd.DataFrame:
    """One hash bucket of all chunks' vocabularies: the corpus count of every word, back to each chunk that has it."""
    total: dict[bytes, int] = defaultdict(int)
    held = []
    for r in group.itertuples():
        words = zstandard.decompress(r.a).split(b" ")
        n = unpacked(r.b, np.int32)
        for w, x in zip(words, n.tolist(), strict=True):
            total[w] += x
        held.append((r.chunk, words, r.c))
    known = [(crc32(w) % CLASSES, n) for w, n in total.items() if n]
    k = np.array([x for x, _ in known], np.int64)
    by_n = np.bincount(k, weights=np.array([n for _, n in known], float), minlength=CLASSES)
    by_v = np.bincount(k, minlength=CLASSES).astype(float)
    out = [(chunk, None, at, packed(np.fromiter(map(total.__getitem__, words), np.int64, len(words))), None) for chunk, words, at in held]
    out.append((None, np.concatenate([by_n, by_v]), None, None, None))
    return pd.DataFrame(out, columns=["chunk", "sums", "at", "counts", "none"]).drop(columns="none")


def summed(chunks: DataFrame, vector: Callable[[np.ndarray, np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """Sum over all training sequences of a vector of fixed size; each partition adds up its own chunks first."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, some = np.zeros(size), False
        for batch in batches:
            for r in batch.to_pylist():
                classes, lens, flags = sequences(r)
                train = (flags & 1) == 0
                for obs, ls in portions(classes[np.repeat(train, lens)], lens[train]):
                    total += vector(obs, ls)
                    some = True
        if some:
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["v"])

    rows = mapped(chunks.select("a", "b", "d", "e"), each, "v array<double>").select(F.posexplode("v").alias("pos", "v")).groupBy("pos").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(size)
    for r in rows:
        out[r.pos] = r.v
    return out


def sequences(r: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a chunk row: classes with the end token put in, lengths (end counted), flags."""
    ids, lens = unpacked(r["a"], np.int32), unpacked(r["b"], np.int32)
    of = unpacked(r["e"], np.uint16)
    return np.insert((of[ids] if len(ids) else np.zeros(0, np.uint16)), np.cumsum(lens), CLASSES), lens + 1, unpacked(r["d"], np.int8)


def portions(obs: np.ndarray, lens: np.ndarray, most: int = 300_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Runs of whole sequences with about so many tokens, to bound memory."""
    ends = np.cumsum(lens)
    at = 0
    while at < len(lens):
        low = ends[at] - lens[at]
        to = max(at + 1, int(np.searchsorted(ends, low + most, "right")))
        yield obs[low : ends[to - 1]], lens[at:to]
        at = to


def time_major(lens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place of each token when all first tokens stand first, then all second ones; running counts; rank of each token's sequence."""
    order = np.argsort(-lens, kind="stable")
    rank = np.empty(len(lens), np.int64)
    rank[order] = np.arange(len(lens))
    active = len(lens) - np.searchsorted(np.sort(lens), np.arange(int(lens.max(initial=0))), "right")
    start = np.concatenate([[0], np.cumsum(active)])
    t = np.arange(int(lens.sum())) - np.repeat(np.cumsum(lens) - lens, lens)
    each = np.repeat(rank, lens)
    return start[t] + each, start, each


def forward(m: Model, obs: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, tuple]:
    """Scaled forward recursion: natural log likelihood of each sequence, and what backward needs."""
    place, start, each = time_major(lens)
    p = np.empty(len(obs), np.int64)
    p[place] = obs
    b = m.emit.T[p]
    alpha, scale = np.empty_like(b), np.empty(len(obs))
    for t in range(len(start) - 1):
        lo, hi = start[t], start[t + 1]
        a = (m.start if t == 0 else alpha[start[t - 1] : start[t - 1] + hi - lo] @ m.move) * b[lo:hi]
        s = a.sum(1)
        scale[lo:hi] = s
        np.divide(a, s[:, None], out=alpha[lo:hi])
    return np.bincount(each, weights=np.log(scale)[place], minlength=len(lens))[np.argsort(np.argsort(-lens, kind="stable"))], (p, b, alpha, scale, start)


def expected(m: Model) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Baum-Welch counts of a batch of sequences: starts, moves, emissions, log likelihood, in one vector."""
    k, width = m.emit.shape

    def vector(obs: np.ndarray, lens: np.ndarray) -> np.ndarray:
        like, (p, b, alpha, scale, start) = forward(m, obs, lens)
        beta = np.ones_like(alpha)
        moves = np.zeros((k, k))
        for t in range(len(start) - 3, -1, -1):
            lo, n = start[t], start[t + 2] - start[t + 1]
            w = b[start[t + 1] : start[t + 2]] * beta[start[t + 1] : start[t + 2]] / scale[start[t + 1] : start[t + 2], None]
            moves += alpha[lo : lo + n].T @ w
            beta[lo : lo + n] = w @ m.move.T
        gamma = alpha * beta
        emits = np.stack([np.bincount(p, weights=gamma[:, s], minlength=width) for s in range(k)])
        return np.concatenate([gamma[: len(lens)].sum(0), (moves * m.move).ravel(), emits.ravel(), [like.sum()]])

    return vector


def bigrams(obs: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Counts of neighbouring coarse classes; the end token is one more."""
    c = np.where(obs == CLASSES, COARSE, obs % COARSE).astype(np.int64)
    inside = np.ones(len(c), bool)
    inside[np.cumsum(lens) - 1] = False
    at = np.flatnonzero(inside)
    return np.bincount(c[at] * (COARSE + 1) + c[at + 1], minlength=(COARSE + 1) ** 2).astype(float)


def initial(pairs: np.ndarray, n: np.ndarray, k: int, rounds: int = 60) -> Model:
    """A first model from the corpus's bigram matrix: expectation-maximisation of P(i, j) = sum p[s] B[s, i] A[s, r] B[r, j]."""
    g = np.random.default_rng(7)
    pairs = pairs.reshape(COARSE + 1, COARSE + 1) + 1e-6
    marginal = (pairs.sum(0) + pairs.sum(1)) / (2 * pairs.sum())
    b = marginal * g.uniform(0.5, 1.5, (k, COARSE + 1))
    b /= b.sum(1, keepdims=True)
    joint = np.full((k, k), 0.1 / k) + np.eye(k)
    joint /= joint.sum()
    for _ in range(rounds):
        ratio = pairs / (b.T @ joint @ b)
        r = joint * (b @ ratio @ b.T)
        left = b * (joint @ b @ ratio.T)
        right = b * (joint.T @ b @ ratio)
        b = left + right + 1e-9 * marginal
        b /= b.sum(1, keepdims=True)
        joint = r / r.sum()
    share = np.append(n + 0.5, 1.0)
    coarse = np.append(np.arange(CLASSES) % COARSE, COARSE)
    share /= np.bincount(coarse, weights=share)[coarse]
    move = joint / joint.sum(1, keepdims=True)
    return normalised(joint.sum(1), move, b[:, coarse] * share * 1e6, n)


def normalised(start: np.ndarray, moves: np.ndarray, emits: np.ndarray, n: np.ndarray) -> Model:
    """Probabilities from counts, with a little of the corpus's own class shares in each state."""
    k = len(start)
    share = np.append(n + 0.5, n.sum() / 200 + 1.0)
    share /= share.sum()
    emit = emits + 10.0 * share
    return Model((start + 1e-3) / (start + 1e-3).sum(), (moves + 1e-3) / (moves + 1e-3).sum(1, keepdims=True), emit / emit.sum(1, keepdims=True)) if k else Model(start, moves, emits)


def scored(m: Model, n_class: np.ndarray, v_class: np.ndarray, n_docs: int) -> Callable[..., pd.DataFrame]:
    known_end = n_docs
    n, v = n_class.sum() + n_docs, v_class.sum() + (n_docs > 0)
    whole = np.log10(n + 0.1 * (v + 1))
    within = np.log10(n_class + 0.1 * (v_class + 1))
    end = np.log10(known_end + 0.1) - whole

    def each(key: tuple, chunk: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in chunk.to_dict("records"):
            ids, lens = unpacked(r["a"], np.int32), unpacked(r["b"], np.int32)
            docs, of = unpacked(r["c"], np.int64), unpacked(r["e"], np.uint16)
            c = np.zeros(len(of), np.int64)
            for at, x in zip(replies["at"], replies["counts"], strict=True):
                c[unpacked(at, np.int32)] = unpacked(x, np.int64)
            logs = np.log10(c + 0.1)
            cls, ls, flags = sequences(r)
            doc = np.repeat(np.arange(len(lens)), lens)
            sums = lambda x: np.bincount(doc, weights=x[ids], minlength=len(lens)) if len(ids) else np.zeros(len(lens))
            like = np.concatenate([forward(m, o, x)[0] for o, x in portions(cls, ls)]) if len(lens) else np.zeros(0)
            out.append(pd.DataFrame({"doc_id": pd.array(docs, "Int64"), "held_out": (flags & 1) == 1, "n_tokens": ls.astype(np.int64), "n_known": (sums((c > 0).astype(float)) + (n_docs > 0)).astype(np.int64), "train_tokens": np.int64(n), "base_score": sums(logs - whole) + end, "score": like / np.log(10) + sums(logs - within[of])}))
            out[-1].loc[(flags & 2) == 2, "doc_id"] = pd.NA
        return pd.concat(out) if out else pd.DataFrame(columns=[x.split()[0] for x in OUT.split(", ")])

    return each


def hmm_score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", states: int = 8, rounds: int = 2) -> DataFrame:
    """Score every text; learn from rows whose crc32(id) mod 10 is not 0. ``rounds``: Baum-Welch rounds over all training rows."""
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark, "hmm")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), (bucket10(id_col, 10) == 0).alias("held"))
    buckets = max(12, 2 * rows.rdd.getNumPartitions())
    kept = scratch.keep(mapped(rows, chunked(buckets), SCHEMA), "kind")
    chunks = kept.where("kind = 0").select("chunk", "a", "b", "c", "d", "e")
    replies = scratch.keep(kept.where("kind = 1").select("chunk", "bucket", "a", "b", "c").groupBy("bucket").applyInPandas(merged, "chunk string, sums array<double>, at binary, counts binary"))
    sums = np.zeros(2 * CLASSES)
    for r in replies.where("sums is not null").select(F.posexplode("sums").alias("pos", "v")).groupBy("pos").agg(F.sum("v").alias("v")).collect():
        sums[r.pos] = r.v
    n_class, v_class = sums[:CLASSES], sums[CLASSES:]
    n_docs = rows.where("not held").count()
    if n_docs:
        model = initial(summed(chunks, bigrams, (COARSE + 1) ** 2), n_class, states)
        for _ in range(rounds):
            x = summed(chunks, expected(model), states + states * states + states * (CLASSES + 1) + 1)
            model = normalised(x[:states], x[states : states + states * states].reshape(states, states), x[states + states * states : -1].reshape(states, -1), n_class)
    else:
        model = normalised(np.ones(states), np.ones((states, states)), np.zeros((states, CLASSES + 1)), n_class)
    back = replies.where("chunk is not null").select("chunk", "at", "counts")
    return chunks.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInPandas(scored(model, n_class, v_class, n_docs), OUT)


def op1_hmm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm_score(table(spark, sf_dir, "documents"))
