"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

Each match of the split pattern is merged on its own: a bucket per merge rank holds positions of a linked list of
byte spans, a bitmap of 256-bit words with a summary word above marks the buckets that have entries, find-first-set
picks the lowest rank, and entries whose pair has changed since are skipped. Within a rank the leftmost position
goes first, so ids equal those of the usual merge loop; a piece of n bytes takes O(n log n), however long.

Defined results: a null text is the empty text (no ids); a null id comes back null; repeated rows are encoded each;
an empty table gives an empty result; other columns are ignored. Vocabulary files are read on each worker by path.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from hashlib import sha256
from heapq import heappop, heappush
from itertools import islice

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import mapped, table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
KEPT, WORDS = 1_000_000, 300_000  # pieces, and words with what stands on them, that a worker remembers
SHORT = 64  # bytes of a piece up to which positions fit a bitmap of one word
APART = re.compile(r" \s|\s ")  # a space beside other white space
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class RankQueue:
    """Positions by rank; pop gives the leftmost position of the lowest rank."""

    __slots__ = ("buckets", "words", "top")

    def __init__(self) -> None:
        self.buckets: dict[int, list[int]] = {}
        self.words: dict[int, int] = {}
        self.top = 0

    def push(self, rank: int, at: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket:
            heappush(bucket, at)
            return
        self.buckets[rank] = [at]
        hi = rank >> 8
        word = self.words.get(hi, 0)
        if not word:
            self.top |= 1 << hi
        self.words[hi] = word | 1 << (rank & 255)

    def pop(self) -> tuple[int, int]:
        top = self.top
        hi = (top & -top).bit_length() - 1
        word = self.words[hi]
        bit = word & -word
        rank = hi << 8 | bit.bit_length() - 1
        bucket = self.buckets[rank]
        at = heappop(bucket)
        if not bucket:
            self.words[hi] = word = word ^ bit
            if not word:
                self.top = top ^ (1 << hi)
        return rank, at


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    return (merge_short if len(piece) <= SHORT else merge_long)(piece, ranks.get)


def merge_short(piece: bytes, get: Callable[[bytes], int | None]) -> list[int]:
    """The queue in local variables: a bucket is a bitmap of positions, the list of live positions one too."""
    n = len(piece)
    top, words, buckets = 0, {}, {}
    now = [get(piece[i : i + 2]) for i in range(n - 1)]
    now.append(None)
    bit = 1
    for r in now:
        if r is not None:
            if r in buckets:
                buckets[r] |= bit
            else:
                buckets[r] = bit
                hi = r >> 8
                if hi in words:
                    words[hi] |= 1 << (r & 255)
                else:
                    words[hi] = 1 << (r & 255)
                    top |= 1 << hi
        bit += bit
    after = list(range(1, n + 2))
    live = bit - 1
    while top:
        hi = (top & -top).bit_length() - 1
        word = words[hi]
        low = word & -word
        rank = hi << 8 | low.bit_length() - 1
        places = buckets[rank]
        here = places & -places
        if places == here:
            del buckets[rank]
            if word == low:
                del words[hi]
                top ^= 1 << hi
            else:
                words[hi] = word ^ low
        else:
            buckets[rank] = places ^ here
        i = here.bit_length() - 1
        if now[i] != rank:
            continue
        j = after[i]
        after[i] = end = after[j]
        now[j] = None
        live ^= 1 << j
        if end < n:
            now[i] = r = get(piece[i : after[end]])
            if r is not None:
                if r in buckets:
                    buckets[r] |= here
                else:
                    buckets[r] = here
                    hi = r >> 8
                    if hi in words:
                        words[hi] |= 1 << (r & 255)
                    else:
                        words[hi] = 1 << (r & 255)
                        top |= 1 << hi
        else:
            now[i] = None
        k = (live & (here - 1)).bit_length() - 1
        if k >= 0:
            r = get(piece[k:end])
            if r != now[k]:
                now[k] = r
                if r is not None:
                    if r in buckets:
                        buckets[r] |= 1 << k
                    else:
                        buckets[r] = 1 << k
                        hi = r >> 8
                        if hi in words:
                            words[hi] |= 1 << (r & 255)
                        else:
                            words[hi] = 1 << (r & 255)
                            top |= 1 << hi
    out, i = [], 0
    while i < n:
        j = after[i]
        out.append(get(piece[i:j]))
        i = j
    return out


def merge_long(piece: bytes, get: Callable[[bytes], int | None]) -> list[int]:
    """The queue with a heap of positions in each bucket and a doubly linked list: no step grows with the piece but the heap's."""
    n = len(piece)
    after, before = list(range(1, n + 2)), list(range(-1, n))
    now: list[int | None] = [None] * n
    queue = RankQueue()
    push = queue.push
    for i in range(n - 1):
        r = get(piece[i : i + 2])
        if r is not None:
            now[i] = r
            push(r, i)
    while queue.top:
        r, i = queue.pop()
        if now[i] != r:
            continue
        j = after[i]
        end = after[j]
        after[i] = end
        now[j] = None
        if end < n:
            before[end] = i
            x = now[i] = get(piece[i : after[end]])
            if x is not None:
                push(x, i)
        else:
            now[i] = None
        k = before[i]
        if k >= 0:
            x = get(piece[k:end])
            if x != now[k]:
                now[k] = x
                if x is not None:
                    push(x, k)
    out, i = [], 0
    while i < n:
        out.append(get(piece[i : after[i]]))
        i = after[i]
    return out


class Codec:
    """Encoder and decoder of one vocabulary; remembers the ids of short pieces."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pieces = [b""] * (1 + max(self.ranks.values()))
        for k, v in self.ranks.items():
            self.pieces[v] = k
        self.split = regex.compile(public_tokenizers.PATTERN)
        ranks = self.ranks

        class Known(dict):
            def __missing__(self, piece: str) -> bytes:
                ids = np.array(merge(piece.encode(), ranks), "<u4").tobytes()
                if len(piece) < 64:
                    if len(self) >= KEPT:
                        self.clear()
                    self[piece] = ids
                return ids

        self.known = known = Known()
        find = self.split.findall

        class Words(dict):
            """Ids of a space and what stands up to the next: no match of the pattern crosses such a place."""

            def __missing__(self, word: str) -> bytes:
                ids = b"".join(map(known.__getitem__, find(f" {word}")))
                if len(word) < 64:
                    if len(self) >= WORDS:
                        self.clear()
                    self[word] = ids
                return ids

        self.words = Words()

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        first, *rest = text.split(" ")
        if first and (not rest or rest[-1]) and not APART.search(text):
            return self.whole(first) + b"".join(map(self.words.__getitem__, rest))
        return self.whole(text)

    def whole(self, text: str) -> bytes:
        get = self.known.__getitem__
        if len(text) < 1_000_000:
            return b"".join(map(get, self.split.findall(text)))
        it = (m[0] for m in self.split.finditer(text))
        parts = []
        while some := b"".join(map(get, islice(it, 100_000))):
            parts.append(some)
        return b"".join(parts)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.pieces.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(4)
def codec(path: str) -> Codec:
    return Codec(path)


def bpe_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Encode each text and decode its ids: number of ids and digests of both."""
    path = path or public_tokenizers.path(VOCABULARY)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            n, x, y = [], [], []
            for text in b.column(1):
                ids = c.encode(text.as_py() or "")
                n.append(len(ids) // 4)
                x.append(sha256(ids).hexdigest())
                y.append(sha256(c.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(x, pa.string()), pa.array(y, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return mapped(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), each, SCHEMA)


def bpe_encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """doc_id and its ids as array<int>."""
    path = path or public_tokenizers.path(VOCABULARY)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            ids = [np.frombuffer(c.encode(t.as_py() or ""), "<u4").astype(np.int32) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return mapped(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), each, "doc_id long, ids array<int>")


def op3_bpe_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digest(table(spark, sf_dir, "documents"))
