"""Ranked lexical search: dual-sorted wavelet trees per shard, intersected best first.

``index`` makes shards: each holds some documents (about ``CHARS`` characters of text, whole documents, at most ``DOCS``), numbered
within the shard by rising doc_id, and the postings of all their terms. In a searching task the postings of the terms
asked become one sequence: each term's by falling impact, so that a range of the sequence is a term's list by impact;
a wavelet tree over the document numbers (its nodes kept level by level, stably partitioned) makes the same ranges navigable by
doc_id. At a node a term's first posting has its largest impact below that node, so the weighted sum of those is an
upper bound for the node's documents, and a leaf's sum is its document's score. Nodes are opened best bound first until no bound
can enter the k best; a task carries its k best from shard to shard, so later shards are pruned at their roots. Ties open towards smaller ids.

Terms: maximal matches of ``TERM`` in the whole text, A-Z lower-cased. Weights and impacts are the integers of ``weights`` and ``impacts``.
Corpus statistics cover all documents. Items meet the shards in blocks of about ``ASKED`` terms, which go to all tasks; a task returns at most
k rows for each item, and these are merged in two steps, so no group has a row from each task.

Defined results: a null or empty text has no terms: the document takes no part, the item gets no rows; a null doc_id is ranked
as the largest id; repeated rows are documents of their own; a null item_id takes no part, and the smallest text stands for a
repeated item_id; equal scores go by doc_id; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.llm.common import mapped, table
from factloom.session import Scratch

TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
CHARS, DOCS = 4_000_000, 16_384  # of a shard, at most (a longer document is a shard of its own)
ASKED = 200_000  # distinct terms of a block of items, about
BEAM = 4  # nodes opened at once for each item
LAST = 1 << 63  # stands for a null id in the order
GROUPED = {"parquet.block.size": str(8 << 20), "parquet.page.size.row.check.min": "1", "parquet.block.size.row.check.min": "1"}  # few shards are a row group: readers and writers hold one whole
SHARD = "ids array<long>, lens array<long>, terms array<string>, dfs array<int>, docs binary, tfs binary"
FOUND = "item_id long, doc_id long, score long, task long"


def terms_of(text: str) -> list[bytes]:
    return TERM.findall(text.encode("utf-8", "replace").lower())


def shard_of(ids: list[int | None], texts: list[str]) -> pa.RecordBatch | None:
    """Postings of the documents, by term and document number; None if they hold no term."""
    order = sorted(range(len(ids)), key=lambda i: LAST if ids[i] is None else ids[i])
    found, own, lens = [], [], []
    for i in order:
        ts = terms_of(texts[i])
        if ts:
            own.append(ids[i])
            lens.append(len(ts))
            found += ts
    if not found:
        return None
    coded = pa.array(found, pa.binary()).dictionary_encode()
    del found
    n = len(own)
    key, tf = np.unique(coded.indices.to_numpy().astype(np.int64) * n + np.repeat(np.arange(n), lens), return_counts=True)
    dfs = np.bincount(key // n, minlength=len(coded.dictionary))
    columns = [[own], [lens], [coded.dictionary.cast(pa.string())], [dfs.astype(np.int32)], [(key % n).astype("<u4").tobytes()], [tf.astype("<u4").tobytes()]]
    kinds = [pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["ids", "lens", "terms", "dfs", "docs", "tfs"])


def sharded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids: list[int | None] = []
    texts: list[str] = []
    held = 0
    for b in batches:
        for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            t = t.as_py()
            if ids and (held + len(t) > CHARS or len(ids) == DOCS):
                if (out := shard_of(ids, texts)) is not None:
                    yield out
                ids, texts, held = [], [], 0
            ids.append(i)
            texts.append(t)
            held += len(t)
    if ids and (out := shard_of(ids, texts)) is not None:
        yield out


def index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each shard: document ids and lengths, terms with their document counts, postings. One pass, no shuffle."""
    text = F.col(text_col).cast("string")
    return mapped(docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).where("text is not null"), sharded, SHARD)


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            ts = pa.array(terms_of(t.as_py()), pa.binary()).value_counts()
            yield pa.RecordBatch.from_arrays([pa.array([i] * len(ts), pa.int64()), ts.field(0).cast(pa.string()), ts.field(1)], names=["item_id", "term", "times"])


def weight(df: Column, n: int) -> Column:
    """floor(1000 ln((2N + 2) / (2 df + 1))), in doubles."""
    return F.floor(F.lit(1000.0) * F.log(F.lit(float(2 * n + 2)) / (2 * df + 1).cast("double"))).cast("long")


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions of the ranges, one after the other."""
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))


class Tree:
    """The dual-sorted sequence of a shard and its wavelet tree, level by level."""

    def __init__(self, docs: np.ndarray, impact: np.ndarray, term: np.ndarray, many: int, n: int):
        order = np.lexsort((docs, -impact, term))
        docs, impact = docs[order], impact[order]
        self.height, self.size = max(0, int(n - 1).bit_length()), len(docs)
        self.starts = np.searchsorted(term[order], np.arange(many + 1))
        zeros, self.first_one = np.zeros((self.height, self.size + 1), np.int32), np.zeros(self.height, np.int64)
        best = np.zeros((self.height + 1, self.size), np.int32)
        best[0] = impact
        for k in range(self.height):
            one = (docs >> (self.height - 1 - k)) & 1
            np.cumsum(1 - one, out=zeros[k, 1:])
            self.first_one[k] = zeros[k, -1]
            order = np.concatenate([np.flatnonzero(one == 0), np.flatnonzero(one)])
            docs, best[k + 1] = docs[order], best[k][order]
        self.zeros, self.best = zeros.ravel(), best.ravel()

    def bounds(self, level: np.ndarray, left: np.ndarray, right: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Weighted largest impact of each range; 0 for an empty one."""
        return np.where(left < right, w * self.best[level * self.size + np.minimum(left, self.size - 1)], 0)

    def opened(self, level: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The ranges in the two children."""
        at = level * (self.size + 1)
        l0, r0, one = self.zeros[at + left].astype(np.int64), self.zeros[at + right].astype(np.int64), self.first_one[level]
        return l0, r0, one + left - l0, one + right - r0


class Best:
    """The k best documents of each item so far, over the shards of a task."""

    def __init__(self, items: int, k: int):
        self.k, self.heaps = k, [[] for _ in range(items)]

    def may_enter(self, item: int, bound: int, doc: int) -> bool:
        """Whether a document with this score and id (or a later one) could be among the best."""
        h = self.heaps[item]
        return bound > 0 and (len(h) < self.k or (bound, -doc) > h[0])

    def add(self, item: int, score: int, doc: int) -> None:
        h = self.heaps[item]
        if len(h) < self.k:
            heapq.heappush(h, (score, -doc))
        elif (score, -doc) > h[0]:
            heapq.heapreplace(h, (score, -doc))


def best_first(tree: Tree, ids: list[int], asks: list[tuple[int, np.ndarray, np.ndarray]], best: Best) -> int:
    """Search one shard for all items at once; returns how many nodes were opened. asks: item, terms (numbers in the tree), weights."""
    queues: dict[int, list] = {}
    height, opened = tree.height, 0

    def put(item: int, bound: int, level: int, prefix: int, ranges: np.ndarray) -> None:
        first = prefix << (height - level)
        if first < len(ids) and best.may_enter(item, bound, ids[first]):
            if level == height:
                best.add(item, bound, ids[first])
            else:
                heapq.heappush(queues.setdefault(item, []), (-bound, first, level, prefix, ranges))

    for item, own, w in asks:
        left, right = tree.starts[own], tree.starts[own + 1]
        put(item, int(tree.bounds(np.zeros(len(own), np.int64), left, right, w).sum()), 0, 0, np.stack([left, right, w]))
    while queues:
        nodes = []
        for item in list(queues):
            q, n = queues[item], 0
            while q and n < BEAM:
                bound, first, level, prefix, ranges = heapq.heappop(q)
                if not best.may_enter(item, -bound, ids[first]):
                    q.clear()  # no later one can either
                    break
                nodes.append((item, level, prefix, ranges))
                n += 1
            if not n:
                del queues[item]
        if not nodes:
            continue
        opened += len(nodes)
        sizes = np.array([x[3].shape[1] for x in nodes])
        level = np.repeat(np.array([x[1] for x in nodes], np.int64), sizes)
        left, right, w = np.concatenate([x[3] for x in nodes], axis=1)
        at = np.cumsum(sizes) - sizes
        for side, (lo, hi) in enumerate(zip(*[iter(tree.opened(level, left, right))] * 2, strict=True)):
            bound = np.add.reduceat(tree.bounds(level + 1, lo, hi, w), at)
            alive = lo < hi
            kept = np.stack([lo[alive], hi[alive], w[alive]])
            ends = np.cumsum(np.add.reduceat(alive.astype(np.int64), at))
            for i, (item, deep, prefix, _) in enumerate(nodes):
                if bound[i]:
                    put(item, int(bound[i]), deep + 1, 2 * prefix + side, kept[:, ends[i - 1] if i else 0 : ends[i]])
    return opened


def searcher(vocabulary: list[str], items: list[tuple[int, np.ndarray, np.ndarray]], n_docs: int, n_terms: int, k: int):
    """items: id, numbers of its terms in the vocabulary, their weights times how often they are asked."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, best, task = pa.array(vocabulary, pa.string()), Best(len(items), k), 0
        for b in batches:
            for row in range(b.num_rows):
                ids, lens, terms, dfs, docs, tfs = (b.column(i)[row] for i in range(6))
                ids = [LAST if i is None else i for i in ids.as_py()]
                task = ids[0] % (1 << 31)
                at = pc.index_in(terms.values, value_set=known).fill_null(-1).to_numpy(zero_copy_only=False)
                sizes = dfs.values.to_numpy().astype(np.int64)
                own = np.flatnonzero(at >= 0)
                if not len(own):
                    continue
                where = spread((np.cumsum(sizes) - sizes)[own], sizes[own])
                docs, tf = np.frombuffer(docs.as_py(), "<u4")[where].astype(np.int64), np.frombuffer(tfs.as_py(), "<u4")[where].astype(np.int64)
                m = np.array([75 + (25 * n * n_docs) // n_terms for n in lens.as_py()], np.int64)
                tree = Tree(docs, impacts(tf, m[docs]), np.repeat(np.arange(len(own)), sizes[own]), len(own), len(ids))
                here = np.full(len(vocabulary), -1)
                here[at[own]] = np.arange(len(own))
                asks = [(i, here[ts][here[ts] >= 0], w[here[ts] >= 0]) for i, (_, ts, w) in enumerate(items)]
                best_first(tree, ids, [x for x in asks if len(x[1])], best)
        rows = [(items[i][0], None if -doc == LAST else -doc, score, task) for i, h in enumerate(best.heaps) for score, doc in h]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(4)], names=["item_id", "doc_id", "score", "task"])

    return each


def first(df: DataFrame, k: int, *by: str | Column) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents with the highest scores above 0 for each item."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "ranking")
    shards = scratch.keep(index(docs, id_col, text_col), options=GROUPED)
    n_shards, n, total = shards.select(F.size("ids").alias("n"), F.aggregate("lens", F.lit(0).cast("long"), lambda a, x: a + x).alias("l")).agg(F.count("*"), F.sum("n"), F.sum("l")).first()
    none = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    if not n_shards:
        return none
    whole = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).cast("string").alias("text")).where("item_id is not null").groupBy("item_id").agg(F.min("text").alias("text")).where("text is not null")
    asked = scratch.keep(mapped(whole, counted, "item_id long, term string, times long"))
    words = asked.select("term").distinct()
    df = shards.select(F.explode(F.arrays_zip("terms", "dfs")).alias("x")).select(F.col("x.terms").alias("term"), F.col("x.dfs").cast("long").alias("df"))
    df = df.join(words, "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    asked = scratch.keep(asked.join(df, "term").select("item_id", "term", (F.col("times") * weight(F.col("df"), n)).alias("w")).where("w > 0"))
    blocks = -(-asked.count() // ASKED)
    out = []
    for b in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).toPandas().sort_values(["item_id", "term"])
        vocabulary = sorted(set(rows["term"]))
        place = {t: i for i, t in enumerate(vocabulary)}
        own = [(int(i), g["term"].map(place).to_numpy(np.int64), g["w"].to_numpy(np.int64)) for i, g in rows.groupby("item_id")]
        if own:
            out.append(scratch.keep(mapped(shards, searcher(vocabulary, own, n, total, k), FOUND)))
    if not out:
        return none
    found = out[0]
    for more in out[1:]:
        found = found.union(more)
    part = F.pmod(F.xxhash64("task"), F.lit(max(1, int(n_shards**0.5))))
    found = first(found.withColumn("part", part), k, "item_id", "part").drop("rank")
    return first(found, k, "item_id").select("item_id", "rank", "doc_id", "score")


def op11_wavelet_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
