"""MinHash near-dedup with HyperMinHash sketches.

A document's set is its distinct five-word shingles, hashed to 64 bits. The top 7 bits choose one of 128 registers; of
the least remaining value a register stores the number of leading zeros (6 bits) and the 10 bits behind the first one.
Empty registers borrow from the first filled one in a fixed random order, so that equal registers stay as likely as the
sets' Jaccard similarity for sets of any size. Four registers (64 bits) make one of 32 bands: a link of similarity 0.75
is missed by all with probability 5e-6. Pairs from bands are estimated from their registers, with the expected
number of accidental register collisions taken off; pairs far below the threshold end there, and all others are
verified on the full sets.

Documents with equal sets are one class throughout. A bucket of a band gives only pairs
with its centre, the smallest id. Links found join classes. In a bucket whose classes aren't all joined yet, shingles that only one
document of all such buckets has can't be shared: a document with too few others is ruled out there, exactly, and the next
centre is the one with fewest of them, which is the original of a group of edited copies. Of what is still apart after it, pairs
are compared unless their sizes of intersection with that centre bound their own below the threshold. So every pair that shares a
band is verified, joined already, or ruled out.

Defined results: a document without words or text has no shingle, is linked with nothing and is its own component; fewer
than five words are one shingle; a null id takes no part (component null, kept false); repeated rows with one id are
one document and come back each; texts of any length are taken whole; an empty table gives an empty result; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import U64, Remembered, components, mapped, mix64, table
from factloom.session import Scratch

WIDTH = 5
REGISTERS, ROWS = 128, 4
MANTISSA = 10
TILE = 2000  # rows of a group's size class that are compared with one another in a task
BASE = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(1, WIDTH + 1)], U64)
ORDER = np.argsort(np.random.default_rng(11).random((REGISTERS, REGISTERS)), axis=1)
BOUNDS = np.arange(REGISTERS, dtype=U64) << U64(57)
SALTS = mix64(np.arange(1, REGISTERS // ROWS + 1, dtype=U64) * U64(0x9E3779B97F4A7C15))


def hashes() -> Remembered:
    """64-bit hashes of words."""
    return Remembered(xxhash.xxh3_64_intdigest, 20_000_000)


def shingles(text: str | None, known: Remembered) -> np.ndarray:
    """Sorted distinct hashes of the text's five-word shingles; of all its words if they are fewer."""
    words = (text or "").encode().lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, U64)
    h = np.fromiter(map(known.__getitem__, words), U64, n)
    if n < WIDTH:
        return mix64((h * BASE[:n]).sum(keepdims=True, dtype=U64) ^ U64(n))
    return np.unique(mix64(sum(h[k : n - WIDTH + 1 + k] * BASE[k] for k in range(WIDTH))))


def sketch(s: np.ndarray) -> np.ndarray:
    """Registers of a non-empty sorted set: leading zeros and mantissa of each bucket's least value."""
    at = np.searchsorted(s, BOUNDS)
    x = s[np.minimum(at, len(s) - 1)]
    filled = (at < len(s)) & (x >> U64(57) == BOUNDS >> U64(57))
    m, e = np.frexp(np.maximum((x << U64(7)).astype(np.float64), 1.0))
    reg = ((64 - e).clip(0, 63) << MANTISSA | ((2 * m - 1) * (1 << MANTISSA)).astype(np.int64)).astype(np.uint16)
    if not filled.all():
        reg = reg[ORDER[np.arange(REGISTERS), filled[ORDER].argmax(1)]]
    return reg


def bands(reg: np.ndarray) -> np.ndarray:
    return mix64(reg.view(U64) ^ SALTS).view(np.int64)


def collisions(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Expected share of registers that agree by accident for disjoint sets of these sizes: two least values in one cell of
    leading zeros and mantissa. Of sets of a and b values over the registers, the least ones' chances of a cell of
    width w at x are about a' w exp(-a' x) and b' w exp(-b' x), with a' and b' the values in a register."""
    x = np.maximum(a, REGISTERS) / REGISTERS
    y = np.maximum(b, REGISTERS) / REGISTERS
    out = np.zeros(len(x))
    for z in range(63):
        lo = 2.0 ** -(z + 1)
        w = lo / (1 << MANTISSA)
        cells = np.linspace(lo, 2 * lo, 9)[:-1] + lo / 16
        dens = np.exp(np.minimum(-(x + y)[:, None] * cells, 0)).mean(1)
        out += x * y * w * w * (1 << MANTISSA) * dens
    return np.minimum(out, 0.5)


def estimate(ra: np.ndarray, rb: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Collision-corrected Jaccard estimate of pairs of register rows."""
    same, extra = (ra == rb).mean(1), collisions(na, nb)
    return np.maximum(0, (same - extra) / (1 - extra))


def sketched(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, size and fingerprint of each set, its registers and bands."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = hashes()
        for b in batches:
            out = []
            for t in b.column(1):
                s = shingles(t.as_py(), known)
                if not len(s):
                    out.append((0, 0, 0, None, None))
                    continue
                reg = sketch(s)
                a = int(np.bitwise_xor.reduce(s).view(np.int64))
                c = int(mix64(s + U64(0x9E3779B97F4A7C15)).sum(dtype=U64).view(np.int64))
                out.append((len(s), a, c, reg.tobytes(), bands(reg)))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([o[i] for o in out], k) for i, k in enumerate(kinds))], names=["doc_id", "n", "k1", "k2", "sketch", "bands"])

    return mapped(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), each, "doc_id long, n long, k1 long, k2 long, sketch binary, bands array<long>")


def likely(pairs: DataFrame, reps: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) whose corrected estimate isn't six standard deviations under the threshold."""
    side = lambda x: reps.select(F.col("rep").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            if not t.num_rows:
                continue
            of = lambda c: t.column(t.schema.get_field_index(c))
            ra, rb = (np.stack([np.frombuffer(x.as_py(), np.uint16) for x in of(c)]) for c in ("sa", "sb"))
            na, nb = (of(c).to_numpy(zero_copy_only=False) for c in ("na", "nb"))
            free = np.minimum(REGISTERS, np.minimum(na, nb))
            ok = (estimate(ra, rb, na, nb) >= threshold - 6 * np.sqrt(threshold * (1 - threshold) / free)) & (np.minimum(na, nb) * 100 >= round(100 * threshold) * np.maximum(na, nb))
            yield pa.RecordBatch.from_arrays([of("a").filter(pa.array(ok)), of("b").filter(pa.array(ok))], names=["a", "b"])

    return mapped(pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "na", "nb", "sa", "sb"), each, "a long, b long")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs with the sizes of intersection and union of their full sets."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            both, union = [], []
            for x, y in zip(t.column(2), t.column(3), strict=True):
                u, v = np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64)
                at = np.searchsorted(v, u)
                at[at == len(v)] = 0
                k = int((v[at] == u).sum())
                both.append(k)
                union.append(len(u) + len(v) - k)
            yield pa.RecordBatch.from_arrays([t.column(0), t.column(1), pa.array(both, pa.int64()), pa.array(union, pa.int64())], names=["a", "b", "both", "union"])

    side = lambda x: sets.select(F.col("rep").alias(x), F.col("set").alias(f"s{x}"))
    return mapped(pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "sa", "sb"), each, "a long, b long, both long, union long")


def sets_of(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(rep, set) of the documents with these ids: the full sets, recomputed from the texts."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = hashes()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingles(t.as_py(), known).tobytes() for t in b.column(1)], pa.binary())], names=["rep", "set"])

    rows = docs.select(F.col(id_col).cast("long").alias("rep"), F.col(text_col).cast("string").alias("text"))
    return mapped(rows.join(ids, "rep", "left_semi").dropDuplicates(["rep"]), each, "rep long, set binary")


def single_shingles(sets: DataFrame) -> DataFrame:
    """(rep, u): how many of a set's shingles no other of these sets has."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [np.frombuffer(x.as_buffer(), np.int64) for x in b.column(1)]
            for lo in range(0, len(own), 256):
                some = own[lo : lo + 256]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column(0)[lo : lo + 256].to_numpy(), [len(x) for x in some])), pa.array(np.concatenate(some))], names=["rep", "t"])

    once = mapped(sets.select("rep", "set"), each, "rep long, t long").groupBy("t").agg(F.count("*").alias("n"), F.min("rep").alias("rep")).where("n = 1")
    return once.groupBy("rep").agg(F.count("*").alias("u"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.75) -> DataFrame:
    """One row per document: size of its set, smallest id reachable by links, whether that is its own."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "near")
    least = round(100 * threshold)
    all_docs = scratch.keep(sketched(docs, id_col, text_col))
    has = all_docs.where("n > 0 and doc_id is not null")
    reps = scratch.keep(has.groupBy("n", "k1", "k2").agg(F.min("doc_id").alias("rep"), F.first("sketch").alias("sketch"), F.first("bands").alias("bands")))
    rows = reps.select("rep", F.explode("bands").alias("key"))
    shared = scratch.keep(rows.groupBy("key").agg(F.count("*").alias("size"), F.min("rep").alias("c")).where("size > 1"))
    members = scratch.keep(rows.join(shared, "key").select("key", "rep", "c", "size"))
    tasks = max(8, -(-members.count() // 50_000))  # of what has at most a row for each member
    wide = members.where("size > 2").select("key", "rep")  # the only pair of other buckets is with the centre

    pairs = scratch.keep(members.where("rep != c").select(F.col("c").alias("a"), F.col("rep").alias("b")).distinct(), tasks=tasks)
    some = scratch.keep(likely(pairs, reps, threshold), tasks=tasks)
    ids = some.select(F.col("a").alias("rep")).union(some.select(F.col("b").alias("rep"))).union(wide.select("rep")).distinct()
    sets = scratch.keep(sets_of(docs, ids, id_col, text_col))
    link = F.col("both") * 100 >= F.col("union") * least
    edges = scratch.keep(verified(some, sets).where(link).select("a", "b"), tasks=4 * tasks)
    labels = components(edges, scratch)

    def still_apart(rows: DataFrame) -> DataFrame:
        """Rows of the buckets that hold more than one label."""
        keys = scratch.keep(rows.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("left")).where("lo != hi").select("key", "left"), tasks=tasks)
        return rows.join(keys, "key")

    def by_label(labels: DataFrame) -> DataFrame:
        lab = wide.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", F.coalesce("label", "rep").alias("label"))
        return scratch.keep(still_apart(scratch.keep(lab, tasks=tasks)).select("key", "rep", "label"), tasks=tasks)

    def possible(apart: DataFrame, info: DataFrame) -> DataFrame:
        """Rows of the buckets still apart, without documents that can't be linked there.

        A partner x of s has |s & x| >= t / (1 + t) * (|s| + |x|), and |x| >= t |s|; |s & x| <= n - u.
        """
        full = scratch.keep(apart.join(info, "rep"), tasks=tasks)
        low = scratch.keep(full.groupBy("key").agg(F.min("n").alias("low")), tasks=tasks)
        can = (F.col("n") - F.col("u")) * (100 + least) >= least * (F.col("n") + F.greatest(F.col("low").cast("double"), F.col("n") * threshold)) - 1e-6
        return scratch.keep(still_apart(scratch.keep(full.join(low, "key").where(can).select("key", "rep", "label", "n", "u"), tasks=tasks)), tasks=tasks)

    def compared(new: DataFrame) -> DataFrame:
        return scratch.keep(verified(likely(new, reps, threshold), sets), tasks=4 * tasks)

    pair = [F.least("rep", "b").alias("a"), F.greatest("rep", "b").alias("b")]
    apart = by_label(labels)
    if not apart.isEmpty():
        of = scratch.keep(apart.select("rep").distinct(), tasks=tasks)
        info = scratch.keep(reps.select("rep", "n").join(of, "rep").join(single_shingles(sets.join(of, "rep", "left_semi")), "rep", "left").select("rep", "n", F.coalesce("u", F.lit(0)).alias("u")), tasks=tasks)
        rest = possible(apart, info)
        centres = scratch.keep(rest.groupBy("key").agg(F.min(F.struct("u", "rep")).alias("x")).select("key", F.col("x.rep").alias("b")), tasks=tasks)
        new = rest.join(centres, "key").where("rep != b").select(*pair)
        new = scratch.keep(new.distinct(), tasks=tasks)
        sizes = compared(new)
        edges = edges.union(sizes.where(link).select("a", "b"))
        labels = components(edges, scratch)

        # What is still apart: documents that share a centre c meet. |s & x| is at most what both may share inside c, plus what both
        # may share outside: shingles outside c that some other document has (o).
        rest = possible(by_label(labels), info)
        if not rest.isEmpty():
            shared_with = sizes.select(F.col("a").alias("c"), F.col("b").alias("rep"), "both").union(sizes.select("b", "a", "both"))
            group = rest.join(centres.withColumnRenamed("b", "c"), "key").select("c", "rep", "label", "n", "u").distinct()
            group = scratch.keep(group.join(shared_with, ["c", "rep"], "left").withColumn("i", F.when(F.col("rep") == F.col("c"), F.col("n")).otherwise(F.col("both"))).select("c", "rep", "label", "n", "u", "i"), tasks=tasks)
            # A link needs sizes within a factor of the threshold, so only neighbouring size classes meet; a class over ``TILE`` rows is cut
            # into tiles, so that no task compares more than TILE x TILE rows.
            group = group.withColumn("k", F.floor(F.log("n") / -math.log(threshold)))
            tiles = scratch.keep(group.groupBy("c", "k").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles")), tasks=tasks)
            place = lambda n: F.pmod(F.xxhash64("rep", F.lit(5)), n).cast("int")
            each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
            own_side = group.withColumn("k2", F.explode(F.array(*(F.col("k") + d for d in (-1, 0, 1))))).join(tiles, ["c", "k"])
            own_side = own_side.join(tiles.select("c", F.col("k").alias("k2"), F.col("tiles").alias("tiles2")), ["c", "k2"])
            own_side = own_side.withColumn("p", place(F.col("tiles"))).withColumn("q", each(F.col("tiles2")))
            other = group.withColumnRenamed("k", "k2").join(tiles.select("c", F.col("k").alias("k2"), F.col("tiles").alias("tiles2")), ["c", "k2"])
            other = other.withColumn("k", F.explode(F.array(*(F.col("k2") + d for d in (-1, 0, 1))))).join(tiles, ["c", "k"])
            other = other.withColumn("q", place(F.col("tiles2"))).withColumn("p", each(F.col("tiles")))
            other = other.select("c", "k", "k2", "p", "q", *(F.col(x).alias(f"{x}2") for x in ("rep", "label", "n", "u", "i")))
            out = lambda n, i, u: F.greatest(F.col(n) - F.col(i) - F.col(u), F.lit(0))
            bound = F.least(F.least(F.col("n") - F.col("u"), F.col("n2") - F.col("u2")), F.least("i", "i2") + F.least(out("n", "i", "u"), out("n2", "i2", "u2")))
            bound = F.when(F.col("i").isNull() | F.col("i2").isNull(), F.least(F.col("n") - F.col("u"), F.col("n2") - F.col("u2"))).otherwise(bound)
            last = own_side.join(other, ["c", "k", "k2", "p", "q"]).where((F.col("label") < F.col("label2")) & (bound * (100 + least) >= least * (F.col("n") + F.col("n2"))))
            last = scratch.keep(last.select(F.least("rep", "rep2").alias("a"), F.greatest("rep", "rep2").alias("b")).distinct(), tasks=4 * tasks)
            edges = edges.union(compared(last.join(new, ["a", "b"], "left_anti").join(pairs, ["a", "b"], "left_anti")).where(link).select("a", "b"))
            labels = components(edges, scratch)
    of_class = reps.select("n", "k1", "k2", "rep").join(labels.withColumnRenamed("node", "rep"), "rep", "left").select(F.col("n").alias("n_shingles"), "k1", "k2", F.coalesce("label", "rep").alias("c"))
    of_class = scratch.keep(of_class)
    scratch.only(all_docs, of_class)
    own = all_docs.select("doc_id", F.col("n").alias("n_shingles"), "k1", "k2").join(of_class, ["n_shingles", "k1", "k2"], "left")
    c = F.when(F.col("doc_id").isNotNull(), F.coalesce("c", "doc_id"))
    return own.select("doc_id", "n_shingles", c.alias("component_id"), F.coalesce(c == F.col("doc_id"), F.lit(False)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.75) -> DataFrame:
    """The rows whose id is the smallest of its group, with all their columns. Rows with a null id stay."""
    name = "_gone"
    while name in [c.lower() for c in docs.columns]:
        name += "_"
    gone = near_duplicates(docs, id_col, text_col, threshold).where("doc_id is not null and not kept").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, docs[id_col].cast("long") == F.col(name), "left_anti")


def op8_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
