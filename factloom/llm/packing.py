"""Best-fit packing of token sequences with certified bin counts.

Texts become ids and a separator; documents longer than a sequence are cut into full pieces and a rest. Rests are dealt
to groups of bounded size and packed best-fit decreasing in each. Dual feasible functions give a lower bound on a group's bins:
a group that meets it is certified. Bins with room to spare (all of an uncertified group's bins that aren't full)
give their documents back; those are dealt anew and packed again, for a few rounds, so that groups
exchange what they could not place well.

Defined results: a null text is the empty text (the separator alone); a null id comes back null; repeated rows are packed
each; an empty table gives an empty result; ties keep the order of doc_id and piece; other columns are ignored.
"""

from __future__ import annotations

import gc
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat
from zlib import crc32

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import mapped, table
from factloom.session import Scratch, ship

VOCABULARY = "word_bpe_49k.json"
KEPT = 96_000_000  # bytes, about, of words and ids that a worker remembers
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"  # ASCII punctuation but the apostrophe
# Bytes that have no visible Latin-1 letter stand for U+0100 and on, in order.
LETTERS = {b: 256 + i for i, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174))}
GROUP = 20_000  # pieces that are packed together
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = PIECES + ", sequence_id long, offset long, room long"


def ragged(pool: np.ndarray, begin: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of a pool one behind the other, and where each of them ends."""
    ends = np.cumsum(count)
    return pool[np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - ends + count, count)], ends


def byte_letters(word: str) -> str:
    """A letter for each UTF-8 byte, as byte-level vocabularies spell them."""
    return word if word.isascii() else word.encode().decode("latin-1").translate(LETTERS)


class Words:
    """Ids of texts by the tokenizer, put together from remembered ids of what stands between white space.

    The tokenizer's normaliser, split pattern and special tokens never reach across white space, so this equals encoding whole texts.
    A special token in a text is that token: a word that holds one is never plain, so the tokenizer itself encodes it.
    Arrow splits the texts and finds their distinct words; only those meet Python. A remembered word is a run in a pool of ids.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.t = Tokenizer.from_file(path)
        self.ends = np.zeros(self.t.get_vocab_size(), bool)
        for token, i in self.t.get_vocab().items():
            self.ends[i] = token.endswith("</w>")
        self.merges = Tokenizer(self.t.model)  # the same merges for words that need no normalising and no splitting but at spaces
        self.merges.pre_tokenizer = WhitespaceSplit()
        self.tails = {"": np.empty(0, "<u4")}
        self.forget()

    def forget(self) -> None:
        self.known, self.held = {"": 0}, 0
        self.pool, self.begin, self.count = np.empty(0, "<u4"), np.zeros(1, np.int64), np.zeros(1, np.int64)

    def encode_one(self, text: str) -> bytes:
        return np.array(self.t.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def tail(self, text: str) -> str:
        if text not in self.tails:
            self.tails[text] = np.frombuffer(self.encode_one(text), "<u4")
        return text

    def add(self, words: list[str], ids: np.ndarray, count: np.ndarray) -> None:
        self.known.update(zip(words, range(len(self.count), len(self.count) + len(words)), strict=True))
        self.held += sum(map(len, words)) + 180 * len(words) + ids.nbytes
        self.begin = np.concatenate([self.begin, len(self.pool) + np.cumsum(count) - count])
        self.count = np.concatenate([self.count, count])
        self.pool = np.concatenate([self.pool, ids])

    def learn(self, words: list[str]) -> None:
        """Remember new words: letters and a tail of marks by one call, split where a word ends; others one by one."""
        cores, rest = {}, []
        plain, core_of, tail_of = [], [], []  # flat lists: nothing here that the garbage collector has to walk
        for w in words:
            core = w.rstrip(MARKS)
            tail = w[len(core) :]
            if len(tail) <= 3 and core.isalpha() and (core.isascii() or max(core) < "Ā"):
                plain.append(w)
                core_of.append(cores.setdefault(core.lower(), len(cores)))
                tail_of.append(tail)
            else:
                rest.append(w)
        if plain:
            ids = np.array(self.merges.encode_batch_fast([" ".join(map(byte_letters, cores))], add_special_tokens=False)[0].ids, "<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) != len(cores):
                raise ValueError("words don't end where the vocabulary says")
            number = {t: i for i, t in enumerate(dict.fromkeys(tail_of))}
            runs = [self.tails[self.tail(t)] for t in number]
            size = np.concatenate([np.diff(cuts, prepend=0), [len(r) for r in runs]])
            at = np.empty((len(plain), 2), np.int64)
            at[:, 0], at[:, 1] = core_of, [number[t] for t in tail_of]
            at[:, 1] += len(cores)
            own, _ = ragged(np.concatenate([ids, *runs]), (np.cumsum(size) - size)[at.ravel()], size[at.ravel()])
            self.add(plain, own, size[at].sum(1))
        if rest:
            found = [e.ids for e in self.t.encode_batch_fast(rest, add_special_tokens=False)]
            self.add(rest, np.array([i for ids in found for i in ids], "<u4"), np.array([len(ids) for ids in found], np.int64))

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        texts = pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string())
        apart = pc.match_substring_regex(texts, "[\x1c-\x1f\x85]")  # where not all agree on what is white space
        alone = np.flatnonzero(apart.to_numpy(zero_copy_only=False)).tolist()
        split = pc.utf8_split_whitespace(pc.if_else(apart, "", texts) if alone else texts)
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False)
        if self.held > KEPT:
            self.forget()
        slots = np.fromiter(map(self.known.get, words.tolist(), repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(slots < 0)
        if len(new):
            missing = words[new].tolist()
            self.learn(missing)
            slots[new] = np.fromiter(map(self.known.__getitem__, missing), np.int64, len(new))
        rows = slots[coded.indices.to_numpy()]
        ids, ends = ragged(self.pool, self.begin[rows], self.count[rows])
        cuts = (4 * np.append(0, ends)[np.append(0, np.cumsum(pc.list_value_length(split).to_numpy()))]).tolist()
        raw = ids.tobytes()
        out = [raw[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        for i in alone:
            out[i] = self.encode_one(texts[i].as_py())
        return out


@lru_cache(2)
def words(path: str) -> Words:
    return Words(path)


def batches_of(lengths: list[int], most: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Runs of texts with about so many bytes."""
    at = size = 0
    for i, n in enumerate(lengths):
        size += n
        if size >= most:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(lengths):
        yield at, len(lengths)


def pieces(docs: DataFrame, id_col: str, text_col: str, path: str, size: int, end: int) -> DataFrame:
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = words(path)
        gc.disable()  # a remembered word is no garbage, and there are many
        stop = np.array([end], "<u4").tobytes()
        for b in batches:
            ids_of, texts, out = b.column(0).to_pylist(), pc.fill_null(b.column(1), ""), []
            for lo, hi in batches_of(pc.binary_length(texts).to_pylist()):
                for doc, ids in zip(ids_of[lo:hi], w.encode(texts[lo:hi]), strict=True):
                    ids += stop
                    n = len(ids) // 4
                    out += [(doc, k, k * size, min(size, n - k * size), crc32(ids[4 * k * size : 4 * (k + 1) * size])) for k in range(-(-n // size))]
            cols = zip(*out, strict=True) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return mapped(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), each, PIECES)


def lower_bound(lengths: np.ndarray, size: int) -> int:
    """Most of the bounds by dual feasible functions: for each threshold t, an item over size - t counts as a whole bin, one
    under t as nothing, others by length; and the rounding functions floor((k + 1) x / size) / k."""
    if not len(lengths):
        return 0
    n = np.bincount(lengths, minlength=size + 1).astype(np.int64)
    x = np.arange(size + 1)
    best = -(-int((n * x).sum()) // size)
    total, count = np.cumsum(n * x), np.cumsum(n)
    t = np.arange(0, size // 2 + 1)
    big = count[size] - count[size - t]
    middle = total[size - t] - np.where(t > 0, total[np.maximum(t - 1, 0)], 0)
    best = max(best, int((big + -(-middle // size)).max()))
    for k in range(1, 21):
        y = (k + 1) * x
        f = np.where(y % size == 0, x * k, y // size * size)  # times k * size
        best = max(best, -(-int((n * f).sum()) // (k * size)))
    return best


def best_fit(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: bin and offset of each item, room left in each bin. Bins wait in buckets by room; a bitmap of rooms finds the tightest."""
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    rooms: list[int] = []
    waiting: dict[int, list[int]] = defaultdict(list)
    mask = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fits = mask >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = waiting[room].pop()
            if not waiting[room]:
                mask ^= 1 << room
        else:
            room, b = size, len(rooms)
            rooms.append(size)
        bins[i], offsets[i] = b, size - room
        rooms[b] = room = room - n
        if room:
            if not waiting[room]:
                mask |= 1 << room
            waiting[room].append(b)
    return bins, offsets, np.array(rooms, np.int64)


def packed_group(size: int, turn: int, last: bool, slack: int):
    def each(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["doc_id", "piece", "ids_crc32"], kind="stable")
        lengths = group["length"].to_numpy()
        bins, offsets, rooms = best_fit(lengths, size)
        certified = len(rooms) == lower_bound(lengths, size)
        final = np.full(len(rooms), True) if last else rooms <= (slack if certified else 0)
        out = group.drop(columns="grp").assign(sequence_id=(turn << 56) + (int(key[0]) << 24) + bins, offset=offsets, room=np.where(final[bins], rooms[bins], -1))
        return out

    return each


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, size: int = 2048, end: int = 0, rounds: int = 3, group: int = GROUP) -> DataFrame:
    """Pack all texts into sequences of at most ``size`` ids. A last round's leftovers stay as they are packed there."""
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark, "packing")
    every = scratch.keep(pieces(docs, id_col, text_col, path or public_tokenizers.path(VOCABULARY), size, end))
    done = [every.where(F.col("length") == size).withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))]
    left = every.where(F.col("length") < size)
    names = every.columns
    for turn in range(1, rounds + 1):
        n = left.count()
        if not n:
            break
        groups = -(-n // group)
        last = turn == rounds or groups == 1
        dealt = left.withColumn("grp", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.lit(turn)), F.lit(groups)))
        placed = scratch.keep(dealt.groupBy("grp").applyInPandas(packed_group(size, turn, last, size // 32), PLACED))
        done.append(placed.where("room >= 0").drop("room"))
        if last:
            break
        left = placed.where("room < 0").select(*names)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
