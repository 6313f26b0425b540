"""Secret scans: fixed patterns plus a linear-chain conditional random field.

Patterns (kinds assign, access, hex) give the base spans. The CRF tags every token of a text (runs between white space, quotes,
brackets and = : , ;) as secret begin, inside or outside, from the token's shape, its neighbours, what parts them, and the file, decoded by
Viterbi. Potentials are sums of parts that depend on one token or gap, so they are remembered by token. A token whose best tag other than
outside lies below outside by more than any moves between tags can make up is outside in every best path; only the runs
between such tokens are decoded, which changes no result. Its spans have the kind ``crf``; those inside a base span are not repeated.

It learns from a bounded sample of rows (about ``sample`` rows with a pattern's first characters and as many others, chosen by hash of
id): the tokens of base spans, odd and ordinary tokens outside them, and made-up secrets of other kinds (MAKERS) put
into the sample's texts behind other names, so that it learns shapes and neighbourhoods beyond the patterns.

Defined results: a null text is the empty text; a null id comes back null; repeated rows are scanned each; an empty
table gives an empty result; offsets are code points; overlapping spans of different kinds all come back; very long texts are scanned whole; a
text without tokens gives no crf span; other columns are ignored.
"""

from __future__ import annotations

import gc
import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256
from string import ascii_letters, ascii_lowercase, ascii_uppercase, digits

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import Remembered, mapped, sampled, table

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX32 = re.compile(r"[0-9a-f]{32,}")
WORDS = ("password", "passwd", "secret", "token", "api")
KINDS = ("assign", "access", "hex", "crf")
WORDLIKE = ("lower", "Title", "UPPER", "miXed")
NAME = 6.0  # the most that a name before may add to, or take from, a secret tag
TOKEN = re.compile(r"""[^\s=:"'(),;<>\[\]{}|`]+""")
ENDS = ".!?"  # not part of a token's end
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+|.", re.S)
O, B, I = 0, 1, 2
AROUND = 3  # tokens of a training window on each side
SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns: leftmost, non-overlapping per kind, failing matches dropped."""
    return [(s, k, e) for s, k, e, _ in base_matches(text)]


def base_matches(text: str) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, start of the secret itself)."""
    out = []
    low = text.lower()
    if any(w in low for w in WORDS):
        out += [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end(), m.start()) for m in HEX32.finditer(text)]
    return sorted(out)


def kind_of(t: str) -> str:
    """Class of a token's characters."""
    if t.isalpha():
        return "lower" if t.islower() else "Title" if t[1:].islower() or len(t) == 1 else "UPPER" if t.isupper() else "miXed"
    if t.isdigit():
        return "digits"
    if t.isalnum():
        return "hex" if not t.strip("0123456789abcdef") else "lower9" if t.islower() else "UPPER9" if t.isupper() else "miXed9"
    core = t.strip("#$%&*!@^~+-_/\\.?")
    if core.isalpha():
        return "word&"
    if not core.strip(digits + ".-/_"):
        return "number&"
    return "rest&" if any(c.isdigit() for c in t) else "letters&"


def own_features(raw: str) -> list[str]:
    """Of a token by itself: its shape."""
    t = raw.rstrip(ENDS)
    n = len(t)
    if not n:
        return ["empty"]
    kind, size = kind_of(t), min(n, 48)
    out = ["bias", f"kind {kind}", f"size {size // 4}", f"kind {kind} size {size // 8}", f"letters {len(set(t)) // 3}", f"repeats {4 * len(set(t)) // n}"]
    letters = n
    if kind not in WORDLIKE:
        letters = sum(map(str.isalpha, t))
        out += [f"moves {min(9, len(PARTS.findall(t)) // 2)}", f"digits {4 * sum(map(str.isdigit, t)) // n}"] + [f"part {p}" for p in ("_", "-", "/", ".") if p in t]
        out += ["address"] * ("@" in t and "." in t)
    elif kind == "miXed":
        out.append(f"moves {min(9, len(PARTS.findall(t)) // 2)}")
    if letters > 3:
        out.append(f"vowels {5 * sum(map(t.lower().count, 'aeiouy')) // letters} {n > 11}")
    if t.isascii():
        out.append("ascii")
    return out


def name_features(raw: str) -> list[str]:
    """Of a token as the one before: its last letters."""
    t = raw.rstrip(ENDS).lower()[-12:]
    return [f"before {t[-8:]}", *{f"before..{t[i : i + 3]}" for i in range(len(t) - 2)}]


def gap_features(gap: str) -> list[str]:
    """Of what stands between a token and the one before."""
    sign, quote = any(c in "=:" for c in gap), any(c in "\"'`" for c in gap)
    return [f"gap {''.join(sorted(set(gap.strip())))[:4]}", f"assigned {sign} {quote}", f"line {chr(10) in gap}"]


def next_features(raw: str) -> list[str]:
    """Of the token behind."""
    t = raw.rstrip(ENDS)
    return [f"next {kind_of(t) if t else ''}"]


def file_features(text: str) -> list[str]:
    n = max(1, len(text))
    return [f"lines {min(9, int(math.log2(1 + text.count(chr(10)))))}", f"signs {min(5, int(2000 * text.count('=') / n))}", f"brace {'{' in text}"]


# -- made-up secrets: names, kinds and benign values, all invented here or public formats

NAMES = "password passwd pwd pass passphrase secret client_secret token access_token auth_token api_key apikey key client_key private_key secret_key access_key credential credentials auth authorization bearer session_key signing_key db_password pin".split()
PLAIN = "page line version order number date price color size total item code name user phone zip id count chapter section figure table note".split()
SIGNS = (" = ", "=", ": ", ":", " := ", ' = "', ': "', "='", " ")


def _some(g: random.Random, chars: str, lo: int, hi: int) -> str:
    return "".join(g.choices(chars, k=g.randint(lo, hi)))


MAKERS = {
    "mixed": lambda g: _some(g, ascii_letters + digits, 12, 48),
    "lower": lambda g: _some(g, ascii_lowercase + digits, 12, 40),
    "upper": lambda g: _some(g, ascii_uppercase + digits, 14, 32),
    "hex": lambda g: _some(g, "0123456789abcdef", 20, 64),
    "base64": lambda g: _some(g, ascii_letters + digits + "+/", 20, 60),
    "prefixed": lambda g: _some(g, ascii_lowercase, 2, 5) + g.choice("_-") + _some(g, ascii_letters + digits, 16, 40),
    "parts": lambda g: "-".join([_some(g, ascii_lowercase, 3, 5), _some(g, digits, 8, 12), _some(g, ascii_letters + digits, 12, 28)]),
    "letters": lambda g: _some(g, ascii_letters, 14, 32),
    "typed": lambda g: "".join(g.sample([g.choice(("Tr0ub4dor", "Summer", "Dragon", "qwerty", "Passw0rd", "letmein", "Sunsh1ne")), _some(g, digits, 2, 5), _some(g, "!@#$%^&*", 0, 2), _some(g, ascii_letters, 2, 5)], 4)),
}
BENIGN = {
    "number": lambda g: _some(g, digits, 1, 16),
    "dotted": lambda g: ".".join(str(g.randint(0, 255)) for _ in range(g.randint(2, 4))),
    "address": lambda g: f"{_some(g, ascii_lowercase, 3, 9)}.{g.randint(1, 99)}@{_some(g, ascii_lowercase, 4, 8)}.com",
    "url": lambda g: f"www.{_some(g, ascii_lowercase, 4, 10)}.org/{_some(g, ascii_lowercase, 3, 9)}/{g.randint(1, 999)}",
    "date": lambda g: f"{g.randint(1900, 2030)}-{g.randint(1, 12):02}-{g.randint(1, 28):02}",
    "phone": lambda g: f"+{g.randint(1, 99)} {g.randint(100, 999)}-{g.randint(1000, 9999)}",
    "short": lambda g: _some(g, ascii_lowercase + digits, 2, 6),
}


def tagged(text: str, secrets: list[tuple[int, int]]) -> tuple[list[tuple[int, int]], list[int]]:
    """Tokens of a text, and their tags from the secrets' places."""
    spans = [(m.start(), m.start() + len(m[0].rstrip(ENDS))) for m in TOKEN.finditer(text)]
    spans = [(s, e) for s, e in spans if e > s]
    tags, last, k = [], -1, 0
    for s, e in spans:
        while k < len(secrets) and secrets[k][1] <= s:
            k += 1
        hit = k < len(secrets) and 2 * (min(e, secrets[k][1]) - max(s, secrets[k][0])) >= e - s
        tags.append((I if last == k else B) if hit else O)
        last = k if hit else -1
    return spans, tags


def windows(text: str, secrets: list[tuple[int, int]], of_file: list[str], g: random.Random, made: bool) -> Iterator[tuple[list[list[str]], list[int]]]:
    """Features and tags of tokens around secrets, around odd tokens, and around some others."""
    spans, tags = tagged(text, secrets)
    centres = [i for i, t in enumerate(tags) if t]
    odd = [i for i, (s, e) in enumerate(spans) if not tags[i] and (any(c.isdigit() for c in text[s:e]) or e - s > 13)]
    some = g.sample(odd, min(len(odd), 1 if made else 8)) + (g.sample(range(len(spans)), min(len(spans), 1 if made else 5)))
    for c in centres + some:
        lo, hi = max(0, c - AROUND), min(len(spans), c + AROUND + 1)
        feats = []
        for i in range(lo, hi):
            s, e = spans[i]
            before, at = (text[slice(*spans[i - 1])], spans[i - 1][1]) if i else ("", 0)
            behind = text[slice(*spans[i + 1])] if i + 1 < len(spans) else ""
            near = [*name_features(before), *gap_features(text[at:s]), *next_features(behind)]
            feats.append(own_features(text[s:e]) + of_file + near)
        yield feats, tags[lo:hi]
        if made and g.random() < 0.4:  # once more with the name before forgotten
            yield [[f for f in fs if not f.startswith("before")] for fs in feats], tags[lo:hi]


def invented(texts: list[str], g: random.Random, n: int, without: tuple[str, ...]) -> Iterator[tuple[str, list[tuple[int, int]], list[str]]]:
    """Pieces of texts with a made-up secret, or a benign value behind a plain name, put in."""
    kinds = [k for k in MAKERS if k not in without]
    for k in range(n if texts else 0):
        text = g.choice(texts)
        at = g.randrange(len(text) + 1)
        left, right = text[max(0, at - 60) : at], text[at : at + 60]
        if k % 3 == 2:
            put = g.choice(PLAIN) + g.choice(SIGNS) + BENIGN[g.choice(list(BENIGN))](g)
            secret = []
        else:
            value = MAKERS[kinds[k % len(kinds)]](g)
            name = g.choice(NAMES)
            head = "" if g.random() < 0.3 else g.choice((name, name.upper(), name.replace("_", "-"), "my_" + name)) + g.choice(SIGNS[:-1])
            put, secret = head + value, [(len(left) + 1 + len(head), len(left) + 1 + len(head) + len(value))]
            put += head[-1] if head[-1:] in ("'", '"') else ""
        yield f"{left} {put} {right}", secret, file_features(text)


@dataclass
class Chain:
    """Weights of features by tag and of moves between tags; ``caution`` is taken off both secret tags."""

    weights: dict[str, tuple[float, float, float]]
    move: np.ndarray
    caution: float = 1.0

    def score(self, features: list[str]) -> tuple[float, float]:
        """Potentials of begin and inside, less that of outside."""
        b = i = 0.0
        for f in features:
            if w := self.weights.get(f):
                b += w[B] - w[O]
                i += w[I] - w[O]
        return b, i

    def most(self, start: str) -> float:
        """The most that one feature of a family adds to a secret tag."""
        return max((max(w[B], w[I]) - w[O] for f, w in self.weights.items() if f.startswith(start)), default=0.0)


def viterbi(unary: np.ndarray, move: np.ndarray) -> list[int]:
    """Best tags of a run with outside on both sides."""
    best, back = move[O] + unary[0], []
    for u in unary[1:]:
        x = best[:, None] + move
        back.append(x.argmax(0))
        best = x.max(0) + u
    tags = [int((best + move[:, O]).argmax())]
    for b in reversed(back):
        tags.append(int(b[tags[-1]]))
    return tags[::-1]


def marginals(unary: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of many runs of one length (runs x places x tags): tag marginals, expected moves (summed over runs), log partition functions."""
    n, size, k = unary.shape
    a, b = np.empty_like(unary), np.empty_like(unary)
    a[:, 0] = move[O] + unary[:, 0]
    for i in range(1, size):
        a[:, i] = np.logaddexp.reduce(a[:, i - 1, :, None] + move, 1) + unary[:, i]
    b[:, -1] = move[:, O]
    for i in range(size - 2, -1, -1):
        b[:, i] = np.logaddexp.reduce(move + (unary[:, i + 1] + b[:, i + 1])[:, None], 2)
    z = np.logaddexp.reduce(a[:, -1] + move[:, O], 1)
    p = np.exp(a + b - z[:, None, None])
    pair = np.zeros((k, k))
    pair[O] += p[:, 0].sum(0)
    pair[:, O] += p[:, -1].sum(0)
    for i in range(1, size):
        pair += np.exp(a[:, i - 1, :, None] + move + (unary[:, i] + b[:, i])[:, None] - z[:, None, None]).sum(0)
    return p, pair, z


def train(texts: list[str], steps: int = 100, seed: int = 5, made: int = 1500, without: tuple[str, ...] = ()) -> Chain:
    """Conditional log likelihood of the windows by gradient steps (Adam). ``without``: kinds of made-up secrets to leave out."""
    g = random.Random(seed)
    texts = [t for t in texts if t]
    data: list[tuple[list[list[str]], list[int]]] = []
    for t in texts:
        data += windows(t, [(v, e) for _, _, e, v in base_matches(t)], file_features(t), g, False)
    for t, secret, of_file in invented(texts, g, made, without):
        data += windows(t, secret, of_file, g, True)
    if not any(any(tags) for _, tags in data):
        return Chain({}, np.zeros((3, 3)), 1e9)
    seen = Counter(f for feats, _ in data for fs in feats for f in fs)
    at = {f: k for k, f in enumerate(sorted(f for f, n in seen.items() if n > 2), 1)}
    size, width = 2 * AROUND + 1, max(sum(f in at for f in fs) for feats, _ in data for fs in feats)
    ids, tag, real = np.zeros((len(data), size, width), np.int32), np.zeros((len(data), size), np.int64), np.zeros((len(data), size), bool)
    for k, (feats, tags) in enumerate(data):
        for i, fs in enumerate(feats):
            own = [at[f] for f in fs if f in at]
            ids[k, i, : len(own)] = own
        tag[k, : len(tags)], real[k, : len(tags)] = tags, True
    w, move = np.zeros((len(at) + 1, 3)), np.zeros((3, 3))
    truth = np.eye(3)[tag]
    moves = np.zeros((3, 3))
    np.add.at(moves, (np.pad(tag, ((0, 0), (1, 0))), np.pad(tag, ((0, 0), (0, 1)))), 1.0)
    shut = np.where(real[..., None], 0.0, [0.0, -40.0, -40.0])
    m, v = [np.zeros_like(w), np.zeros_like(move)], [np.zeros_like(w), np.zeros_like(move)]
    flat = ids.ravel()
    for step in range(1, steps + 1):
        unary = np.stack([w[:, t][ids].sum(2) for t in range(3)], 2) + shut
        p, pair, _ = marginals(unary, move)
        d = (truth - p) * real[..., None]
        gw = np.stack([np.bincount(flat, weights=np.repeat(d[..., t].ravel(), width), minlength=len(w)) for t in range(3)], 1) - 0.3 * w
        gw[0] = 0
        for x, grad, a, b in ((w, gw, m[0], v[0]), (move, moves - pair - 0.3 * move, m[1], v[1])):
            a += 0.1 * (grad - a)
            b += 0.01 * (grad * grad - b)
            x += 0.1 * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
    return Chain({f: tuple(map(float, w[k])) for f, k in at.items()}, move)


class Tagger:
    """Decodes texts with a chain; potentials are remembered by token."""

    def __init__(self, c: Chain):
        self.c = c
        self.forms: dict[tuple, tuple[float, float]] = {}
        self.own = Remembered(self.own_score, 64_000_000)
        self.name = Remembered(lambda t: tuple(max(-NAME, min(NAME, x)) for x in c.score(name_features(t))), 4_000_000)
        self.next, self.gap = (Remembered(lambda t, of=of: c.score(of(t)), 4_000_000) for of in (next_features, gap_features))
        mv = c.move
        self.turn = max(mv[a, t] + mv[t, b] - mv[a, O] - mv[O, b] for a in range(3) for t in (B, I) for b in range(3)) - c.caution
        self.around = sum(c.most(x) for x in ("gap ", "assigned ", "line ", "next "))

    def own_score(self, raw: str) -> tuple[float, float]:
        """Words of one form have the same features: kind, length, distinct letters, share of vowels, moves between cases."""
        t = raw.rstrip(ENDS)
        n = len(t)
        if n > 63 or not t.isalpha():
            return self.c.score(own_features(raw))
        kind = kind_of(t)
        key = (kind, n, len(set(t)), 5 * sum(map(t.lower().count, "aeiouy")) // n, t.isascii(), len(PARTS.findall(t)) // 2 if kind == "miXed" else 0)
        x = self.forms.get(key)
        if x is None:
            x = self.forms[key] = self.c.score(own_features(raw))
        return x

    def spans(self, text: str) -> list[tuple[int, int]]:
        c, own = self.c, self.own
        tokens = set(TOKEN.findall(text))
        if not tokens or not c.weights:
            return []
        fb, fi = c.score(file_features(text))
        least = -(NAME + self.around + max(fb, fi) + self.turn)  # a token under it by itself is outside
        if max(max(own[t]) for t in tokens) < least:
            return []
        out: list[tuple[int, int]] = []
        run: list[tuple[int, int, float, float]] = []
        start, raw, before, end = 0, "", "", 0  # the token in hand waits for the one behind it

        def close() -> None:
            tags = viterbi(np.array([(0.0, b - c.caution, i - c.caution) for _, _, b, i in run]), c.move)
            last = O
            for t, (s, e, _, _) in zip(tags, run, strict=True):
                if t == I and last != O:
                    out[-1] = (out[-1][0], e)
                elif t != O:
                    out.append((s, e))
                last = t
            run.clear()

        def settle(behind: str) -> None:
            ob, oi = own[raw]
            if max(ob, oi) >= least:
                (nb, ni), (gb, gi), (xb, xi) = self.name[before], self.gap[text[end:start]], self.next[behind]
                b, i = ob + nb + gb + xb + fb, oi + ni + gi + xi + fi
                if max(b, i) + self.turn >= 0:
                    run.append((start, start + len(raw), b, i))
                    return
            if run:
                close()

        for m in TOKEN.finditer(text):
            t = m[0].rstrip(ENDS)
            if not t:
                continue
            if raw:
                settle(t)
                before, end = raw, start + len(raw)
            start, raw = m.start(), t
        if raw:
            settle("")
        if run:
            close()
        return out


def all_spans(text: str, tagger: Tagger) -> tuple[list, list]:
    """Base spans; base and crf spans, by start, then kind."""
    base = base_spans(text)
    extra = [(s, 3, e) for s, e in tagger.spans(text) if not any(x <= s and e <= z for x, _, z in base)]
    return base, sorted(base + extra)


def learn(docs: DataFrame, id_col: str, text_col: str, sample: int) -> Chain:
    text = F.col(text_col).cast("string")
    hit = text.rlike("AKIA|[0-9a-f]{32}|[sS]ecret|[pP]assw|[tT]oken ?[:=]|[aA][pP][iI]_?[kK]ey")
    rows = docs.select(F.col(id_col).cast("string").alias("i"), text.alias("text")).where("text is not null")
    n = {r.hit: r.n for r in rows.select(hit.alias("hit")).groupBy("hit").agg(F.count("*").alias("n")).collect()}

    def pick(k: bool) -> list[str]:
        """The filter by hash stands before the search, so that few texts are searched again. Of a long text the part around a pattern, or its
        middle, is enough to learn from, so that what comes to the driver is bounded."""
        if k not in n:
            return []
        some = sampled(rows, sample, "i", n=n[k], but=hit == k)
        first = F.regexp_instr("text", F.lit("AKIA|[0-9a-f]{32}|[sS]ecret|[pP]assw|[tT]oken ?[:=]|[aA][pP][iI]_?[kK]ey"))
        return sorted(r.text for r in some.select(F.substring(F.col("text"), F.greatest(F.when(F.lit(k), first).otherwise(F.length("text") / 2).cast("int") - LEARNT // 2, F.lit(1)), F.lit(LEARNT)).alias("text")).collect())

    return train([*pick(True), *pick(False)])


LEARNT = 6000  # characters of a sampled text that come to the driver


def render(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = 400) -> DataFrame:
    """Spans of secrets in each text, with counts of the base kinds."""
    chain = learn(docs, id_col, text_col, sample)
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    kinds = [pa.int64()] * 4 + [pa.string()] * 2

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(chain)
        gc.disable()  # what is remembered is no garbage
        for b in batches:
            out = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                base, full = all_spans(text.as_py() or "", tagger)
                n = [sum(k == x for _, k, _ in base) for x in range(3)]
                out.append((doc, *n, sha256(render(base).encode()).hexdigest(), render(full)))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=names)

    return mapped(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), each, SCHEMA)


def redact_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[SECRET]", sample: int = 400) -> DataFrame:
    """The same rows and columns with every span of the text replaced by ``mark``; overlapping spans become one. Null texts stay null."""
    chain = learn(docs, id_col, text_col, sample)
    at = docs.columns.index(text_col)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(chain)
        gc.disable()  # what is remembered is no garbage
        for b in batches:
            out = []
            for text in b.column(at):
                text = text.as_py()
                spans = all_spans(text, tagger)[1] if text else []
                parts, last = [], 0
                for s, _, e in spans:
                    if s >= last:
                        parts += [text[last:s], mark]
                    last = max(last, e)
                out.append("".join([*parts, text[last:]]) if spans else text)
            cols = list(b.columns)
            cols[at] = pa.array(out, b.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(cols, schema=b.schema)

    return mapped(docs, each, docs.schema)


def op2_secret_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))
