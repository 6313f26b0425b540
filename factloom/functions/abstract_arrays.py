"""``functions.abstract`` on numpy arrays, for tasks that hold the same node of many modules: a value is three arrays, a truth two (surely, surely not)."""

from __future__ import annotations

import numpy as np

from factloom.functions.abstract import ALWAYS, BIG, BIT, INF, NUMBER, SIZED, bits

Value = tuple[np.ndarray, np.ndarray, np.ndarray]
Truth = tuple[np.ndarray, np.ndarray]


def value(n: int, types: int, lo: float = INF, hi: float = -INF) -> Value:
    return np.full(n, types, np.int64), np.full(n, lo), np.full(n, hi)


def only(t: np.ndarray, of: int) -> np.ndarray:
    return (t != 0) & (t & ~of == 0)


def has(t: np.ndarray, of: int) -> np.ndarray:
    return t & of != 0


def where(cond: np.ndarray, v: Value, other: Value) -> Value:
    return np.where(cond, v[0], other[0]), np.where(cond, v[1], other[1]), np.where(cond, v[2], other[2])


def join(a: Value, b: Value) -> Value:
    return a[0] | b[0], np.minimum(a[1], b[1]), np.maximum(a[2], b[2])


def outward(t: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> Value:
    far = lambda x: has(t, BIT["int"]) & (np.abs(x) >= BIG) & (np.abs(x) < INF)
    step = 2.0**-51
    return t, np.where(far(lo), lo - np.abs(lo) * step, lo), np.where(far(hi), hi + np.abs(hi) * step, hi)


def truth(v: Value) -> Truth:
    t, lo, hi = v
    sized, none = only(t, NUMBER | SIZED), t == BIT["NoneType"]
    return only(t, ALWAYS) | sized & ((lo > 0) | (hi < 0)), none | sized & (lo == 0) & (hi == 0)


def flag(t: Truth) -> Value:
    return np.full(len(t[0]), BIT["bool"], np.int64), np.where(t[0], 1.0, 0.0), np.where(t[1], 0.0, 1.0)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.where((a == 0) | (b == 0), 0.0, a * b)


def binary(op: str, a: Value, b: Value) -> Value:
    (at, alo, ahi), (bt, blo, bhi) = a, b
    n, whole, logic = len(at), bits("int", "bool"), op in ("and", "or", "xor")
    real = (op == "truediv") | has(at, BIT["float"]) | has(bt, BIT["float"]) | ((op == "pow") & ~(blo >= 0))
    ints = (op != "truediv") & has(at, whole) & has(bt, whole) & ~(logic & only(at, BIT["bool"]) & only(bt, BIT["bool"]))
    bools = logic & has(at, BIT["bool"]) & has(bt, BIT["bool"])
    t = real * np.int64(BIT["float"]) | ints * np.int64(BIT["int"]) | bools * np.int64(BIT["bool"])
    known = only(at, NUMBER) & only(bt, NUMBER) & ~((op == "pow") & (alo < 0) & ~only(bt, whole))
    lo, hi = np.full(n, -INF), np.full(n, INF)
    with np.errstate(all="ignore"):
        if op == "add":
            lo, hi = alo + blo, ahi + bhi
        elif op == "sub":
            lo, hi = alo - bhi, ahi - blo
        elif op == "mul":
            ends = [_times(x, y) for x in (alo, ahi) for y in (blo, bhi)]
            lo, hi = np.minimum.reduce(ends), np.maximum.reduce(ends)
        elif op == "mod":
            rest = (blo > 0) & (bhi < INF)
            lo, hi = np.where(rest, 0.0, lo), np.where(rest, bhi, hi)
        lo, hi = np.where(np.isnan(lo), -INF, lo), np.where(np.isnan(hi), INF, hi)
        flags, wide = t == BIT["bool"], outward(t, lo, hi)
        numbers = t, np.where(flags, 0.0, wide[1]), np.where(flags, 1.0, wide[2])
        out = value(n, BIT["unknown"], -INF, INF)
        if op == "mod":
            out = where(at == BIT["str"], value(n, BIT["str"], 0.0, INF), out)
        if op == "add":
            out = where((at == bt) & (at == BIT["list"]), (at, np.zeros(n), np.full(n, INF)), out)
            out = where((at == bt) & np.isin(at, (BIT["str"], BIT["bytes"], BIT["tuple"])), (at, alo + blo, ahi + bhi), out)
    return where(known, numbers, out)


def unary(op: str, a: Value) -> Value:
    t, lo, hi = a
    if op == "not":
        yes, no = truth(a)
        return flag((no, yes))
    unknown = value(len(t), BIT["unknown"], -INF, INF)
    kind = t & ~BIT["bool"] | np.where(has(t, BIT["bool"]), BIT["int"], 0)
    return where(only(t, NUMBER), (kind, -hi, -lo) if op == "neg" else (kind, lo, hi), unknown) if op in ("neg", "pos") else unknown


def compare(op: str, a: Value, b: Value) -> Truth:
    (at, alo, ahi), (bt, blo, bhi) = a, b
    numbers, none, may = only(at, NUMBER) & only(bt, NUMBER), BIT["NoneType"], bits("NoneType", "unknown")
    if op in ("lt", "ge"):
        t = (ahi < blo, ~(ahi < blo) & (alo >= bhi)) if op == "lt" else (bhi <= alo, ~(bhi <= alo) & (blo > ahi))
    elif op in ("le", "gt"):
        t = (ahi <= blo, ~(ahi <= blo) & (alo > bhi)) if op == "le" else (bhi < alo, ~(bhi < alo) & (blo >= ahi))
    elif op in ("eq", "ne"):
        same = (alo == ahi) & (blo == bhi) & (alo == blo)
        t = same, ~same & ((ahi < blo) | (bhi < alo))
    elif op in ("is", "isnot"):
        numbers, same = True, (at == none) & (bt == none)
        t = same, ~same & ((at == none) & ~has(bt, may) | (bt == none) & ~has(at, may))
    else:
        t = (at < 0, at < 0)
    yes, no = t[0] & numbers, t[1] & numbers
    return (no, yes) if op in ("ne", "isnot") else (yes, no)


def called(name: str, n: int, a: Value) -> Value:
    t, lo, hi = a
    size, unknown = len(t), value(len(t), BIT["unknown"], -INF, INF)
    cut = lambda x: np.where(np.abs(x) < BIG, np.trunc(x) + 0.0, x)
    fixed = {"str": ("str", 0.0, INF), "isinstance": ("bool", 0.0, 1.0), "tuple": ("tuple", 0.0, INF), "list": ("list", 0.0, INF), "dict": ("dict", 0.0, INF), "set": ("set", 0.0, INF)}
    as_ = lambda kind: np.full(size, BIT[kind], np.int64)
    if name == "len" and n == 1:
        return where(only(t, SIZED), (as_("int"), np.maximum(lo, 0.0), hi), value(size, BIT["int"], 0.0, INF))
    if name == "int" and n == 0:
        return value(size, BIT["int"], 0.0, 0.0)
    if name in ("int", "float"):
        numbers = only(t, NUMBER) if n == 1 else np.zeros(size, bool)
        return where(numbers, (as_(name), cut(lo), cut(hi)) if name == "int" else (as_(name), lo, hi), value(size, BIT[name], -INF, INF))
    if name == "bool" and n == 1:
        return flag(truth(a))
    if name == "abs" and n == 1:
        small = np.where(lo >= 0, lo, np.where(hi <= 0, -hi, 0.0))
        return where(only(t, NUMBER) & ~has(t, BIT["bool"]), (t, small, np.maximum(np.abs(lo), np.abs(hi))), unknown)
    if name in fixed:
        kind, low, high = fixed[name]
        return value(size, BIT[kind], low, high)
    return a if name in ("min", "max") and n > 1 else unknown


def made(op: str, name: str, n: int, a: Value, b: Value) -> Value:
    """What a node makes of its operands, as ``operators.values`` has it; no types: no value."""
    there, nothing = a[0] != 0, value(len(a[0]), 0)
    if op == "join":
        return a
    if op in ("BinOp", "Compare"):
        return where(there & (b[0] != 0), binary(name, a, b) if op == "BinOp" else flag(compare(name, a, b)), nothing)
    if op == "UnaryOp":
        return where(there, unary(name, a), nothing)
    if op == "builtin":
        return where(there | (n == 0), called(name, n, a), nothing)
    if op == "edge" and name in ("true", "false"):
        return where(there & ~truth(a)[name == "true"], value(len(there), BIT["int"]), nothing)
    return nothing
