"""Abstract values as three columns, and what instructions make of them: types, lo, hi.

``types`` is a set of type names as bits. ``lo`` and ``hi`` bound numbers, and the sizes of strings and containers; a value of types without
bounds (None, functions, ...) has lo = inf and hi = -inf, so joins are bit_or, min and max. No bits: no value (not reached). Sizes of
containers that can change are unbounded, for other names may hold the same one. Integers from 2^53 on have their bounds rounded outward.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

TYPES = ("int", "float", "bool", "str", "bytes", "NoneType", "list", "tuple", "dict", "set", "function", "class", "instance", "module", "unknown")
BIT = {t: 1 << i for i, t in enumerate(TYPES)}
INF = float("inf")
BIG = float(1 << 53)


def bits(*names: str) -> int:
    return sum(BIT[n] for n in names)


NUMBER, MUTABLE = bits("int", "float", "bool"), bits("list", "dict", "set")
FIXED = bits("str", "bytes", "tuple")
SIZED, ALWAYS = MUTABLE | FIXED, bits("function", "class", "module")
Value = tuple[Column, Column, Column]
MERGE = {"types": F.bit_or, "lo": F.min, "hi": F.max}


def value(types: int, lo: float = INF, hi: float = -INF) -> Value:
    return F.lit(types).cast("long"), F.lit(lo), F.lit(hi)


def unknown() -> Value:
    return value(BIT["unknown"], -INF, INF)


def only(types: Column, of: int) -> Column:
    """All types are among those."""
    return (types != 0) & (types.bitwiseAND(F.lit(~of)) == 0)


def has(types: Column, of: int) -> Column:
    return types.bitwiseAND(F.lit(of)) != 0


def pick(*cases: tuple[Column, Value], other: Value) -> Value:
    """The value of the first case that holds."""
    return tuple(reduce(lambda rest, case: F.when(case[0], case[1][i]).otherwise(rest), reversed(cases), other[i]) for i in range(3))  # type: ignore[return-value]


def struct(v: Value) -> Column:
    return F.struct(v[0].cast("long").alias("types"), v[1].cast("double").alias("lo"), v[2].cast("double").alias("hi"))


def fields(c: str) -> Value:
    return F.col(f"{c}.types"), F.col(f"{c}.lo"), F.col(f"{c}.hi")


def names(types: Column) -> Column:
    """Type names, sorted and joined."""
    return F.array_join(F.array_sort(F.array_compact(F.array(*[F.when(has(types, b), t) for t, b in BIT.items()]))), ",")


def outward(types: Column, lo: Column, hi: Column) -> Value:
    far = lambda x: has(types, BIT["int"]) & (F.abs(x) >= BIG) & (F.abs(x) < INF)
    step = 2.0**-51
    return types, F.when(far(lo), lo - F.abs(lo) * step).otherwise(lo), F.when(far(hi), hi + F.abs(hi) * step).otherwise(hi)


def constant(kind: Column, text: Column) -> Value:
    """Of a literal's type name and source text."""
    number = F.regexp_replace(F.lower(text), "_", "")
    code = lambda x, n, base: F.conv(F.substring(x, 3, 1000), base, 10).cast("double")
    n = F.when(text == "True", 1.0).when(text == "False", 0.0).when(number.startswith("0x"), code(number, 3, 16)).when(number.startswith("0o"), code(number, 3, 8)).when(number.startswith("0b"), code(number, 3, 2)).otherwise(number.try_cast("double"))
    n = F.when((F.length(number) < 18) | ~number.rlike("^0[xob]"), n)
    plain = text.rlike("^'[^'\\\\]*'$") | text.rlike('^"[^"\\\\]*"$')
    size = (F.length(text) - 2).cast("double")
    bit = F.create_map(*[F.lit(x) for kv in BIT.items() for x in kv])[kind]
    other = pick((kind.isin("NoneType"), value(BIT["NoneType"])), (bit.isNull(), unknown()), other=(bit.cast("long"), F.lit(-INF), F.lit(INF)))
    return pick((kind.isin("int", "float", "bool") & n.isNotNull() & ~F.isnan(n), outward(bit.cast("long"), n, n)), ((kind == "str") & plain, (bit.cast("long"), size, size)), other=other)


def truth(v: Value) -> Column:
    """True, false, or null if either may be."""
    t, lo, hi = v
    sized = only(t, NUMBER | SIZED)
    return F.when(t == BIT["NoneType"], False).when(only(t, ALWAYS), True).when(sized & ((lo > 0) | (hi < 0)), True).when(sized & (lo == 0) & (hi == 0), False)


def flag(t: Column) -> Value:
    """The bool of a truth."""
    return F.lit(BIT["bool"]).cast("long"), F.when(t, 1.0).otherwise(0.0), F.when(~t, 0.0).otherwise(1.0)


def _times(a: Column, b: Column) -> Column:
    return F.when((a == 0) | (b == 0), 0.0).otherwise(a * b)


def binary_stages() -> list[dict[str, Column]]:
    """Stages of columns, the last of which adds ``binary``, the value of operator ``name`` on a and b (structs). Stages keep expressions small."""
    op, c = F.col("name"), F.col
    at, alo, ahi, bt, blo, bhi = (c(f"{v}.{x}") for v in "ab" for x in ("types", "lo", "hi"))
    real, whole, none = F.lit(BIT["float"]).cast("long"), bits("int", "bool"), F.lit(0).cast("long")
    logic = op.isin("and", "or", "xor")
    may_float = (op == "truediv") | has(at, BIT["float"]) | has(bt, BIT["float"]) | ((op == "pow") & ~(blo >= 0))
    may_int = (op != "truediv") & has(at, whole) & has(bt, whole) & ~(logic & only(at, BIT["bool"]) & only(bt, BIT["bool"]))
    may_bool = logic & has(at, BIT["bool"]) & has(bt, BIT["bool"])
    kinds = F.when(may_float, real).otherwise(none).bitwiseOR(F.when(may_int, F.lit(BIT["int"]).cast("long")).otherwise(none)).bitwiseOR(F.when(may_bool, F.lit(BIT["bool"]).cast("long")).otherwise(none))
    ends = [_times(x, y) for x in (alo, ahi) for y in (blo, bhi)]
    rest = (op == "mod") & (blo > 0) & (bhi < INF)
    first = {
        "_t": kinds,
        "_n": only(at, NUMBER) & only(bt, NUMBER) & ~((op == "pow") & (alo < 0) & ~only(bt, whole)),  # roots of negative numbers are complex
        "_lo": F.when(op == "add", alo + blo).when(op == "sub", alo - bhi).when(op == "mul", F.least(*ends)).when(rest, 0.0).otherwise(-INF),
        "_hi": F.when(op == "add", ahi + bhi).when(op == "sub", ahi - blo).when(op == "mul", F.greatest(*ends)).when(rest, bhi).otherwise(INF),
    }
    second = {"_lo": F.when(F.isnan("_lo"), -INF).otherwise(c("_lo")), "_hi": F.when(F.isnan("_hi"), INF).otherwise(c("_hi"))}
    flags = c("_t") == BIT["bool"]
    numbers = struct((c("_t"), *(F.when(flags, float(k)).otherwise(x) for k, x in enumerate(outward(c("_t"), c("_lo"), c("_hi"))[1:]))))
    same = (op == "add") & (at == bt)
    out = F.when(c("_n"), numbers).when(same & at.isin(bits("str"), bits("bytes"), bits("tuple")), struct((at, alo + blo, ahi + bhi)))
    out = out.when(same & (at == bits("list")), struct((at, F.lit(0.0), F.lit(INF)))).when((op == "mod") & (at == bits("str")), struct(value(bits("str"), 0.0, INF))).otherwise(struct(unknown()))
    return [first, second, {"binary": out}]


def unary(op: Column, a: Value) -> Value:
    t, lo, hi = a
    kind = F.when(only(t, BIT["bool"]), F.lit(BIT["int"]).cast("long")).otherwise(t.bitwiseAND(F.lit(~BIT["bool"])).bitwiseOR(F.when(has(t, BIT["bool"]), F.lit(BIT["int"])).otherwise(F.lit(0)).cast("long")))
    return pick((op == "not", flag(~truth(a))), ((op == "neg") & only(t, NUMBER), (kind, -hi, -lo)), ((op == "pos") & only(t, NUMBER), (kind, lo, hi)), other=unknown())


def compare(op: Column, a: Value, b: Value) -> Column:
    """Truth of a comparison."""
    (at, alo, ahi), (bt, blo, bhi) = a, b
    numbers = only(at, NUMBER) & only(bt, NUMBER)
    lt = lambda x, y: F.when(x[2] < y[1], True).when(x[1] >= y[2], False)
    le = lambda x, y: F.when(x[2] <= y[1], True).when(x[1] > y[2], False)
    eq = F.when((alo == ahi) & (blo == bhi) & (alo == blo), True).when((ahi < blo) | (bhi < alo), False)
    none, may = BIT["NoneType"], bits("NoneType", "unknown")
    same = F.when((at == none) & (bt == none), True).when((at == none) & ~has(bt, may) | (bt == none) & ~has(at, may), False)
    out = F.when(numbers & (op == "lt"), lt(a, b)).when(numbers & (op == "le"), le(a, b)).when(numbers & (op == "gt"), lt(b, a)).when(numbers & (op == "ge"), le(b, a))
    return out.when(numbers & (op == "eq"), eq).when(numbers & (op == "ne"), ~eq).when(op == "is", same).when(op == "isnot", ~same)


CALLED = ("len", "int", "float", "bool", "str", "abs", "list", "tuple", "dict", "set", "isinstance", "min", "max")


def called(name: Column, n: Column, a: Value) -> Value:
    """A builtin of n arguments; a joins them."""
    t, lo, hi = a
    zero, cut = F.lit(0.0), lambda x: F.when(F.abs(x) == INF, x).when(x < 0, F.ceil(x).cast("double")).otherwise(F.floor(x).cast("double"))
    big = F.when(F.abs(lo) < BIG, cut(lo)).otherwise(lo), F.when(F.abs(hi) < BIG, cut(hi)).otherwise(hi)
    one, is_ = n == 1, lambda x: name == x
    i, f = F.lit(BIT["int"]).cast("long"), F.lit(BIT["float"]).cast("long")
    small = F.when(lo >= 0, lo).when(hi <= 0, -hi).otherwise(zero)
    return pick(
        (is_("len") & one & only(t, SIZED), (i, F.greatest(lo, zero), hi)),
        (is_("len") & one, (i, zero, F.lit(INF))),
        (is_("int") & (n == 0), value(BIT["int"], 0.0, 0.0)),
        (is_("int") & one & only(t, NUMBER), (i, *big)),
        (is_("int"), value(BIT["int"], -INF, INF)),
        (is_("float") & one & only(t, NUMBER), (f, lo, hi)),
        (is_("float"), value(BIT["float"], -INF, INF)),
        (is_("bool") & one, flag(truth(a))),
        (is_("abs") & one & only(t, NUMBER) & ~has(t, BIT["bool"]), (t, small, F.greatest(F.abs(lo), F.abs(hi)))),
        (is_("str"), value(BIT["str"], 0.0, INF)),
        (is_("isinstance"), value(BIT["bool"], 0.0, 1.0)),
        (is_("tuple"), value(BIT["tuple"], 0.0, INF)),
        (is_("list"), value(BIT["list"], 0.0, INF)),
        (is_("dict"), value(BIT["dict"], 0.0, INF)),
        (is_("set"), value(BIT["set"], 0.0, INF)),
        (name.isin("min", "max") & (n > 1), a),
        other=unknown(),
    )


def widened(v: Value, old: Value) -> Value:
    """Bounds that still move become unbounded."""
    return v[0], F.when(v[1] < old[1], -INF).otherwise(v[1]), F.when(v[2] > old[2], INF).otherwise(v[2])
