"""What builtins do to points-to sets: one row per flow, joined to calls instead of a handler for each."""

from __future__ import annotations

# (builtin, source, source field, target, target field).
# source: arg0.., any (every argument), rest (all but the first), kw (every keyword), recv. A field of '' is the value itself, '[]' its elements, '{}' its keys.
# target: result, recv, pair (the tuple that is the result's element), call (a parameter of the function given). '#' is the argument's position, '-' the one before.
ALLOCATES = {
    "list": "list", "tuple": "tuple", "set": "set", "dict": "dict", "frozenset": "set", "enumerate": "list", "zip": "list", "map": "list", "filter": "list", "reversed": "list", "sorted": "list", "range": "list",
    "len": "const", "isinstance": "const", "bool": "const", "int": "const", "float": "const", "str": "const", "repr": "const", "sum": "const", "abs": "const", "hash": "const", "id": "const", "ord": "const", "chr": "const",
    "dict.keys": "list", "dict.values": "list", "dict.items": "list", "list.copy": "list", "dict.copy": "dict", "set.copy": "set", "set.union": "set",
}
PAIRS = ("enumerate", "zip", "dict.items")
FLOWS = [
    *((b, "arg0", f, "result", "[]") for b in ("list", "tuple", "set", "frozenset", "reversed", "sorted") for f in ("[]", "{}")),
    ("enumerate", "arg0", "[]", "pair", "[1]"), ("enumerate", "arg0", "{}", "pair", "[1]"), ("zip", "any", "[]", "pair", "[#]"), ("zip", "any", "{}", "pair", "[#]"),
    ("map", "rest", "[]", "call", "arg-"), ("map", "rest", "{}", "call", "arg-"), ("filter", "arg1", "[]", "result", "[]"), ("filter", "arg1", "{}", "result", "[]"), ("filter", "arg1", "[]", "call", "arg0"), ("filter", "arg1", "{}", "call", "arg0"),
    ("iter", "arg0", "", "result", ""), ("next", "arg0", "[]", "result", ""), ("next", "arg0", "{}", "result", ""), ("next", "arg1", "", "result", ""), ("aiter", "arg0", "", "result", ""), ("anext", "arg0", "[]", "result", ""), ("anext", "arg1", "", "result", ""),
    *((b, "any", "", *to) for b in ("min", "max") for to in (("result", ""), ("call", "arg0"))), *((b, "arg0", "[]", *to) for b in ("min", "max") for to in (("result", ""), ("call", "arg0"))), ("sorted", "arg0", "[]", "call", "arg0"),
    ("sum", "arg0", "[]", "result", ""), ("sum", "arg1", "", "result", ""), ("getattr", "arg2", "", "result", ""), ("dict", "arg0", "[]", "result", "[]"), ("dict", "arg0", "{}", "result", "{}"), ("dict", "kw", "", "result", "[]"),
    ("list.append", "arg0", "", "recv", "[]"), ("list.insert", "arg1", "", "recv", "[]"), ("list.extend", "arg0", "[]", "recv", "[]"), ("list.pop", "recv", "[]", "result", ""), ("list.copy", "recv", "[]", "result", "[]"),
    ("set.add", "arg0", "", "recv", "[]"), ("set.update", "arg0", "[]", "recv", "[]"), ("set.pop", "recv", "[]", "result", ""), ("set.copy", "recv", "[]", "result", "[]"), ("set.union", "recv", "[]", "result", "[]"), ("set.union", "arg0", "[]", "result", "[]"),
    ("dict.get", "recv", "[]", "result", ""), ("dict.get", "arg1", "", "result", ""), ("dict.pop", "recv", "[]", "result", ""), ("dict.pop", "arg1", "", "result", ""), ("dict.setdefault", "recv", "[]", "result", ""), ("dict.setdefault", "arg1", "", "result", ""), ("dict.setdefault", "arg1", "", "recv", "[]"), ("dict.setdefault", "arg0", "", "recv", "{}"),
    ("dict.update", "arg0", "[]", "recv", "[]"), ("dict.update", "arg0", "{}", "recv", "{}"), ("dict.keys", "recv", "{}", "result", "[]"), ("dict.values", "recv", "[]", "result", "[]"), ("dict.items", "recv", "{}", "pair", "[0]"), ("dict.items", "recv", "[]", "pair", "[1]"), ("dict.copy", "recv", "[]", "result", "[]"), ("dict.copy", "recv", "{}", "result", "{}"),
]
# Builtins that call a function that they are given: which argument it is, and the result's field that its results reach ('' for none).
CALLBACKS = [("map", "arg0", "[]"), ("filter", "arg0", ""), ("sorted", "key", ""), ("min", "key", ""), ("max", "key", "")]
# Builtins that call a special method of their first argument, and whether its result is theirs.
PROTOCOLS = [
    ("len", "__len__", False), ("bool", "__bool__", False), ("int", "__int__", False), ("float", "__float__", False), ("str", "__str__", False), ("repr", "__repr__", False), ("hash", "__hash__", False),
    ("iter", "__iter__", True), ("next", "__next__", True), ("aiter", "__aiter__", True), ("anext", "__anext__", True), ("reversed", "__reversed__", True), ("abs", "__abs__", True),
]
