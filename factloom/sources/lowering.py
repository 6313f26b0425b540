"""Python source to flat instructions with labels and jumps, one list for each scope. Plain Python, no Spark.

An instruction names variables only: every sub-expression goes to a temporary ``$t<n>``, every literal to a pooled constant ``$c<n>``
set at the module's head. Loops test again on each turn; ``for`` asks HasNext before next(); ``with`` calls __enter__ and __exit__.

Exceptions: inside ``try`` and ``with`` a Catch stands before every statement and after the last, for each handler, finally part or __exit__ that an exception may reach, so
that what had been assigned by then is seen there. ``return``, ``break`` and ``continue`` run the finally parts and __exit__ calls that they leave: they set a
flag, jump there, and the flag is tested behind. Each such part is lowered once, however many ways lead through it.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

BINARY = {ast.Add: "add", ast.Sub: "sub", ast.Mult: "mul", ast.Div: "truediv", ast.FloorDiv: "floordiv", ast.Mod: "mod", ast.Pow: "pow", ast.MatMult: "matmul", ast.LShift: "lshift", ast.RShift: "rshift", ast.BitAnd: "and", ast.BitOr: "or", ast.BitXor: "xor"}
UNARY = {ast.USub: "neg", ast.UAdd: "pos", ast.Invert: "invert", ast.Not: "not"}
COMPARE = {ast.Eq: "eq", ast.NotEq: "ne", ast.Lt: "lt", ast.LtE: "le", ast.Gt: "gt", ast.GtE: "ge", ast.Is: "is", ast.IsNot: "isnot", ast.In: "in", ast.NotIn: "notin"}


PIECE = 100_000  # characters of a module parsed at once, about: a tree takes a hundred times its text
CUT = re.compile(r"\n(?=[^\W\d]|@)(?!(?:else|elif|except|finally)\b)")


def top_level(text: str, piece: int | None = None) -> Iterator[ast.stmt]:
    """The module's statements, one after the other."""
    for s, line in placed(text, piece):
        yield ast.increment_lineno(s, line) if line else s


def placed(text: str, piece: int | None = None) -> Iterator[tuple[ast.stmt, int]]:
    """The module's statements with the lines before their piece, which their own line numbers don't count. Large texts are parsed in pieces that end before a line that may begin a statement of the module.
    If a piece doesn't parse, its end was inside a string, a bracket or a continued line, and it grows; so an error is that of the whole text."""
    piece = PIECE if piece is None else piece
    at = line = 0
    while at < len(text) or not text:
        want = piece
        while True:
            cut = CUT.search(text, at + want)
            end = cut.end() if cut else len(text)
            try:
                todo = ast.parse(text[at:end]).body[::-1]
                break
            except SyntaxError:
                if end == len(text):
                    ast.parse(text)
                    raise
                want += want + 1
        while todo:
            yield todo.pop(), line
        line += text.count("\n", at, end) + text.count("\r", at, end) - text.count("\r\n", at, end)
        if not text:
            return
        at = end


@dataclass(slots=True)
class Instr:
    kind: str
    target: str | None = None
    base: str | None = None
    name: str | None = None
    label: str | None = None
    args: list[tuple[str, str | None, str]] = field(default_factory=list)  # (role, name, variable)
    line: int = 0

    def loads(self) -> set[str]:
        out = {v for _, _, v in self.args}
        return out | {self.base} if self.base and self.kind not in ("Del", "FuncDef", "ClassDef", "Import") else out


@dataclass
class Scope:
    qualname: str
    kind: str  # module, function, class
    parent: Scope | None
    body: list[Instr] = field(default_factory=list)
    params: list[tuple[str, str, bool]] = field(default_factory=list)  # (name, kind, has default)
    bases: list[str] = field(default_factory=list)
    decorators: list[str] = field(default_factory=list)
    globals: set[str] = field(default_factory=set)
    nonlocals: set[str] = field(default_factory=set)
    is_async: bool = False
    is_generator: bool = False
    line: int = 0

    def stores(self) -> set[str]:
        own = {i.target for i in self.body if i.target} | {i.base for i in self.body if i.kind == "Del"}
        return (own | {p[0] for p in self.params}) - self.globals - self.nonlocals


class Lowering:
    """Lowers one module; ``scopes`` lists its scopes, the module first; ``unknown`` what wasn't understood."""

    def __init__(self, name: str, text: str):
        self.scopes: list[Scope] = []
        self.unknown: list[tuple[str, str, int]] = []
        self.n = {"t": 0, "c": 0, "L": 0, "f": 0}
        self.pool: dict[tuple, str] = {}
        self.loops: list[tuple[str, str, int]] = []  # (next turn, end, cleanups around the loop)
        self.guards: list[list[Instr]] = []  # Catch instructions of what is around, innermost last
        self.cleanups: list[tuple[str, list]] = []  # (label, ways that lead through it) of finally parts and __exit__ calls around
        self.caught: tuple = ()
        self.taken: set[str] = set()
        self.before = 0  # lines before the piece of the text that is lowered
        self.module = self.scope = self.open(name, "module", None, 0)
        for s, self.before in placed(text):
            self.block([s])
        head = [Instr("Const", t, name=kind, args=[], label=value) for (kind, value), t in self.pool.items()]
        self.module.body[:0] = head
        self.held = {s.qualname: s.stores() for s in self.scopes}

    # -- places

    def line(self, node: ast.AST | None) -> int:
        return node.lineno + self.before if hasattr(node, "lineno") else 0

    def open(self, name: str, kind: str, parent: Scope | None, line: int) -> Scope:
        full = f"{parent.qualname}.{name}" if parent else name
        while full in self.taken:
            full += f"@{line}"
        self.taken.add(full)
        s = Scope(full, kind, parent, line=line)
        self.scopes.append(s)
        return s

    def fresh(self, kind: str = "t") -> str:
        self.n[kind] += 1
        return f"${kind}{self.n[kind]}"

    def emit(self, kind: str, node: ast.AST | None = None, **k) -> Instr:
        i = Instr(kind, line=self.line(node), **k)
        self.scope.body.append(i)
        return i

    def put(self, kind: str, node: ast.AST | None = None, **k) -> str:
        t = self.fresh()
        self.emit(kind, node, target=t, **k)
        return t

    def label(self, name: str) -> None:
        self.emit("Label", label=name)

    def constant(self, value: object) -> str:
        key = (type(value).__name__, repr(value))
        if key not in self.pool:
            self.pool[key] = self.fresh("c")
        return self.pool[key]

    # -- expressions: each gives the variable that holds the value

    def expr(self, e: ast.expr | None) -> str:
        if e is None:
            return self.constant(None)
        if isinstance(e, ast.Name):
            return e.id
        method = getattr(self, f"e_{type(e).__name__}", None)
        if method is None:
            self.unknown.append(("expression", type(e).__name__, self.line(e)))
            return self.put("Unknown", e, name=type(e).__name__)
        return method(e)

    def e_Constant(self, e: ast.Constant) -> str:
        return self.constant(e.value)

    def e_UnaryOp(self, e: ast.UnaryOp) -> str:
        if isinstance(e.op, ast.USub) and isinstance(e.operand, ast.Constant) and isinstance(e.operand.value, (int, float, complex)):
            return self.constant(-e.operand.value)
        return self.put("UnaryOp", e, name=UNARY[type(e.op)], args=[("pos", None, self.expr(e.operand))])

    def e_BinOp(self, e: ast.BinOp) -> str:
        return self.put("BinOp", e, name=BINARY[type(e.op)], args=[("pos", None, self.expr(e.left)), ("pos", None, self.expr(e.right))])

    def e_BoolOp(self, e: ast.BoolOp) -> str:
        out, end = self.fresh(), self.fresh("L")
        for k, v in enumerate(e.values):
            self.emit("Copy", e, target=out, args=[("pos", None, self.expr(v))])
            if k < len(e.values) - 1:
                self.emit("JumpIfFalse" if isinstance(e.op, ast.And) else "JumpIfTrue", e, label=end, args=[("pos", None, out)])
        self.label(end)
        return out

    def e_Compare(self, e: ast.Compare) -> str:
        out, end, left = self.fresh(), self.fresh("L"), self.expr(e.left)
        for k, (op, r) in enumerate(zip(e.ops, e.comparators, strict=True)):
            right = self.expr(r)
            self.emit("Compare", e, target=out, name=COMPARE[type(op)], args=[("pos", None, left), ("pos", None, right)])
            if k < len(e.ops) - 1:
                self.emit("JumpIfFalse", e, label=end, args=[("pos", None, out)])
            left = right
        if len(e.ops) > 1:
            self.label(end)
        return out

    def e_IfExp(self, e: ast.IfExp) -> str:
        out, other, end = self.fresh(), self.fresh("L"), self.fresh("L")
        self.emit("JumpIfFalse", e, label=other, args=[("pos", None, self.expr(e.test))])
        self.emit("Copy", e, target=out, args=[("pos", None, self.expr(e.body))])
        self.emit("Goto", e, label=end)
        self.label(other)
        self.emit("Copy", e, target=out, args=[("pos", None, self.expr(e.orelse))])
        self.label(end)
        return out

    def e_NamedExpr(self, e: ast.NamedExpr) -> str:
        self.assign(e.target, self.expr(e.value))
        return e.target.id

    def e_Lambda(self, e: ast.Lambda) -> str:
        name = self.fresh("f")
        self.function(name, e.args, [ast.copy_location(ast.Return(e.body), e)], [], e)
        return name

    def display(self, e: ast.expr, kind: str, elts: list[ast.expr]) -> str:
        args = [("star" if isinstance(x, ast.Starred) else "pos", None, self.expr(x.value if isinstance(x, ast.Starred) else x)) for x in elts]
        return self.put("Build", e, name=kind, args=args)

    def e_List(self, e: ast.List) -> str:
        return self.display(e, "list", e.elts)

    def e_Tuple(self, e: ast.Tuple) -> str:
        return self.display(e, "tuple", e.elts)

    def e_Set(self, e: ast.Set) -> str:
        return self.display(e, "set", e.elts)

    def e_Dict(self, e: ast.Dict) -> str:
        args = []
        for k, v in zip(e.keys, e.values, strict=True):
            args += [("star", None, self.expr(v))] if k is None else [("key", None, self.expr(k)), ("value", None, self.expr(v))]
        return self.put("Build", e, name="dict", args=args)

    def loops_of(self, gens: list[ast.comprehension], inner) -> None:
        if not gens:
            return inner()
        g, rest = gens[0], gens[1:]

        def body() -> None:
            skip = self.fresh("L")
            for test in g.ifs:
                self.emit("JumpIfFalse", test, label=skip, args=[("pos", None, self.expr(test))])
            self.loops_of(rest, inner)
            self.label(skip)

        self.each(g.target, self.expr(g.iter), body, g.is_async, g.iter)

    def comprehension(self, e: ast.expr, kind: str, method: str, value) -> str:
        out = self.put("Build", e, name=kind)
        self.loops_of(e.generators, lambda: value(out, method))
        return out

    def call_method(self, e: ast.AST, obj: str, method: str, *args: str) -> str:
        return self.put("Call", e, base=self.put("LoadAttr", e, base=obj, name=method), args=[("pos", None, a) for a in args])

    def e_ListComp(self, e: ast.ListComp) -> str:
        return self.comprehension(e, "list", "append", lambda out, m: self.call_method(e, out, m, self.expr(e.elt)))

    def e_SetComp(self, e: ast.SetComp) -> str:
        return self.comprehension(e, "set", "add", lambda out, m: self.call_method(e, out, m, self.expr(e.elt)))

    def e_DictComp(self, e: ast.DictComp) -> str:
        return self.comprehension(e, "dict", "", lambda out, _: self.emit("StoreSubscr", e, base=out, args=[("key", None, self.expr(e.key)), ("value", None, self.expr(e.value))]))

    def e_GeneratorExp(self, e: ast.GeneratorExp) -> str:
        name, first = self.fresh("f"), self.expr(e.generators[0].iter)
        source = ast.Name("$source", ast.Load())
        g0 = e.generators[0]
        gens = [ast.comprehension(g0.target, source, g0.ifs, g0.is_async), *e.generators[1:]]

        def body() -> None:
            self.loops_of(gens, lambda: self.put("Yield", e, args=[("pos", None, self.expr(e.elt))]))

        args = ast.arguments([], [ast.arg("$source")], None, [], [], None, [])
        self.function(name, args, body, [], e, generator=True)
        return self.put("Call", e, base=name, args=[("pos", None, first)])

    def e_Await(self, e: ast.Await) -> str:
        return self.put("Await", e, args=[("pos", None, self.expr(e.value))])

    def e_Yield(self, e: ast.Yield) -> str:
        self.scope.is_generator = True
        return self.put("Yield", e, args=[("pos", None, self.expr(e.value))])

    def e_YieldFrom(self, e: ast.YieldFrom) -> str:
        self.scope.is_generator = True
        return self.put("Yield", e, name="from", args=[("pos", None, self.expr(e.value))])

    def e_Call(self, e: ast.Call) -> str:
        f = self.expr(e.func)
        args = [("star", None, self.expr(a.value)) if isinstance(a, ast.Starred) else ("pos", None, self.expr(a)) for a in e.args]
        args += [("kw" if k.arg else "kwstar", k.arg, self.expr(k.value)) for k in e.keywords]
        return self.put("Call", e, base=f, args=args)

    def e_JoinedStr(self, e: ast.JoinedStr) -> str:
        args = []
        for v in e.values:
            args.append(("pos", None, self.expr(v.value if isinstance(v, ast.FormattedValue) else v)))
            if isinstance(v, ast.FormattedValue) and v.format_spec is not None:
                args.append(("format", None, self.expr(v.format_spec)))
        return self.put("Format", e, args=args)

    e_TemplateStr = e_JoinedStr

    def e_Attribute(self, e: ast.Attribute) -> str:
        return self.put("LoadAttr", e, base=self.expr(e.value), name=e.attr)

    def e_Subscript(self, e: ast.Subscript) -> str:
        return self.put("LoadSubscr", e, base=self.expr(e.value), args=[("key", None, self.expr(e.slice))])

    def e_Slice(self, e: ast.Slice) -> str:
        return self.put("Build", e, name="slice", args=[("pos", None, self.expr(x)) for x in (e.lower, e.upper, e.step)])

    def e_Starred(self, e: ast.Starred) -> str:
        return self.expr(e.value)

    # -- assignment

    def assign(self, target: ast.expr, value: str, node: ast.AST | None = None) -> None:
        node = node or target
        if isinstance(target, ast.Name):
            self.emit("Copy", node, target=target.id, args=[("pos", None, value)])
        elif isinstance(target, ast.Attribute):
            self.emit("StoreAttr", node, base=self.expr(target.value), name=target.attr, args=[("value", None, value)])
        elif isinstance(target, ast.Subscript):
            self.emit("StoreSubscr", node, base=self.expr(target.value), args=[("key", None, self.expr(target.slice)), ("value", None, value)])
        elif isinstance(target, ast.Starred):
            self.assign(target.value, value, node)
        elif isinstance(target, (ast.Tuple, ast.List)):
            n, star = len(target.elts), next((k for k, x in enumerate(target.elts) if isinstance(x, ast.Starred)), None)
            for k, x in enumerate(target.elts):
                if star is None or k < star:
                    key = self.constant(k)
                elif k == star:
                    key = self.put("Build", node, name="slice", args=[("pos", None, self.constant(v)) for v in (k, k + 1 - n or None, None)])
                else:
                    key = self.constant(k - n)
                self.assign(x, self.put("LoadSubscr", node, base=value, args=[("key", None, key)]), node)

    # -- statements

    def block(self, body: list[ast.stmt]) -> None:
        for s in body:
            self.catch(s)
            method = getattr(self, f"s_{type(s).__name__}", None)
            if method is None:
                self.unknown.append(("statement", type(s).__name__, s.lineno))
                self.emit("Unknown", s, name=type(s).__name__)
            else:
                method(s)
        if body and not isinstance(body[-1], (ast.Return, ast.Raise, ast.Break, ast.Continue)):
            self.catch(body[-1])

    def catch(self, node: ast.AST) -> None:
        """An exception here goes to any handler around, up to one that takes all (finally parts and __exit__ calls do)."""
        here = (self.scope.qualname, len(self.scope.body), len(self.guards), self.n["L"])
        if self.guards and here != self.caught:
            for g in reversed(self.guards):
                for c in g:
                    self.emit("Catch", node, label=c.label, name=c.name, args=c.args)
                if any(not c.args for c in g):
                    break
            self.caught = (self.scope.qualname, len(self.scope.body), len(self.guards), self.n["L"])

    def leave(self, depth: int, go) -> None:
        """``go`` on once the cleanups beyond the first ``depth`` have run, innermost first."""
        if len(self.cleanups) <= depth:
            go()
            return
        flag, (label, ways) = self.fresh(), self.cleanups[-1]
        ways.append((flag, depth, go))
        self.emit("Copy", target=flag, args=[("pos", None, self.constant(True))])
        self.emit("Goto", label=label)

    def guarded(self, node: ast.AST, body, close) -> None:
        """``body``, and ``close`` however body is left."""
        last, start, scope = self.fresh("L"), len(self.scope.body), self.scope
        ways: list[tuple] = []
        self.guards.append([Instr("Catch", label=last, name="finally")])
        self.cleanups.append((last, ways))
        self.catch(node)
        body()
        self.guards.pop()
        self.cleanups.pop()
        self.label(last)
        close()
        for flag, depth, go in ways:
            on = self.fresh("L")
            self.emit("JumpIfFalse", node, label=on, args=[("pos", None, flag)])
            self.leave(depth, go)
            self.label(on)
        unset = self.constant(False) if ways else None
        scope.body[start:start] = [Instr("Copy", flag, args=[("pos", None, unset)], line=self.line(node)) for flag, _, _ in ways]

    def s_Expr(self, s: ast.Expr) -> None:
        self.expr(s.value)

    def s_Assign(self, s: ast.Assign) -> None:
        if len(s.targets) == 1 and isinstance(s.targets[0], (ast.Tuple, ast.List)) and isinstance(s.value, (ast.Tuple, ast.List)):
            left, right = s.targets[0].elts, s.value.elts
            if len(left) == len(right) and not any(isinstance(x, ast.Starred) for x in (*left, *right)):
                held = [self.put("Copy", s, args=[("pos", None, self.expr(v))]) for v in right]
                for t, v in zip(left, held, strict=True):
                    self.assign(t, v, s)
                return
        value = self.expr(s.value)
        for t in s.targets:
            self.assign(t, value, s)

    def s_AugAssign(self, s: ast.AugAssign) -> None:
        """The target's object and key are computed once; the operator may change what the target holds in place."""
        t = s.target
        if isinstance(t, ast.Name):
            old, store = t.id, {"kind": "Copy", "target": t.id}
        elif isinstance(t, ast.Attribute):
            base = self.expr(t.value)
            old, store = self.put("LoadAttr", t, base=base, name=t.attr), {"kind": "StoreAttr", "base": base, "name": t.attr}
        else:
            base, key = self.expr(t.value), ("key", None, self.expr(t.slice))
            old, store = self.put("LoadSubscr", t, base=base, args=[key]), {"kind": "StoreSubscr", "base": base, "args": [key]}
        new = self.put("BinOp", s, name=BINARY[type(s.op)], label="inplace", args=[("pos", None, old), ("pos", None, self.expr(s.value))])
        role = "pos" if isinstance(t, ast.Name) else "value"
        self.emit(node=s, **{**store, "args": [*store.get("args", []), (role, None, new)]})

    def s_AnnAssign(self, s: ast.AnnAssign) -> None:
        if s.value is not None:
            self.assign(s.target, self.expr(s.value), s)
        if isinstance(s.target, ast.Name):
            self.emit("Anno", s, name=s.target.id, label=ast.unparse(s.annotation))

    def s_Return(self, s: ast.Return) -> None:
        value = self.expr(s.value)
        if self.cleanups:
            value = self.put("Copy", s, args=[("pos", None, value)])
        self.leave(0, lambda: self.emit("Return", s, args=[("pos", None, value)]))

    def s_Delete(self, s: ast.Delete) -> None:
        for t in s.targets:
            if isinstance(t, ast.Name):
                self.emit("Del", s, base=t.id)
            elif isinstance(t, (ast.Tuple, ast.List)):
                self.s_Delete(ast.copy_location(ast.Delete(t.elts), s))
            elif isinstance(t, ast.Attribute):
                self.emit("DelAttr", s, base=self.expr(t.value), name=t.attr)
            else:
                self.emit("DelSubscr", s, base=self.expr(t.value), args=[("key", None, self.expr(t.slice))])

    def s_Pass(self, s: ast.Pass) -> None:
        self.emit("Pass", s)

    def s_Global(self, s: ast.Global) -> None:
        self.scope.globals.update(s.names)

    def s_Nonlocal(self, s: ast.Nonlocal) -> None:
        self.scope.nonlocals.update(s.names)

    def s_If(self, s: ast.If) -> None:
        other, end = self.fresh("L"), self.fresh("L")
        self.emit("JumpIfFalse", s, label=other, args=[("pos", None, self.expr(s.test))])
        self.block(s.body)
        self.emit("Goto", s, label=end)
        self.label(other)
        self.block(s.orelse)
        self.label(end)

    def s_While(self, s: ast.While) -> None:
        top, other, end = (self.fresh("L") for _ in range(3))
        self.label(top)
        self.emit("JumpIfFalse", s, label=other, args=[("pos", None, self.expr(s.test))])
        self.loops.append((top, end, len(self.cleanups)))
        self.block(s.body)
        self.loops.pop()
        self.emit("Goto", s, label=top)
        self.label(other)
        self.block(s.orelse)
        self.label(end)

    def each(self, target: ast.expr, source: str, body, is_async: int, node: ast.AST, orelse: list[ast.stmt] = ()) -> None:  # type: ignore[assignment]
        top, other, end = (self.fresh("L") for _ in range(3))
        it = self.put("Call", node, base="aiter" if is_async else "iter", args=[("pos", None, source)])
        self.label(top)
        self.emit("JumpIfFalse", node, label=other, args=[("pos", None, self.put("HasNext", node, args=[("pos", None, it)]))])
        x = self.put("Call", node, base="anext" if is_async else "next", args=[("pos", None, it)])
        self.assign(target, self.put("Await", node, args=[("pos", None, x)]) if is_async else x, node)
        self.loops.append((top, end, len(self.cleanups)))
        body()
        self.loops.pop()
        self.emit("Goto", node, label=top)
        self.label(other)
        self.block(list(orelse))
        self.label(end)

    def s_For(self, s: ast.For) -> None:
        self.each(s.target, self.expr(s.iter), lambda: self.block(s.body), isinstance(s, ast.AsyncFor), s, s.orelse)

    s_AsyncFor = s_For

    def s_Break(self, s: ast.Break) -> None:
        _, end, depth = self.loops[-1]
        self.leave(depth, lambda: self.emit("Goto", s, label=end))

    def s_Continue(self, s: ast.Continue) -> None:
        top, _, depth = self.loops[-1]
        self.leave(depth, lambda: self.emit("Goto", s, label=top))

    def s_With(self, s: ast.With) -> None:
        self.within(s, s.items)

    def within(self, s: ast.With, items: list[ast.withitem]) -> None:
        """The items one in the other, the body in the last."""
        if not items:
            self.block(s.body)
            return
        is_async, item, none = isinstance(s, ast.AsyncWith), items[0], self.constant(None)
        wait = lambda v: self.put("Await", s, args=[("pos", None, v)]) if is_async else v
        m = self.expr(item.context_expr)
        v = wait(self.call_method(s, m, "__aenter__" if is_async else "__enter__"))

        def body() -> None:
            if item.optional_vars is not None:
                self.assign(item.optional_vars, v, s)
            self.within(s, items[1:])

        self.guarded(s, body, lambda: wait(self.call_method(s, m, "__aexit__" if is_async else "__exit__", none, none, none)))

    s_AsyncWith = s_With

    def s_Raise(self, s: ast.Raise) -> None:
        args = [("pos", None, self.expr(s.exc))] if s.exc else []
        self.emit("Raise", s, args=args + ([("cause", None, self.expr(s.cause))] if s.cause else []))

    def s_Assert(self, s: ast.Assert) -> None:
        end = self.fresh("L")
        self.emit("JumpIfTrue", s, label=end, args=[("pos", None, self.expr(s.test))])
        args = [("pos", None, self.expr(s.msg))] if s.msg else []
        self.emit("Raise", s, args=[("pos", None, self.put("Call", s, base="AssertionError", args=args))])
        self.label(end)

    def s_Try(self, s: ast.Try) -> None:
        if s.finalbody:
            self.guarded(s, lambda: self.handled(s), lambda: self.block(s.finalbody))
        else:
            self.handled(s)

    def handled(self, s: ast.Try) -> None:
        """The body with its handlers, and the else part, whose exceptions they don't see."""
        end = self.fresh("L")
        catches = []
        for h in s.handlers:
            kinds = h.type.elts if isinstance(h.type, ast.Tuple) else [h.type]
            catches.append(Instr("Catch", label=self.fresh("L"), name=h.name, args=[("pos", None, self.expr(k)) for k in kinds if k is not None]))
        self.guards.append(catches)
        self.block(s.body)
        self.guards.pop()
        self.block(s.orelse)
        self.emit("Goto", s, label=end)
        for h, c in zip(s.handlers, catches, strict=True):
            self.label(c.label)
            if h.name:
                self.emit("CatchBind", h, target=h.name, args=[("pos", None, self.expr(k)) for k in ([h.type] if h.type else [])])
            self.block(h.body)
            self.emit("Goto", h, label=end)
        self.label(end)

    s_TryStar = s_Try

    def s_Match(self, s: ast.Match) -> None:
        subject, end = self.expr(s.subject), self.fresh("L")
        for case in s.cases:
            skip = self.fresh("L")
            test = self.put("Match", case.pattern, label=ast.unparse(case.pattern), args=[("pos", None, subject)])
            self.emit("JumpIfFalse", case.pattern, label=skip, args=[("pos", None, test)])
            for p in ast.walk(case.pattern):
                bound = getattr(p, "name", None) if isinstance(p, (ast.MatchAs, ast.MatchStar)) else getattr(p, "rest", None)
                if bound:
                    part = subject if p is case.pattern else self.put("Match", p, name="part", args=[("pos", None, subject)])
                    self.emit("Copy", p, target=bound, args=[("pos", None, part)])
            if case.guard is not None:
                self.emit("JumpIfFalse", case.guard, label=skip, args=[("pos", None, self.expr(case.guard))])
            self.block(case.body)
            self.emit("Goto", case.pattern, label=end)
            self.label(skip)
        self.label(end)

    def s_Import(self, s: ast.Import) -> None:
        for a in s.names:
            self.emit("Import", s, target=a.asname or a.name.split(".")[0], base=a.name, label="0", name="whole" if a.asname else "top")

    def s_ImportFrom(self, s: ast.ImportFrom) -> None:
        for a in s.names:
            self.emit("Import", s, target=None if a.name == "*" else a.asname or a.name, base=s.module or "", name=f"from:{a.name}", label=str(s.level))

    # -- scopes

    def function(self, name: str, a: ast.arguments, body, decorators: list[ast.expr], node: ast.AST, is_async: bool = False, generator: bool = False) -> None:
        decos = [self.expr(d) for d in decorators]
        defaults = [("default", p.arg, self.expr(d)) for p, d in zip([*a.posonlyargs, *a.args][len(a.posonlyargs) + len(a.args) - len(a.defaults) :], a.defaults, strict=True)]
        defaults += [("default", p.arg, self.expr(d)) for p, d in zip(a.kwonlyargs, a.kw_defaults, strict=True) if d is not None]
        has = {n for _, n, _ in defaults}
        s = self.open(name, "function", self.scope, self.line(node))
        s.params = [(p.arg, "posonly", p.arg in has) for p in a.posonlyargs] + [(p.arg, "pos", p.arg in has) for p in a.args] + ([(a.vararg.arg, "star", True)] if a.vararg else []) + [(p.arg, "kwonly", p.arg in has) for p in a.kwonlyargs] + ([(a.kwarg.arg, "kwstar", True)] if a.kwarg else [])
        s.decorators = [ast.unparse(d) for d in decorators]
        s.is_async, s.is_generator = is_async, generator
        self.emit("FuncDef", node, target=name, base=s.qualname, args=defaults)
        self.inside(s, body if callable(body) else lambda: self.block(body))
        self.decorate(name, decos, s.decorators, node)

    def inside(self, scope: Scope, body) -> None:
        """``body`` in a scope of its own, without the loops, handlers and cleanups around."""
        outer = self.scope, self.loops, self.guards, self.cleanups
        self.scope, self.loops, self.guards, self.cleanups = scope, [], [], []
        body()
        self.scope, self.loops, self.guards, self.cleanups = outer

    def decorate(self, name: str, decos: list[str], texts: list[str], node: ast.AST) -> None:
        for d, text in reversed(list(zip(decos, texts, strict=True))):
            if text not in ("staticmethod", "classmethod", "property"):
                self.emit("Copy", node, target=name, args=[("pos", None, self.put("Call", node, base=d, args=[("pos", None, name)]))])

    def s_FunctionDef(self, s: ast.FunctionDef) -> None:
        self.function(s.name, s.args, s.body, s.decorator_list, s, isinstance(s, ast.AsyncFunctionDef))

    s_AsyncFunctionDef = s_FunctionDef

    def s_ClassDef(self, s: ast.ClassDef) -> None:
        decos = [self.expr(d) for d in s.decorator_list]
        args = [("base", None, self.expr(b)) for b in s.bases] + [("kw", k.arg, self.expr(k.value)) for k in s.keywords]
        c = self.open(s.name, "class", self.scope, s.lineno)
        c.bases = [v for r, _, v in args if r == "base"]
        c.decorators = [ast.unparse(d) for d in s.decorator_list]
        self.emit("ClassDef", s, target=s.name, base=c.qualname, args=args)
        self.inside(c, lambda: self.block(s.body))
        self.decorate(s.name, decos, c.decorators, s)

    def s_TypeAlias(self, s: ast.TypeAlias) -> None:
        self.emit("Anno", s, name=s.name.id, label=ast.unparse(s.value))

    # -- names

    def owner(self, scope: Scope, name: str) -> tuple[str, str]:
        """(owning scope, kind) of a name used in a scope: local, parameter, temporary, cell, global or builtin."""
        if name.startswith("$c"):
            return self.module.qualname, "temporary"
        if name in scope.globals:
            return self.module.qualname, "global"
        if name in self.held[scope.qualname]:
            return scope.qualname, "temporary" if name[0] == "$" else "parameter" if name in {p[0] for p in scope.params} else "global" if scope is self.module else "local"
        up = scope.parent
        while up is not None:
            if up.kind == "function" and name in self.held[up.qualname]:
                return up.qualname, "nonlocal" if name in scope.nonlocals else "cell"
            up = up.parent
        return (self.module.qualname, "global") if name in self.held[self.module.qualname] else ("", "builtin")


def rename(body: list[Instr], old: str, new: str) -> list[Instr]:
    """The instructions with one variable renamed."""
    r = lambda v: new if v == old else v
    return [Instr(i.kind, r(i.target), r(i.base) if i.kind not in ("FuncDef", "ClassDef", "Import") else i.base, i.name, i.label, [(a, n, r(v)) for a, n, v in i.args], i.line) for i in body]
