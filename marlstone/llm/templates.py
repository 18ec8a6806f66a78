"""A sandboxed template language: lexer, parser to a syntax tree, constant folding, compilation to closures.

Statements: for / endfor, if / elif / else / endif, set, generation / endgeneration.  Expressions: literals, names,
lookups by key (a.b, a['b'], a[0]), not, and, or, comparisons, in, + - * / % ~, filters by name.  Lookups reach
dictionary keys and list items only, never Python attributes; there are no calls, and filters come from a fixed
table.  A compiled template yields (text, in generation) pieces as it goes, so that its input may be a stream.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any


class TemplateError(ValueError):
    pass


@dataclass(frozen=True)
class Const:
    value: Any


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Item:
    of: Any
    key: Any


@dataclass(frozen=True)
class Op:
    name: str
    args: tuple


@dataclass(frozen=True)
class Filter:
    name: str
    of: Any


@dataclass(frozen=True)
class Emit:
    value: Any


@dataclass(frozen=True)
class For:
    name: str
    over: Any
    body: tuple


@dataclass(frozen=True)
class If:
    test: Any
    then: tuple
    other: tuple


@dataclass(frozen=True)
class Set:
    name: str
    value: Any


@dataclass(frozen=True)
class Generation:
    body: tuple


FILTERS: dict[str, Callable[[Any], Any]] = {
    "trim": lambda x: str(x).strip(),
    "lower": lambda x: str(x).lower(),
    "upper": lambda x: str(x).upper(),
    "length": len,
    "string": str,
    "first": lambda x: x[0],
    "last": lambda x: x[-1],
}
_DIVIDE = {"/": operator.truediv, "%": operator.mod}
_OPS: dict[str, Callable] = {
    "+": operator.add, "-": operator.sub, "*": operator.mul, "~": lambda a, b: f"{a}{b}", "==": operator.eq, "!=": operator.ne,
    "<": operator.lt, ">": operator.gt, "<=": operator.le, ">=": operator.ge, "in": lambda a, b: a in b, "not in": lambda a, b: a not in b,
    "not": operator.not_, "neg": operator.neg, **_DIVIDE,
}
_CONSTANTS = {"true": True, "false": False, "none": None, "True": True, "False": False, "None": None}
_WORDS = frozenset("for in endfor if elif else endif set generation endgeneration not and or".split())

_TAG = re.compile(r"\{%(-?)(.*?)(-?)%\}|\{\{(-?)(.*?)(-?)\}\}|\{#.*?#\}", re.S)
_TOKEN = re.compile(r"""\s*(?:('(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(\d+(?:\.\d+)?)|([A-Za-z_]\w*)|(==|!=|<=|>=|[-+*/%~<>=|.,\[\]()]))""", re.S)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "\\": "\\", "'": "'", '"': '"'}


def _tokens(source: str) -> list[tuple[str, Any]]:
    out, at = [], 0
    source = source.rstrip()
    while at < len(source):
        m = _TOKEN.match(source, at)
        if not m:
            raise TemplateError(f"unexpected {source[at:at + 12]!r}")
        at = m.end()
        if m[1] is not None:
            out.append(("const", re.sub(r"\\(.)", lambda e: _ESCAPES.get(e[1], e[0]), m[1][1:-1], flags=re.S)))
        elif m[2] is not None:
            out.append(("const", float(m[2]) if "." in m[2] else int(m[2])))
        elif m[3] is not None:
            out.append(("const", _CONSTANTS[m[3]]) if m[3] in _CONSTANTS else ("word" if m[3] in _WORDS else "name", m[3]))
        else:
            out.append(("mark", m[4]))
    return out


class _Expression:
    """Recursive descent over one tag's tokens, loosest binding first."""

    def __init__(self, tokens: list[tuple[str, Any]]):
        self.tokens, self.at = tokens, 0

    def take(self, *values: str) -> str | None:
        if self.at < len(self.tokens) and self.tokens[self.at][0] in ("mark", "word") and self.tokens[self.at][1] in values:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def need(self, value: str) -> None:
        if not self.take(value):
            raise TemplateError(f"expected {value!r}")

    def name(self) -> str:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] != "name":
            raise TemplateError("expected a name")
        self.at += 1
        name = self.tokens[self.at - 1][1]
        if name.startswith("_"):
            raise TemplateError(f"{name!r} is not open to templates")
        return name

    def end(self) -> None:
        if self.at != len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")

    def whole(self):
        left = self.conjunction()
        while self.take("or"):
            left = Op("or", (left, self.conjunction()))
        return left

    def conjunction(self):
        left = self.negation()
        while self.take("and"):
            left = Op("and", (left, self.negation()))
        return left

    def negation(self):
        return Op("not", (self.negation(),)) if self.take("not") else self.comparison()

    def comparison(self):
        left = self.sum()
        while True:
            if mark := self.take("==", "!=", "<=", ">=", "<", ">", "in"):
                left = Op(mark, (left, self.sum()))
            elif self.take("not"):
                self.need("in")
                left = Op("not in", (left, self.sum()))
            else:
                return left

    def sum(self):
        left = self.product()
        while mark := self.take("+", "-", "~"):
            left = Op(mark, (left, self.product()))
        return left

    def product(self):
        left = self.unary()
        while mark := self.take("*", "/", "%"):
            left = Op(mark, (left, self.unary()))
        return left

    def unary(self):
        return Op("neg", (self.unary(),)) if self.take("-") else self.postfix()

    def postfix(self):
        left = self.primary()
        while True:
            if self.take("."):
                left = Item(left, Const(self.name()))
            elif self.take("["):
                left = Item(left, self.whole())
                self.need("]")
            elif self.take("|"):
                left = Filter(self.name(), left)
            else:
                return left

    def primary(self):
        if self.take("("):
            inner = self.whole()
            self.need(")")
            return inner
        if self.at < len(self.tokens) and self.tokens[self.at][0] == "const":
            self.at += 1
            return Const(self.tokens[self.at - 1][1])
        return Name(self.name())


def parse(source: str) -> tuple:
    """The syntax tree: a tuple of statements."""
    items: list[tuple[str, Any]] = []
    at, strip = 0, False
    for m in _TAG.finditer(source):
        text = source[at : m.start()]
        text = text.lstrip() if strip else text
        if m[1] or m[4]:
            text = text.rstrip()
        if text:
            items.append(("text", text))
        if m[2] is not None:
            items.append(("do", _Expression(_tokens(m[2]))))
        elif m[5] is not None:
            items.append(("put", _Expression(_tokens(m[5]))))
        at, strip = m.end(), bool(m[3] or m[6])
    text = source[at:]
    items.append(("text", text.lstrip() if strip else text))
    body, at, ended = _block(items, 0, ())
    if ended:
        raise TemplateError(f"unexpected {ended!r}")
    return body


def _block(items: list, at: int, ends: tuple[str, ...]) -> tuple[tuple, int, str | None]:
    """Statements up to one of ends; its tag stays for the caller to read on."""
    out: list = []
    while at < len(items):
        kind, x = items[at]
        at += 1
        if kind == "text":
            out.append(Emit(Const(x)))
            continue
        if kind == "put":
            out.append(Emit(x.whole()))
            x.end()
            continue
        word = x.take("for", "if", "set", "generation", "endfor", "elif", "else", "endif", "endgeneration")
        if word in ends:
            return tuple(out), at, word
        if word == "for":
            name = x.name()
            x.need("in")
            over = x.whole()
            body, at, _ = _block(items, at, ("endfor",))
            out.append(For(name, over, body))
        elif word == "if":
            found, at = _branches(x.whole(), items, at)
            out.append(found)
        elif word == "set":
            name = x.name()
            x.need("=")
            out.append(Set(name, x.whole()))
        elif word == "generation":
            body, at, _ = _block(items, at, ("endgeneration",))
            out.append(Generation(body))
        else:
            raise TemplateError(f"unexpected statement {word!r}")
        if word != "if":
            x.end()
    if ends:
        raise TemplateError(f"missing {ends[-1]!r}")
    return tuple(out), at, None


def _branches(test, items: list, at: int) -> tuple[If, int]:
    then, at, word = _block(items, at, ("elif", "else", "endif"))
    if word == "elif":
        other, at = _branches(items[at - 1][1].whole(), items, at)
        return If(test, then, (other,)), at
    other: tuple = ()
    if word == "else":
        other, at, _ = _block(items, at, ("endif",))
    return If(test, then, other), at


def fold(node):
    """The tree with constant parts worked out: operators and filters on constants, decided branches, joined texts."""
    if isinstance(node, tuple):
        out: list = []
        for x in node:
            x = fold(x)
            for y in x if isinstance(x, tuple) else (x,):
                if isinstance(y, Emit) and isinstance(y.value, Const):
                    text = _text(y.value.value)
                    if out and isinstance(out[-1], Emit) and isinstance(out[-1].value, Const):
                        out[-1] = Emit(Const(out[-1].value.value + text))
                    elif text:
                        out.append(Emit(Const(text)))
                else:
                    out.append(y)
        return tuple(out)
    if isinstance(node, Op):
        args = tuple(map(fold, node.args))
        if isinstance(args[0], Const) and node.name in ("and", "or"):
            return args[1] if bool(args[0].value) == (node.name == "and") else args[0]
        if all(isinstance(a, Const) for a in args):
            try:
                return Const(_OPS[node.name](*(a.value for a in args)))
            except (TypeError, ZeroDivisionError):
                return Op(node.name, args)  # left to fail where it is reached
        if node.name == "+" and isinstance(args[1], Const) and isinstance(args[1].value, str) and isinstance(args[0], Op) and args[0].name == "+" and isinstance(args[0].args[1], Const) and isinstance(args[0].args[1].value, str):
            return Op("+", (args[0].args[0], Const(args[0].args[1].value + args[1].value)))
        return Op(node.name, args)
    if isinstance(node, Filter):
        of = fold(node.of)
        return Const(FILTERS[node.name](of.value)) if isinstance(of, Const) and node.name in FILTERS else Filter(node.name, of)
    if isinstance(node, Item):
        return Item(fold(node.of), fold(node.key))
    if isinstance(node, Emit):
        return Emit(fold(node.value))
    if isinstance(node, For):
        return For(node.name, fold(node.over), fold(node.body))
    if isinstance(node, If):
        test = fold(node.test)
        if isinstance(test, Const):
            return fold(node.then if test.value else node.other)
        return If(test, fold(node.then), fold(node.other))
    if isinstance(node, Set):
        return Set(node.name, fold(node.value))
    if isinstance(node, Generation):
        return Generation(fold(node.body))
    return node


def _text(value: Any) -> str:
    return "" if value is None else str(value)


def _expression(node, filters: dict) -> Callable[[dict], Any]:
    if isinstance(node, Const):
        value = node.value
        return lambda env: value
    if isinstance(node, Name):
        name = node.name
        return lambda env: env.get(name)
    if isinstance(node, Item):
        of, key = _expression(node.of, filters), _expression(node.key, filters)

        def item(env):
            held, k = of(env), key(env)
            if isinstance(held, dict):
                return held.get(k)
            if isinstance(held, (list, tuple, str)) and isinstance(k, int):
                return held[k] if -len(held) <= k < len(held) else None
            return None

        return item
    if isinstance(node, Filter):
        if node.name not in filters:
            raise TemplateError(f"no filter {node.name!r}")
        f, of = filters[node.name], _expression(node.of, filters)
        return lambda env: f(of(env))
    a, *b = (_expression(x, filters) for x in node.args)
    if node.name == "and":
        return lambda env: a(env) and b[0](env)
    if node.name == "or":
        return lambda env: a(env) or b[0](env)
    f = _OPS[node.name]
    return (lambda env: f(a(env), b[0](env))) if b else (lambda env: f(a(env)))


Piece = tuple[str, bool]


def _statement(node, filters: dict) -> Callable[[dict, bool], Iterator[Piece]]:
    if isinstance(node, tuple):
        steps = [_statement(x, filters) for x in node]

        def block(env, learn):
            for step in steps:
                yield from step(env, learn)

        return block
    if isinstance(node, Emit):
        value = _expression(node.value, filters)

        def emit(env, learn):
            text = _text(value(env))
            if text:
                yield text, learn

        return emit
    if isinstance(node, If):
        test, then, other = _expression(node.test, filters), _statement(node.then, filters), _statement(node.other, filters)
        return lambda env, learn: then(env, learn) if test(env) else other(env, learn)
    if isinstance(node, Set):
        name, value = node.name, _expression(node.value, filters)

        def put(env, learn):
            env[name] = value(env)
            yield from ()

        return put
    if isinstance(node, Generation):
        body = _statement(node.body, filters)
        return lambda env, learn: body(env, True)
    name, over, body = node.name, _expression(node.over, filters), _statement(node.body, filters)

    def loop(env, learn):
        rows = iter(over(env) or ())
        done = object()
        now, i = next(rows, done), 0
        while now is not done:
            after = next(rows, done)
            inner = dict(env)
            inner[name] = now
            inner["loop"] = {"index": i + 1, "index0": i, "first": i == 0, "last": after is done}
            yield from body(inner, learn)
            now, i = after, i + 1

    return loop


class Template:
    """render(**names) yields (text, in generation); a name's list may be any iterator."""

    def __init__(self, source: str, filters: dict[str, Callable[[Any], Any]] | None = None):
        self.tree = fold(parse(source))
        self._run = _statement(self.tree, FILTERS | (filters or {}))

    def render(self, **names: Any) -> Iterator[Piece]:
        return self._run(dict(names), False)
