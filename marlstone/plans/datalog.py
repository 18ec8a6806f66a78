"""A small Datalog: rules over DataFrames, compiled to DataFrame plans.

    head(x, y) :- relation(column: x, other: 'constant'), rule(y, x), not other(x), x > 3, y = $param.
    ?(x, count(y)) :- head(x, y).
    :order -x, y
    :limit 10

Atoms over base tables name their columns; atoms over rules go by position.  Several rules with one head are a union;
heads have set semantics.  A recursive rule is evaluated semi-naively: each round joins only the rows that are new, and
writes them as a work table.  Head aggregates are count, sum, min, max.  Two fixed rules exist: PageRank(edges) and
ShortestPath(edges, from, to), as `?(…) <~ PageRank(rule)`, and Nearest(vectors, asked, k) gives the k rows (id, similarity) of
a relation (id, vector) nearest to a vector, for other rules to join.

Programs read tables.  Only run_mutable takes one with `:put relation key, key` or `:rm relation key, key`, which writes the
answer's rows to a stored relation, or removes those with its keys.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.operators.graph import pagerank, shortest_path
from marlstone.operators.vectors import knn
from marlstone.sources.relations import Relations
from marlstone.work import materialize


class DatalogError(ValueError):
    pass


_TOKEN = re.compile(r"\s*(?:('(?:[^'\\]|\\.)*')|(-?\d+(?:\.\d+)?)|(\$?[A-Za-z_?][\w]*)|(:-|<~|<=|>=|!=|[=<>(),.:\-?]))|\s*#[^\n]*")


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Const:
    value: Any


@dataclass(frozen=True)
class Atom:
    name: str
    args: tuple  # (column or None, term)
    negated: bool


@dataclass(frozen=True)
class Compare:
    left: Any
    op: str
    right: Any


@dataclass(frozen=True)
class Rule:
    head: str
    args: tuple  # (aggregate or None, variable)
    body: tuple
    fixed: tuple | None = None


AGGREGATES = {"count": lambda c: F.count(c), "sum": lambda c: F.sum(c), "min": lambda c: F.min(c), "max": lambda c: F.max(c)}
_COMPARE = {"=": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b}


class _Parser:
    def __init__(self, source: str, params: dict[str, Any]):
        self.tokens: list[tuple[str, Any]] = []
        at = 0
        source = source.strip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m or m.end() == at:
                raise DatalogError(f"unexpected {source[at:at + 15]!r}")
            at = m.end()
            if m[1]:
                self.tokens.append(("const", m[1][1:-1].replace("\\'", "'")))
            elif m[2]:
                self.tokens.append(("const", float(m[2]) if "." in m[2] else int(m[2])))
            elif m[3]:
                if m[3][0] == "$":
                    if m[3][1:] not in params:
                        raise DatalogError(f"no parameter {m[3]}")
                    self.tokens.append(("const", params[m[3][1:]]))
                else:
                    self.tokens.append(("name", m[3]))
            elif m[4]:
                self.tokens.append(("mark", m[4]))
        self.at = 0

    def peek(self, ahead: int = 0):
        return self.tokens[self.at + ahead] if self.at + ahead < len(self.tokens) else ("end", None)

    def take(self, value: str) -> bool:
        if self.peek()[0] in ("mark", "name") and self.peek()[1] == value:
            self.at += 1
            return True
        return False

    def need(self, value: str) -> None:
        if not self.take(value):
            raise DatalogError(f"expected {value!r}, found {self.peek()[1]!r}")

    def name(self) -> str:
        kind, value = self.peek()
        if kind != "name":
            raise DatalogError(f"expected a name, found {value!r}")
        self.at += 1
        return value

    def term(self):
        kind, value = self.peek()
        self.at += 1
        if kind == "const":
            return Const(value)
        if kind == "name":
            return Const(value == "true") if value in ("true", "false") else Var(value)
        raise DatalogError(f"expected a term, found {value!r}")

    def program(self) -> tuple[list[Rule], list[tuple[str, bool]], int | None]:
        rules, order, limit = [], [], None
        self.write: tuple[str, str, list[str]] | None = None  # put or rm, relation, keys
        while self.peek()[0] != "end":
            if self.take(":"):
                word = self.name()
                if word == "limit":
                    limit = self.term().value
                elif word == "order":
                    while True:
                        down = self.take("-")
                        order.append((self.name(), down))
                        if not self.take(","):
                            break
                elif word in ("put", "rm"):
                    if self.write:
                        raise DatalogError("a program writes once")
                    relation, keys = self.name(), [self.name()]
                    while self.take(","):
                        keys.append(self.name())
                    self.write = word, relation, keys
                else:
                    raise DatalogError(f"unknown option :{word}")
                continue
            rules.append(self.rule())
        return rules, order, limit

    def rule(self) -> Rule:
        head = "?" if self.take("?") else self.name()
        args = []
        self.need("(")
        while not self.take(")"):
            name = self.name()
            if self.take("("):
                if name not in AGGREGATES:
                    raise DatalogError(f"unknown aggregate {name}")
                args.append((name, self.name()))
                self.need(")")
            else:
                args.append((None, name))
            self.take(",")
        if self.take("<~"):
            name, given = self.name(), []
            self.need("(")
            while not self.take(")"):
                given.append(self.term())
                self.take(",")
            self.need(".")
            return Rule(head, tuple(args), (), (name, tuple(given)))
        self.need(":-")
        body = [self.literal()]
        while self.take(","):
            body.append(self.literal())
        self.need(".")
        return Rule(head, tuple(args), tuple(body))

    def literal(self):
        negated = self.take("not")
        if self.peek()[0] == "name" and self.peek(1) == ("mark", "("):
            name, args = self.name(), []
            self.need("(")
            while not self.take(")"):
                if self.peek()[0] == "name" and self.peek(1) == ("mark", ":"):
                    column = self.name()
                    self.need(":")
                    args.append((column, self.term()))
                else:
                    args.append((None, self.term()))
                self.take(",")
            return Atom(name, tuple(args), negated)
        left = self.term()
        kind, op = self.peek()
        if kind != "mark" or op not in _COMPARE:
            raise DatalogError(f"expected a comparison, found {op!r}")
        self.at += 1
        return Compare(left, op, self.term())


class _Engine:
    def __init__(self, rules: list[Rule], tables: dict[str, DataFrame]):
        self.rules: dict[str, list[Rule]] = {}
        for r in rules:
            self.rules.setdefault(r.head, []).append(r)
        self.tables, self.done = tables, {}

    def columns(self, head: str) -> list[str]:
        return [v for _, v in self.rules[head][0].args]

    def relation(self, name: str) -> DataFrame:
        if name in self.rules:
            if name not in self.done:
                self.done[name] = self.evaluate(name)
            return self.done[name]
        if name not in self.tables:
            raise DatalogError(f"no relation {name}")
        return self.tables[name]

    def evaluate(self, head: str) -> DataFrame:
        plain = [r for r in self.rules[head] if not any(isinstance(a, Atom) and a.name == head for a in r.body)]
        looping = [r for r in self.rules[head] if r not in plain]
        if not plain:
            raise DatalogError(f"{head} has no rule to begin with")
        out = None
        for r in plain:
            part = self.apply(r, {})
            out = part if out is None else out.union(part)
        out = out.distinct()
        if not looping:
            return out
        if any(a for r in self.rules[head] for a, _ in r.args) or any(sum(isinstance(a, Atom) and a.name == head for a in r.body) > 1 or any(isinstance(a, Atom) and a.negated and a.name == head for a in r.body) for r in looping):
            raise DatalogError(f"{head}: recursion is linear, positive and without aggregates")
        out = new = materialize(out, head)
        while not new.isEmpty():
            step = None
            for r in looping:
                part = self.apply(r, {head: new})
                step = part if step is None else step.union(part)
            new = materialize(step.toDF(*out.columns).distinct().join(out, out.columns, "left_anti"), head)
            out = materialize(out.union(new), head)
        return out

    def apply(self, rule: Rule, given: dict[str, DataFrame]) -> DataFrame:
        if rule.fixed:
            return self.fixed(rule)
        names = [v for _, v in rule.args]
        bound: DataFrame | None = None
        atoms = [a for a in rule.body if isinstance(a, Atom)]
        for a in (a for a in atoms if not a.negated):
            rows = self.rows(a, given)
            shared = [c for c in rows.columns if bound is not None and c in bound.columns]
            if bound is not None and not shared:
                raise DatalogError(f"{a.name} shares no variable with the atoms before it")
            bound = rows if bound is None else bound.join(rows, shared)
        if bound is None:
            raise DatalogError(f"{rule.head} needs an atom")
        for c in (c for c in rule.body if isinstance(c, Compare)):
            known = lambda t: isinstance(t, Const) or t.name in bound.columns  # noqa: B023, E731
            column = lambda t: F.lit(t.value) if isinstance(t, Const) else F.col(t.name)
            if c.op == "=" and isinstance(c.left, Var) and not known(c.left):
                bound = bound.withColumn(c.left.name, column(c.right))
            elif known(c.left) and known(c.right):
                bound = bound.filter(_COMPARE[c.op](column(c.left), column(c.right)))
            else:
                raise DatalogError("a comparison has an unbound variable")
        for a in (a for a in atoms if a.negated):
            rows = self.rows(a, given)
            if missing := [c for c in rows.columns if c not in bound.columns]:
                raise DatalogError(f"unbound in a negation: {missing}")
            bound = bound.join(rows, rows.columns, "left_anti")
        if missing := [n for n in names if n not in bound.columns]:
            raise DatalogError(f"unbound in the head: {missing}")
        if any(a for a, _ in rule.args):
            rows = bound.select(*dict.fromkeys(bound.columns)).distinct()
            keys = [v for a, v in rule.args if not a]
            found = rows.groupBy(*keys).agg(*(AGGREGATES[a](F.col(v)).alias(f"{a}_{v}") for a, v in rule.args if a))
            return found.select(*(f"{a}_{v}" if a else v for a, v in rule.args))
        return bound.select(*names)

    def rows(self, atom: Atom, given: dict[str, DataFrame]) -> DataFrame:
        """The atom's rows, its columns named by its variables."""
        df = given.get(atom.name) if atom.name in given else self.relation(atom.name)
        picked: list[tuple[str, Any]] = []
        for i, (column, term) in enumerate(atom.args):
            if column is None:
                if i >= len(df.columns):
                    raise DatalogError(f"{atom.name} has {len(df.columns)} columns")
                column = df.columns[i]
            elif column not in df.columns:
                raise DatalogError(f"{atom.name} has no column {column}")
            picked.append((column, term))
        seen: dict[str, str] = {}
        for column, term in picked:
            if isinstance(term, Const):
                df = df.filter(F.col(column) == F.lit(term.value))
            elif term.name in seen:
                df = df.filter(F.col(column) == F.col(seen[term.name]))
            else:
                seen[term.name] = column
        return df.select(*(F.col(c).alias(v) for v, c in seen.items() if v != "_"))

    def fixed(self, rule: Rule) -> DataFrame:
        name, given = rule.fixed
        if not given or not isinstance(given[0], Var):
            raise DatalogError(f"{name} needs a relation")
        edges = self.relation(given[0].name)
        if name == "Nearest":
            if len(given) != 3 or not all(isinstance(t, Const) for t in given[1:]):
                raise DatalogError("Nearest needs a relation, a vector and a number")
            key, column = edges.columns[:2]
            return knn(edges, given[1].value, given[2].value, key, column).toDF(*(v for _, v in rule.args))
        links = edges.select(F.col(edges.columns[0]).alias("src"), F.col(edges.columns[1]).alias("dst"))
        if name == "PageRank":
            out = pagerank(links, *(t.value for t in given[1:]))
        elif name == "ShortestPath":
            out = shortest_path(links, given[1].value, given[2].value)
        else:
            raise DatalogError(f"no fixed rule {name}")
        return out.toDF(*(v for _, v in rule.args))


def _answer(program: str, tables: dict[str, DataFrame], params: dict[str, Any] | None) -> tuple[DataFrame, tuple[str, str, list[str]] | None]:
    parser = _Parser(program, params or {})
    rules, order, limit = parser.program()
    if not any(r.head == "?" for r in rules):
        raise DatalogError("there is no rule ?")
    out = _Engine(rules, tables).relation("?")
    if order:
        out = out.orderBy(*(F.desc(n) if down else F.col(n) for n, down in order))
    return out if limit is None else out.limit(limit), parser.write


def run(program: str, tables: dict[str, DataFrame], params: dict[str, Any] | None = None) -> DataFrame:
    """The rows of the rule `?`; a program that writes is refused."""
    out, write = _answer(program, tables, params)
    if write:
        raise DatalogError(f"the program writes to {write[1]}; reading alone is allowed here")
    return out


def run_mutable(program: str, store: Relations, params: dict[str, Any] | None = None, tables: dict[str, DataFrame] | None = None) -> DataFrame:
    """The rows of the rule `?` over stored relations and tables, after what the program writes."""
    out, write = _answer(program, {**{n: store.table(n) for n in store.names()}, **(tables or {})}, params)
    if write:
        word, relation, keys = write
        (store.put if word == "put" else store.remove)(relation, out, keys)
    return out
