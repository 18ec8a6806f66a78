"""Receiver types against a recursive evaluator, on cases by hand and on random programs."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from marlstone.operators import inference

DECLS = "id string, file string, name string, kind string, owner string"
BINDINGS = "file string, local string, target string, module string"
FACTS = "file string, owner string, name string, role string, base_kind string, base string, steps array<struct<op:string,name:string>>"
CALLS = "call_id string, file string, base_kind string, base string, steps array<struct<op:string,name:string>>, method string"


def frames(spark, decls, bindings, facts, calls):
    return [spark.createDataFrame(rows, schema) for rows, schema in ((decls, DECLS), (bindings, BINDINGS), (facts, FACTS), (calls, CALLS))]


def inferred(spark, *program):
    got = inference.infer(*frames(spark, *program)).collect()
    assert len({r.call_id for r in got}) == len(got)
    return {r.call_id: r.target for r in got}


def single(values):
    values = list(values)
    return values[0] if values and values[0] is not None and all(v == values[0] for v in values) else None


class Evaluator:
    """One call at a time, by recursion."""

    def __init__(self, decls, bindings, facts):
        self.decls = {d[0]: d for d in decls}
        self.visible, self.modules, self.facts, self.members = defaultdict(set), defaultdict(set), defaultdict(list), defaultdict(list)
        self.top, self.classes = defaultdict(set), defaultdict(list)
        for i, file, name, kind, owner in decls:
            if owner is None:
                self.top[file, name].add(i)
                self.visible[file, name].add(i)
            else:
                self.members[file, owner, name].append(i)
            if kind == "class":
                self.classes[file, name].append(i)
        for file, local, target, module in bindings:
            if target:
                self.visible[file, local].add(target)
            else:
                self.modules[file, local].add(module)
        for file, owner, name, role, kind, base, steps in facts:
            self.facts[file, owner or "", name, role].append(None if kind is None else (kind, base, tuple(steps or ())))
        self.heritage = defaultdict(list)
        for file, owner, _, role, kind, base, _ in facts:
            if role == "extends":
                self.heritage[file, owner].append((kind, base))

    def kind(self, i):
        return self.decls[i][3]

    def named(self, file, name, kinds):
        return single({i for i in self.visible[file, name] if self.kind(i) in kinds}) if len({i for i in self.visible[file, name] if self.kind(i) in kinds}) == 1 else None

    def type_of(self, file, path, depth=0):
        kinds = ("class", "interface", "type_alias")
        if depth > inference.MAX_DEPTH:
            return None
        if "." in path:
            space, name = path.rsplit(".", 1)
            held = self.modules[file, space]
            found = {i for i in self.top[next(iter(held)), name] if self.kind(i) in kinds} if len(held) == 1 else set()
            i = next(iter(found)) if len(found) == 1 else None
        else:
            i = self.named(file, path, kinds)
        if i is None or self.kind(i) != "type_alias":
            return i
        _, file2, name, _, _ = self.decls[i]
        e = single(self.facts[file2, "", name, "alias"])
        if not e or e[0] != "type" or e[2]:
            return None
        said = written(e[1])
        return self.type_of(file2, said[0], depth + 1) if said and not said[1] else None

    def bases(self, t):
        _, file, name, kind, _ = self.decls[t]
        said = self.heritage[file, name]
        if not said:
            return []
        if len({i for i in self.decls if self.decls[i][1:4] == (file, name, kind)}) != 1 or (kind == "class" and len(said) != 1):
            return None
        out = []
        for k, base in said:
            w = written(base) if k == "type" else None
            b = self.type_of(file, w[0]) if w and not w[1] else None
            if b is None:
                return None
            out.append(b)
        return list(dict.fromkeys(out))

    def walk(self, t, own, seen):
        """(found, answer): nothing found is (False, None), no answer (True, None)."""
        if t in seen or len(seen) > 40:
            return True, None
        seen.add(t)
        got = own(t)
        if got is not None:
            return got
        bases = self.bases(t)
        if bases is None:
            return True, None
        answers = []
        for b in bases:
            found, x = self.walk(b, own, seen)
            if found and x is None:
                return True, None
            if found:
                answers.append(x)
        return (False, None) if not answers else (True, single(answers))

    def method(self, t, name):
        def own(t):
            _, file, owner, _, _ = self.decls[t]
            held = self.members[file, owner, name]
            calls = [i for i in held if self.kind(i) in ("method", "function")]
            props = [i for i in held if i not in calls]
            if calls:
                return True, calls[0] if len(calls) == 1 else None
            if props:
                typed = any(e and e[0] == "type" and e[1].startswith("typeof ") for r in ("field", "field_init", "returns") for e in self.facts[file, owner, name, r])
                return True, props[0] if len(props) == 1 and not typed else None
            return None

        return self.walk(t, own, set())[1]

    def field(self, t, name):
        def own(t):
            _, file, owner, _, _ = self.decls[t]
            for role in ("field", "field_init"):
                said = self.facts[file, owner, name, role]
                if said:
                    e = single(said)
                    return True, (file, e) if e else None
            return (True, None) if self.members[file, owner, name] else None

        return self.walk(t, own, set())[1]

    def returned(self, i, recv, depth):
        _, file, name, _, owner = self.decls[i]
        e = single(self.facts[file, owner or "", name, "returns"])
        return self.typed(file, e[1], recv, depth) if e and e[0] == "type" and not e[2] else None

    def typed(self, file, text, recv, depth):
        if text == "this":
            return recv
        w = written(text)
        t = self.type_of(file, w[0]) if w else None
        return t and ("inst", t, w[1])

    def variable(self, i, depth):
        _, file, name, _, _ = self.decls[i]
        e = single(self.facts[file, "", name, "var"])
        return self.value(file, e, depth + 1) if e else None

    def value(self, file, e, depth):
        if depth > inference.MAX_DEPTH:
            return None
        kind, base, steps = e
        v = None
        only = self.classes[file, base]
        if kind == "type":
            v = self.typed(file, base, None, depth)
        elif kind == "this" and len(only) == 1:
            v = ("inst", only[0], False)
        elif kind == "super" and len(only) == 1:
            up = self.bases(only[0])
            v = ("inst", up[0], False) if up and len(up) == 1 else None
        elif kind == "fn":
            f = self.named(file, base, ("function",))
            v = self.returned(f, None, depth) if f else None
        elif kind == "var":
            if self.modules[file, base]:
                v = ("module", next(iter(self.modules[file, base])), False) if len(self.modules[file, base]) == 1 else None
            else:
                i = self.named(file, base, ("class", "variable", "constant"))
                v = i and (("class", i, False) if self.kind(i) == "class" else self.variable(i, depth))
        for op, name in steps:
            if v is None:
                return None
            if op == "await":
                v = (*v[:2], False)
            elif v[2]:
                return None
            elif v[0] == "module":
                held = self.top[v[1], name]
                i = next(iter(held)) if len(held) == 1 else None
                if op == "field":
                    v = i and (("class", i, False) if self.kind(i) == "class" else self.variable(i, depth) if self.kind(i) in ("variable", "constant") else None)
                else:
                    v = self.returned(i, None, depth) if i and self.kind(i) == "function" else None
            elif op == "field":
                f = self.field(v[1], name)
                v = self.value(f[0], f[1], depth + 1) if f else None
            else:
                m = self.method(v[1], name)
                v = self.returned(m, v, depth) if m and self.kind(m) in ("method", "function") else None
        return v

    def target(self, call):
        _, file, kind, base, steps, method = call
        v = self.value(file, (kind, base, tuple(steps or ())), 0)
        return self.method(v[1], method) if v and v[0] != "module" and not v[2] else None


def written(text):
    promise = text.startswith("Promise<")
    inner = text[8:-1] if promise else text
    return None if any(c in inner for c in "|[ <") else (inner, promise)


def by_hand():
    decls = [
        ("A", "a.ts", "A", "class", None), ("A.go", "a.ts", "go", "method", "A"), ("A.self", "a.ts", "self", "method", "A"), ("A.b", "a.ts", "b", "property", "A"), ("A.soon", "a.ts", "soon", "method", "A"),
        ("B", "b.ts", "B", "class", None), ("B.run", "b.ts", "run", "method", "B"), ("B.a", "b.ts", "a", "property", "B"),
        ("C", "c.ts", "C", "class", None), ("make", "c.ts", "make", "function", None), ("loop1", "c.ts", "loop1", "variable", None), ("loop2", "c.ts", "loop2", "variable", None), ("one", "c.ts", "one", "constant", None), ("T", "c.ts", "T", "type_alias", None),
        ("D1", "d.ts", "D", "class", None), ("D2", "d.ts", "D", "class", None), ("D.go", "d.ts", "go", "method", "D"),
        ("I", "i.ts", "I", "interface", None), ("J", "i.ts", "J", "interface", None), ("K", "i.ts", "K", "interface", None), ("L", "i.ts", "L", "interface", None), ("I.x", "i.ts", "x", "method", "I"), ("J.y", "i.ts", "y", "method", "J"),
    ]
    bindings = [("b.ts", "A", "A", None), ("a.ts", "B", "B", None), ("c.ts", "A", "A", None), ("c.ts", "B", "B", None), ("c.ts", "ns", None, "a.ts"), ("c.ts", "D", "D1", None), ("c.ts", "D", "D2", None), ("c.ts", "L", "L", None), ("c.ts", "K", "K", None)]
    t = lambda x: ("type", x, None)
    facts = [
        ("a.ts", "A", "b", "field", *t("B | undefined")), ("a.ts", "A", "self", "returns", *t("this")), ("a.ts", "A", "soon", "returns", *t("Promise< B >")), ("b.ts", "B", "a", "field_init", *t("A")), ("b.ts", "B", "", "extends", *t("A")),
        ("c.ts", "C", "", "extends", *t("B")), ("c.ts", None, "make", "returns", *t("T")), ("c.ts", None, "T", "alias", *t("B")), ("c.ts", None, "loop1", "var", "var", "loop2", None), ("c.ts", None, "loop2", "var", "var", "loop1", None),
        ("c.ts", None, "one", "var", "fn", "make", [("field", "a")]), ("i.ts", "K", "", "extends", *t("I")), ("i.ts", "K", "", "extends", *t("J")), ("i.ts", "L", "", "extends", *t("K")), ("i.ts", "L", "", "extends", *t("I")),
    ]
    calls = [
        ("typed", "c.ts", "type", "A", None, "go"), ("inherited", "c.ts", "type", "Map<string, A>", None, "go"), ("up", "c.ts", "this", "C", None, "go"), ("super", "c.ts", "super", "C", None, "run"), ("alias", "c.ts", "type", "T", None, "run"),
        ("fn", "c.ts", "fn", "make", None, "run"), ("field", "c.ts", "type", "A", [("field", "b")], "run"), ("chain", "c.ts", "var", "one", [("field", "b"), ("field", "a"), ("call", "self")], "go"), ("loop", "c.ts", "var", "loop1", None, "go"),
        ("promise", "c.ts", "type", "A", [("call", "soon")], "run"), ("awaited", "c.ts", "type", "A", [("call", "soon"), ("await", None)], "run"), ("this", "c.ts", "this", "C", [("call", "self")], "run"), ("twice", "c.ts", "type", "D", None, "go"),
        ("space", "c.ts", "var", "ns", [("field", "A")], "go"), ("dotted", "c.ts", "type", "ns.A", None, "go"), ("union", "c.ts", "type", "A | B", None, "go"), ("parallel", "c.ts", "type", "K", None, "y"), ("diamond", "c.ts", "type", "L", None, "y"), ("near", "c.ts", "type", "L", None, "x"), ("unknown", "c.ts", "type", "A", None, "none"),
    ]
    return decls, bindings, facts, calls


def test_cases_by_hand(spark):
    got = inferred(spark, *by_hand())
    assert got == {
        "typed": "A.go", "up": "A.go", "super": "B.run", "alias": "B.run", "fn": "B.run", "field": "B.run", "chain": "A.go", "awaited": "B.run",
        "space": "A.go", "dotted": "A.go", "parallel": "J.y",
    } | {"this": "B.run"}


def random_program(seed):
    rng = random.Random(seed)
    files, names, members = [f"f{i}" for i in range(4)], ["A", "B", "C", "D"], ["m", "n", "o"]
    decls, bindings, facts, calls = [], [], [], []
    for file in files:
        for name in names:
            if rng.random() < 0.7:
                kind = rng.choice(["class", "class", "class", "interface", "type_alias"])
                decls.append((f"{file}.{name}", file, name, kind, None))
                texts = lambda: rng.choice([*names, *names, "s.A", "s.B", "Promise<A>", "A | B"])
                if kind == "type_alias":
                    facts.append((file, None, name, "alias", "type", texts(), None))
                    continue
                for _ in range(rng.choice([0, 1, 1, 1, 2] if kind == "interface" else [0, 1, 1, 1, 1, 2])):
                    facts.append((file, name, "", "extends", "type", texts(), None))
                for m in members:
                    if rng.random() < 0.5:
                        what = rng.choice(["method", "method", "property"])
                        decls.append((f"{file}.{name}.{m}", file, m, what, name))
                        if rng.random() < 0.9:
                            role = "returns" if what == "method" else rng.choice(["field", "field_init"])
                            facts.append((file, name, m, role, "type", rng.choice([texts(), texts(), "this"]), None))
                        if rng.random() < 0.1:
                            decls.append((f"{file}.{name}.{m}2", file, m, "method", name))
        for name in ("v", "w"):
            decls.append((f"{file}.{name}", file, name, "variable", None))
            e = rng.choice([("type", rng.choice(names), None), ("var", rng.choice(["v", "w", "s"]), [("field", rng.choice(["m", "v", "A"]))]), ("fn", "f", [("call", "n")])])
            facts.append((file, None, name, "var", *e))
        decls.append((f"{file}.f", file, "f", "function", None))
        facts.append((file, None, "f", "returns", "type", rng.choice([*names, "Promise<B>"]), None))
        for name in names:
            if rng.random() < 0.5:
                bindings.append((file, name, f"{rng.choice(files)}.{name}", None))
        bindings.append((file, "s", None, rng.choice(files)))
    known = {d[0] for d in decls}
    bindings = [b for b in bindings if b[2] is None or b[2] in known]
    for i in range(150):
        base = rng.choice([("type", rng.choice([*names, "s.C", "Promise<D>"])), ("this", rng.choice(names)), ("super", rng.choice(names)), ("fn", "f"), ("var", rng.choice(["v", "w", "s", *names]))])
        steps = [rng.choice([("field", rng.choice([*members, "A", "v"])), ("call", rng.choice([*members, "f"])), ("await", None)]) for _ in range(rng.randrange(4))]
        calls.append((f"c{i}", rng.choice(files), *base, steps, rng.choice(members)))
    return decls, bindings, facts, calls


@pytest.mark.parametrize("seed", range(4))
def test_random_programs(spark, seed):
    decls, bindings, facts, calls = random_program(seed)
    plain = Evaluator(decls, bindings, facts)
    want = {c[0]: t for c in calls if (t := plain.target(c))}
    assert len(want) > 2
    assert inferred(spark, decls, bindings, facts, calls) == want


def test_written_types(spark):
    cases = {
        ": Svc": ("Svc", False), "models.Svc": ("models.Svc", False), "Repo<User, Map<string, X>>": ("Repo", False), "Svc | undefined": ("Svc", False), "null | Svc": ("Svc", False), "Promise<Svc>": ("Svc", True), "Promise<Svc | null>": ("Svc", True),
        "A | B": None, "Svc[]": None, "{ a: Svc }": None, "() => Svc": None, "typeof svc": None, "Promise<Promise<X>>": None, "": None, "A<B>|C<D>": None,
    }
    got = {r.t: r.w for r in spark.createDataFrame([(t,) for t in cases], "t string").select("t", inference.written_type(F.col("t")).alias("w")).collect()}
    assert {t: w and (w.path, w.promise) for t, w in got.items()} == cases
