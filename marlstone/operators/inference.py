"""Receiver types across files, by a worklist of expressions.

A member call's receiver is a base and steps: base_kind `type` (a written type), `this` or `super` (of a class of the file), `fn` (what a
function returns), `var` (a name that no scope binds: a variable, class or namespace import); steps `field`, `call` and `await`.  Facts say
the same of declarations.  Two tables hold what one step can do: what a base of a file is, and what a step on a value leads to; both are
built by joins over all facts, inheritance included.  Each round takes every open expression one base and one step further with one join
each; an expression of a fact (a field's, a variable's, a returned type's) takes the place of what led to it, in its own file, with the
steps that were left.  A step survives only if it names exactly one declaration, and a step of a call may run through MAX_DEPTH facts, so
that circular facts end.

decls: id, file, name, kind (class, interface, type_alias, function, method, property, variable, constant), owner (null at the top).
bindings: file, local, target (id), module (file of a namespace import).
facts: file, owner ('' at the top), name, role (field, field_init, returns, var, alias, extends), base_kind, base, steps (op, name).
calls: call_id, file, base_kind, base, steps, method.  Unions, ambiguous names, type parameters and untyped values give no answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marlstone.work import materialize

MAX_DEPTH = 16
STEPS = "array<struct<op:string,name:string>>"
_NAME = r"[\p{L}_$][\p{L}\p{N}_$]*"


def written_type(text: Column) -> Column:
    """path and promise of a written type that names exactly one; null otherwise.  `| null` and `| undefined` do not count, type
    arguments are left out, and one Promise is taken off."""
    plain = F.regexp_replace(F.regexp_replace(F.trim(F.regexp_replace(text, r"^\s*:+", "")), r"\s+", " "), r" ?([<>,|.\[\]()]) ?", "$1")
    nothing = lambda t: F.regexp_replace(F.regexp_replace(t, r"^((null|undefined)\|)+", ""), r"(\|(null|undefined))+$", "")
    single = nothing(plain)
    inner = nothing(F.regexp_extract(single, r"^Promise(?:Like)?<(.*)>$", 1))
    promise = single.rlike(r"^Promise(Like)?<.*>$")
    head = F.when(promise, inner).otherwise(single)
    for _ in range(8):  # arguments nest: the innermost first
        head = F.regexp_replace(head, r"(?<=[\p{L}\p{N}_$])<[^<>{}&=\"'`]*>", "")
    named = head.rlike(rf"^{_NAME}(\.{_NAME})*$") & ~head.rlike(r"^Promise(Like)?$")
    return F.when(named, F.struct(head.alias("path"), promise.alias("promise")))


def _one(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """The rows of groups that hold exactly one distinct value, which is not null."""
    found = rows.groupBy(*by).agg(F.countDistinct(value).alias("_n"), F.min(value).alias(value), F.count(F.when(F.col(value).isNull(), 1)).alias("_null"))
    return found.filter("_n = 1 and _null = 0").drop("_n", "_null")


def _expressions(facts: DataFrame, roles: list[str]) -> DataFrame:
    """file, owner, name and the one expression of all facts of these roles, or null where they differ or one is unknown."""
    whole = F.when(F.col("base_kind").isNotNull(), F.to_json(F.struct("base_kind", "base", F.coalesce("steps", F.array().cast(STEPS)).alias("steps"))))
    rows = facts.filter(F.col("role").isin(roles)).select("file", "owner", "name", whole.alias("e"))
    found = rows.groupBy("file", "owner", "name").agg(F.countDistinct("e").alias("n"), F.min("e").alias("e"), F.count(F.when(F.col("e").isNull(), 1)).alias("unknown"))
    return found.select("file", "owner", "name", F.from_json(F.when((F.col("n") == 1) & (F.col("unknown") == 0), F.col("e")), f"base_kind string, base string, steps {STEPS}").alias("e"))


class Program:
    """The declarations, bindings and facts of a corpus, and the tables that a step of inference reads."""

    def __init__(self, decls: DataFrame, bindings: DataFrame, facts: DataFrame, calls: DataFrame):
        self.decls, self.bindings = decls, bindings
        self.facts = facts.withColumn("owner", F.coalesce("owner", F.lit("")))
        self.calls = calls
        top = decls.filter("owner is null").select("file", "name", "id", "kind")
        self.exported = top
        imported = bindings.filter("target is not null").select("file", F.col("local").alias("name"), F.col("target").alias("id")).join(decls.select("id", "kind"), "id")
        self.visible = materialize(top.unionByName(imported).distinct(), "visible")
        self.types = self._types()
        self.parents = self._parents()
        self.methods = materialize(self._looked_up(self._own_methods()), "methods")
        self.fields = materialize(self._looked_up(self._own_fields()), "fields")

    def _named(self, kinds: list[str]) -> DataFrame:
        """file, name, id of what a name of these kinds means in a file, where it means one thing."""
        return _one(self.visible.filter(F.col("kind").isin(kinds)), ["file", "name"], "id")

    def _types(self) -> DataFrame:
        """file, text, id, promise of every written type that names one class or interface, aliases followed."""
        texts = self.facts.select("file", "base_kind", "base").union(self.calls.select("file", "base_kind", "base")).filter("base_kind = 'type'")
        texts = texts.select("file", F.col("base").alias("text")).distinct().withColumn("t", written_type(F.col("text"))).filter("t is not null")
        texts = texts.select("file", "text", "t.path", "t.promise")
        kinds = ["class", "interface", "type_alias"]
        plain = texts.filter(~F.col("path").contains(".")).join(self._named(kinds).withColumnRenamed("name", "path"), ["file", "path"])
        dotted = texts.filter(F.col("path").contains(".")).withColumns({"local": F.expr("substring_index(path, '.', size(split(path, '[.]')) - 1)"), "name": F.substring_index("path", ".", -1)})
        spaces = _one(self.bindings.filter("module is not null"), ["file", "local"], "module")
        members = _one(self.exported.filter(F.col("kind").isin(kinds)), ["file", "name"], "id").withColumnRenamed("file", "module")
        dotted = dotted.join(spaces, ["file", "local"]).join(members, ["module", "name"])
        found = materialize(plain.select("file", "text", "id", "promise").unionByName(dotted.select("file", "text", "id", "promise")), "written")
        aliases = self.decls.filter("kind = 'type_alias' and owner is null").select("id", "file", "name")
        said = _expressions(self.facts, ["alias"]).filter("owner = '' and e.base_kind = 'type' and size(e.steps) = 0").select("file", "name", F.col("e.base").alias("text"))
        step = aliases.join(said, ["file", "name"]).join(found.filter("not promise").select("file", "text", F.col("id").alias("to")), ["file", "text"]).select(F.col("id").alias("alias"), "to")
        step = materialize(step, "aliases")
        done = found.join(aliases.select("id"), "id", "left_anti")
        pending = found.join(aliases.select("id"), "id", "left_semi")
        for _ in range(MAX_DEPTH):
            pending = materialize(pending.join(step, F.col("id") == F.col("alias")).select("file", "text", F.col("to").alias("id"), "promise"), "alias-step")
            if pending.isEmpty():
                break
            done = done.unionByName(pending.join(aliases.select("id"), "id", "left_anti").select(*done.columns))
            pending = pending.join(aliases.select("id"), "id", "left_semi")
        return materialize(done.select("file", "text", "id", "promise"), "types")

    def _parents(self) -> DataFrame:
        """id, paths: every way up from each class or interface (itself first), with how it ends: `open` at a type, `closed` where the
        next base is unknown, doubtful or met before on the way."""
        own = self.decls.filter("kind in ('class', 'interface')").select("id", "file", "name", "kind")
        single = _one(own, ["file", "name", "kind"], "id")  # a class that shares its name in its file has no known bases
        said = self.facts.filter("role = 'extends'").select("file", F.col("owner").alias("name"), "base_kind", "base")
        base = own.select("id", "file", "name", "kind").join(said, ["file", "name"]).join(self.types.filter("not promise").select("file", F.col("text").alias("base"), F.col("id").alias("to")), ["file", "base"], "left")
        base = base.withColumn("n", F.count(F.lit(1)).over(W.partitionBy("id"))).join(single.select("id").withColumn("single", F.lit(True)), "id", "left")
        sure = (F.col("base_kind") == "type") & F.col("to").isNotNull() & F.col("single").isNotNull() & ((F.col("kind") == "interface") | (F.col("n") == 1))
        base = materialize(base.select("id", F.when(F.coalesce(sure, F.lit(False)), F.col("to")).alias("to")).distinct(), "bases")
        step = base.select(F.col("id").alias("last"), "to")
        front = own.select("id", F.array("id").alias("path"), F.lit(False).alias("closed"))
        found = front
        for depth in range(MAX_DEPTH + 1):
            way = front.filter("not closed").withColumn("last", F.element_at("path", -1)).join(step, "last")
            again = F.col("to").isNull() | F.array_contains("path", F.col("to")) | F.lit(depth == MAX_DEPTH)
            front = materialize(way.select("id", F.when(again, F.col("path")).otherwise(F.concat("path", F.array("to"))).alias("path"), again.alias("closed")), "ways")
            if front.isEmpty():
                break
            found = found.unionByName(front)
        return materialize(found, "parents")

    def _own_methods(self) -> DataFrame:
        """id, name, found, callable: a type's own method (or property that is called) of a name; found is null where it is doubtful."""
        types = self.decls.filter("kind in ('class', 'interface')").select("id", "file", F.col("name").alias("owner"))
        members = self.decls.filter("owner is not null").select("file", "owner", "name", F.col("id").alias("member"), F.col("kind").isin("method", "function").alias("callable"))
        typed = self.facts.filter("base_kind = 'type' and base like 'typeof %'").select("file", "owner", "name").distinct().withColumn("alias", F.lit(True))
        each = members.groupBy("file", "owner", "name").agg(
            F.countDistinct(F.when(F.col("callable"), F.col("member"))).alias("m"), F.min(F.when(F.col("callable"), F.col("member"))).alias("method"),
            F.countDistinct(F.when(~F.col("callable"), F.col("member"))).alias("p"), F.min(F.when(~F.col("callable"), F.col("member"))).alias("property"),
        ).join(typed, ["file", "owner", "name"], "left")
        found = F.when(F.col("m") == 1, F.col("method")).when((F.col("m") == 0) & (F.col("p") == 1) & F.col("alias").isNull(), F.col("property"))
        return types.join(each, ["file", "owner"]).select("id", "name", F.struct(found.alias("id"), (F.col("m") == 1).alias("callable")).alias("found"), found.isNotNull().alias("sure"))

    def _own_fields(self) -> DataFrame:
        """id, name, found: the expression of a type's own field (file, base_kind, base, steps); unsure where there are several or none."""
        types = self.decls.filter("kind in ('class', 'interface')").select("id", "file", F.col("name").alias("owner"))
        declared = _expressions(self.facts, ["field"]).withColumn("declared", F.lit(True))
        given = _expressions(self.facts, ["field_init"]).select("file", "owner", "name", F.col("e").alias("given"))
        members = self.decls.filter("owner is not null").select("file", "owner", "name").distinct()
        rows = declared.join(given, ["file", "owner", "name"], "full").join(members, ["file", "owner", "name"], "full")
        e = F.when(F.col("declared").isNotNull(), F.col("e")).otherwise(F.col("given"))
        rows = types.join(rows, ["file", "owner"]).withColumn("x", e)
        return rows.select("id", "name", F.struct("file", "x.base_kind", "x.base", "x.steps").alias("found"), F.col("x").isNotNull().alias("sure"))

    def _looked_up(self, own: DataFrame) -> DataFrame:
        """id, name, found: what each type holds under each name, itself or by inheritance.  A way up ends where a type holds the name;
        one that is closed before, a type met on two ways, a doubtful holder or two different answers give none."""
        ways = self.parents.filter("not closed").withColumn("at", F.element_at("path", -1))
        held = ways.join(own.select(F.col("id").alias("at"), "name", F.to_json("found").alias("found"), "sure"), "at").select("id", "name", "path", "found", "sure")
        closed = self.parents.filter("closed").groupBy("id").agg(F.collect_list("path").alias("closed"))
        twice = ways.withColumn("n", F.count(F.lit(1)).over(W.partitionBy("id", "at"))).filter("n > 1").groupBy("id").agg(F.collect_list("path").alias("twice"))
        all_held = held.groupBy("id", "name").agg(F.collect_list(F.struct("path", "found", "sure")).alias("held")).join(closed, "id", "left").join(twice, "id", "left")
        stops = F.transform("held", lambda h: F.element_at(h["path"], -1))
        before = lambda p: F.slice(p, 1, F.size(p) - 1)
        none = F.array().cast("array<array<string>>")
        rows = all_held.withColumn("stops", stops)
        rows = rows.withColumns({
            "reached": F.filter("held", lambda h: ~F.arrays_overlap(before(h["path"]), F.col("stops"))),
            "shut": F.exists(F.coalesce("closed", none), lambda p: ~F.arrays_overlap(p, F.col("stops"))),
            "met": F.transform(F.filter(F.coalesce("twice", none), lambda p: ~F.arrays_overlap(before(p), F.col("stops"))), lambda p: F.element_at(p, -1)),
        })
        answers = F.array_distinct(F.transform("reached", lambda h: h["found"]))
        good = ~F.col("shut") & (F.size(F.array_distinct("met")) == F.size("met")) & F.forall("reached", lambda h: h["sure"]) & (F.size(answers) == 1)
        return rows.filter(good).select("id", "name", F.from_json(answers[0], own.schema["found"].dataType).alias("found"))

    def _returned(self) -> DataFrame:
        """id, file, text of the type that a function or method is said to return."""
        said = _expressions(self.facts, ["returns"]).filter("e.base_kind = 'type' and size(e.steps) = 0").select("file", "owner", "name", F.col("e.base").alias("text"))
        callables = self.decls.filter("kind in ('function', 'method')").select("id", "file", F.coalesce("owner", F.lit("")).alias("owner"), "name")
        return callables.join(said, ["file", "owner", "name"]).select("id", "file", "text")

    def _variables(self) -> DataFrame:
        """id and the expression of a module's variable."""
        said = _expressions(self.facts, ["var"]).filter("owner = '' and e is not null").select("file", "name", F.struct("file", "e.base_kind", "e.base", "e.steps").alias("next"))
        return self.decls.filter("owner is null and kind in ('variable', 'constant')").select("id", "file", "name").join(said, ["file", "name"]).select("id", "next")

    def bases(self) -> DataFrame:
        """file, base_kind, base: either a value (kind inst, class or module; id; promise) or the expression that stands for it (next)."""
        nothing, value = F.lit(None).cast(f"struct<file:string,base_kind:string,base:string,steps:{STEPS}>").alias("next"), ["kind", "id", "promise"]
        typed = self.types.select("file", F.lit("type").alias("base_kind"), F.col("text").alias("base"), F.lit("inst").alias("kind"), "id", "promise", nothing)
        classes = _one(self.decls.filter("kind = 'class'"), ["file", "name"], "id")
        this = classes.select("file", F.lit("this").alias("base_kind"), F.col("name").alias("base"), F.lit("inst").alias("kind"), "id", F.lit(False).alias("promise"), nothing)
        up = _one(self.parents.filter("not closed and size(path) = 2").select("id", F.element_at("path", 2).alias("to")), ["id"], "to")
        above = classes.join(up, "id").select("file", F.lit("super").alias("base_kind"), F.col("name").alias("base"), F.lit("inst").alias("kind"), F.col("to").alias("id"), F.lit(False).alias("promise"), nothing)
        as_type = F.struct("file", F.lit("type").alias("base_kind"), F.col("text").alias("base"), F.array().cast(STEPS).alias("steps")).alias("next")
        none = [F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("id"), F.lit(None).cast("boolean").alias("promise")]
        functions = self._named(["function"]).join(self._returned().select("id", as_type), "id").select("file", F.lit("fn").alias("base_kind"), F.col("name").alias("base"), *none, "next")
        spaces = _one(self.bindings.filter("module is not null"), ["file", "local"], "module")
        modules = spaces.select("file", F.lit("var").alias("base_kind"), F.col("local").alias("base"), F.lit("module").alias("kind"), F.concat(F.lit("module:"), "module").alias("id"), F.lit(False).alias("promise"), nothing)
        names = self._named(["class", "variable", "constant"]).join(spaces.select("file", F.col("local").alias("name")), ["file", "name"], "left_anti").join(self.decls.select("id", F.col("kind").alias("what")), "id")
        values = names.filter("what = 'class'").select("file", F.lit("var").alias("base_kind"), F.col("name").alias("base"), F.lit("class").alias("kind"), "id", F.lit(False).alias("promise"), nothing)
        variables = names.join(self._variables(), "id").select("file", F.lit("var").alias("base_kind"), F.col("name").alias("base"), *none, "next")
        rows = typed
        for more in (this, above, functions, modules, values, variables):
            rows = rows.unionByName(more)
        return materialize(rows.select("file", "base_kind", "base", *value, "next"), "base-table")

    def steps(self) -> DataFrame:
        """id, op, name: the expression that a step on a value leads to (next), the class it is (class), or the call's target."""
        as_type = F.struct("file", F.lit("type").alias("base_kind"), F.col("text").alias("base"), F.array().cast(STEPS).alias("steps")).alias("next")
        no_next, no_id = F.lit(None).cast(f"struct<file:string,base_kind:string,base:string,steps:{STEPS}>").alias("next"), F.lit(None).cast("string")
        fields = self.fields.select("id", F.lit("field").alias("op"), "name", F.col("found").alias("next"), no_id.alias("class"), no_id.alias("target"))
        targets = self.methods.select("id", F.lit("target").alias("op"), "name", no_next, no_id.alias("class"), F.col("found.id").alias("target"))
        returned = self._returned().select(F.col("id").alias("member"), as_type)
        called = self.methods.filter("found.callable").select("id", "name", F.col("found.id").alias("member")).join(returned, "member").select("id", F.lit("call").alias("op"), "name", "next", no_id.alias("class"), no_id.alias("target"))
        inside = _one(self.exported, ["file", "name"], "id").join(self.decls.select("id", "kind"), "id").withColumn("module", F.concat(F.lit("module:"), "file"))
        classes = inside.filter("kind = 'class'").select(F.col("module").alias("id"), F.lit("field").alias("op"), "name", no_next, F.col("id").alias("class"), no_id.alias("target"))
        variables = inside.join(self._variables(), "id").select(F.col("module").alias("id"), F.lit("field").alias("op"), "name", "next", no_id.alias("class"), no_id.alias("target"))
        functions = inside.filter("kind = 'function'").join(returned, F.col("id") == F.col("member")).select(F.col("module").alias("id"), F.lit("call").alias("op"), "name", "next", no_id.alias("class"), no_id.alias("target"))
        rows = fields
        for more in (targets, called, classes, variables, functions):
            rows = rows.unionByName(more)
        return materialize(rows, "step-table")


def infer(decls: DataFrame, bindings: DataFrame, facts: DataFrame, calls: DataFrame) -> DataFrame:
    """call_id, target of the calls whose receiver has exactly one type that holds the method."""
    program = Program(decls, bindings, facts, calls)
    bases, steps = program.bases(), program.steps()
    last = F.array(F.struct(F.lit("target").alias("op"), F.col("method").alias("name"))).cast(STEPS)
    unset = F.lit(None).cast("string")
    start = calls.select("call_id", "file", "base_kind", "base", F.concat(F.coalesce("steps", F.array().cast(STEPS)), last).alias("steps"), unset.alias("recv"), unset.alias("recv_kind"), F.lit(0).alias("depth"))
    work = materialize(start.withColumn("outer", F.size("steps")), "calls")
    carried = ["call_id", "steps", "depth", "outer"]
    done = []
    while not work.isEmpty():
        own = (F.col("base_kind") == "type") & (F.col("base") == "this")
        this = work.filter(own & F.col("recv").isNotNull()).select(*carried, F.col("recv_kind").alias("kind"), F.col("recv").alias("id"), F.lit(False).alias("promise"))
        found = work.filter(~own).join(bases, ["file", "base_kind", "base"])
        values = found.filter("next is null").select(*carried, "kind", "id", "promise").unionByName(this)
        opened = found.filter("next is not null").select(*carried, "next", unset.alias("recv"), unset.alias("recv_kind"))
        first = lambda s: (s["op"] != "await").cast("int")
        lead = F.coalesce(F.array_position(F.transform("steps", first), 1), F.lit(1)).cast("int")  # the target step is there
        values = values.withColumns({"promise": F.col("promise") & (lead == 1), "steps": F.slice("steps", lead, F.size("steps"))}).filter("not promise")
        head = values.withColumns({"op": F.col("steps")[0]["op"], "name": F.col("steps")[0]["name"], "steps": F.slice("steps", 2, F.size("steps"))})
        moved = head.join(steps, ["id", "op", "name"])
        done.append(materialize(moved.filter("op = 'target'").select("call_id", "target"), "inferred"))
        left = F.size("steps")
        fresh = left < F.col("outer")
        moved = moved.filter("op <> 'target'").withColumns({"depth": F.when(fresh, 0).otherwise(F.col("depth")), "outer": F.least("outer", left)})
        called = F.col("op") == "call"
        opened = opened.unionByName(moved.filter("next is not null").select(*carried, "next", F.when(called & ~F.col("id").startswith("module:"), F.col("id")).alias("recv"), F.when(called, F.col("kind")).alias("recv_kind")))
        opened = opened.withColumn("depth", F.col("depth") + 1).filter(F.col("depth") <= MAX_DEPTH)
        onward = opened.select("call_id", "next.file", "next.base_kind", "next.base", F.concat("next.steps", "steps").alias("steps"), "recv", "recv_kind", "depth", "outer")
        # a class that a namespace holds is a value already: its next round starts from a base of its own file
        classes = moved.filter("class is not null").join(decls.select(F.col("id").alias("class"), "file", F.col("name").alias("base")), "class")
        onward = onward.unionByName(classes.select("call_id", "file", F.lit("var").alias("base_kind"), "base", "steps", unset.alias("recv"), unset.alias("recv_kind"), "depth", "outer"))
        work = materialize(onward, "work")
    out = calls.select("call_id", unset.alias("target")).limit(0)
    for rows in done:
        out = out.unionByName(rows)
    return out
