"""Name resolution as a ladder of joins.

Each rung is an equi join that proposes targets for calls with a priority, a confidence and a method; the lowest rung with
a proposal decides.  A rung that knows where a name leads but finds nothing there proposes null, which stops the ladder
instead of letting a lower rung guess.  One target at the deciding rung is an edge, several are ambiguous.

calls: call_id, file, caller, container, qualifier, name.  symbols: id, name, kind, container, file.
imports: file, local, target_file, symbol (the binding's name in the target; null for a default export).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marlstone.work import materialize

SELF_WORDS = ("self", "this", "cls", "Self")
TYPES = ("class", "struct", "enum", "interface", "trait", "type")


def _rung(hits: DataFrame, priority: int, confidence: float, method: str, kind: str = "calls") -> DataFrame:
    return hits.select("call_id", F.col("id").alias("target"), F.lit(priority).alias("priority"), F.lit(confidence).alias("confidence"), F.lit(kind).alias("kind"), F.lit(method).alias("method"))


def _only(hits: DataFrame) -> DataFrame:
    """The hits of calls that have exactly one."""
    return hits.groupBy("call_id").agg(F.min("id").alias("id"), F.countDistinct("id").alias("n")).filter("n = 1").drop("n")


def self_receiver(calls: DataFrame, symbols: DataFrame, priority: int = 1) -> DataFrame:
    """self.name(): a member of the caller's container."""
    asked = calls.filter(F.col("qualifier").isin(*SELF_WORDS)).select("call_id", "name", "container")
    return _rung(asked.join(symbols.select("id", "name", "container"), ["name", "container"]), priority, 1.0, "self")


def type_qualifier(calls: DataFrame, symbols: DataFrame, priority: int = 3) -> DataFrame:
    """Type.name(): a member of the type; a type without such a member stops the ladder."""
    types = symbols.filter(F.col("kind").isin(*TYPES)).select(F.col("name").alias("qualifier")).distinct()
    asked = calls.filter(F.col("qualifier").isNotNull() & ~F.col("qualifier").isin(*SELF_WORDS)).join(types, "qualifier").select("call_id", "name", F.col("qualifier").alias("container"))
    return _rung(asked.join(symbols.select("id", "name", "container"), ["name", "container"], "left"), priority, 1.0, "type")


def same_file(calls: DataFrame, symbols: DataFrame, priority: int = 4) -> DataFrame:
    """name(): a function or type at the top of the caller's file."""
    tops = symbols.filter(F.col("kind").isin("function", *TYPES)).select("id", "name", "file")
    return _rung(calls.filter("qualifier is null").select("call_id", "name", "file").join(tops, ["name", "file"]), priority, 1.0, "same-file")


def import_binding(calls: DataFrame, symbols: DataFrame, imports: DataFrame, priority: int = 5) -> DataFrame:
    """name(): what the file's import of that name binds; an import that leads nowhere stops the ladder."""
    bound = calls.filter("qualifier is null").select("call_id", "file", F.col("name").alias("local")).join(imports, ["file", "local"])
    bound = bound.select("call_id", F.col("target_file").alias("file"), F.coalesce("symbol", "local").alias("name"))
    return _rung(bound.join(symbols.select("id", "name", "file"), ["name", "file"], "left"), priority, 1.0, "import")


def imported_file(calls: DataFrame, symbols: DataFrame, imports: DataFrame, priority: int = 6) -> DataFrame:
    """name(): the only function of this name in the files that the caller's file imports."""
    files = imports.select("file", "target_file").distinct()
    asked = calls.filter("qualifier is null").select("call_id", "file", "name").join(files, "file").select("call_id", "name", F.col("target_file").alias("file"))
    functions = symbols.filter("kind = 'function'").select("id", "name", "file")
    return _rung(_only(asked.join(functions, ["name", "file"])), priority, 0.9, "imported-file")


def globally_unique(calls: DataFrame, symbols: DataFrame, priority: int = 7) -> DataFrame:
    """name(): the only function of this name anywhere.  Uniqueness is decided on the symbols, before any join."""
    single = symbols.filter("kind = 'function'").groupBy("name").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")).filter("n = 1").drop("n")
    return _rung(calls.filter("qualifier is null").select("call_id", "name").join(single, "name"), priority, 0.5, "unique", "possible_call")


def unique_method(calls: DataFrame, symbols: DataFrame, traits: tuple[str, ...] = (), priority: int = 9) -> DataFrame:
    """x.name() on an unknown receiver: one trait's method 0.7, the only method 0.5, else every candidate (ambiguous)."""
    methods = symbols.filter("kind = 'method'").select("id", "name", "container")
    counts = methods.groupBy("name").agg(F.countDistinct("container").alias("owners"), F.countDistinct("id").alias("n"))
    asked = calls.filter(F.col("qualifier").isNotNull() & ~F.col("qualifier").isin(*SELF_WORDS)).select("call_id", "name").join(methods, "name").join(counts, "name")
    trait = F.col("container").isin(*traits) & (F.col("owners") == 1) if traits else F.lit(False)
    return asked.select("call_id", F.col("id").alias("target"), F.lit(priority).alias("priority"), F.when(trait, 0.7).otherwise(0.5).alias("confidence"), F.when(trait, "calls_trait_method").otherwise("possible_call").alias("kind"), F.lit("method").alias("method"))


def decide(calls: DataFrame, rungs: list[DataFrame]) -> DataFrame:
    """call_id, state (edge, ambiguous, unresolved), target, candidates, kind, confidence, method."""
    proposed = reduce(DataFrame.unionByName, rungs)
    first = proposed.withColumn("first", F.min("priority").over(W.partitionBy("call_id"))).filter("priority = first")
    found = first.groupBy("call_id").agg(F.array_sort(F.collect_set("target")).alias("candidates"), F.min("kind").alias("kind"), F.max("confidence").alias("confidence"), F.min("method").alias("method"))
    n = F.coalesce(F.size("candidates"), F.lit(0))
    state = F.when(n == 1, "edge").when(n > 1, "ambiguous").otherwise("unresolved")
    out = calls.select("call_id").join(found, "call_id", "left")
    one = lambda c: F.when(n == 1, F.col(c))
    return out.select("call_id", state.alias("state"), F.when(n == 1, F.element_at("candidates", 1)).alias("target"), F.coalesce("candidates", F.array().cast("array<string>")).alias("candidates"), one("kind").alias("kind"), one("confidence").alias("confidence"), one("method").alias("method"))


def _summed(symbols: DataFrame, *by: str) -> DataFrame:
    """The number, least and greatest id of the symbols of each key."""
    return symbols.groupBy(*by).agg(F.countDistinct("id").alias("n"), F.min("id").alias("target"), F.max("id").alias("last"))


def count_calls(calls: DataFrame, symbols: DataFrame, imports: DataFrame, traits: tuple[str, ...] = ()) -> DataFrame:
    """call_id, state, target, n, kind, confidence, method: what resolve_calls decides, with the number of candidates in place of
    their list, which for a name that many symbols bear would hold them all at each of its calls.  Symbols are counted by each rung's key
    before the join, so that a call (one row a call_id) meets one row a rung."""
    c = materialize(calls.select("call_id", "file", "container", "qualifier", "name"), "calls")
    s = materialize(symbols.select("id", "name", "kind", "container", "file"), "symbols")
    free, of_self = c.filter("qualifier is null"), F.col("qualifier").isin(*SELF_WORDS)
    of_type, functions = F.col("kind").isin(*TYPES), s.filter("kind = 'function'")
    members = _summed(s, "name", "container")

    def rung(hits: DataFrame, priority: int, method: str, confidence: Column | float = 1.0, kind: Column | str = "calls") -> DataFrame:
        lit = lambda x: x if isinstance(x, Column) else F.lit(x)
        return hits.select("call_id", F.lit(priority).alias("priority"), F.coalesce("n", F.lit(0)).alias("n"), "target", lit(kind).alias("kind"), lit(confidence).alias("confidence"), F.lit(method).alias("method"))

    named = c.filter(~of_self).select("call_id", "name", F.col("qualifier").alias("container"))
    types = s.filter(of_type).select(F.col("name").alias("container")).distinct()
    bound = imports.select("file", "local", F.col("target_file").alias("of"), F.coalesce("symbol", "local").alias("name")).distinct()
    bound = _summed(bound.join(s.select("id", "name", F.col("file").alias("of")), ["name", "of"], "left"), "file", "local")
    near = free.join(imports.select("file", F.col("target_file").alias("of")).distinct(), "file").join(_summed(functions, "name", "file").withColumnRenamed("file", "of"), ["name", "of"])
    near = near.groupBy("call_id").agg(F.min("target").alias("target"), F.max("last").alias("last")).filter("target = last").withColumn("n", F.lit(1).cast("long"))
    single = functions.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("target")).filter("n = 1")
    in_trait = F.col("container").isin(*traits) if traits else F.lit(False)
    methods = s.filter("kind = 'method'").groupBy("name").agg(F.countDistinct("id").alias("n"), F.min("id").alias("target"), F.countDistinct("container").alias("owners"), F.bool_or(in_trait).alias("trait"))
    one_trait = F.coalesce("trait", F.lit(False)) & (F.col("owners") == 1)
    rungs = [
        rung(c.filter(of_self).select("call_id", "name", "container").join(members, ["name", "container"]), 1, "self"),
        rung(named.join(types, "container").join(members, ["name", "container"], "left"), 3, "type"),
        rung(free.join(_summed(s.filter(F.col("kind").isin("function", *TYPES)), "name", "file"), ["name", "file"]), 4, "same-file"),
        rung(free.join(bound.withColumnRenamed("local", "name"), ["file", "name"]), 5, "import"),
        rung(near, 6, "imported-file", 0.9),
        rung(free.join(single, "name"), 7, "unique", 0.5, "possible_call"),
        rung(named.select("call_id", "name").join(methods, "name"), 9, "method", F.when(one_trait, 0.7).otherwise(0.5), F.when(one_trait, "calls_trait_method").otherwise("possible_call")),
    ]
    first = reduce(DataFrame.unionByName, rungs).groupBy("call_id").agg(F.min(F.struct("priority", "n", "target", "kind", "confidence", "method")).alias("first")).select("call_id", "first.*")
    out = c.select("call_id").join(first, "call_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    one = lambda column: F.when(F.col("n") == 1, F.col(column)).alias(column)
    state = F.when(F.col("n") == 1, "edge").when(F.col("n") > 1, "ambiguous").otherwise("unresolved")
    out = out.select("call_id", state.alias("state"), one("target"), "n", one("kind"), one("confidence"), one("method"))
    made = s.filter(of_type).select(F.col("id").alias("target"), F.lit(True).alias("is_type")).distinct()
    out = out.join(made, "target", "left").withColumn("kind", F.when(F.col("is_type") & (F.col("kind") == "calls"), "instantiates").otherwise(F.col("kind")))
    return out.select("call_id", "state", "target", "n", "kind", "confidence", "method")


def resolve_calls(calls: DataFrame, symbols: DataFrame, imports: DataFrame, traits: tuple[str, ...] = ()) -> DataFrame:
    """The whole ladder with the list of candidates of each call; calling a type makes an instance.  Where names are borne by many
    symbols, count_calls gives the same without the lists."""
    rungs = [self_receiver(calls, symbols), type_qualifier(calls, symbols), same_file(calls, symbols), import_binding(calls, symbols, imports), imported_file(calls, symbols, imports), globally_unique(calls, symbols), unique_method(calls, symbols, traits)]
    types = symbols.filter(F.col("kind").isin(*TYPES)).select(F.col("id").alias("target"), F.lit(True).alias("is_type"))
    decided = decide(calls, rungs).join(types, "target", "left")
    return decided.withColumn("kind", F.when(F.col("is_type") & (F.col("kind") == "calls"), "instantiates").otherwise(F.col("kind"))).drop("is_type")


def resolve_references(refs: DataFrame, symbols: DataFrame, imports: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """Types and values referred to by name, among symbols of the given kinds: same file, import, imported file."""
    fit = symbols.filter(F.col("kind").isin(*kinds))
    here = _rung(refs.filter("qualifier is null").select("call_id", "name", "file").join(fit.select("id", "name", "file"), ["name", "file"]), 1, 1.0, "same-file", "references")
    bound = import_binding(refs, fit, imports, 2).withColumn("kind", F.lit("references"))
    near = imported_file(refs, fit.withColumn("kind", F.lit("function")), imports, 3).withColumn("kind", F.lit("references"))
    return decide(refs, [here, bound, near])


def _near(hits: DataFrame) -> DataFrame:
    """Of a call's candidates (file: the call's, at: the candidate's) those in the call's own file, if any is."""
    own = hits.withColumn("own", F.col("at") == F.col("file")).withColumn("any", F.max("own").over(W.partitionBy("call_id")))
    return own.filter(F.col("own") | ~F.coalesce("any", F.lit(False))).drop("own", "any")


def _members(asked: DataFrame, symbols: DataFrame) -> DataFrame:
    """call_id, file, id, at of the members `name` of the type `type`."""
    s = symbols.filter("container is not null").select("id", "name", F.col("container").alias("type"), F.col("file").alias("at"))
    return asked.join(s, ["type", "name"]).select("call_id", "file", "id", "at")


def _tops(asked: DataFrame, symbols: DataFrame) -> DataFrame:
    """call_id, id of the only declaration `name` at the top of the file `target_file`."""
    s = symbols.filter("container is null").select("id", "name", F.col("file").alias("target_file"))
    return _only(asked.join(s, ["target_file", "name"]))


def _imported_types(imports: DataFrame) -> DataFrame:
    return imports.filter("not is_module").groupBy("file", F.col("local").alias("last")).agg(F.min("imported").alias("imported"))


def path_qualifiers(calls: DataFrame, symbols: DataFrame, imports: DataFrame, modules: DataFrame) -> DataFrame:
    """call_id, state, target, candidates, method of calls (call_id, file, qualifier, name) through a path `a::b::name`: members of the
    type its last segment names (under its imported name), then what the module that a lone segment is bound to holds, then the
    module at the path from the crate's root (modules: path, file), then a function in a module written inline (qualified_name
    `b::name`).  What none of these knows is unresolved: the name alone is never looked for.

    imports: file, local, imported, is_module, target_file."""
    c = calls.withColumn("parts", F.filter(F.split("qualifier", "::"), lambda s: s != "")).withColumn("last", F.element_at("parts", -1))
    c = c.join(_imported_types(imports), ["file", "last"], "left").withColumn("type", F.coalesce("imported", "last"))
    members = _near(_members(c.select("call_id", "file", "name", "type"), symbols))
    bound = imports.filter("target_file is not null").groupBy("file", F.col("local").alias("last")).agg(F.min("target_file").alias("target_file"))
    alias = _tops(c.filter(F.size("parts") == 1).join(bound, ["file", "last"]).select("call_id", "name", "target_file"), symbols)
    inner = F.filter("parts", lambda s: ~s.isin("crate", "self", "super"))
    path = c.withColumn("path", F.array_join(inner, "::"))
    crate = _tops(path.join(modules.select("path", F.col("file").alias("target_file")), "path").select("call_id", "name", "target_file"), symbols)
    inline = symbols.filter("kind = 'function'").select("id", F.col("qualified_name").alias("full"), F.col("file").alias("at"))
    written = _near(path.filter("path <> ''").select("call_id", "file", F.concat_ws("::", "path", "name").alias("full")).join(inline, "full").select("call_id", "file", "id", "at"))
    rungs = [_rung(members, 1, 1.0, "qualifier_type"), _rung(alias, 2, 1.0, "qualifier_module"), _rung(crate, 3, 1.0, "qualifier_module"), _rung(written, 4, 1.0, "inline_module")]
    return decide(calls, rungs).select("call_id", "state", "target", "candidates", "method")


def receivers(calls: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """call_id, state, target, candidates, method of calls (call_id, file, qualifier, receiver_type, name) on a receiver: what the module it
    is bound to holds at its top (nothing else then), static members of the class it imports, what a namespace of the file
    declares (qualified_name `ns.name`), the one member of the type it is annotated with, members of a type with a capital."""
    c = calls.withColumn("last", F.col("qualifier"))
    bound = imports.filter("is_module").groupBy("file", F.col("local").alias("last")).agg(F.min("target_file").alias("target_file"))
    spaces = c.join(bound, ["file", "last"])
    held = spaces.select("call_id").join(_tops(spaces.select("call_id", "name", "target_file"), symbols), "call_id", "left")  # a module without it stops
    typed = _imported_types(imports)
    static = _near(_members(c.join(typed, ["file", "last"]).select("call_id", "file", "name", F.col("imported").alias("type")), symbols))
    inside = symbols.filter("kind = 'function' and container is null").select("id", "file", F.col("qualified_name").alias("full"))
    member = _only(c.select("call_id", "file", F.concat_ws(".", "qualifier", "name").alias("full")).join(inside, ["file", "full"]))
    noted = c.filter("receiver_type is not null").join(typed.withColumnRenamed("last", "receiver_type"), ["file", "receiver_type"], "left")
    noted = _only(_near(_members(noted.select("call_id", "file", "name", F.coalesce("imported", "receiver_type").alias("type")), symbols)))
    capital = _near(_members(c.filter(F.col("qualifier").rlike("^[A-Z][A-Za-z0-9_]*$")).select("call_id", "file", "name", F.col("qualifier").alias("type")), symbols))
    rungs = [_rung(held, 1, 1.0, "import_namespace"), _rung(static, 2, 1.0, "qualifier_type"), _rung(member, 3, 1.0, "namespace_member"), _rung(noted, 4, 1.0, "type_annotation"), _rung(capital, 5, 1.0, "qualifier_type")]
    return decide(calls, rungs).select("call_id", "state", "target", "candidates", "method")


def with_facts(decided: DataFrame, facts: DataFrame) -> DataFrame:
    """decided(call_id, state, target, candidates or n, kind, confidence, method) with what a type checker knows (facts: call_id, target) in
    place of what the ladder found; of several facts on one call none counts."""
    known = facts.groupBy("call_id").agg(F.min("target").alias("fact"), F.countDistinct("target").alias("n")).filter("n = 1").drop("n")
    x = decided.join(known, "call_id", "left")
    over = F.col("fact").isNotNull()
    value = {"state": F.lit("edge"), "target": F.col("fact"), "candidates": F.array("fact"), "kind": F.coalesce("kind", F.lit("calls")), "confidence": F.lit(1.0), "method": F.lit("checker")}
    value = {c: x for c, x in value.items() if c != "candidates"} | {"n": F.lit(1).cast("long")} if "n" in decided.columns else value
    return x.select("call_id", *(F.when(over, v).otherwise(F.col(c)).alias(c) for c, v in value.items()))


def provenance(method: Column) -> Column:
    return F.when(method.isin("self", "type", "same-file", "import"), "resolved").when(method == "imported-file", "inferred").when(method.isin("unique", "method"), "guessed")


def resolve_imports(imports: DataFrame, files: DataFrame, extensions: tuple[str, ...] = ("ts", "tsx", "js", "jsx", "py", "rs")) -> DataFrame:
    """file, module, target_file: relative modules against the importing file's directory, with extensions and index files
    tried in order, as one equi join on all spellings of the existing files."""
    spelled = []
    for rank, e in enumerate(extensions):
        spelled.append(files.filter(F.col("path").endswith(f".{e}")).select(F.regexp_replace("path", rf"\.{e}$", "").alias("stem"), F.col("path").alias("target_file"), F.lit(2 * rank).alias("rank")))
        spelled.append(files.filter(F.col("path").rlike(rf"/(index|__init__|mod)\.{e}$")).select(F.regexp_replace("path", rf"/(index|__init__|mod)\.{e}$", "").alias("stem"), F.col("path").alias("target_file"), F.lit(2 * rank + 1).alias("rank")))
    spelled.append(files.select(F.col("path").alias("stem"), F.col("path").alias("target_file"), F.lit(-1).alias("rank")))
    known = reduce(DataFrame.unionByName, spelled)
    steps = F.concat(F.slice(F.split("file", "/"), 1, F.size(F.split("file", "/")) - 1), F.split("module", "/"))
    stem = F.array_join(F.aggregate(steps, F.array().cast("array<string>"), lambda done, s: F.when((s == ".") | (s == ""), done).when(s == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.array_append(done, s))), "/")
    asked = imports.filter(F.col("module").startswith(".")).select("file", "module", stem.alias("stem"))
    return asked.join(known, "stem").groupBy("file", "module").agg(F.min_by("target_file", F.struct("rank", "target_file")).alias("target_file"))
