"""Calls that carry their argument labels (`move(to:by:)`), resolved among overloads and by module scope.

decls: id, file, name, kind, container (null at the top), labels (of its parameters, null where it takes none by label), exported.
calls: call_id, file, target (a selector or a bare name), receiver, is_method, receiver_type, container (of the caller).
imports: file, module, testable.

Rungs, the first with any candidate decides: members of the enclosing type (no receiver, or self / Self), members of the receiver's known
type, static members and cases of a type that is named, functions and types of the module (or of one it imports: exported ones, all where
the import is testable).  Within a rung labels keep those overloads that match, if any do; the caller's own file goes before others.  One
candidate is an edge, more are ambiguous.  Candidates meet their calls by equi joins on container or module and name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CALLABLE, TYPES = ("function", "method", "init"), ("class", "struct", "enum", "protocol", "actor")
#: Rungs with their method; a case that is built refers to it.
RUNGS = ("same_container", "type_annotation", "qualifier_type", "enum_case", "swift-module")


def module_root(path: Column) -> Column:
    """The folder of the module a file belongs to: a target under the last Sources or Tests, or else the top folder."""
    target = F.regexp_extract(path, r"^((?:.*/)?(?:Sources|Tests)/[^/]+)/[^/]+", 1)
    return F.when(target != "", target).when(path.contains("/"), F.substring_index(path, "/", 1)).otherwise("")


def module_name(path: Column) -> Column:
    return F.substring_index(module_root(path), "/", -1)


def base_name(target: Column) -> Column:
    return F.when(target.endswith(")") & target.contains("("), F.substring_index(target, "(", 1)).otherwise(target)


def labels_of(target: Column) -> Column:
    """The argument labels of a selector; null for a bare name."""
    inner = F.regexp_extract(target, r"^[^(]*\((.*)\)$", 1)
    return F.when(target.endswith(")") & target.contains("("), F.filter(F.split(inner, ":"), lambda s: s != ""))


def labels_match(call: Column, decl: Column) -> Column:
    """Whether labels agree one by one; `*`, a trailing closure, agrees with any."""
    return F.coalesce((F.size(call) == F.size(decl)) & F.forall(F.zip_with(call, decl, lambda c, d: (c == "*") | (c == d)), lambda x: x), F.lit(False))


def resolve_calls(calls: DataFrame, decls: DataFrame, imports: DataFrame) -> DataFrame:
    """call_id, target_id (null where ambiguous), kind (calls, references), method and candidates of every call that a rung answers.

    What is resolved are the shapes of calls, against classes of declarations alike in all that is asked of them, with their number and
    least id: neither equal calls nor equal declarations are paired one by one."""
    asked = ["file", "target", "receiver", "is_method", "receiver_type", "container"]
    shaped = calls.select("call_id", F.to_json(F.struct(*asked)).alias("shape"), *asked)
    found = _resolve_shapes(shaped.drop("call_id").distinct(), _alike(decls), imports)
    of_calls = shaped.select("call_id", "shape").join(found, "shape").groupBy("call_id", "place").agg(F.sum("n").alias("n"), F.min("id").alias("id"))
    best = of_calls.groupBy("call_id").agg(F.min(F.struct("place", "n", "id")).alias("best")).select("call_id", "best.*")  # a call_id may stand for several calls
    rung = F.floor(F.col("place") / 4).cast("int")
    kind = F.when(rung == 3, "references").otherwise("calls")
    return best.select("call_id", F.when(F.col("n") == 1, F.col("id")).alias("target_id"), kind.alias("kind"), F.array(*map(F.lit, RUNGS))[rung].alias("method"), F.col("n").alias("candidates"))


def _alike(decls: DataFrame) -> DataFrame:
    """decls without their ids, each once, with the number of those alike (members) and the least id."""
    held = ["file", "name", "kind", "container", "labels", "exported"]
    return decls.groupBy(*held).agg(F.count(F.lit(1)).alias("members"), F.min("id").alias("id"))


def _resolve_shapes(calls: DataFrame, decls: DataFrame, imports: DataFrame) -> DataFrame:
    """shape, place, n, id: the number and least id of the candidates at a shape's first place.  Places are four a rung: labels and file
    agree, labels alone do, the file alone, neither."""
    c = calls.withColumns({"base": base_name(F.col("target")), "labels": labels_of(F.col("target")), "receiver": F.trim("receiver")})
    implicit = F.col("receiver").isNull() & ~F.col("is_method")
    held = [F.col("shape"), F.col("labels"), F.col("file").alias("call_file"), F.col("base").alias("name")]
    members = decls.filter("container is not null").select("id", "members", "file", "name", "container", F.col("kind").alias("decl_kind"), F.col("labels").alias("decl_labels"))
    callable_members = members.filter(F.col("decl_kind").isin(*CALLABLE))
    named = F.col("receiver").rlike(r"^\p{Lu}[\p{L}\p{N}_]*$") & ~F.col("receiver").isin("Self")

    def rung(at: int, rows: DataFrame, container: str, of: DataFrame) -> DataFrame:
        found = rows.select(*held, F.col(container).alias("container")).join(of, ["container", "name"])
        return found.select("shape", F.lit(at).alias("rung"), "id", "members", "file", "call_file", "labels", "decl_labels")

    own = c.filter(implicit | F.col("receiver").isin("self", "Self"))
    scope = decls.filter((F.col("kind").isin(*CALLABLE) & F.col("container").isNull()) | F.col("kind").isin(*TYPES))
    scope = scope.filter(F.col("file").endswith(".swift")).select("id", "members", "file", "name", F.col("labels").alias("decl_labels"), "exported", module_root(F.col("file")).alias("root"), module_name(F.col("file")).alias("module"))
    free = c.filter(implicit).select(*held, module_root(F.col("file")).alias("root"))
    inside = free.join(scope, ["root", "name"])
    seen = imports.groupBy(F.col("file").alias("call_file"), "module").agg(F.bool_or("testable").alias("testable"))
    beyond = free.withColumnRenamed("root", "own_root").join(seen, "call_file").join(scope, ["module", "name"]).filter((F.col("root") != F.col("own_root")) & (F.col("exported") | F.col("testable")))
    columns = ["shape", F.lit(4).alias("rung"), "id", "members", "file", "call_file", "labels", "decl_labels"]
    candidates = rung(0, own, "container", callable_members)
    for more in (
        rung(1, c.filter("receiver_type is not null"), "receiver_type", callable_members), rung(2, c.filter(named), "receiver", callable_members), rung(3, c.filter(named), "receiver", members.filter("decl_kind = 'enum_member'")), inside.select(*columns), beyond.select(*columns),
    ):
        candidates = candidates.unionByName(more)
    apart = F.when(labels_match(F.col("labels"), F.col("decl_labels")), 0).otherwise(2) + F.when(F.col("file") == F.col("call_file"), 0).otherwise(1)
    places = candidates.groupBy("shape", (F.col("rung") * 4 + apart).alias("place")).agg(F.sum("members").alias("n"), F.min("id").alias("id"))
    return places.groupBy("shape").agg(F.min(F.struct("place", "n", "id")).alias("best")).select("shape", "best.*")
