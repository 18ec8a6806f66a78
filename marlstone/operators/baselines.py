"""Baselines of references from documents to declarations: capture, moves, and checks against files edited since.

references: doc, ref.  baselines: doc, ref, body_hash, fingerprint, neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marlstone.functions import text as T


#: Kinds of edges whose ends are a declaration's callers and callees.
CALLS = ("calls", "instantiates")


def capture(references: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The present state of each reference that names one node (nodes: id, ref, body, body_hash): the recorded body hash, or else that of
    the body, the node's id as fingerprint, and all its callers and callees by edges(source, target, kind), in order."""
    single = nodes.withColumn("n", F.count(F.lit(1)).over(W.partitionBy("ref"))).filter("n = 1")
    body_hash = F.coalesce(F.when(F.col("body_hash") != "", F.col("body_hash")), T.body_hash(F.col("body")))
    hit = references.join(single.select("ref", "id", body_hash.alias("body_hash")), "ref")
    calls = edges.filter(F.col("kind").isin(*CALLS))
    both = calls.select(F.col("source").alias("id"), F.col("target").alias("near")).union(calls.select("target", "source")).filter("id <> near")
    near = both.join(hit.select("id").distinct(), "id", "left_semi").groupBy("id").agg(F.array_sort(F.collect_set("near")).alias("neighbours"))
    neighbours = F.coalesce("neighbours", F.array().cast("array<string>")).alias("neighbours")
    return hit.join(near, "id", "left").select("doc", "ref", "body_hash", F.col("id").alias("fingerprint"), neighbours)


def move(baselines: DataFrame, moves: DataFrame) -> DataFrame:
    """baselines after moves(doc, old_ref, new_ref, new_id): the reference and fingerprint change, the body hash stays; what stood at the
    new reference is replaced."""
    m = moves.select("doc", F.col("old_ref").alias("ref"), "new_ref", "new_id")
    moved = baselines.join(m, ["doc", "ref"]).select("doc", F.col("new_ref").alias("ref"), "body_hash", F.col("new_id").alias("fingerprint"), "neighbours")
    stay = baselines.join(m.select("doc", "ref"), ["doc", "ref"], "left_anti").join(moved.select("doc", "ref"), ["doc", "ref"], "left_anti")
    return stay.select("doc", "ref", "body_hash", "fingerprint", "neighbours").unionByName(moved)


def resolve_in_symbols(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """ref_id, n, body_hash of refs(ref_id, kind, path, name) among fresh symbols(path, kind, name, qualified_name, container,
    body): of an equivalent kind, by qualified name or a bare one; candidates are narrowed to the qualified name, then the kind,
    then what lies at the top, each where that leaves any (one, for the last)."""
    plain = lambda c: F.replace(F.col(c), F.lit("::"), F.lit("."))
    s = symbols.select("path", F.col("kind").alias("s_kind"), F.col("name").alias("s_name"), plain("qualified_name").alias("s_full"), F.col("container").isNull().alias("top"), T.body_hash(F.col("body")).alias("hash"))
    s = s.groupBy("path", "s_kind", "s_name", "s_full", "top").agg(F.count(F.lit(1)).alias("members"), F.min("hash").alias("hash"))  # symbols alike meet a reference as one row
    r = refs.select("ref_id", "kind", "path", "name", plain("name").alias("full"))
    bare = ~F.contains(F.col("full"), F.lit("."))
    whole = r.join(s.withColumn("full", F.col("s_full")), ["path", "full"]).withColumn("is_full", F.lit(True))
    short = r.filter(bare).join(s.withColumn("name", F.col("s_name")), ["path", "name"]).filter(~F.col("s_full").eqNullSafe(F.col("full"))).withColumn("is_full", F.when(F.col("s_full").isNotNull(), False))
    hit = whole.unionByName(short).filter(T.kinds_equivalent(F.col("kind"), F.col("s_kind")))
    w = W.partitionBy("ref_id")
    for test in (F.col("is_full"), F.col("s_kind") == F.col("kind")):
        hit = hit.withColumn("is", test).withColumn("any", F.max("is").over(w)).filter(F.col("is") | ~F.col("any")).drop("is", "any")
    hit = hit.withColumn("tops", F.sum(F.when(F.col("top"), F.col("members")).otherwise(0)).over(w)).filter((F.col("tops") != 1) | F.col("top"))
    found = hit.groupBy("ref_id").agg(F.sum("members").alias("n"), F.min("hash").alias("body_hash"))
    return r.select("ref_id").join(found, "ref_id", "left").select("ref_id", F.coalesce("n", F.lit(0)).alias("n"), F.when(F.col("n") == 1, F.col("body_hash")).alias("body_hash"))


def check_with_changes(refs: DataFrame, indexed: DataFrame, changes: DataFrame, symbols: DataFrame) -> DataFrame:
    """ref_id, state (fresh, changed, unverified), reason of refs(ref_id, kind, path, name, recorded_hash).  Files of changes(path,
    change: edited, deleted, unparsed) are judged by their fresh symbols, all others by what is indexed(ref_id, state,
    body_hash)."""
    x = refs.join(changes, "path", "left").join(resolve_in_symbols(refs, symbols).withColumnRenamed("body_hash", "fresh_hash"), "ref_id").join(indexed.select("ref_id", "state", "body_hash"), "ref_id", "left")
    edited = F.col("change") == "edited"
    reason = (
        F.when(F.col("change") == "deleted", "deleted").when(F.col("change") == "unparsed", "unparsed").when(edited & (F.col("n") == 0), "moved").when(edited & (F.col("n") > 1), "several")
        .when(edited, F.lit(None)).when(F.col("state") == "Ambiguous", "several").when(F.coalesce("state", F.lit("Missing")) == "Missing", "moved")
    )
    now = F.when(edited, F.col("fresh_hash")).otherwise(F.col("body_hash"))
    state = F.when(reason.isNotNull() | F.col("recorded_hash").isNull() | now.isNull(), "unverified").when(now == F.col("recorded_hash"), "fresh").otherwise("changed")
    return x.select("ref_id", state.alias("state"), reason.alias("reason"))
