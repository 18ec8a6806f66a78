"""Lookups, joins and aggregates over the property graph (nodes, edges).

Every join is an equi join that Catalyst plans: the small, filtered side is broadcast only if its measured size allows
it.  Each ordering ends in a unique key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marlstone.functions import text as T

#: Kinds that carry calls, kinds of mere structure, and kinds that are not declarations.
CALL_KINDS = ("calls", "calls_trait_method", "possible_call", "instantiates")
STRUCTURE_KINDS = ("contains", "exports")
CONTAINERS = ("file", "module")


def by_ids(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """Nodes of ids (id, pos), in the order of pos."""
    return nodes.join(ids, "id").orderBy("pos")


def where_defined(nodes: DataFrame, name: str) -> DataFrame:
    """Declarations with this id, else with exactly this name or qualified name; never files or modules."""
    hit = nodes.filter((F.col("id") == name) | (((F.col("name") == name) | (F.col("qualified_name") == name)) & ~F.col("kind").isin(*CONTAINERS)))
    first = hit.withColumn("by_id", (F.col("id") == name).cast("int"))
    best = first.withColumn("best", F.max("by_id").over(W.partitionBy(F.lit(1)))).filter("by_id = best")  # the matches of one name
    return best.drop("by_id", "best").orderBy("file_path", "start_line", "id")


def neighbours(nodes: DataFrame, edges: DataFrame, ids: DataFrame, incoming: bool, kinds: tuple[str, ...] = CALL_KINDS) -> DataFrame:
    """Callers (incoming) or callees of the nodes in ids(node): one row a neighbour with its first call line, low-value
    paths last."""
    near, far = ("target", "source") if incoming else ("source", "target")
    found = edges.filter(F.col("kind").isin(*kinds)).join(ids, F.col(near) == F.col("node"), "left_semi").groupBy(F.col(far).alias("id")).agg(F.min("line").alias("line"))
    rows = nodes.join(found, "id").withColumn("low_value", T.is_low_value_path(F.col("file_path")))
    return rows.orderBy("low_value", F.col("line").asc_nulls_last(), "id")


def who_calls(nodes: DataFrame, edges: DataFrame, unresolved: DataFrame, name: str) -> DataFrame:
    """Callers of every declaration of a name, then call sites that may mean it; the first phase that meets a node keeps it."""
    ids = where_defined(nodes, name).select(F.col("id").alias("node"))
    sure = neighbours(nodes, edges, ids, True).select("id", "line", F.lit(0).alias("phase"))
    maybe = unresolved.filter(F.col("name") == name).groupBy(F.col("source").alias("id")).agg(F.min("line").alias("line")).withColumn("phase", F.lit(1))
    first = W.partitionBy("id").orderBy("phase", F.col("line").asc_nulls_last())
    return sure.unionByName(maybe).withColumn("rn", F.row_number().over(first)).filter("rn = 1").drop("rn")


def what_calls(nodes: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    """Callees of every declaration of a name, and of the file node where the name is an indexed path; one row a callee, in the order of the
    least id that calls it."""
    files = nodes.filter((F.col("kind") == "file") & (F.col("file_path") == name)).select("id")
    sources = where_defined(nodes, name).select("id").union(files).distinct()
    found = edges.filter(F.col("kind").isin(*CALL_KINDS)).join(sources.select(F.col("id").alias("source")), "source")
    first = found.groupBy(F.col("target").alias("id")).agg(F.min("source").alias("by"), F.min("line").alias("line"))
    return nodes.join(first, "id").orderBy("by", "id")


def unresolved_sites(refs: DataFrame, name: str, limit: int) -> DataFrame:
    """Call sites by this name or ending in it after a dot or colons, with the number of all of them on each row."""
    import re

    hit = refs.filter(F.col("name").contains(name) & F.col("name").rlike(rf"(^|\.|::){re.escape(name)}$"))
    total = hit.agg(F.count(F.lit(1)).alias("total"))
    return hit.orderBy("source", "line", "name").limit(limit).join(F.broadcast(total))  # one row


def who_imports(bindings: DataFrame, wanted: DataFrame) -> DataFrame:
    """Files that import what `wanted`(key) names: a binding answers to its file, its stem, its module, the module's last
    segment and its symbol.  The disjunction is an equi join on the exploded keys, not a nested loop."""
    keys = F.array_distinct(F.array(F.col("module"), T.last_segment(F.col("module")), T.path_stem(F.col("module")), F.col("symbol"), F.col("target_file")))
    return bindings.withColumn("key", F.explode(F.filter(keys, lambda k: k.isNotNull()))).join(wanted, "key").select("source_file", "module", "symbol").distinct()


def _buckets(first: str, last: str, width: int) -> Column:
    return F.explode(F.sequence(F.floor(F.col(first) / width), F.floor(F.col(last) / width)))


def enclosing(points: DataFrame, spans: DataFrame, width: int = 64) -> DataFrame:
    """The smallest span of the same file around each point (point_id, file_path, at), by lines cut into buckets of width.

    A span reaches as many buckets as it covers; a point lies in one, so the range join is an equi join with a residual.  Equal spans
    are joined as one, by their least id, and equal points as one."""
    places = points.select("file_path", "at").distinct().withColumn("bucket", F.floor(F.col("at") / width))
    s = spans.filter("end_line >= start_line").groupBy(F.col("file_path").alias("span_file"), "start_line", "end_line").agg(F.min("id").alias("id")).withColumn("span_bucket", _buckets("start_line", "end_line", width))
    hits = places.join(s, (F.col("file_path") == F.col("span_file")) & (F.col("bucket") == F.col("span_bucket")) & F.col("at").between(F.col("start_line"), F.col("end_line")))
    best = hits.groupBy("file_path", "at").agg(F.min(F.struct((F.col("end_line") - F.col("start_line")).alias("size"), (-F.col("start_line")).alias("later"), "id")).alias("best"))
    return points.select("point_id", "file_path", "at").join(best, ["file_path", "at"]).select("point_id", F.col("best.id").alias("id"))


def overlapping(chunks: DataFrame, spans: DataFrame, most: int = 8, width: int = 64) -> DataFrame:
    """For each chunk (chunk_id, file_path, first, last) the declarations that overlap it: containers last, then larger
    overlap, smaller span, id; at most `most`.

    Equal chunks are answered once.  Equal spans stand as one until the best `most` of a chunk are known, then as their `most` least
    ids, which are all that can come first."""
    same = ["file_path", "first", "last"]
    held = spans.filter("end_line >= start_line").select("id", "kind", F.col("kind").isin(*CONTAINERS).alias("container"), F.col("file_path").alias("span_file"), "start_line", "end_line")
    shape = ["span_file", "start_line", "end_line", "container"]
    s = held.groupBy(*shape).agg(F.min("id").alias("least")).withColumn("span_bucket", _buckets("start_line", "end_line", width))
    c = chunks.select(*same).distinct().withColumn("bucket", _buckets("first", "last", width))
    hit = c.join(s, (F.col("file_path") == F.col("span_file")) & (F.col("bucket") == F.col("span_bucket")) & (F.col("start_line") <= F.col("last")) & (F.col("end_line") >= F.col("first")))
    hit = hit.filter(F.col("bucket") == F.floor(F.greatest("start_line", "first") / width))  # a pair counts in the bucket that its overlap begins in
    hit = hit.select(*same, *shape, "least", (F.least("end_line", "last") - F.greatest("start_line", "first") + 1).alias("overlap"), (F.col("end_line") - F.col("start_line")).alias("span"))
    order = [F.col("container"), F.desc("overlap"), F.col("span")]
    few = hit.withColumn("place", F.row_number().over(W.partitionBy(*same).orderBy(*order, "least"))).filter(F.col("place") <= most).drop("place", "least")
    ids = held.withColumn("nth", F.row_number().over(W.partitionBy(*shape).orderBy("id"))).filter(F.col("nth") <= most).drop("nth")
    best = few.join(ids, shape).withColumn("rank", F.row_number().over(W.partitionBy(*same).orderBy(*order, "id"))).filter(F.col("rank") <= most)
    return chunks.select("chunk_id", *same).join(best, same).select("chunk_id", "id", "kind", "overlap", "span", "rank")


def lexical_parents(spans: DataFrame, width: int = 64) -> DataFrame:
    """id, parent: the smallest other span of the file that holds the whole span (equal spans: the smaller id).

    Of equal spans all but the least id have that one as their parent; what is left is a join of different spans, first for the size of
    the smallest that holds each, then for the least id among those of this size."""
    same = ["file_path", "start_line", "end_line"]
    least = spans.groupBy(*same).agg(F.min("id").alias("least"))
    size = F.col("end_line") - F.col("start_line")
    inner = least.select("file_path", F.col("start_line").alias("at"), F.col("end_line").alias("until"), size.alias("own"), F.floor(F.col("start_line") / width).alias("bucket"))
    outer = least.filter("end_line >= start_line").select(F.col("file_path").alias("span_file"), "start_line", "end_line", "least", size.alias("size"), _buckets("start_line", "end_line", width).alias("span_bucket"))
    fits = (F.col("file_path") == F.col("span_file")) & (F.col("bucket") == F.col("span_bucket")) & (F.col("at") >= F.col("start_line")) & (F.col("until") <= F.col("end_line"))
    smallest = inner.join(outer, fits & (F.col("size") > F.col("own"))).groupBy("file_path", "at", "until", "bucket").agg(F.min("size").alias("best"))
    above = smallest.join(outer, fits & (F.col("size") == F.col("best"))).groupBy("file_path", F.col("at").alias("start_line"), F.col("until").alias("end_line")).agg(F.min("least").alias("above"))
    held = spans.select("id", *same).join(least, same).join(above, same, "left")
    own = (F.col("id") > F.col("least")) & (F.col("end_line") >= F.col("start_line"))
    return held.select("id", F.when(own, F.col("least")).otherwise(F.col("above")).alias("parent")).filter("parent is not null")


def shared_neighbours(edges: DataFrame, given: DataFrame, least: int = 2, limit: int = 64) -> DataFrame:
    """Nodes adjacent to at least `least` of the given nodes(node), most shared first."""
    both = edges.select(F.col("source").alias("id"), F.col("target").alias("node")).unionByName(edges.select(F.col("target").alias("id"), F.col("source").alias("node"))).distinct()
    return both.join(given, "node").groupBy("id").agg(F.count(F.lit(1)).alias("shared")).filter(F.col("shared") >= least).orderBy(F.desc("shared"), "id").limit(limit)


def resolve_refs(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """ref_id, state (Missing, Resolved, Ambiguous), id of references (ref_id, ref_kind, ref_path, ref_name): within the
    path, exact qualified names go before names of the same kind, these before any name; the first stage with a hit decides.

    Nodes are counted by path and name before the join, so that a reference meets one row a kind, however many bear its name."""
    n = nodes.select("id", F.col("file_path").alias("ref_path"), "kind", "name", "qualified_name")
    counts = [F.count(F.lit(1)).alias("n"), F.min("id").alias("id")]
    full = n.groupBy("ref_path", F.col("qualified_name").alias("ref_name")).agg(*counts)
    bare = n.groupBy("ref_path", F.col("name").alias("ref_name"), "kind").agg(*counts)
    exact = refs.join(full, ["ref_path", "ref_name"]).select("ref_id", F.lit(0).alias("stage"), "n", "id")
    named = refs.join(bare, ["ref_path", "ref_name"]).select("ref_id", F.when(T.kinds_equivalent(F.col("kind"), F.col("ref_kind")), 1).otherwise(2).alias("stage"), "n", "id")
    best = exact.unionByName(named).groupBy("ref_id").agg(F.min(F.struct("stage", "id")).alias("best"), *(F.sum(F.when(F.col("stage") == s, F.col("n"))).alias(f"n{s}") for s in range(3)))
    n_best = F.coalesce("n0", "n1", "n2", F.lit(0))
    state = F.when(n_best == 0, "Missing").when(n_best == 1, "Resolved").otherwise("Ambiguous")
    return refs.select("ref_id").distinct().join(best, "ref_id", "left").select("ref_id", state.alias("state"), F.when(n_best == 1, F.col("best.id")).alias("id"))


def for_code(groundings: DataFrame, entities: DataFrame, wanted: DataFrame, rank_of: Column) -> DataFrame:
    """Entities grounded to any of wanted(node_id): how many of these they touch, their worst health; most first."""
    hits = groundings.join(wanted, "node_id").groupBy("entity_id").agg(F.countDistinct("node_id").alias("matched"), F.max(rank_of).alias("worst"))
    return hits.join(entities, "entity_id")


def hot_members(members: DataFrame, key: str, item: str, most: int) -> DataFrame:
    """key, item of keys with more than `most` items: what stands for the pairs of such a key, whose number would be its square."""
    m = members.select(key, item).distinct()
    return m.join(m.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most).select(key), key)


def candidate_pairs(members: DataFrame, key: str, item: str, most: int = 64) -> DataFrame:
    """Unordered pairs of items (a < b) that share a key of at most `most` items, with how many keys they share in all.  Keys of more
    items count through the items' memberships; pairs that share nothing else are in hot_members, as classes."""
    m = members.select(key, item).distinct()
    few = m.join(m.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") <= most).select(key), key)
    pairs = few.select(key, F.col(item).alias("a")).join(few.select(key, F.col(item).alias("b")), key).filter("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    hot = hot_members(members, key, item, most).groupBy(item).agg(F.collect_set(key).alias("hot"))
    pairs = pairs.join(hot.select(F.col(item).alias("a"), F.col("hot").alias("hot_a")), "a", "left").join(hot.select(F.col(item).alias("b"), F.col("hot").alias("hot_b")), "b", "left")
    more = F.coalesce(F.size(F.array_intersect("hot_a", "hot_b")), F.lit(0))
    return pairs.select("a", "b", (F.col("n") + F.when(F.col("hot_a").isNotNull() & F.col("hot_b").isNotNull(), more).otherwise(0)).alias("shared"))


def undirected(edges: DataFrame) -> DataFrame:
    """node, neighbour of both directions, loops left out."""
    both = edges.select(F.col("source").alias("node"), F.col("target").alias("neighbour")).union(edges.select("target", "source"))
    return both.filter("node <> neighbour").distinct()


def call_degrees(edges: DataFrame) -> DataFrame:
    """id, callers, callees: distinct neighbours by call."""
    calls = edges.filter(F.col("kind").isin(*CALL_KINDS))
    into = calls.groupBy(F.col("target").alias("id")).agg(F.countDistinct("source").alias("callers"))
    out = calls.groupBy(F.col("source").alias("id")).agg(F.countDistinct("target").alias("callees"))
    return into.join(out, "id", "full").select("id", F.coalesce("callers", F.lit(0)).alias("callers"), F.coalesce("callees", F.lit(0)).alias("callees"))


def most_central(nodes: DataFrame, edges: DataFrame, limit: int = 1) -> DataFrame:
    """The symbols used from most other files."""
    files = nodes.select("id", "file_path")
    used = edges.join(files.withColumnsRenamed({"id": "source", "file_path": "source_file"}), "source").join(files.withColumnsRenamed({"id": "target", "file_path": "target_file"}), "target")
    used = used.filter("source_file <> target_file").groupBy(F.col("target").alias("id")).agg(F.countDistinct("source_file").alias("files"))
    return used.orderBy(F.desc("files"), "id").limit(limit)
