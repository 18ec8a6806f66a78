"""Lookups, joins and aggregates over the stand-in graph, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.functions import text as T
from marlstone.operators import structural as S
from marlstone.plans.registry import query
from marlstone.plans.views import Views

LOW = f"regexp_matches(lower(file_path), '{T.LOW_VALUE_FOLDER}|{T.LOW_VALUE_FILE}')"
CALLS = "('calls', 'calls_trait_method', 'possible_call', 'instantiates')"
NODE = ("id", "kind", "name", "file_path", "start_line")


def long(c):
    return F.col(c).cast("long") if isinstance(c, str) else c.cast("long")


@query("flt_1_nodes_by_ids", "SELECT n.id, kind, name, pos FROM g_nodes n JOIN (VALUES ('part:5', 0), ('nation:3', 1), ('none:1', 2), ('region:1', 3)) v(id, pos) ON n.id = v.id ORDER BY pos", ("g_nodes",))
def _(v: Views):
    ids = v._spark.createDataFrame([("part:5", 0), ("nation:3", 1), ("none:1", 2), ("region:1", 3)], "id string, pos int")
    return S.by_ids(v.g_nodes, ids).select("id", "kind", "name", "pos")


@query("flt_2_where_defined", "SELECT id, kind, name, file_path, start_line FROM g_nodes WHERE (name = 'cold widget' OR qualified_name = 'cold widget') AND kind NOT IN ('file', 'module')", ("g_nodes",))
def _(v: Views):
    return S.where_defined(v.g_nodes, "cold widget").select(*NODE)


@query("flt_2_where_defined_by_id", "SELECT id, kind, name, file_path, start_line FROM g_nodes WHERE id = 'nation:3'", ("g_nodes",))
def _(v: Views):
    return S.where_defined(v.g_nodes, "nation:3").select(*NODE)


@query("flt_3_low_value_paths", f"SELECT kind, {LOW} AS low_value, count(*) AS n FROM g_nodes GROUP BY ALL", ("g_nodes",))
def _(v: Views):
    return v.g_nodes.groupBy("kind", T.is_low_value_path(F.col("file_path")).alias("low_value")).agg(F.count(F.lit(1)).alias("n"))


@query("flt_4_visible_entities", "SELECT position, type, status, file FROM entities WHERE status <> 'archived' AND type IN ('spec', 'requirement') AND topic IN ('de', 'en')", ("entities",))
def _(v: Views):
    topics = v._spark.createDataFrame([("de",), ("en",)], "topic string")
    return v.entities.filter((F.col("status") != "archived") & F.col("type").isin("spec", "requirement")).join(topics, "topic", "left_semi").select("position", "type", "status", "file")


@query("flt_6_name_components", "SELECT id, name FROM (SELECT id, name FROM g_nodes WHERE lower(name) LIKE '%widget%' AND list_contains(regexp_split_to_array(lower(name), '[^a-z0-9]+'), 'widget')) ORDER BY length(name), id LIMIT 24", ("g_nodes",))
def _(v: Views):
    hit = v.g_nodes.filter(F.lower("name").contains("widget") & F.array_contains(T.identifier_components(F.col("name")), "widget"))
    return hit.orderBy(F.length("name"), "id").limit(24).select("id", "name")


@query("flt_7_unresolved_sites", "SELECT source, name, line, count(*) OVER () AS total FROM (SELECT source, target AS name, line FROM g_edges WHERE kind = 'calls' AND confidence < 0.95 AND regexp_matches(target, '(^|\\.|::|:)7$')) ORDER BY source, line, name LIMIT 50".replace("\\\\", "\\"), ("g_edges",))
def _(v: Views):
    refs = v.g_edges.filter("kind = 'calls' and confidence < 0.95").select("source", F.regexp_replace("target", ":", "::").alias("name"), "line")
    return S.unresolved_sites(refs, "7", 50).select("source", F.regexp_replace("name", "::", ":").alias("name"), "line", "total")


@query("flt_8_list_membership", "SELECT count(*) AS n, cast(sum(l_quantity) AS double) AS quantity FROM lineitem WHERE l_returnflag IN ('A', 'R')")
def _(v: Views):
    # The list is a parameter of two values; shuffled by three flags, a third of the table would lie in one task.
    flags = v._spark.createDataFrame([(["A", "R"],)], "flags array<string>").select(F.explode("flags").alias("l_returnflag"))
    return v.lineitem.join(F.broadcast(flags), "l_returnflag", "left_semi").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity"))


@query("flt_9_fact_levels", "SELECT id, kind, name, file_path, start_line, end_line, qualified_name FROM g_nodes WHERE kind = 'method'", ("g_nodes",))
def _(v: Views):
    levels = {"minimal": ("id", "kind", "name"), "standard": ("id", "kind", "name", "file_path", "start_line", "end_line", "qualified_name")}
    return v.g_nodes.filter("kind = 'method'").select(*levels["standard"])


@query("flt_10_recipients", "SELECT conv_id, turn, role FROM conversations WHERE role = 'user' AND (conv_id % 3 = 1 OR turn = 0)")
def _(v: Views):
    relays = v.conversations.withColumn("recipients", F.array((F.col("conv_id") % 3).cast("string"), F.when(F.col("turn") == 0, "1")))
    return relays.filter(F.array_contains(F.array_compact("recipients"), "1") & (F.col("role") == "user")).select("conv_id", "turn", "role")


@query("flt_11_specs", "SELECT position, title, topic FROM entities WHERE type = 'spec' AND status IN ('active', 'draft')", ("entities",))
def _(v: Views):
    return v.entities.filter("type = 'spec' and status in ('active', 'draft')").orderBy("title", "position").select("position", "title", "topic")


@query("flt_13_parameters", "SELECT id, name FROM g_nodes WHERE kind <> 'module' AND file_path = 'brand/Brand#13'", ("g_nodes",))
def _(v: Views):
    return v._spark.sql("select id, name from {nodes} where kind <> :kind and file_path = :path", args={"kind": "module", "path": "brand/Brand#13"}, nodes=v.g_nodes)


NEIGHBOUR = f"SELECT n.id, f.line, {LOW} AS low_value FROM g_nodes n JOIN (SELECT %s AS id, min(line) AS line FROM g_edges WHERE kind IN {CALLS} AND %s = '%s' GROUP BY 1) f ON n.id = f.id"


@query("join_1_callers", NEIGHBOUR % ("source", "target", "part:5"), ("g_nodes", "g_edges"))
def _(v: Views):
    return S.neighbours(v.g_nodes, v.g_edges, v._spark.createDataFrame([("part:5",)], "node string"), True).select("id", "line", "low_value")


@query("join_1_callees", NEIGHBOUR % ("target", "source", "order:7"), ("g_nodes", "g_edges"))
def _(v: Views):
    return S.neighbours(v.g_nodes, v.g_edges, v._spark.createDataFrame([("order:7",)], "node string"), False).select("id", "line", "low_value")


@query("join_2_edge_files", "SELECT e.kind, coalesce(n.file_path, '') AS file_path, count(*) AS n FROM g_edges e LEFT JOIN g_nodes n ON e.source = n.id GROUP BY ALL", ("g_nodes", "g_edges"))
def _(v: Views):
    files = v.g_nodes.select("id", "file_path")
    return v.g_edges.join(files, F.col("source") == F.col("id"), "left").groupBy("kind", F.coalesce("file_path", F.lit("")).alias("file_path")).agg(F.count(F.lit(1)).alias("n"))


@query("join_3_bindings", "SELECT e.source, e.target, n.name FROM g_edges e LEFT JOIN g_nodes n ON e.target = n.id AND n.kind = 'file' WHERE e.kind = 'imports'", ("g_nodes", "g_edges"))
def _(v: Views):
    files = v.g_nodes.filter("kind = 'file'").select(F.col("id").alias("target"), "name")
    return v.g_edges.filter("kind = 'imports'").join(files, "target", "left").select("source", "target", "name")


@query("join_4_who_calls", f"""SELECT id, line, phase FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY phase, line NULLS LAST) rn FROM (
    SELECT source AS id, min(line) AS line, 0 AS phase FROM g_edges WHERE kind IN {CALLS} AND target IN (SELECT id FROM g_nodes WHERE name = 'cold widget' AND kind NOT IN ('file', 'module')) GROUP BY 1
    UNION ALL SELECT source, min(line), 1 FROM g_edges WHERE confidence < 0.92 AND target = 'part:5' GROUP BY 1)) WHERE rn = 1""", ("g_nodes", "g_edges"))  # fmt: skip
def _(v: Views):
    maybe = v.g_edges.filter("confidence < 0.92 and target = 'part:5'").select("source", F.lit("cold widget").alias("name"), "line")
    return S.who_calls(v.g_nodes, v.g_edges, maybe, "cold widget")


@query("join_6_who_imports", """SELECT DISTINCT url AS source_file, module, symbol FROM (SELECT url, regexp_extract(url, '//([^/]+)', 1) AS module, regexp_extract(url, '([a-z]{2})/[0-9]+', 1) AS symbol FROM pages)
    WHERE symbol = 'en' OR module = 'thther.example.org' OR regexp_extract(module, '([^.:/#]+)$', 1) IN ('en', 'net') OR url = 'en'""")
def _(v: Views):
    bindings = v.pages.select(F.col("url").alias("source_file"), F.regexp_extract("url", "//([^/]+)", 1).alias("module"), F.regexp_extract("url", "([a-z]{2})/[0-9]+", 1).alias("symbol"), F.lit(None).cast("string").alias("target_file"))
    return S.who_imports(bindings, v._spark.createDataFrame([("en",), ("thther.example.org",), ("net",)], "key string"))


@query("join_7_cross_file_edges", "SELECT s.file_path AS source_file, t.file_path AS target_file, count(*) AS n FROM g_edges e JOIN g_nodes s ON e.source = s.id JOIN g_nodes t ON e.target = t.id WHERE s.file_path <> t.file_path GROUP BY ALL", ("g_nodes", "g_edges"))
def _(v: Views):
    files = v.g_nodes.select("id", "file_path")
    joined = v.g_edges.join(files.withColumnsRenamed({"id": "source", "file_path": "source_file"}), "source").join(files.withColumnsRenamed({"id": "target", "file_path": "target_file"}), "target")
    return joined.filter("source_file <> target_file").groupBy("source_file", "target_file").agg(F.count(F.lit(1)).alias("n"))


CHUNK = "SELECT s.id AS chunk_id, s.file_path, s.start_line AS first, s.start_line + 79 AS last FROM g_nodes s"


@query("join_8_chunk_overlap", f"""SELECT chunk_id, id, overlap, rank FROM (SELECT c.chunk_id, n.id, least(n.end_line, c.last) - greatest(n.start_line, c.first) + 1 AS overlap,
    row_number() OVER (PARTITION BY chunk_id ORDER BY n.kind IN ('file', 'module'), least(n.end_line, c.last) - greatest(n.start_line, c.first) + 1 DESC, n.end_line - n.start_line, n.id) AS rank
    FROM ({CHUNK}) c JOIN g_nodes n ON n.file_path = c.file_path AND n.start_line <= c.last AND n.end_line >= c.first AND n.end_line >= n.start_line) WHERE rank <= 8""", ("g_nodes",))  # fmt: skip
def _(v: Views):
    chunks = v.g_nodes.select(F.col("id").alias("chunk_id"), "file_path", F.col("start_line").alias("first"), (F.col("start_line") + 79).alias("last"))
    return S.overlapping(chunks, v.g_nodes).select("chunk_id", "id", "overlap", long("rank").alias("rank"))


@query("join_9_enclosing", """SELECT point_id, id FROM (SELECT p.p_partkey AS point_id, n.id, row_number() OVER (PARTITION BY p.p_partkey ORDER BY n.end_line - n.start_line, n.start_line DESC, n.id) rn
    FROM part p JOIN g_nodes n ON n.file_path = 'brand/' || p.p_brand AND p.p_partkey % 499 + 3 BETWEEN n.start_line AND n.end_line) WHERE rn = 1""", ("g_nodes",))
def _(v: Views):
    points = v.part.select(F.col("p_partkey").alias("point_id"), F.concat(F.lit("brand/"), "p_brand").alias("file_path"), (F.col("p_partkey") % 499 + 3).alias("at"))
    return S.enclosing(points, v.g_nodes)


@query("join_10_lexical_parents", """SELECT id, parent FROM (SELECT a.id, b.id AS parent, row_number() OVER (PARTITION BY a.id ORDER BY b.end_line - b.start_line, b.id) rn FROM g_nodes a JOIN g_nodes b ON a.file_path = b.file_path
    AND a.start_line >= b.start_line AND a.end_line <= b.end_line AND b.end_line >= b.start_line AND (b.end_line - b.start_line > a.end_line - a.start_line OR (b.end_line - b.start_line = a.end_line - a.start_line AND b.id < a.id))) WHERE rn = 1""", ("g_nodes",))
def _(v: Views):
    return S.lexical_parents(v.g_nodes)


@query("join_12_shared_neighbours", """SELECT id, count(*) AS shared FROM (SELECT source AS id, target AS node FROM g_edges UNION SELECT target, source FROM g_edges) WHERE node IN ('part:1', 'part:2', 'part:3', 'supplier:4', 'nation:2')
    GROUP BY id HAVING count(*) >= 2 ORDER BY shared DESC, id LIMIT 64""", ("g_edges",))
def _(v: Views):
    given = v._spark.createDataFrame([(x,) for x in ("part:1", "part:2", "part:3", "supplier:4", "nation:2")], "node string")
    return S.shared_neighbours(v.g_edges, given)


@query("join_13_for_code", """SELECT entity_id, count(DISTINCT node_id) AS matched, max(CASE health WHEN 'fresh' THEN 0 WHEN 'changed' THEN 1 WHEN 'unverified' THEN 2 WHEN 'ambiguous' THEN 3 ELSE 4 END) AS worst
    FROM groundings WHERE node_id IN ('supplier:3', 'part:39', 'part:13', 'supplier:6') GROUP BY entity_id""", ("groundings",))
def _(v: Views):
    wanted = v._spark.createDataFrame([(x,) for x in ("supplier:3", "part:39", "part:13", "supplier:6")], "node_id string")
    order = F.when(F.col("health") == "fresh", 0).when(F.col("health") == "changed", 1).when(F.col("health") == "unverified", 2).when(F.col("health") == "ambiguous", 3).otherwise(4)
    return S.for_code(v.groundings, v.documents.select(F.col("doc_id").alias("entity_id")), wanted, order)


REFS = "SELECT p_partkey AS ref_id, CASE WHEN p_partkey % 2 = 0 THEN 'struct' ELSE 'function' END AS ref_kind, 'brand/' || p_brand AS ref_path, CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN p_brand || '.' || p_name ELSE 'gone' END AS ref_name FROM part"


@query("join_14_resolve_references", f"""SELECT ref_id, CASE n WHEN 0 THEN 'Missing' WHEN 1 THEN 'Resolved' ELSE 'Ambiguous' END AS state, CASE WHEN n = 1 THEN id END AS id FROM (
    SELECT ref_id, count(id) FILTER (stage = best) AS n, min(id) FILTER (stage = best) AS id FROM (SELECT *, min(stage) OVER (PARTITION BY ref_id) AS best FROM (
    SELECT r.ref_id, n.id, CASE WHEN n.qualified_name = r.ref_name THEN 0 WHEN n.name = r.ref_name AND r.ref_kind = 'struct' AND n.kind = 'class' THEN 1 WHEN n.name = r.ref_name THEN 2 END AS stage
    FROM ({REFS}) r LEFT JOIN g_nodes n ON n.file_path = r.ref_path)) GROUP BY ref_id)""", ("g_nodes",))  # fmt: skip
def _(v: Views):
    refs = v.part.selectExpr("p_partkey ref_id", "case when p_partkey % 2 = 0 then 'struct' else 'function' end ref_kind", "'brand/' || p_brand ref_path", "case p_partkey % 3 when 0 then p_name when 1 then p_brand || '.' || p_name else 'gone' end ref_name")
    return S.resolve_refs(refs, v.g_nodes)


@query("join_15_labelled", "SELECT lang, count(*) AS n FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) GROUP BY lang")
def _(v: Views):
    return v.documents.join(v.labels, "doc_id", "left_semi").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


@query("join_16_unlabelled", "SELECT lang, count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY lang")
def _(v: Views):
    return v.documents.join(v.labels, "doc_id", "left_anti").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


MEMBERS = ", m AS (SELECT DISTINCT node_id, entity_id FROM groundings), n AS (SELECT node_id, count(*) AS n FROM m GROUP BY node_id)"


@query("join_18_grounded_pairs", f"""{MEMBERS}, p AS (SELECT a.entity_id AS a, b.entity_id AS b FROM m a JOIN m b ON a.node_id = b.node_id AND a.entity_id < b.entity_id JOIN n ON n.node_id = a.node_id WHERE n.n <= 33 GROUP BY ALL)
    SELECT p.a, p.b, count(*) AS shared FROM p JOIN m x ON x.entity_id = p.a JOIN m y ON y.entity_id = p.b AND y.node_id = x.node_id GROUP BY ALL""", ("groundings",))
def _(v: Views):
    return S.candidate_pairs(v.groundings, "node_id", "entity_id", 33)


@query("join_18_hot_members", f"{MEMBERS} SELECT m.node_id, m.entity_id FROM m JOIN n USING (node_id) WHERE n.n > 33", ("groundings",))
def _(v: Views):
    return S.hot_members(v.groundings, "node_id", "entity_id", 33)


@query("agg_1_first_call_line", f"SELECT target AS id, min(line) AS line, count(*) AS n FROM g_edges WHERE kind IN {CALLS} GROUP BY 1", ("g_edges",))
def _(v: Views):
    return v.g_edges.filter(F.col("kind").isin(*S.CALL_KINDS)).groupBy(F.col("target").alias("id")).agg(F.min("line").alias("line"), F.count(F.lit(1)).alias("n"))


@query("agg_2_health_counts", "SELECT cast(count(*) FILTER (health = 'fresh') AS bigint) AS fresh, count(*) FILTER (health = 'changed') AS changed, count(*) FILTER (health NOT IN ('fresh', 'changed')) AS other FROM groundings", ("groundings",))
def _(v: Views):
    n = lambda c: F.count(F.when(c, 1))
    h = F.col("health")
    return v.groundings.agg(n(h == "fresh").alias("fresh"), n(h == "changed").alias("changed"), n(~h.isin("fresh", "changed")).alias("other"))


@query("agg_3_call_degrees", f"""SELECT coalesce(i.id, o.id) AS id, coalesce(callers, 0) AS callers, coalesce(callees, 0) AS callees FROM (SELECT target AS id, count(DISTINCT source) AS callers FROM g_edges WHERE kind IN {CALLS} GROUP BY 1) i
    FULL JOIN (SELECT source AS id, count(DISTINCT target) AS callees FROM g_edges WHERE kind IN {CALLS} GROUP BY 1) o ON i.id = o.id""", ("g_edges",))
def _(v: Views):
    return S.call_degrees(v.g_edges)


@query("agg_4_totals", "SELECT (SELECT count(*) FROM g_nodes) AS nodes, (SELECT count(*) FROM g_edges) AS edges, (SELECT count(DISTINCT file_path) FROM g_nodes) AS files", ("g_nodes", "g_edges"))
def _(v: Views):
    n = v.g_nodes.agg(F.count(F.lit(1)).alias("nodes"), F.countDistinct("file_path").alias("files"))
    e = v.g_edges.agg(F.count(F.lit(1)).alias("edges"))
    return n.join(F.broadcast(e)).select("nodes", "edges", "files")  # one row each


@query("agg_5_dominant_language", "SELECT lang, count(*) AS n FROM documents GROUP BY lang ORDER BY n DESC, lang LIMIT 1")
def _(v: Views):
    return v.documents.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(1)


@query("agg_6_most_central", "SELECT e.target AS id, count(DISTINCT s.file_path) AS files FROM g_edges e JOIN g_nodes s ON e.source = s.id JOIN g_nodes t ON e.target = t.id WHERE s.file_path <> t.file_path GROUP BY 1 ORDER BY files DESC, id LIMIT 10", ("g_nodes", "g_edges"))
def _(v: Views):
    return S.most_central(v.g_nodes, v.g_edges, 10)


@query("agg_7_grouped_count", "SELECT kind, file_path, count(id) AS n FROM g_nodes GROUP BY ALL", ("g_nodes",))
def _(v: Views):
    return v.g_nodes.groupBy("kind", "file_path").agg(F.count("id").alias("n"))


@query("agg_8_edges_by_kind", "SELECT kind, count(*) AS n, round(avg(confidence), 6) AS confidence FROM g_edges GROUP BY kind", ("g_edges",))
def _(v: Views):
    return v.g_edges.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 6).alias("confidence"))


@query("agg_9_facets", "SELECT 'type' AS facet, type AS value, count(*) AS n FROM entities GROUP BY 2 UNION ALL SELECT 'status', status, count(*) FROM entities GROUP BY 2", ("entities",))
def _(v: Views):
    facet = lambda c: v.entities.groupBy(F.lit(c).alias("facet") if c == "type" else F.lit("status").alias("facet"), F.col(c).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return facet("type").unionByName(facet("status"))


@query("agg_10_worst_health", "SELECT entity_id, max_by(health, rank) AS health FROM (SELECT *, CASE health WHEN 'fresh' THEN 0 WHEN 'changed' THEN 1 WHEN 'unverified' THEN 2 WHEN 'ambiguous' THEN 3 ELSE 4 END AS rank FROM groundings) GROUP BY entity_id", ("groundings",))
def _(v: Views):
    from marlstone.operators.knowledge import HEALTH, health_rank, worst_health

    assert len(HEALTH) == 5 and health_rank is not None
    return worst_health(v.groundings)


@query("agg_11_module_clusters", """SELECT module, count(DISTINCT file_path) AS files, count(*) AS symbols FROM (SELECT split_part(file_path, '/', 1) AS module, file_path FROM g_nodes) GROUP BY module HAVING count(DISTINCT file_path) >= 3""", ("g_nodes",))
def _(v: Views):
    groups = v.g_nodes.groupBy(F.split_part("file_path", F.lit("/"), F.lit(1)).alias("module")).agg(F.countDistinct("file_path").alias("files"), F.count(F.lit(1)).alias("symbols"))
    return groups.filter("files >= 3")


@query("agg_14_severities", "SELECT severity, count(*) AS n FROM (SELECT CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'warning' ELSE 'info' END AS severity FROM events) GROUP BY severity")
def _(v: Views):
    severity = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "purchase", "warning").otherwise("info")
    return v.events.groupBy(severity.alias("severity")).agg(F.count(F.lit(1)).alias("n"))


@query("agg_19_revision_digest", "SELECT o_orderpriority AS grp, sha256(string_agg(o_orderkey || ':' || o_orderstatus, ',' ORDER BY o_orderkey)) AS digest FROM orders GROUP BY 1")
def _(v: Views):
    rows = v.orders.groupBy(F.col("o_orderpriority").alias("grp"))
    parts = F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", "o_orderstatus"))), lambda r: F.concat(r["o_orderkey"].cast("string"), F.lit(":"), r["o_orderstatus"]))
    return rows.agg(F.sha2(F.array_join(parts, ","), 256).alias("digest"))


@query("set_6_neighbours", "SELECT node, count(*) AS n FROM (SELECT source AS node, target AS neighbour FROM g_edges UNION SELECT target, source FROM g_edges) WHERE node <> neighbour GROUP BY node", ("g_edges",))
def _(v: Views):
    return S.undirected(v.g_edges).groupBy("node").agg(F.count(F.lit(1)).alias("n"))


@query("set_7_related", """SELECT DISTINCT related FROM (SELECT target_id AS related FROM relations WHERE type = 'refines' UNION SELECT source_id FROM relations WHERE type = 'supersedes') WHERE related IN (SELECT doc_id FROM documents)""", ("relations",))
def _(v: Views):
    both = v.relations.filter("type = 'refines'").select(F.col("target_id").alias("related")).union(v.relations.filter("type = 'supersedes'").select("source_id"))
    return both.distinct().join(v.documents.select(F.col("doc_id").alias("related")), "related", "left_semi")


@query("x_23_file_context", "SELECT id, name, start_line FROM g_nodes WHERE file_path LIKE '%Brand#5' ", ("g_nodes",))
def _(v: Views):
    return v.g_nodes.filter(F.col("file_path").endswith("Brand#5")).orderBy("start_line", "id").select("id", "name", "start_line")


@query("x_5_repair", """SELECT kind, count(*) AS n FROM g_edges e WHERE EXISTS (SELECT 1 FROM g_nodes n WHERE n.id = e.source AND n.kind <> 'method') AND EXISTS (SELECT 1 FROM g_nodes n WHERE n.id = e.target AND n.kind <> 'method') GROUP BY kind""", ("g_nodes", "g_edges"))
def _(v: Views):
    live = v.g_nodes.filter("kind <> 'method'").select("id")
    kept = v.g_edges.join(live.withColumnRenamed("id", "source"), "source", "left_semi").join(live.withColumnRenamed("id", "target"), "target", "left_semi")
    return kept.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("join_5_what_calls", """, s AS (SELECT id FROM g_nodes WHERE (kind = 'file' AND file_path = 'order_11') OR (kind NOT IN ('file', 'module') AND (name = 'order_11' OR qualified_name = 'order_11')))
    SELECT e.target AS id, min(e.source) AS by, min(e.line) AS line FROM g_edges e JOIN s ON e.source = s.id JOIN g_nodes n ON n.id = e.target WHERE e.kind = 'calls' GROUP BY e.target""", ("g_nodes", "g_edges"))
def _(v: Views):
    return S.what_calls(v.g_nodes, v.g_edges, "order_11").select("id", "by", "line")
