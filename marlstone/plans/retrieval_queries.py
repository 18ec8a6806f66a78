"""Regions, seeds, admission, promotion, budgets and context over stand-in evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.operators import retrieval as R
from marlstone.operators.ranking import numbered
from marlstone.operators.source_ranges import merge_in_phase
from marlstone.plans.registry import query
from marlstone.plans.views import Views

# Lines of orders hit the declarations of parts: a hit is an order, its place its rank by price.
HITS = """hits AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS hit, o_orderkey % 480 AS first, o_orderkey % 480 + 79 AS last, -((o_custkey % 9) / 100.0) AS rank, o_custkey % 4 AS n_concepts FROM orders),
    over AS (SELECT hit, 'part:' || l_partkey AS id, row_number() OVER (PARTITION BY hit ORDER BY l_partkey) - 1 AS place, p_partkey % 499 AS start_line, p_partkey % 499 + p_size AS end_line, p_size % 3 AS n_name FROM hits JOIN (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey)"""


def _hits(v: Views):
    from pyspark.sql import Window as W

    k = F.col("o_orderkey")
    hits = numbered(v.orders, [F.desc("o_totalprice"), "o_orderkey"], "hit")
    hits = hits.select(k, "hit", (k % 480).alias("first"), (k % 480 + 79).alias("last"), (-(F.col("o_custkey") % 9) / 100).alias("rank"), (F.col("o_custkey") % 4).alias("n_concepts"))
    lines = v.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("p_partkey")).distinct()
    over = hits.select("o_orderkey", "hit").join(lines, "o_orderkey").join(v.part, "p_partkey")
    p = F.col("p_partkey")
    over = over.select("hit", F.concat(F.lit("part:"), p).alias("id"), (F.row_number().over(W.partitionBy("hit").orderBy("p_partkey")) - 1).alias("place"), (p % 499).alias("start_line"), (p % 499 + F.col("p_size")).alias("end_line"), (F.col("p_size") % 3).alias("n_name"))
    return hits.drop("o_orderkey"), over


@query("sc_8_regions", f"""WITH {HITS} SELECT id, round(max(score), 9) AS score FROM (SELECT id, least(1.2, greatest(n_concepts - 1, 0) * 0.18 + n_name * 0.32 + CASE WHEN start_line BETWEEN first AND last THEN 0.08 WHEN start_line <= first AND end_line >= last THEN 0.04 ELSE 0 END + least(abs(rank) * 2, 0.1) + 20.0 / (61 + hit + place)) AS score
    FROM over JOIN hits USING (hit)) GROUP BY id""")
def _(v: Views):
    return R.region_alignment(*_hits(v)).select("id", F.round("score", 9).alias("score"))


@query("sc_11_seeds", """, pref AS (SELECT id, file_path, min(t) AS t, min_by(r, t) AS r FROM (SELECT 'part:' || p_partkey AS id, 'brand/' || p_brand AS file_path, p_partkey % 3 AS t, p_partkey AS r FROM part WHERE p_size = 7) GROUP BY ALL),
    one AS (SELECT id, file_path, place FROM (SELECT *, row_number() OVER (ORDER BY t, r, id) AS place FROM pref) WHERE place <= 12), pool AS (SELECT 'part:' || p_partkey AS id, 'brand/' || p_brand AS file_path, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part),
    rest AS (SELECT * FROM pool WHERE id NOT IN (SELECT id FROM one)), two AS (SELECT id, place FROM (SELECT id, row_number() OVER (ORDER BY rank, id) AS place FROM (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY rank, id) AS nth FROM rest WHERE file_path NOT IN (SELECT file_path FROM one)) WHERE nth = 1) WHERE place + (SELECT count(*) FROM one) <= 18),
    three AS (SELECT id, place FROM (SELECT id, row_number() OVER (ORDER BY rank, id) AS place FROM rest WHERE id NOT IN (SELECT id FROM two)) WHERE place + (SELECT count(*) FROM one) + (SELECT count(*) FROM two) <= 24)
    SELECT id, row_number() OVER (ORDER BY step, place) AS place FROM (SELECT id, 0 AS step, place FROM one UNION ALL SELECT id, 1, place FROM two UNION ALL SELECT id, 2, place FROM three)""", ("g_links",))
def _(v: Views):
    p = v.part.select(F.concat(F.lit("part:"), "p_partkey").alias("id"), F.concat(F.lit("brand/"), "p_brand").alias("file_path"), "p_partkey", "p_size", "p_retailprice")
    pool = numbered(p, [F.desc("p_retailprice"), "p_partkey"], "rank").select("id", "file_path", (F.col("rank") + 1).alias("rank"))
    preferred = p.filter("p_size = 7").select("id", "file_path", (F.col("p_partkey") % 3).alias("tier"), F.col("p_partkey").alias("rank"))
    return R.choose_seeds(preferred, pool)


FILES = "SELECT p_brand AS file_path, min(p_partkey) % 9 = 0 AS pinned, min(p_partkey) % 7 = 0 AS bridge, max(p_size) = 50 AND min(p_size) = 1 AS strong, CASE WHEN min(p_partkey) % 2 = 0 THEN min(p_partkey) END AS source_rank, count(*) AS score FROM part GROUP BY p_brand"


def _candidates(v: Views):
    k = F.min("p_partkey")
    return v.part.groupBy(F.col("p_brand").alias("file_path")).agg((k % 9 == 0).alias("pinned"), (k % 7 == 0).alias("bridge"), ((F.max("p_size") == 50) & (F.min("p_size") == 1)).alias("strong"), F.when(k % 2 == 0, k).alias("source_rank"), F.count(F.lit(1)).alias("score"))


@query("sc_14_file_admission", f"""SELECT file_path, tier, place FROM (SELECT *, row_number() OVER (ORDER BY tier, CASE WHEN tier = 3 THEN source_rank END NULLS LAST, score DESC, file_path) AS place FROM (SELECT *, CASE WHEN pinned THEN 0 WHEN bridge THEN 1 WHEN strong THEN 2 WHEN source_rank IS NOT NULL AND row_number() OVER (ORDER BY source_rank NULLS LAST, file_path) <= 3 THEN 3 ELSE 4 END AS tier FROM ({FILES}))) WHERE place <= 12""")
def _(v: Views):
    return R.admit_files(_candidates(v), 12)


FOUND = "SELECT 'part:' || p_partkey AS id, p_brand AS file_path, cast(round(p_retailprice * 100) AS bigint) AS score FROM part"


def _found(v: Views):
    return v.part.select(F.concat(F.lit("part:"), "p_partkey").alias("id"), F.col("p_brand").alias("file_path"), F.round(F.col("p_retailprice") * 100).cast("long").alias("score"))


@query("sc_15_reservations", f"""WITH found AS ({FOUND}), facet AS (SELECT 'size' || (p_size % 5) AS facet, 'part:' || p_partkey AS id, p_size % 5 AS weight FROM part WHERE p_size > 20), best AS (SELECT id, max(weight) AS fw FROM (SELECT *, row_number() OVER (PARTITION BY facet ORDER BY score DESC, id) AS nth FROM facet JOIN found USING (id)) WHERE nth = 1 GROUP BY id)
    SELECT id, place, tier < 2 AS reserved FROM (SELECT id, tier, row_number() OVER (ORDER BY tier, fw DESC NULLS LAST, score DESC, id) AS place FROM (SELECT *, CASE WHEN fw IS NOT NULL THEN 0 WHEN in_file = 1 THEN 1 ELSE 2 END AS tier FROM (SELECT f.*, fw, row_number() OVER (PARTITION BY file_path ORDER BY score DESC, id) AS in_file FROM found f LEFT JOIN best USING (id))) WHERE tier = 0 OR in_file <= 4) WHERE place <= 40""")
def _(v: Views):
    size = F.col("p_size")
    facets = v.part.filter("p_size > 20").select(F.concat(F.lit("size"), size % 5).alias("facet"), F.concat(F.lit("part:"), "p_partkey").alias("id"), (size % 5).alias("weight"))
    return R.admit_declarations(_found(v), facets, 40)


@query("sc_16_promotion", f"""WITH adm AS (SELECT file_path, score, pinned AS protected FROM ({FILES}) WHERE source_rank IS NOT NULL), spine AS (SELECT p_brand AS file_path, min(p_partkey) AS step FROM part WHERE p_size = 3 GROUP BY p_brand ORDER BY step LIMIT 5),
    weak AS (SELECT file_path, row_number() OVER (ORDER BY score, file_path DESC) AS turn FROM adm WHERE NOT protected AND file_path NOT IN (SELECT file_path FROM spine)), need AS (SELECT file_path, row_number() OVER (ORDER BY step, file_path) AS turn FROM spine WHERE file_path NOT IN (SELECT file_path FROM adm)), swap AS (SELECT n.file_path, w.file_path AS out FROM need n JOIN weak w USING (turn))
    SELECT file_path, false AS promoted FROM adm WHERE file_path NOT IN (SELECT out FROM swap) UNION ALL SELECT file_path, true FROM swap""")
def _(v: Views):
    admitted = _candidates(v).filter("source_rank is not null").select("file_path", "score", F.col("pinned").alias("protected"))
    spine = v.part.filter("p_size = 3").groupBy(F.col("p_brand").alias("file_path")).agg(F.min("p_partkey").alias("step")).orderBy("step").limit(5)
    return R.promote(admitted, spine)


@query("sc_20_ledger", """SELECT place, cost, cast(spent AS bigint) AS spent FROM (SELECT row_number() OVER (ORDER BY s_suppkey) AS place, cost, sum(cost) OVER (ORDER BY s_suppkey) AS spent FROM (SELECT s_suppkey, cast(ceil(length('{"s_suppkey":' || s_suppkey || ',"s_name":"' || s_name || '"}') / 4) AS bigint) AS cost FROM supplier)) WHERE spent <= 500""")
def _(v: Views):
    return R.ledger(v.supplier.select("s_suppkey", "s_name"), 500, ["s_suppkey"]).select("place", "cost", "spent")


@query("sc_21_source_admission", """WITH RECURSIVE s AS (SELECT 't' || (p_partkey % 20) AS task, 'part:' || p_partkey AS id, p_brand AS file_path, p_partkey % 90 AS first, p_partkey % 90 + p_size AS last, p_partkey % 7 = 0 AS atomic,
        CASE WHEN p_partkey % 31 = 0 THEN 0 WHEN p_partkey = 17 THEN 1 WHEN p_partkey = 9 THEN 2 ELSE 3 END AS tier, cast(round(p_retailprice * 100) AS bigint) AS score FROM part),
    u AS (SELECT *, row_number() OVER (PARTITION BY task, file_path ORDER BY tier, score DESC, id) AS turn FROM s),
    k AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY tier, CASE WHEN tier = 3 THEN turn END NULLS FIRST, score DESC, id) AS n FROM u),
    run AS (SELECT DISTINCT task, 0::bigint AS n, 300::bigint AS room, []::varchar[] AS shown, NULL::varchar AS id, []::bigint[] AS took, 0::bigint AS cost FROM s
        UNION ALL SELECT task, n, room - coalesce(list_sum(costs[1:m]), 0)::bigint, list_concat(shown, list_transform(free[1:m], lambda x: file_path || ':' || x)), id, free[1:m], coalesce(list_sum(costs[1:m]), 0)::bigint FROM (
            SELECT *, CASE WHEN total <= room THEN len(free) WHEN atomic THEN 0 ELSE len(list_filter(range(1, len(free) + 1), lambda i: list_sum(costs[1:i]) <= room)) END AS m FROM (
                SELECT *, list_transform(free, lambda x: 1 + x % 3) AS costs, coalesce(list_sum(list_transform(free, lambda x: 1 + x % 3)), 0) AS total FROM (
                    SELECT k.task, k.n, k.id, k.file_path, k.atomic, run.room, run.shown, list_filter(range(k.first, k.last + 1), lambda x: NOT list_contains(run.shown, k.file_path || ':' || x)) AS free FROM run JOIN k ON k.task = run.task AND k.n = run.n + 1))))
    SELECT task, id, cast(len(took) AS bigint) AS lines, took[1] AS first, took[-1] AS last, cost FROM run WHERE len(took) > 0""")
def _(v: Views):
    k = F.col("p_partkey")
    first, last = k % 90, k % 90 + F.col("p_size")
    rows = v.part.select(
        F.concat(F.lit("t"), k % 20).alias("task"), F.concat(F.lit("part:"), k).alias("id"), F.col("p_brand").alias("file_path"), first.alias("first"), F.transform(F.sequence(first, last), lambda x: 1 + x % 3).alias("costs"),
        (k % 7 == 0).alias("atomic"), F.lit(False).alias("centred"), (k % 31 == 0).alias("exact"), (k == 17).alias("flow_target"), (k == 9).alias("answer"), F.round(F.col("p_retailprice") * 100).cast("long").alias("score"),
    )
    shown = R.admit_sources(rows, 400)
    return shown.groupBy("task", "id").agg(F.sum(F.col("last") - F.col("first") + 1).alias("lines"), F.min("first").alias("first"), F.max("last").alias("last"), F.sum("cost").alias("cost"))


@query("sc_21_merged_phases", """SELECT task, file_path, phase, id, min(first) AS first, max(last) AS last, min(place) AS place, bool_and(atomic) AS atomic FROM (SELECT * EXCLUDE (id), first_value(id) OVER (PARTITION BY task, file_path, phase, island ORDER BY place) AS id FROM (SELECT *, sum(fresh) OVER (PARTITION BY task, file_path, phase ORDER BY first, last DESC, place ROWS UNBOUNDED PRECEDING) AS island FROM (
    SELECT *, CASE WHEN first <= max(last) OVER (PARTITION BY task, file_path, phase ORDER BY first, last DESC, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM (
    SELECT 't' || (l_suppkey % 10) AS task, 'f' || (l_partkey % 40) AS file_path, l_linenumber % 3 AS phase, l_orderkey || ':' || l_linenumber AS id, l_orderkey % 5000 AS first, l_orderkey % 5000 + l_linenumber * 3 AS last, l_orderkey * 10 + l_linenumber AS place, l_returnflag = 'R' AS atomic FROM lineitem)))) GROUP BY task, file_path, phase, island, id""")
def _(v: Views):
    o, n = F.col("l_orderkey"), F.col("l_linenumber")
    rows = v.lineitem.select(F.concat(F.lit("t"), F.col("l_suppkey") % 10).alias("task"), F.concat(F.lit("f"), F.col("l_partkey") % 40).alias("file_path"), (n % 3).alias("phase"), F.concat_ws(":", o, n).alias("id"), (o % 5000).alias("first"), (o % 5000 + n * 3).alias("last"), (o * 10 + n).alias("place"), (F.col("l_returnflag") == "R").alias("atomic"))
    return merge_in_phase(rows)


@query("gr_19_cluster_context", """, both_ways AS (SELECT source AS id, target AS near FROM g_edges WHERE source <> target UNION SELECT target, source FROM g_edges WHERE source <> target), m AS (SELECT 'c' || s_nationkey AS cluster, 'supplier:' || s_suppkey AS id FROM supplier UNION ALL SELECT 'c' || n_nationkey, 'nation:' || n_nationkey FROM nation),
    near AS (SELECT m.cluster, m.id, b.near, x.cluster AS other FROM m JOIN both_ways b USING (id) LEFT JOIN m x ON x.id = b.near), held AS (SELECT m.cluster, m.id, 'member' AS role, coalesce(n, 0) AS n FROM m LEFT JOIN (SELECT cluster, id, count(*) AS n FROM near WHERE other = cluster GROUP BY ALL) USING (cluster, id)
    UNION ALL SELECT cluster, near, 'neighbour', count(*) FROM near WHERE other IS DISTINCT FROM cluster GROUP BY ALL) SELECT cluster, id, role, n, place FROM (SELECT *, row_number() OVER (PARTITION BY cluster, role ORDER BY n DESC, id) AS place FROM held) WHERE place <= 5""", ("g_edges",))
def _(v: Views):
    members = v.supplier.select(F.concat(F.lit("c"), "s_nationkey").alias("cluster"), F.concat(F.lit("supplier:"), "s_suppkey").alias("id")).unionByName(v.nation.select(F.concat(F.lit("c"), "n_nationkey").alias("cluster"), F.concat(F.lit("nation:"), "n_nationkey").alias("id")))
    return R.cluster_context(members, v.g_edges, 5)


RULES = [("requirement", "refines", "spec"), ("spec", "implemented_by", "component"), ("decision", "affects", "component")]


@query("x_14_allowed_relations", """, pairs AS (SELECT doc_id AS a, doc_id + 1 AS b, doc_id % 4 + 1 AS shared FROM documents), rules AS (SELECT * FROM (VALUES ('requirement', 'refines', 'spec'), ('spec', 'implemented_by', 'component'), ('decision', 'affects', 'component')) t(ta, type, tb))
    SELECT DISTINCT p.a, p.b, r.type, p.shared FROM (SELECT * FROM pairs UNION ALL SELECT b, a, shared FROM pairs) p JOIN entities x ON x.position = p.a JOIN entities y ON y.position = p.b JOIN rules r ON r.ta = x.type AND r.tb = y.type""", ("entities",))
def _(v: Views):
    i = F.col("doc_id")
    pairs = v.documents.select(i.alias("a"), (i + 1).alias("b"), (i % 4 + 1).alias("shared"))
    return R.allowed_relations(pairs, v.entities.select(F.col("position").alias("id"), F.col("type").alias("kind")), RULES)


@query("x_15_entity_panel", """SELECT position AS entity_id, part, coalesce(n, 0) AS n, worst FROM (SELECT position, part FROM entities, (VALUES ('groundings'), ('relations')) t(part) WHERE status = 'draft') LEFT JOIN (SELECT entity_id AS position, 'groundings' AS part, count(*) AS n, max(CASE WHEN health = 'fresh' THEN 0 ELSE 1 END) AS worst FROM groundings GROUP BY 1
    UNION ALL SELECT source_id, 'relations', count(*), max(CASE WHEN type = 'supersedes' THEN 1 ELSE 0 END) FROM relations GROUP BY 1) USING (position, part)""", ("entities", "groundings", "relations"))
def _(v: Views):
    groundings = v.groundings.select("entity_id", F.when(F.col("health") == "fresh", 0).otherwise(1).alias("rank"))
    relations = v.relations.select(F.col("source_id").alias("entity_id"), F.when(F.col("type") == "supersedes", 1).otherwise(0).alias("rank"))
    return R.entity_panel(v.entities.filter("status = 'draft'").select(F.col("position").alias("entity_id")), {"groundings": groundings, "relations": relations})


CLUSTERS = """SELECT 'customer:' || c_custkey AS id, 'function' AS kind, c_name AS qualified_name, CASE WHEN c_custkey % 3 > 0 THEN 'nation' END AS container_id, 'd' || (c_nationkey % 7) AS file_path, cast(c_custkey % 30 AS bigint) AS start_line, cast(c_custkey % 30 + c_custkey % 13 AS bigint) AS end_line, c_custkey % 4 = 1 AS is_exported, 'c' || c_nationkey AS cluster FROM customer
    UNION ALL SELECT 'supplier:' || s_suppkey, 'method', s_name, 'nation', 'd' || (s_nationkey % 7), cast(s_suppkey % 25 AS bigint), cast(s_suppkey % 25 + 2 AS bigint), s_suppkey % 2 = 0, 'c' || s_nationkey FROM supplier"""


def _clusters(v: Views):
    from marlstone.operators import cluster_context as C

    nodes = v._spark.sql(CLUSTERS.replace("FROM customer", "FROM {customer}").replace("FROM supplier", "FROM {supplier}"), customer=v.customer, supplier=v.supplier)
    names = nodes.select("id", "qualified_name", "kind", "container_id", "file_path", "start_line", "end_line", "is_exported")
    context = C.context_nodes(nodes.select("cluster", "id"), names, v.g_edges, 40)
    files = v.documents.filter("doc_id < 7").select(F.concat(F.lit("d"), "doc_id").alias("path"), F.col("text").alias("content"))  # seven files are what the clusters name
    return C, context, C.context_blocks(context, files)


NODES_OF = f""", n AS ({CLUSTERS}), k AS (SELECT *, is_exported OR container_id IS NULL AS primary_node FROM n), r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY primary_node DESC, file_path, start_line, id) AS place, count(*) OVER (PARTITION BY cluster) AS total FROM k),
    callers AS (SELECT target AS id, source, row_number() OVER (PARTITION BY target ORDER BY source) AS nth FROM (SELECT DISTINCT source, target FROM g_edges WHERE kind = 'calls' AND source <> target))"""


@query("gr_19_context_nodes", NODES_OF + """ SELECT r.cluster, place, r.id, primary_node AS "primary", total, coalesce((SELECT string_agg(source, ',' ORDER BY nth) FROM callers WHERE callers.id = r.id AND nth <= 5 AND primary_node), '') AS callers FROM r WHERE place <= 40""", ("g_edges",))
def _(v: Views):
    return _clusters(v)[1].select("cluster", "place", "id", "primary", "total", F.array_join("callers", ",").alias("callers"))


@query("gr_19_context_blocks", NODES_OF + """, t AS (SELECT 'd' || doc_id AS file_path, string_split(regexp_replace(text, '\\n$', ''), chr(10)) AS lines FROM documents WHERE doc_id < 7),
    b AS (SELECT cluster, place, id, greatest(start_line - CASE WHEN primary_node THEN 3 ELSE 0 END, 1) AS first, end_line + CASE WHEN primary_node THEN 3 ELSE 0 END AS until, lines FROM r JOIN t USING (file_path) WHERE place <= 40 AND start_line >= 1),
    c AS (SELECT cluster, place, id, first, least(until, len(lines)) AS last, lines FROM b)
    SELECT cluster, place, id, first, cast(last AS bigint) AS last, md5(array_to_string(lines[first:last], chr(10))) AS content FROM c WHERE first <= last AND trim(regexp_replace(array_to_string(lines[first:last], ' '), '\\s+', ' ', 'g')) <> ''""".replace("\\\\", "\\"), ("g_edges",))
def _(v: Views):
    return _clusters(v)[2].select("cluster", "place", "id", "first", "last", F.md5("content").alias("content"))


@query("gr_19_fitted_context")
def _(v: Views):
    """Blocks within the budget; held against a plain loop in the tests."""
    C, context, blocks = _clusters(v)
    return C.fit_context(context, blocks, 3000).drop("content")
