"""Ranked retrieval over the stand-in graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.functions import text as T
from marlstone.operators import scope as S
from marlstone.plans.registry import query
from marlstone.plans.views import Views

NAMES = "list_filter(regexp_split_to_array(lower({}), '[^a-z0-9à-ÿ]+'), lambda w: w <> '')"
TASK = "Where does the cold widget get its Supplier#000000007 and who orders small widgets"


@query("sc_1_query_plan", "SELECT * FROM (VALUES ('cold', 1.0::double), ('widget', 1.0), ('get', 1.0), ('orders', 1.0), ('order', 0.55), ('small', 1.0), ('widgets', 1.0), ('supplier', 1.15), ('000000007', 1.15)) t(term, weight)")
def _(v: Views):
    plan = S.plan_query(TASK)
    return v._spark.createDataFrame([(t, float(w)) for t, w in plan.terms.items()], "term string, weight double")


@query("sc_4_exact_channel", "SELECT id, row_number() OVER (ORDER BY file_path, start_line, id) AS rank FROM g_nodes WHERE (lower(name) = 'supplier#000000007' OR lower(qualified_name) = 'supplier#000000007') AND kind NOT IN ('file', 'module')", ("g_nodes",))
def _(v: Views):
    return S.exact_channel(v.g_nodes, S.plan_query(TASK)).select("id", "rank")




@query("sc_5_concepts", f"""SELECT id, rank FROM (SELECT id, row_number() OVER (ORDER BY sum(w) DESC, any_value(dl), id) AS rank FROM (SELECT id, len(a) + len(b) AS dl, unnest(list_concat(a, b)) AS term, unnest(list_concat([10.0 FOR x IN a], [4.0 FOR x IN b])) AS w FROM (SELECT id, {NAMES.format('name')} AS a, {NAMES.format('qualified_name')} AS b FROM g_nodes WHERE kind NOT IN ('file', 'module')))
    WHERE term = 'cold' GROUP BY id) WHERE rank <= 30""", ("g_nodes",))
def _(v: Views):
    return S.concept_channels(v.g_nodes, S.plan_query(TASK)).filter("channel = 'concept:cold'").select("id", "rank")


TERMS = "(" + ", ".join(f"'{t}'" for t in S.plan_query(TASK).terms) + ")"
SEARCHED = f"""w AS (SELECT id, {NAMES.format('name')} AS a, {NAMES.format('qualified_name')} AS b FROM g_nodes WHERE kind NOT IN ('file', 'module')), dl AS (SELECT id, len(a) + len(b) AS dl FROM w),
    post AS (SELECT id, term, sum(x) AS tf FROM (SELECT id, unnest(a) AS term, 10.0::double AS x FROM w UNION ALL SELECT id, unnest(b), 4.0 FROM w) WHERE term IN {TERMS} GROUP BY ALL),
    score AS (SELECT id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 9) AS score FROM post JOIN dl USING (id) JOIN (SELECT term, count(*) AS df FROM post GROUP BY term) USING (term), (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl) GROUP BY id)"""


@query("sc_3_text_channel", f""", {SEARCHED} SELECT id, rank, 1.0::double AS weight FROM (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM score) WHERE rank <= 80""", ("g_nodes",))
def _(v: Views):
    return S.text_channel(v.g_nodes, S.plan_query(TASK)).select("id", "rank", "weight")


PATH_TERMS = "[" + ", ".join(f"'{t}'" for t in S.plan_query("brand 13 nation 3").terms) + "]"
PARTS = "list_distinct(list_filter(regexp_split_to_array(lower(regexp_replace(regexp_replace(regexp_replace(file_path, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '[^A-Za-z0-9]+', ' ', 'g')), ' '), lambda x: length(x) >= 2))"


@query("sc_10_path_channel", f"""SELECT id, rank, 0.4::double AS weight FROM (SELECT id, row_number() OVER (ORDER BY len(list_intersect({PARTS}, {PATH_TERMS})) DESC, file_path, id) AS rank FROM g_nodes WHERE kind NOT IN ('file', 'module') AND len(list_intersect({PARTS}, {PATH_TERMS})) > 0) WHERE rank <= 40""", ("g_nodes",))
def _(v: Views):
    return S.path_channel(v.g_nodes, S.plan_query("brand 13 nation 3")).select("id", "rank", "weight")


@query("sc_2_concepts", """SELECT * FROM (VALUES ('cold', 'cold', 1.0::double), ('widget', 'widget', 1.0), ('get', 'get', 1.0), ('orders', 'orders', 1.0), ('orders', 'order', 0.55), ('small', 'small', 1.0), ('widgets', 'widgets', 1.0), ('widgets', 'widget', 1.0),
    ('supplier#000000007', 'supplier', 1.15), ('supplier#000000007', '000000007', 1.15)) t(concept, term, weight)""")
def _(v: Views):
    plan = S.plan_query(TASK)
    return v._spark.createDataFrame([(k, t, float(plan.terms[t])) for k, ts in plan.concepts.items() for t in ts], "concept string, term string, weight double")


@query("sc_6_vector_channel", """SELECT id, rank, 0.5::double AS weight FROM (SELECT 'v' || vec_id AS id, row_number() OVER (ORDER BY round(list_cosine_similarity(embedding::double[], (SELECT embedding FROM embeddings WHERE vec_id = 11)::double[]), 9) DESC, 'v' || vec_id) AS rank FROM embeddings) WHERE rank <= 40""")
def _(v: Views):
    asked = [float(x) for x in v.embeddings.filter("vec_id = 11").first()["embedding"]]
    vectors = v.embeddings.select(F.concat(F.lit("v"), "vec_id").alias("id"), F.col("embedding").alias("vector"))
    return S.vector_channel(vectors, asked).select("id", "rank", "weight")


@query("sc_13_file_scores")
def _(v: Views):
    plan = S.plan_query(TASK)
    return S.file_scores(S.node_scores(S.evidence(v.g_nodes, plan)), v.g_nodes, plan).select("file_path", F.round("score", 6).alias("score"), "exact")


@query("sc_15_admission")
def _(v: Views):
    return S.scope(v.g_nodes, TASK).select("id", "file_path", "place")


PATH_TERMS = ("from", "with", "nicht", "para", "dans")


@query("sc_18_strength", """WITH f AS (SELECT doc_id, doc_id % 5 AS pick, doc_id % 50 = 7 AS exact, list_filter(regexp_split_to_array(lower(substr(text, 1, 400)), '[^a-z0-9à-ÿ]+'), lambda w: w IN ('from', 'with', 'nicht', 'para', 'dans')) AS terms FROM documents)
    SELECT doc_id // 5 AS task, CASE WHEN count(*) FILTER (pick < 3) = 0 THEN 'none' WHEN bool_or(exact AND pick < 3) OR n >= 3 THEN 'strong' WHEN n > 0 THEN 'moderate' ELSE 'weak' END AS strength, n AS covered
    FROM f JOIN (SELECT doc_id // 5 AS task, len(list_distinct(flatten(list(CASE WHEN pick < 3 THEN terms ELSE [] END)))) AS n FROM f GROUP BY 1) c ON c.task = doc_id // 5 GROUP BY doc_id // 5, n""")
def _(v: Views):
    d = v.documents.select((F.col("doc_id") / 5).cast("long").alias("task"), (F.col("doc_id") % 5).alias("pick"), (F.col("doc_id") % 50 == 7).alias("exact"), T.words(F.substring("text", 1, 400)).alias("terms"))
    return S.strength(d.select("task").distinct(), d.filter("pick < 3"), list(PATH_TERMS))


@query("sc_9_co_called", "SELECT DISTINCT source, target FROM g_edges WHERE source IN ('order:1', 'order:2', 'order:3', 'order:4') AND target IN (SELECT id FROM g_nodes WHERE kind = 'class')", ("g_nodes", "g_edges"))
def _(v: Views):
    orders = v._spark.createDataFrame([(f"order:{i}",) for i in range(1, 5)], "id string")
    return S.co_called(v.g_edges, orders.union(v.g_nodes.filter("kind = 'class'").select("id")))


@query("sc_17_test_neighbours", "SELECT id, file_path FROM g_nodes WHERE id IN (SELECT source FROM g_edges WHERE target IN ('part:5', 'part:6')) AND file_path LIKE 'tests/%' ORDER BY file_path, id LIMIT 3", ("g_nodes", "g_edges"))
def _(v: Views):
    chosen = v._spark.createDataFrame([("part:5",), ("part:6",)], "id string")
    return S.test_neighbours(v.g_nodes, v.g_edges, chosen).select("id", "file_path")


@query("sc_7_bridges", """, both_ways AS (SELECT source AS id, target AS near FROM g_edges WHERE confidence >= 0.8 UNION SELECT target, source FROM g_edges WHERE confidence >= 0.8)
    SELECT id, file_path FROM (SELECT id, file_path, row_number() OVER (PARTITION BY file_path ORDER BY id) AS nth FROM g_nodes WHERE id IN (SELECT id FROM both_ways WHERE near IN ('nation:1', 'nation:2', 'nation:3')) AND id IN (SELECT id FROM both_ways WHERE near LIKE 'order:%')) WHERE nth <= 2""", ("g_nodes", "g_edges"))
def _(v: Views):
    left = v._spark.createDataFrame([(f"nation:{i}",) for i in (1, 2, 3)], "id string")
    return S.bridges(v.g_edges, v.g_nodes, left, v.g_nodes.filter("kind = 'variable'").select("id"))


@query("sc_1_task_plans", """SELECT p_partkey AS task, concept, term, weight FROM part, LATERAL (SELECT * FROM (VALUES ('orders', 'orders', 1.0::double), ('orders', 'order', 0.55), ('small', 'small', 1.0), (lower(p_brand), 'brand', 1.15), (lower(p_brand), string_split(p_brand, '#')[2], 1.15)) t(concept, term, weight)) WHERE length(term) >= 2""")
def _(v: Views):
    """A task a part, each planned as terms by concept."""
    return S.query_plans(v.part.select(F.col("p_partkey").alias("task"), F.concat(F.lit("who orders small "), "p_brand").alias("text")))
