"""Knowledge-base queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.functions import text as T
from marlstone.operators import knowledge as W
from marlstone.plans.registry import query
from marlstone.plans.views import Views

ALLOWED = ("derived_from", "refines")


@query("wk_2_listing", "SELECT type, count(*) AS n, count(*) FILTER (status = 'active') AS active FROM entities GROUP BY type", ("entities",))
def _(v: Views):
    return v.entities.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("status") == "active", 1)).alias("active"))


TOPICS = "SELECT p_partkey % 40 AS k, min('topic' || (p_partkey % 40)) AS id, min(p_name) AS title FROM part GROUP BY 1"


@query("wk_3_topics", f"""WITH t AS ({TOPICS}), names AS (SELECT lower(trim(title)) AS normal, min(id) AS named FROM t GROUP BY 1 HAVING count(DISTINCT id) = 1), wanted AS (SELECT DISTINCT p_name AS name FROM part UNION SELECT 'topic7')
    SELECT w.name, coalesce(t.id, n.named) AS topic FROM wanted w LEFT JOIN t ON t.id = w.name LEFT JOIN names n ON n.normal = lower(trim(w.name))""")
def _(v: Views):
    topics = v.part.groupBy((F.col("p_partkey") % 40).alias("k")).agg(F.min(F.concat(F.lit("topic"), (F.col("p_partkey") % 40).cast("string"))).alias("id"), F.min("p_name").alias("title"))
    topics = topics.select("id", "title", F.array(F.col("title")).alias("aliases"))
    wanted = v.part.select(F.col("p_name").alias("name")).union(v._spark.createDataFrame([("topic7",)], "name string")).distinct()
    return W.resolve_topics(wanted, topics)


@query("wk_4_grounding_health", """SELECT health, count(*) AS n FROM (SELECT CASE WHEN p.p_partkey IS NULL THEN 'missing' WHEN g.entity_id % 13 = 0 THEN 'unverified' WHEN p.p_size % 2 = g.entity_id % 2 THEN 'fresh' ELSE 'changed' END AS health
    FROM groundings g LEFT JOIN part p ON 'part:' || p.p_partkey = g.node_id WHERE g.ordinal = 0) GROUP BY health""", ("groundings",))
def _(v: Views):
    refs = v.groundings.filter("ordinal = 0").select("entity_id", F.col("node_id").alias("ref_id"), F.when(F.col("entity_id") % 13 != 0, (F.col("entity_id") % 2).cast("string")).alias("recorded_hash"))
    resolved = v.part.select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("ref_id"), F.lit("Resolved").alias("state"), (F.col("p_size") % 2).cast("string").alias("body_hash"))
    return W.grounding_health(refs, resolved).groupBy("health").agg(F.count(F.lit(1)).alias("n"))


@query("wk_5_effective_baselines", """, own AS (SELECT node_id AS ref, entity_id AS doc, CASE WHEN entity_id % 4 = 0 THEN 'f' || (entity_id % 3) END AS fp FROM groundings), com AS (SELECT node_id AS ref, entity_id AS doc, 'f' || (entity_id % 2) AS fp FROM groundings WHERE entity_id % 3 = 0)
    SELECT ref, doc, coalesce(fp, s, a) AS fingerprint, CASE WHEN fp IS NOT NULL THEN 'own' WHEN s IS NOT NULL THEN 'file' WHEN a IS NOT NULL THEN 'others' ELSE 'none' END AS source, coalesce(n, 0) > 1 AS conflict FROM own
    LEFT JOIN (SELECT ref, doc, CASE WHEN count(DISTINCT fp) = 1 THEN min(fp) END AS s FROM com GROUP BY ALL) USING (ref, doc) LEFT JOIN (SELECT ref, count(DISTINCT fp) AS n, CASE WHEN count(DISTINCT fp) = 1 THEN min(fp) END AS a FROM com GROUP BY ref) USING (ref)""", ("groundings",))
def _(v: Views):
    base = v.groundings.select(F.col("node_id").alias("ref"), F.col("entity_id").alias("doc"))
    own = base.withColumn("fingerprint", F.when(F.col("doc") % 4 == 0, F.concat(F.lit("f"), (F.col("doc") % 3).cast("string"))))
    committed = base.filter("doc % 3 = 0").withColumn("fingerprint", F.concat(F.lit("f"), (F.col("doc") % 2).cast("string")))
    return W.effective_baseline(own, committed, v._spark.createDataFrame([], "ref string, fingerprint string"))


@query("wk_8_duplicate_ids", """SELECT 'duplicate-id' AS code, 'error' AS severity, cast(position AS varchar) AS entity, 'also in ' || f AS message FROM (SELECT *, row_number() OVER w AS n, first_value(file) OVER w AS f FROM entities WINDOW w AS (PARTITION BY id ORDER BY file, position)) WHERE n > 1""", ("entities",))
def _(v: Views):
    return W.duplicate_ids(v.entities)


@query("wk_8_relations", """, j AS (SELECT r.*, e.status FROM relations r LEFT JOIN (SELECT position, any_value(status) AS status FROM entities GROUP BY position) e ON e.position = r.target_id)
    SELECT code, severity, cast(source_id AS varchar) AS entity, type || ' ' || target_id AS message FROM (SELECT 'relation-type' AS code, 'error' AS severity, * FROM j WHERE type NOT IN ('derived_from', 'refines') UNION ALL SELECT 'relation-self', 'error', * FROM j WHERE source_id = target_id
    UNION ALL SELECT 'relation-missing', 'error', * FROM j WHERE status IS NULL UNION ALL SELECT 'relation-inactive', 'warning', * FROM j WHERE status = 'archived')""", ("relations", "entities"))
def _(v: Views):
    return W.all_issues(W.relation_issues(v.relations, v.entities, ALLOWED), W.contradictions(v.relations))


@query("wk_8_orphans", "SELECT 'orphan' AS code, 'info' AS severity, cast(position AS varchar) AS entity, type AS message FROM entities WHERE type IN ('spec', 'decision') AND position NOT IN (SELECT source_id FROM relations UNION SELECT target_id FROM relations)", ("entities", "relations"))
def _(v: Views):
    return W.orphans(v.entities, v.relations, ("spec", "decision"))


@query("wk_9_overlaps", """SELECT 'range-overlap' AS code, 'error' AS severity, id AS entity, 'until ' || reached AS message FROM (SELECT *, max(end_line) OVER (PARTITION BY file_path ORDER BY start_line, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM g_nodes WHERE kind = 'method') WHERE start_line <= reached""", ("g_nodes",))
def _(v: Views):
    return W.overlaps(v.g_nodes.filter("kind = 'method'").select(F.col("file_path").alias("file"), "id", F.col("start_line").alias("first"), F.col("end_line").alias("last")))


@query("wk_8_divergence", "SELECT 'divergence' AS code, 'warning' AS severity, id AS entity, count(DISTINCT status) || ' values' AS message FROM entities GROUP BY id HAVING count(DISTINCT status) > 1", ("entities",))
def _(v: Views):
    return W.divergence(v.entities, "id", "status")


@query("wk_10_rendered_views", "SELECT topic, sha256('# ' || topic || chr(10) || string_agg('- ' || trim(title) || ' (' || status || ')', chr(10) ORDER BY title, position)) AS page FROM entities GROUP BY topic", ("entities",))
def _(v: Views):
    return W.rendered(v.entities, "topic").select("topic", F.sha2("page", 256).alias("page"))


@query("wk_10_view_drift", "SELECT * FROM (VALUES ('de', 'changed'), ('xx', 'extra'), ('fr', 'missing')) t(topic, drift)")
def _(v: Views):
    few = v.entities
    stored = W.rendered(few, "topic").filter("topic <> 'fr'").withColumn("page", F.when(F.col("topic") == "de", "old").otherwise(F.col("page")))
    return W.view_drift(stored.union(v._spark.createDataFrame([("xx", "p")], "topic string, page string")), few, "topic")


@query("join_19_similar_titles", """, w AS (SELECT position, type, list_distinct(list_filter(regexp_split_to_array(lower(title || ' ' || summary), '[^a-z0-9à-ÿ]+'), lambda x: x <> '')) AS words FROM entities)
    SELECT a.position AS a, b.position AS b, round(len(list_intersect(a.words, b.words)) / len(list_distinct(list_concat(a.words, b.words))), 6) AS score FROM w a JOIN w b ON a.type = b.type AND a.position < b.position WHERE len(list_intersect(a.words, b.words)) / len(list_distinct(list_concat(a.words, b.words))) >= 0.6""", ("entities",))
def _(v: Views):
    titles = v.entities.select(F.col("position").alias("id"), "type", F.concat_ws(" ", "title", "summary").alias("title"))
    return W.similar_pairs(titles, 0.6).select("a", "b", F.round("score", 6).alias("score"))


@query("agg_18_relation_candidates", """, g AS (SELECT DISTINCT node_id AS node, entity_id AS entity FROM groundings), e AS (SELECT DISTINCT source, target FROM g_edges WHERE kind = 'references'), m AS (SELECT g.* FROM g JOIN (SELECT node FROM g GROUP BY node HAVING count(*) > 16) USING (node)),
    s AS (SELECT least(p.entity, q.entity) AS a, greatest(p.entity, q.entity) AS b, sum(0.3) AS weight FROM e JOIN g p ON p.node = e.source JOIN g q ON q.node = e.target WHERE p.entity <> q.entity GROUP BY 1, 2),
    h AS (SELECT x.entity AS a, y.entity AS b, count(*) AS shared FROM g x JOIN g y ON x.node = y.node AND x.entity < y.entity WHERE x.node NOT IN (SELECT node FROM m) GROUP BY 1, 2),
    p AS (SELECT a, b, least(1, coalesce(weight, 0)) AS weight, coalesce(shared, 0) AS shared FROM s FULL JOIN h USING (a, b)), c AS (SELECT a, b, count(*) AS more FROM p JOIN m x ON x.entity = a JOIN m y ON y.entity = b AND x.node = y.node GROUP BY 1, 2)
    SELECT a, b, round(cast(weight + 0.2 * (shared + coalesce(more, 0)) AS double), 6) AS score, shared + coalesce(more, 0) AS shared, NULL AS node FROM p LEFT JOIN c USING (a, b) UNION ALL SELECT entity, NULL, 0.2, NULL, node FROM m""", ("groundings", "g_edges"))
def _(v: Views):
    grounded = v.groundings.select(F.col("node_id").alias("node"), F.col("entity_id").alias("entity"))
    edges = v.g_edges.filter("kind = 'references'").select("source", "target").distinct().withColumn("weight", F.lit(0.3))
    return W.relation_candidates(edges, grounded, most=16).select("a", "b", F.round("score", 6).alias("score"), "shared", "node")


@query("x_13_promotion", "SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN doc_id % 6 = 0 THEN 'rejected' WHEN n_chars % 100 >= 70 THEN 'promoted' WHEN n_chars % 100 >= 40 THEN 'in_flight' ELSE 'rejected' END AS outcome FROM documents) GROUP BY outcome")
def _(v: Views):
    outcome = W.promotion((F.col("n_chars") % 100) / 100, F.col("doc_id") % 6 != 0)
    return v.documents.groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@query("wk_12_operations", "SELECT * FROM (VALUES ('a', 'e1', 'applied'), ('b', 'e1', 'applied'), ('c', 'e1', 'failed'), ('d', 'e1', 'aborted'), ('x', 'e2', 'replayed'), ('y', 'e2', 'rejected'), ('z', 'e2', 'applied'), ('z', 'e2', 'rejected')) t(op_id, entity, outcome)")
def _(v: Views):
    ops = [("a", 1, "e1", "h", 1), ("b", 2, "e1", "h", 2), ("c", 3, "e1", "h", 9), ("d", 4, "e1", "h", 3), ("x", 5, "e2", "p", None), ("y", 6, "e2", "q", None), ("z", 7, "e2", "h", 5), ("z", 8, "e2", "h", 5)]
    operations = v._spark.createDataFrame(ops, "op_id string, seq int, entity string, payload_hash string, expects int")
    log = v._spark.createDataFrame([("x", "p"), ("y", "other")], "op_id string, payload_hash string")
    return W.apply_operations(operations, log, v._spark.createDataFrame([("e1", 1), ("e2", 5)], "entity string, revision int"))


@query("wk_14_diagnostics", "SELECT severity, code, count(*) AS n FROM (SELECT 'error' AS severity, 'dup' AS code FROM entities WHERE revision = 7 UNION ALL SELECT 'info', 'old' FROM entities WHERE revision = 1) GROUP BY ALL", ("entities",))
def _(v: Views):
    dup = W.issue(v.entities.filter("revision = 7"), "dup", "error", F.col("position"), F.col("id"))
    old = W.issue(v.entities.filter("revision = 1"), "old", "info", F.col("position"), F.col("id"))
    return W.all_issues(dup, old).groupBy("severity", "code").agg(F.count(F.lit(1)).alias("n"))


BODY_TERMS = "(SELECT doc_id, list_filter(regexp_split_to_array(text, '[^\\p{L}\\p{N}_]+'), lambda w: strlen(w) >= 2 AND NOT regexp_matches(w, '^\\p{N}') AND NOT list_contains([%s], lower(w))) AS raw FROM documents)" % ", ".join(f"'{k}'" for k in T.KEYWORDS)


@query("x_25_body_terms", f"""SELECT doc_id, coalesce(string_agg(raw[pos], ' ' ORDER BY pos), '') AS terms FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS nth FROM (
    SELECT doc_id, raw, pos FROM (SELECT doc_id, raw, unnest(range(1, len(raw) + 1)) AS pos FROM {BODY_TERMS} WHERE len(raw) > 0) WHERE list_position(list_transform(raw, lambda w: lower(w)), lower(raw[pos])) = pos
    UNION ALL SELECT doc_id, raw, NULL FROM {BODY_TERMS} WHERE len(raw) = 0)) WHERE nth <= 256 GROUP BY doc_id""")
def _(v: Views):
    return v.documents.select("doc_id", T.body_terms(F.col("text")).alias("terms"))
