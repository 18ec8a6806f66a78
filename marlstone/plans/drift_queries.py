"""Drift rules over stand-in claims and facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.operators import drift as D
from marlstone.plans.registry import query
from marlstone.plans.views import Views

CLAIMS = "claims AS (SELECT doc_id, source AS file, CASE doc_id % 4 WHEN 0 THEN 'path' WHEN 1 THEN 'command' WHEN 2 THEN 'dependency' ELSE 'version' END AS kind, 'key' || (doc_id % 60) AS value, doc_id % 10 = 0 AS negated, n_chars % 400 AS line FROM documents)"
MEMO = "Run `npm run build` and see `src/a/b.ts`.\nIt requires `left-pad` react@18.2\nWe no longer use `make old`. TODO later"


def _claims(v: Views):
    return v.claims.select("file", "line", "kind", F.col("key").alias("value"), "negated")


def _facts(v: Views):
    return v.part.filter("p_size % 3 <> 0").select(F.concat(F.lit("key"), F.col("p_size").cast("string")).alias("value")).distinct()


@query("dr_1_claims", """SELECT * FROM (VALUES (1, 'command', 'npm run build', false), (1, 'path', 'src/a/b.ts', false), (2, 'version', 'react@18.2', false), (2, 'dependency', 'left-pad', false), (3, 'command', 'make old', true)) t(line, kind, value, negated)""")
def _(v: Views):
    docs = v._spark.createDataFrame([("memo", MEMO)], "file string, text string")
    return D.claims(docs, "file", "text").select(F.col("line").cast("int").alias("line"), "kind", "value", "negated")


for _name, _kind, _code in (("dr_2_missing_paths", "path", "path-missing"), ("dr_3_dead_commands", "command", "command-dead")):

    @query(_name, f"WITH {CLAIMS} SELECT '{_code}' AS code, 'error' AS severity, file, line, value AS message FROM claims WHERE kind = '{_kind}' AND NOT negated AND value NOT IN (SELECT 'key' || p_size FROM part WHERE p_size % 3 <> 0)")
    def _(v: Views, kind=_kind, code=_code):
        return D.missing(_claims(v), _facts(v), kind, code)


@query("dr_4_dependencies", """SELECT code, severity, file, line, message FROM (SELECT 'dependency-missing' AS code, 'error' AS severity, p_brand AS file, p_partkey AS line, 'lib' || (p_partkey % 12) AS message FROM part WHERE p_partkey % 12 > 8
    UNION ALL SELECT 'version-mismatch', 'warning', p_brand, p_partkey, 'lib' || (p_partkey % 12) || ' ' || (p_partkey % 5) || ' ' || (p_partkey % 12) || '.1' FROM part WHERE p_partkey % 12 <= 8 AND p_partkey % 5 <> p_partkey % 12)""")
def _(v: Views):
    k = F.col("p_partkey")
    claimed = v.part.select(F.col("p_brand").alias("file"), k.alias("line"), F.lit("version").alias("kind"), F.concat(F.lit("lib"), (k % 12).cast("string"), F.lit("@"), (k % 5).cast("string")).alias("value"), F.lit(False).alias("negated"))
    manifest = v._spark.createDataFrame([(f"lib{i}", f"{i}.1") for i in range(9)], "name string, version string")
    return D.dependency_issues(claimed, manifest)


@query("dr_5_conflicts", """SELECT 'conflict' AS code, 'warning' AS severity, min(file) AS file, cast(NULL AS bigint) AS line, kind || ' ' || key || ' ' || string_agg(DISTINCT value, '|' ORDER BY value) AS message FROM claims WHERE NOT negated GROUP BY kind, key HAVING count(DISTINCT value) > 1""", ("claims",))
def _(v: Views):
    return D.conflicts(v.claims)


@query("dr_7_index_sync", "SELECT code, count(*) AS n FROM (SELECT 'index-orphan' AS code FROM part WHERE p_partkey % 7 = 1 AND p_partkey % 5 = 0 UNION ALL SELECT 'index-missing' FROM part WHERE p_partkey % 5 <> 0 AND p_partkey % 7 <> 1) GROUP BY code")
def _(v: Views):
    files = lambda c: v.part.filter(c).select(F.col("p_partkey").cast("string").alias("file"))
    return D.symmetric_difference(files("p_partkey % 7 = 1"), files("p_partkey % 5 <> 0")).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


@query("dr_8_scripts", "SELECT DISTINCT p_type AS message FROM part WHERE p_type NOT IN (SELECT unnest(regexp_split_to_array(text, '[^\\w:-]+')) FROM documents)".replace("\\\\", "\\"))
def _(v: Views):
    return D.uncovered_scripts(v.part.select(F.col("p_type").alias("value")).distinct(), v.documents, "text").select("message")


@query("dr_9_staleness", """SELECT severity, count(*) AS n, min(message) AS message FROM (SELECT CASE WHEN greatest(a, c) = 2 THEN 'error' ELSE 'warning' END AS severity, concat_ws(', ', CASE WHEN a > 0 THEN age || ' days' END, CASE WHEN c > 0 THEN n || ' commits' END) AS message FROM (
    SELECT *, CASE WHEN age >= 90 THEN 2 WHEN age >= 30 THEN 1 ELSE 0 END AS a, CASE WHEN n >= 200 THEN 2 WHEN n >= 50 THEN 1 ELSE 0 END AS c FROM (SELECT file, date_diff('day', max(ts)::date, date '1999-01-01') AS age, count(*) AS n FROM commits GROUP BY file)) WHERE greatest(a, c) > 0) GROUP BY severity""", ("commits",))
def _(v: Views):
    files = v.commits.groupBy("file").agg(F.datediff(F.lit("1999-01-01").cast("date"), F.max("ts").cast("date")).alias("age_days"), F.count(F.lit(1)).alias("commits_since"))
    return D.staleness(files).groupBy("severity").agg(F.count(F.lit(1)).alias("n"), F.min("message").alias("message"))


@query("dr_10_markers", "SELECT doc_id AS file, line, w AS message FROM (SELECT doc_id, unnest(range(1, len(l) + 1)) AS line, unnest(l) AS content FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)), (SELECT 1), LATERAL (SELECT regexp_extract(content, '\\b(Wher|Nicht)\\b', 1) AS w) WHERE w <> ''".replace("\\\\", "\\"))
def _(v: Views):
    return D.markers(v.documents, "doc_id", "text", ("Wher", "Nicht")).select(F.col("file").cast("long").alias("file"), "line", "message")


@query("dr_11_broken_links", """SELECT page_id AS file, href AS message FROM (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages) WHERE href NOT IN (SELECT '/' || substr(lang, 1, 2) FROM documents UNION SELECT '/the' UNION SELECT '/The')""")
def _(v: Views):
    targets = v.documents.select(F.concat(F.lit("/"), F.substring("lang", 1, 2)).alias("value")).union(v._spark.createDataFrame([("/the",), ("/The",)], "value string")).distinct()
    return D.broken_links(v.pages, "page_id", "html", targets).select(F.col("file").cast("long").alias("file"), "message")


@query("dr_12_frontmatter", "SELECT file, message, count(*) AS n FROM (SELECT source AS file, concat_ws(',', CASE WHEN doc_id % 3 = 0 THEN 'title' END, CASE WHEN doc_id % 5 = 0 THEN 'status' END) AS message FROM documents) WHERE message <> '' GROUP BY ALL")
def _(v: Views):
    rows = v.documents.select(F.col("source").alias("file"), F.when(F.col("doc_id") % 3 != 0, "t").alias("title"), F.when(F.col("doc_id") % 5 == 0, " ").otherwise("x").alias("status"))
    return D.incomplete(rows, ("title", "status")).groupBy("file", "message").agg(F.count(F.lit(1)).alias("n"))


@query("dr_13_grounding_shapes", "SELECT code, count(*) AS n FROM (SELECT 'grounding-shape' AS code FROM groundings WHERE entity_id % 8 = 0 UNION ALL SELECT 'grounding-duplicate' FROM (SELECT entity_id, CASE WHEN entity_id % 8 = 0 THEN 'x' ELSE 'supplier:1' END AS n FROM groundings GROUP BY ALL HAVING count(*) > 1)) GROUP BY code", ("groundings",))
def _(v: Views):
    rows = v.groundings.select("entity_id", F.when(F.col("entity_id") % 8 == 0, "x").otherwise("supplier:1").alias("node_id"))
    return D.bad_shapes(rows).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


@query("dr_14_unreachable", """, reach(id) AS (SELECT 4 UNION SELECT r.target_id FROM reach x JOIN relations r ON r.source_id = x.id) SELECT cast(doc_id AS varchar) AS file FROM documents WHERE doc_id NOT IN (SELECT id FROM reach)""", ("relations",))
def _(v: Views):
    links = v.relations.select(F.col("source_id").cast("string").alias("src"), F.col("target_id").cast("string").alias("dst"))
    return D.unreachable(v.documents.select(F.col("doc_id").cast("string").alias("file")), links, v._spark.createDataFrame([("4",)], "id string")).select("file")


@query("dr_15_copies", "SELECT min(source) AS file, lang || ' ' || count(DISTINCT sha256(text)) AS message FROM documents GROUP BY lang HAVING count(DISTINCT sha256(text)) > 1")
def _(v: Views):
    return D.differing_copies(v.documents.select(F.col("source").alias("file"), F.col("lang").alias("name"), F.col("text").alias("content"))).select("file", "message")


@query("dr_16_grounding_states", """SELECT state, count(*) AS n FROM (SELECT CASE WHEN p_partkey % 11 = 0 THEN 'ambiguous' WHEN p_partkey % 7 = 0 THEN CASE WHEN p_partkey % 2 = 0 THEN 'moved' ELSE 'gone' END WHEN p_partkey % 5 = 0 THEN 'unverified' WHEN p_size % 3 = 0 THEN 'intact' ELSE 'changed' END AS state FROM part) GROUP BY state""")
def _(v: Views):
    k = F.col("p_partkey")
    refs = v.part.select(k.alias("ref_id"), F.when(k % 5 != 0, "0").alias("recorded_hash"))
    resolved = v.part.select(k.alias("ref_id"), F.when(k % 11 == 0, "Ambiguous").when(k % 7 == 0, "Missing").otherwise("Resolved").alias("state"), (F.col("p_size") % 3).cast("string").alias("body_hash"))
    moved = v.part.filter("p_partkey % 2 = 0").select(k.alias("ref_id"), F.lit("moved").alias("verdict"))
    return D.grounding_states(refs, resolved, moved).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


@query("dr_18_relocation", """, lost AS (SELECT p_partkey AS ref_id, CASE p_partkey % 2 WHEN 0 THEN 'struct' ELSE 'function' END AS kind, p_name || (p_partkey % 30) AS name, CASE WHEN p_partkey % 3 > 0 THEN 'h' || (p_partkey % 70) END AS rec FROM part),
    node AS (SELECT p_partkey AS id, CASE p_partkey % 2 WHEN 0 THEN 'class' ELSE 'method' END AS kind, p_name || (p_partkey % 50) AS name, 'h' || (p_partkey % 110) AS hash FROM part),
    m AS (SELECT ref_id, id, l.rec, node.name = l.name AS named, node.hash = l.rec AS body FROM lost l JOIN node ON (l.kind = 'struct') = (node.kind = 'class') AND (node.name = l.name OR node.hash = l.rec)),
    r AS (SELECT ref_id, 'A' AS rung, CASE WHEN count(*) = 1 THEN min(id) WHEN count(*) FILTER (named) = 1 THEN min(id) FILTER (named) END AS target, CASE WHEN count(*) = 1 THEN 1.0::double WHEN count(*) FILTER (named) = 1 THEN 0.8::double END AS c FROM m WHERE body GROUP BY ref_id
    UNION ALL SELECT ref_id, 'B', CASE WHEN count(*) = 1 THEN min(id) END, CASE WHEN count(*) = 1 THEN CASE WHEN any_value(rec) IS NOT NULL THEN 0.92::double ELSE 0.88::double END END FROM m WHERE named GROUP BY ref_id), b AS (SELECT ref_id, arg_min(row(rung, target, c), row(target IS NULL, rung)) AS x FROM r GROUP BY ref_id)
    SELECT l.ref_id, CASE WHEN x IS NULL THEN 'gone' WHEN x[2] IS NULL THEN 'ambiguous' ELSE 'found' END AS state, x[2] AS target, cast(x[3] AS double) AS confidence FROM lost l LEFT JOIN b USING (ref_id)""", ("chain",))
def _(v: Views):
    k = F.col("p_partkey")
    text = lambda a, n: F.concat(a, (k % n).cast("string"))
    lost = v.part.select(k.alias("ref_id"), F.when(k % 2 == 0, "struct").otherwise("function").alias("kind"), text(F.col("p_name"), 30).alias("name"), F.when(k % 3 > 0, text(F.lit("h"), 70)).alias("recorded_hash"))
    nodes = v.part.select(k.alias("id"), F.when(k % 2 == 0, "class").otherwise("method").alias("kind"), text(F.col("p_name"), 50).alias("name"), text(F.lit("h"), 110).alias("body_hash"))
    none = v._spark.createDataFrame([], "ref_id long, target long, score double")
    return D.relocation_ladder(lost, nodes, none).select("ref_id", "state", "target", "confidence")


@query("dr_19_stale_content", """SELECT path, age_days, source FROM (SELECT 'doc/' || o_orderkey AS path, CASE WHEN o_orderkey % 4 = 0 THEN 'last_updated' ELSE 'mtime' END AS source, cast(CASE WHEN o_orderkey % 4 = 0 THEN greatest(date_diff('day', cast(o_orderdate AS date), date '1998-01-01'), 0) ELSE floor((epoch(timestamp '1998-01-01') - epoch(o_orderdate)) / 86400) END AS bigint) AS age_days FROM orders) WHERE age_days > 1200""")
def _(v: Views):
    own = F.when(F.col("o_orderkey") % 4 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(F.col("o_orderkey") % 4 == 1, "soon")
    files = v.orders.select(F.concat(F.lit("doc/"), "o_orderkey").alias("path"), own.alias("last_updated"), F.col("o_orderdate").alias("modified"))
    return D.stale_content(files, F.lit("1998-01-01").cast("timestamp"), 1200)


@query("dr_19_cleanup", """SELECT path, reason, age_minutes FROM (SELECT path, CASE WHEN path LIKE 'graph.db%' THEN NULL WHEN path LIKE '%.tmp' THEN 'temporary' WHEN path LIKE 'local/%.lock' THEN 'lock' END AS reason, cast(floor((epoch(timestamp '2024-01-20') - floor(epoch(ts))) / 60) AS bigint) AS age_minutes FROM (
    SELECT ts, CASE event_id % 5 WHEN 0 THEN 'a/x' || event_id || '.tmp' WHEN 1 THEN 'local/y' || event_id || '.lock' WHEN 2 THEN 'graph.db/z' || event_id || '.tmp' WHEN 3 THEN 'b/y' || event_id || '.lock' ELSE 'doc.md' END AS path FROM events)) WHERE reason IS NOT NULL AND age_minutes >= 60""")
def _(v: Views):
    i = F.col("event_id")
    name = lambda a, b: F.concat(F.lit(a), i, F.lit(b))
    path = F.when(i % 5 == 0, name("a/x", ".tmp")).when(i % 5 == 1, name("local/y", ".lock")).when(i % 5 == 2, name("graph.db/z", ".tmp")).when(i % 5 == 3, name("b/y", ".lock")).otherwise("doc.md")
    return D.cleanup_candidates(v.events.select(path.alias("path"), F.col("ts").alias("modified")), F.lit("2024-01-20").cast("timestamp"))


ISSUES = "SELECT CASE WHEN p_partkey % 9 = 0 THEN 'POPULATION_PENDING' WHEN p_partkey % 9 = 1 THEN 'GROUNDING_MOVED_BY_NEIGHBORS' WHEN p_partkey % 9 = 2 THEN 'todo' ELSE 'stale' END AS code, CASE p_partkey % 7 WHEN 0 THEN 'error' WHEN 1 THEN 'warning' ELSE 'info' END AS severity, p_brand AS file FROM part"


def _issues(v: Views):
    k = F.col("p_partkey")
    return v.part.select(F.when(k % 9 == 0, "POPULATION_PENDING").when(k % 9 == 1, "GROUNDING_MOVED_BY_NEIGHBORS").when(k % 9 == 2, "todo").otherwise("stale").alias("code"), F.when(k % 7 == 0, "error").when(k % 7 == 1, "warning").otherwise("info").alias("severity"), F.col("p_brand").alias("file"))


@query("agg_13_drift_score", f"SELECT cast(greatest(0, least(100, 100 - sum(CASE WHEN code IN ('POPULATION_PENDING', 'GROUNDING_MOVED_BY_NEIGHBORS') THEN 0 WHEN severity = 'error' THEN 10 WHEN severity = 'warning' THEN 3 ELSE 1 END))) AS bigint) AS score, count(*) FILTER (severity = 'error') AS n_error, count(*) FILTER (severity = 'warning') AS n_warning, count(*) FILTER (severity = 'info') AS n_info FROM ({ISSUES})")
def _(v: Views):
    return D.score(_issues(v))


@query("dr_17_repair_targets", f"SELECT file, count(*) AS n, arg_max(severity, CASE severity WHEN 'error' THEN 2 WHEN 'warning' THEN 1 ELSE 0 END) AS worst, string_agg(DISTINCT code, ',' ORDER BY code) AS codes FROM ({ISSUES}) GROUP BY file")
def _(v: Views):
    return D.repair_targets(_issues(v))


@query("x_18_rewritten_anchors", """SELECT p_partkey, CASE WHEN p_size < 10 THEN 'see part:' || (p_size + 100) || '.' ELSE 'see part:' || p_size || '.' END AS text FROM part""")
def _(v: Views):
    docs = v.part.select("p_partkey", F.concat(F.lit("see part:"), F.col("p_size").cast("string"), F.lit(".")).alias("text"))
    mapping = v._spark.createDataFrame([(f"part:{i}", f"part:{i + 100}") for i in range(1, 10)], "old string, new string")
    return D.rewrite_anchors(docs, "p_partkey", "text", mapping, r"part:\d+")
