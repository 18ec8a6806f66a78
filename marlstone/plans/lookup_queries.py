"""Sources, staleness, bound pages, baselines, stored relations and index states."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from marlstone.operators import baselines as B
from marlstone.operators import lookup as L
from marlstone.plans import datalog
from marlstone.plans.registry import query
from marlstone.plans.views import Views
from marlstone.sources.relations import Relations
from marlstone.work import shared_dir

# Every document is a file of lines with one declaration in it; every seventh has changed since it was recorded.
FILE = """SELECT doc_id, 'doc/' || doc_id AS path, text AS content, string_split(regexp_replace(text, '\n$', ''), chr(10)) AS lines, CASE WHEN doc_id % 7 = 0 THEN 'old' ELSE sha256(text) END AS recorded_hash FROM documents"""
SOURCE = f"""SELECT 'n' || doc_id AS id, CASE WHEN has THEN CASE WHEN a <= cap THEN array_to_string(lines[a:cap], chr(10)) ELSE '' END END AS source, cast(CASE WHEN has THEN a ELSE s END AS bigint) AS source_start, cast(CASE WHEN has THEN cap ELSE e END AS bigint) AS source_end,
    has AND cap < upto AS truncated, has AND recorded_hash <> sha256(content) AS stale FROM (SELECT *, least(a + 1, upto) AS cap FROM (SELECT *, s > 0 AS has, least(greatest(s, 1), greatest(n, 1)) AS a, least(greatest(e, s), n) AS upto
    FROM (SELECT *, doc_id % 5 AS s, doc_id % 5 + doc_id % 4 AS e, CASE WHEN content = '' THEN 0 ELSE len(lines) END AS n FROM ({FILE}))))"""


def _files(v: Views):
    d = v.documents
    recorded = F.when(F.col("doc_id") % 7 == 0, "old").otherwise(F.sha2("text", 256))
    return d.select(F.concat(F.lit("doc/"), "doc_id").alias("path"), F.col("text").alias("content"), recorded.alias("recorded_hash"))


def _declared(v: Views):
    i = F.col("doc_id")
    return v.documents.select(F.concat(F.lit("n"), "doc_id").alias("id"), F.lit("function").alias("kind"), F.concat(F.lit("doc/"), "doc_id").alias("file_path"), F.concat(F.lit("f"), "doc_id").alias("qualified_name"), (i % 5).alias("start_line"), (i % 5 + i % 4).alias("end_line"))


@query("x_1_get_source", SOURCE)
def _(v: Views):
    i = F.col("doc_id")
    wanted = v.documents.select(F.when(i % 2 == 0, F.concat(F.lit("n"), "doc_id")).otherwise(F.concat(F.lit("function:doc/"), "doc_id", F.lit(":f"), "doc_id")).alias("ref"))
    return L.get(_declared(v), wanted, _files(v), 2).select("id", "source", "source_start", "source_end", "truncated", "stale")


@query("x_7_staleness", """SELECT 'doc/' || doc_id AS path, doc_id % 7 = 0 OR doc_id % 11 = 0 OR doc_id % 13 = 0 AS stale FROM documents WHERE NOT (doc_id % 11 = 0 AND doc_id % 13 = 0)""")
def _(v: Views):
    files = _files(v).withColumn("i", F.substring("path", 5, 20).cast("long"))
    return L.staleness(files.filter("i % 11 <> 0").select("path", F.col("recorded_hash").alias("content_hash")), files.filter("i % 13 <> 0").select("path", "content"))


PAGED = "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey"


@query("page_3_bound_page", f"""SELECT o_orderkey, o_totalprice, place FROM (SELECT *, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 12 AS place FROM ({PAGED}) LIMIT 24) WHERE place > 0""")
def _(v: Views):
    rows = v.orders.filter("o_orderstatus = 'F'").select("o_orderkey", "o_totalprice")
    order = [F.desc("o_totalprice"), "o_orderkey"]
    request = L.Request("list", ("F",), "r1")
    _, cursor = L.bounded_page(rows, order, request, 12)
    page, _ = L.bounded_page(rows, order, request, 12, cursor=cursor)
    return page.drop("estimated_tokens")


@query("page_3_token_budget", """SELECT doc_id, place, cast(running AS bigint) AS estimated_tokens FROM (SELECT *, sum(ceil(length('{"doc_id":' || doc_id || ',"n_chars":' || n_chars || '}') / 4)) OVER (ORDER BY n_chars DESC, doc_id) AS running, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS place FROM documents) WHERE place <= 40 AND (place = 1 OR running <= 150)""")
def _(v: Views):
    page, _ = L.bounded_page(v.documents.select("doc_id", "n_chars"), [F.desc("n_chars"), "doc_id"], L.Request("search", (), "r1"), 40, 150)
    return page.select("doc_id", "place", "estimated_tokens")


@query("wk_7_link_pages", """SELECT source_id, target_id, place, total, total > 4 AS truncated, CASE WHEN total > 4 THEN 4 END AS next_offset FROM (SELECT entity_id AS source_id, node_id AS target_id, row_number() OVER (PARTITION BY node_id ORDER BY entity_id) AS place, count(*) OVER (PARTITION BY node_id) AS total FROM groundings WHERE ordinal = 0) WHERE place > 2 AND place <= 4""", ("groundings",))
def _(v: Views):
    links = v.groundings.filter("ordinal = 0").select(F.col("entity_id").alias("source_id"), F.col("node_id").alias("target_id"))
    return L.link_page(links, "target_id", ["source_id"], 2, 2)


@query("x_10_grounding_rows", "SELECT entity_id, node_id, ordinal, health FROM groundings WHERE entity_id % 50 = 3", ("groundings",))
def _(v: Views):
    return L.grounding_rows(v.groundings, v.documents.filter("doc_id % 50 = 3").select(F.col("doc_id").alias("entity_id")))


@query("x_11_diagnostics", """SELECT *, count(*) OVER () > 30 AS truncated FROM (SELECT CASE WHEN doc_id % 3 = 0 THEN 'error' ELSE 'info' END AS severity, 'C' || (doc_id % 4) AS code, doc_id AS entity, 'docs/' || source || '/' || lang AS file, 'm' AS message FROM documents)
    WHERE file LIKE 'docs/src1/%' OR file = 'docs/src2/de' OR file LIKE 'docs/src2/de/%' ORDER BY severity, file, code, entity, message LIMIT 30""")
def _(v: Views):
    i = F.col("doc_id")
    found = v.documents.select(F.when(i % 3 == 0, "error").otherwise("info").alias("severity"), F.concat(F.lit("C"), i % 4).alias("code"), i.alias("entity"), F.concat_ws("/", F.lit("docs"), "source", "lang").alias("file"), F.lit("m").alias("message"))
    return L.diagnostics(found, paths=("docs/src1", "docs/src2/de"), limit=30)


@query("x_20_activity_page", "SELECT event_id, event_type, place FROM (SELECT *, row_number() OVER (ORDER BY ts DESC, event_id DESC) - 25 AS place FROM events WHERE ts >= timestamp '2024-01-20') WHERE place BETWEEN 1 AND 25")
def _(v: Views):
    rows = v.events.filter(F.col("ts") >= F.lit("2024-01-20").cast("timestamp")).select("event_id", "event_type", "ts")
    order, request = [F.desc("ts"), F.desc("event_id")], L.Request("activity", ("since=2024-01-20",), "r1")
    _, cursor = L.bounded_page(rows, order, request, 25)
    return L.bounded_page(rows, order, request, 25, cursor=cursor)[0].select("event_id", "event_type", "place")


@query("x_21_listing_page", "SELECT c_custkey, c_mktsegment, row_number() OVER (ORDER BY c_custkey) AS place FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY c_custkey LIMIT 20")
def _(v: Views):
    rows = v.customer.filter("c_mktsegment = 'BUILDING'").select("c_custkey", "c_mktsegment")
    return L.bounded_page(rows, ["c_custkey"], L.Request("members", ("BUILDING",), "r1"), 20)[0].drop("estimated_tokens")


@query("x_22_spec_rollup", """SELECT spec, health, count(*) AS n FROM (SELECT doc_id AS spec, doc_id AS entity_id FROM documents WHERE doc_id % 20 = 0 UNION SELECT doc_id - doc_id % 20, doc_id FROM documents WHERE doc_id % 3 = 1) JOIN groundings USING (entity_id) GROUP BY ALL""", ("groundings",))
def _(v: Views):
    i = F.col("doc_id")
    specs = v.documents.filter("doc_id % 20 = 0").select(i.alias("spec"))
    members = v.documents.filter("doc_id % 3 = 1").select((i - i % 20).alias("spec"), i.alias("entity_id"))
    return L.spec_rollup(specs, members, v.groundings)


@query("x_24_explained", """SELECT id, string_agg(channel || ' #' || rank, ', ' ORDER BY rank, channel) AS why FROM (SELECT 'part:' || p_partkey AS id, 'text' AS channel, p_size AS rank FROM part WHERE p_size < 9 UNION ALL SELECT 'part:' || p_partkey, 'vector', p_partkey % 7 + 1 FROM part WHERE p_partkey % 3 = 0) WHERE id IN (SELECT id FROM g_nodes) GROUP BY id""", ("g_nodes",))
def _(v: Views):
    key = F.concat(F.lit("part:"), "p_partkey").alias("id")
    evidence = v.part.filter("p_size < 9").select(key, F.lit("text").alias("channel"), F.col("p_size").cast("long").alias("rank")).unionByName(v.part.filter("p_partkey % 3 = 0").select(key, F.lit("vector").alias("channel"), (F.col("p_partkey") % 7 + 1).alias("rank")))
    return L.explained(v.g_nodes.select("id"), evidence)


@query("x_12_whole_entities", """SELECT position, id, type, title, matched FROM (SELECT e.*, count(*) OVER (PARTITION BY e.position) AS n, matched FROM entities e JOIN (SELECT entity_id AS position, count(DISTINCT node_id) AS matched FROM groundings WHERE node_id IN ('supplier:3', 'part:39') GROUP BY 1) USING (position)) WHERE status <> 'archived'""", ("entities", "groundings"))
def _(v: Views):
    from marlstone.operators import structural as S

    wanted = v._spark.createDataFrame([("supplier:3",), ("part:39",)], "node_id string")
    visible = v.entities.filter("status <> 'archived'")
    found = S.for_code(v.groundings, visible.select(F.col("position").alias("entity_id")), wanted, F.lit(0))
    return visible.join(found, F.col("position") == F.col("entity_id")).select("position", "id", "type", "title", "matched")


@query("x_27_relocated_refs", """SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'function' WHEN p_partkey % 3 = 1 THEN 'method' ELSE 'class' END || ':brand/' || p_brand || ':' || p_name AS ref FROM part""")
def _(v: Views):
    from marlstone.functions import text as T

    k = F.col("p_partkey")
    old = F.when(k % 3 == 0, "function:old.rs:f").when(k % 3 == 1, "struct:old.rs:f").otherwise("deadbeef")
    kind = F.when(k % 3 == 0, "method").when(k % 3 == 1, "method").otherwise("class")
    return v.part.select("p_partkey", T.relocated_ref(old, kind, F.concat(F.lit("brand/"), "p_brand"), F.col("p_name")).alias("ref"))


@query("x_28_event_arguments", r"""SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'note' WHEN 1 THEN 'todo' WHEN 2 THEN NULL WHEN 3 THEN NULL ELSE 'risk' END AS kind, CASE event_id % 4 WHEN 0 THEN 'src/a' || event_id || '.py' WHEN 1 THEN 'b.py' WHEN 2 THEN '.' ELSE '../up/' || user_id END AS file FROM events""")
def _(v: Views):
    from marlstone.sources import logs

    i = F.col("event_id")
    kind = F.when(i % 5 == 0, " Note ").when(i % 5 == 1, "TODO").when(i % 5 == 2, "milestone").when(i % 5 == 3, F.lit("note" + " " * 20)).otherwise("risk")
    file = F.when(i % 4 == 0, F.concat(F.lit(".\\src\\x\\..\\a"), i, F.lit(".py"))).when(i % 4 == 1, "./a/../b.py").when(i % 4 == 2, "./").otherwise(F.concat(F.lit("a/../../up/"), "user_id"))
    return v.events.select("event_id", logs.normal_kind(kind).alias("kind"), logs.normal_file(file).alias("file"))


@query("src_12_json_documents", "SELECT event_id AS id, event_type AS kind, value FROM events WHERE event_id % 200 = 0 AND event_id % 600 <> 0")
def _(v: Views):
    from marlstone.sources import logs

    path = f"{shared_dir(v._spark)}/records-{uuid.uuid4().hex}"
    few = v.events.filter("event_id % 200 = 0").select(F.when(F.col("event_id") % 600 == 0, F.lit("{broken")).otherwise(F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("kind"), "value"))).alias("text"), F.pmod(F.xxhash64("event_id"), F.lit(1 << 40)).alias("part"))
    few.write.partitionBy("part").text(path)  # a file a record
    return logs.read_documents(v._spark, f"{path}/*", "id long, kind string, value double")


REFERENCE = "SELECT doc_id AS doc, 'r' || (doc_id % 40) AS ref FROM documents"
BASELINE = f"""base AS (SELECT DISTINCT doc, d.ref, CASE WHEN p_partkey % 3 = 0 THEN 'h' || p_partkey ELSE sha256(p_name) END AS body_hash, 'part:' || p_partkey AS fingerprint FROM ({REFERENCE}) d JOIN part ON 'r' || p_partkey = d.ref)"""


def _captured(v: Views):
    k = F.col("p_partkey")
    nodes = v.part.select(F.concat(F.lit("part:"), k).alias("id"), F.concat(F.lit("r"), k).alias("ref"), F.col("p_name").alias("body"), F.when(k % 3 == 0, F.concat(F.lit("h"), k)).alias("body_hash"))
    return B.capture(v.documents.select(F.col("doc_id").alias("doc"), F.concat(F.lit("r"), F.col("doc_id") % 40).alias("ref")), nodes, v.g_edges)


@query("x_8_capture", f"""SELECT doc, ref, body_hash, fingerprint, coalesce(array_to_string(near, ','), '') AS neighbours FROM (SELECT DISTINCT doc, d.ref, CASE WHEN p_partkey % 3 = 0 THEN 'h' || p_partkey ELSE sha256(p_name) END AS body_hash, 'part:' || p_partkey AS fingerprint FROM ({REFERENCE}) d JOIN part ON 'r' || p_partkey = d.ref)
    LEFT JOIN (SELECT fingerprint, list_sort(list(DISTINCT near)) AS near FROM (SELECT source AS fingerprint, target AS near FROM g_edges WHERE kind = 'calls' UNION ALL SELECT target, source FROM g_edges WHERE kind = 'calls') WHERE fingerprint LIKE 'part:%' GROUP BY fingerprint) USING (fingerprint)""", ("g_edges",))
def _(v: Views):
    return _captured(v).withColumn("neighbours", F.array_join("neighbours", ","))


@query("x_9_moved_baselines", f"""WITH {BASELINE} SELECT doc, CASE WHEN ref IN ('r1', 'r2') THEN 'moved:' || ref ELSE ref END AS ref, body_hash, CASE WHEN ref IN ('r1', 'r2') THEN 'new' ELSE fingerprint END AS fingerprint FROM base""")
def _(v: Views):
    held = _captured(v)
    moves = held.filter("ref in ('r1', 'r2')").select("doc", F.col("ref").alias("old_ref"), F.concat(F.lit("moved:"), "ref").alias("new_ref"), F.lit("new").alias("new_id"))
    return B.move(held, moves).select("doc", "ref", "body_hash", "fingerprint")


@query("x_17_fresh_symbols", """SELECT p_partkey AS ref_id, CASE WHEN file_change IN ('deleted', 'unparsed') OR reason IS NOT NULL OR p_partkey % 6 = 5 THEN 'unverified' WHEN now = recorded THEN 'fresh' ELSE 'changed' END AS state, CASE WHEN file_change IN ('deleted', 'unparsed') THEN file_change ELSE reason END AS reason FROM (
    SELECT *, CASE WHEN p_partkey % 6 = 5 THEN NULL WHEN p_partkey % 6 = 4 THEN 'other' ELSE sha256(p_name) END AS recorded, CASE WHEN file_change = 'edited' THEN CASE WHEN p_partkey % 10 = 0 THEN sha256(p_name || ' new') ELSE sha256(p_name) END ELSE sha256(p_name) END AS now,
        CASE WHEN file_change = 'edited' AND p_partkey % 10 = 1 THEN 'moved' WHEN file_change IS NULL AND p_partkey % 9 = 0 THEN 'moved' WHEN file_change IS NULL AND p_partkey % 9 = 1 THEN 'several' END AS reason FROM (
        SELECT *, CASE p_size % 4 WHEN 0 THEN 'edited' WHEN 1 THEN CASE WHEN p_size % 8 = 1 THEN 'deleted' ELSE 'unparsed' END END AS file_change FROM part))""")
def _(v: Views):
    k = F.col("p_partkey")
    path = F.concat(F.lit("f"), F.col("p_size"))
    name = F.concat(F.lit("T.m"), k)
    refs = v.part.select(k.alias("ref_id"), F.lit("function").alias("kind"), path.alias("path"), name.alias("name"), F.when(k % 6 == 5, None).when(k % 6 == 4, "other").otherwise(F.sha2("p_name", 256)).alias("recorded_hash"))
    indexed = v.part.select(k.alias("ref_id"), F.when(k % 9 == 0, "Missing").when(k % 9 == 1, "Ambiguous").otherwise("Resolved").alias("state"), F.sha2("p_name", 256).alias("body_hash"))
    size = F.col("p_size")
    changes = v.part.select(path.alias("path"), F.when(size % 4 == 0, "edited").when(size % 8 == 1, "deleted").when(size % 4 == 1, "unparsed").alias("change")).filter("change is not null").distinct()
    symbols = v.part.filter(k % 10 != 1).select(path.alias("path"), F.lit("method").alias("kind"), F.concat(F.lit("m"), k).alias("name"), F.concat(F.lit("T::m"), k).alias("qualified_name"), F.lit("T").alias("container"), F.when(k % 10 == 0, F.concat("p_name", F.lit("  new"))).otherwise(F.col("p_name")).alias("body"))
    return B.check_with_changes(refs, indexed, changes, symbols)


FOUND = "SELECT 'doc/' || doc_id AS path, sha256(text) AS now FROM documents WHERE doc_id % 13 <> 0"
STATUS = f"""SELECT count(*) FILTER (was IS NULL) AS added, count(*) FILTER (was <> now) AS changed, count(*) FILTER (now IS NULL) AS removed FROM ({FOUND}) FULL JOIN (SELECT 'doc/' || doc_id AS path, CASE WHEN doc_id % 7 = 0 THEN 'old' ELSE sha256(text) END AS was FROM documents WHERE doc_id % 11 <> 0) USING (path)"""


def _status(v: Views):
    files = _files(v).withColumn("i", F.substring("path", 5, 20).cast("long"))
    return L.status(files.filter("i % 13 <> 0").select("path", F.sha2("content", 256).alias("hash")), files.filter("i % 11 <> 0").select("path", F.col("recorded_hash").alias("hash")), {"files": 10_000_000})


@query("x_6_index_status", f"SELECT added, changed, removed, 'stale' AS state, 'refresh' AS job, false AS limit_exceeded FROM ({STATUS})")
def _(v: Views):
    return _status(v)


@query("x_16_health_report", f"SELECT 'wiki' AS part, 'stale' AS state, 'refresh' AS job, added + changed + removed AS changes FROM ({STATUS}) UNION ALL SELECT 'graph', 'fresh', NULL, 0 UNION ALL SELECT 'vectors', 'missing', 'rebuild', count(*) FROM embeddings")
def _(v: Views):
    same = v.part.select(F.col("p_partkey").cast("string").alias("path"), F.sha2("p_name", 256).alias("hash"))
    vectors = v.embeddings.select(F.col("vec_id").cast("string").alias("path"), F.lit("x").alias("hash"))
    return L.health_report({"wiki": _status(v), "graph": L.status(same, same), "vectors": L.status(vectors, vectors.limit(0))})


@query("wk_13_index_states", """SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'missing' WHEN o_orderkey % 7 = 0 THEN 'corrupt' WHEN o_orderkey % 5 = 0 THEN 'rebuild_required' WHEN o_orderkey % 5 = 1 THEN 'migration_required' WHEN o_totalprice > 200000 THEN 'stale' WHEN o_orderpriority LIKE '1%' THEN 'degraded' ELSE 'fresh' END AS state FROM orders""")
def _(v: Views):
    k = F.col("o_orderkey")
    state = L.index_state(k % 7 != 0, k % 5, 2, 1, F.col("o_totalprice") > 200_000, F.col("o_orderpriority").like("1%").cast("int"), k % 11 != 0)
    return v.orders.select("o_orderkey", state.alias("state"))


@query("fts_5_integrity", """SELECT doc_id AS doc, 'lost' AS problem FROM documents WHERE doc_id % 10 = 0 AND regexp_matches(lower(text), '(^|[^a-z0-9à-ÿ])the($|[^a-z0-9à-ÿ])') UNION ALL SELECT doc_id, 'extra' FROM documents WHERE doc_id % 25 = 1""")
def _(v: Views):
    from marlstone.functions import text as T

    whole = v.documents.select(F.col("doc_id").alias("doc"), F.explode(F.array_distinct(T.words(F.coalesce("text", F.lit(""))))).alias("term"))
    stored = whole.filter("not (doc % 10 = 0 and term = 'the')").union(v.documents.filter("doc_id % 25 = 1").select("doc_id", F.lit("zzzznever")))
    return L.posting_integrity(v.documents, "doc_id", "text", stored)


def _store(v: Views) -> Relations:
    return Relations(v._spark, f"{shared_dir(v._spark)}/relations-{uuid.uuid4().hex}")


@query("snk_5_keyed_upsert", """SELECT p_partkey AS id, CASE WHEN p_partkey % 5 = 0 THEN 'new' ELSE p_name END AS name FROM part WHERE p_partkey % 3 <> 0 OR p_partkey % 5 = 0""")
def _(v: Views):
    store = _store(v)
    store.create("items", "id long, name string")
    rows = v.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    store.put("items", rows, ["id"])
    store.remove("items", rows.filter("id % 3 = 0"), ["id"])
    changed = rows.filter("id % 5 = 0").withColumn("name", F.lit("new"))
    store.put("items", changed.unionByName(changed.withColumn("name", F.lit("a"))), ["id"])
    return store.table("items")


@query("dl_4_relations", "SELECT * FROM (VALUES ('items', 'id', 'bigint'), ('items', 'name', 'string'), ('pairs', 'a', 'bigint'), ('pairs', 'b', 'bigint')) t(relation, name, type)")
def _(v: Views):
    store = _store(v)
    store.create("items", "id long, name string")
    store.create("pairs", "a long, b long")
    store.create("gone", "a long")
    store.drop("gone")
    store.put("pairs", v.part.select(F.col("p_partkey").alias("a"), F.col("p_size").alias("b")), ["a"])
    return v._spark.createDataFrame([(n, c, t) for n in store.names() for c, t in store.columns(n).items()], "relation string, name string, type string")


@query("dl_5_put_and_remove", """SELECT DISTINCT l_partkey AS part, l_suppkey AS supplier FROM lineitem WHERE l_quantity >= 30 AND l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_nationkey = 3)""")
def _(v: Views):
    store = _store(v)
    store.create("offers", "part long, supplier long")
    tables = {"lineitem": v.lineitem, "supplier": v.supplier}
    datalog.run_mutable("?(part, supplier) :- lineitem(l_partkey: part, l_suppkey: supplier, l_quantity: q), q >= $least. :put offers part, supplier", store, {"least": 30.0}, tables)
    datalog.run_mutable("?(supplier) :- supplier(s_suppkey: supplier, s_nationkey: 3). :rm offers supplier", store, {}, tables)
    return store.table("offers")


NEAR = "(SELECT vec_id, list_cosine_similarity(embedding::double[], (SELECT embedding FROM embeddings WHERE vec_id = 7)::double[]) AS s, label FROM embeddings ORDER BY s DESC, vec_id LIMIT 30)"


@query("join_20_nearest_in_rules", f"SELECT vec_id AS id, n_name AS nation, round(s, 6) AS similarity FROM {NEAR} JOIN nation ON n_nationkey = label")
def _(v: Views):
    asked = [float(x) for x in v.embeddings.filter("vec_id = 7").first()["embedding"]]
    out = datalog.run(
        """vectors(id, vector) :- embeddings(vec_id: id, embedding: vector).
        near(id, similarity) <~ Nearest(vectors, $asked, 30).
        ?(id, nation, similarity) :- near(id, similarity), embeddings(vec_id: id, label: key), nation(n_nationkey: key, n_name: nation).""",
        {"embeddings": v.embeddings, "nation": v.nation},
        {"asked": asked},
    )
    return out.withColumn("similarity", F.round("similarity", 6))
