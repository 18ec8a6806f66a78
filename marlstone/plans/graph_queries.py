"""Graph algorithms over the stand-in graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.operators import flows as FL
from marlstone.operators import graph as G
from marlstone.plans.registry import query
from marlstone.plans.views import Views


def _ids(v: Views, *ids: str):
    return v._spark.createDataFrame([(i,) for i in ids], "id string")


@query("gr_1_impact", """, reach(id, root, depth) AS (SELECT 'nation:3', 'nation:3', 0 UNION SELECT 'nation:5', 'nation:5', 0 UNION SELECT e.source, r.root, r.depth + 1 FROM reach r JOIN g_edges e ON e.target = r.id WHERE e.kind NOT IN ('contains', 'exports') AND r.depth < 2)
    SELECT id, cast(min(depth) AS int) AS depth, arg_min(root, row(depth, root)) AS root FROM reach GROUP BY id ORDER BY depth, id LIMIT 500""", ("g_edges",))
def _(v: Views):
    return G.impact(v.g_edges, _ids(v, "nation:3", "nation:5"), 2).select("id", "depth", "root")


@query("gr_2_impact_groundings", """, reach(id, depth) AS (SELECT 'supplier:3', 0 UNION SELECT e.source, r.depth + 1 FROM reach r JOIN g_edges e ON e.target = r.id WHERE e.kind NOT IN ('contains', 'exports') AND r.depth < 1),
    hit AS (SELECT id, min(depth) AS depth FROM reach GROUP BY id ORDER BY depth, id LIMIT 500) SELECT g.entity_id, cast(min(h.depth) AS int) AS depth FROM hit h JOIN groundings g ON g.node_id = h.id GROUP BY 1""", ("g_edges", "groundings"))
def _(v: Views):
    hit = G.impact(v.g_edges, _ids(v, "supplier:3"), 1)
    return v.groundings.join(hit, F.col("node_id") == F.col("id")).groupBy("entity_id").agg(F.min("depth").alias("depth"))


def _pagerank_sql(rounds: int) -> str:
    ctes = ["links AS MATERIALIZED (SELECT src, dst FROM g_links)", "ids AS MATERIALIZED (SELECT src AS id FROM links UNION SELECT dst FROM links)", "deg AS MATERIALIZED (SELECT src, count(*) AS o FROM links GROUP BY src)",
            "r0 AS MATERIALIZED (SELECT id, 1.0::double / (SELECT count(*) FROM ids) AS rank FROM ids)"]
    for i in range(rounds):
        ctes.append(f"""r{i + 1} AS MATERIALIZED (SELECT ids.id, 0.15::double / (SELECT count(*) FROM ids) + 0.85 * (coalesce(c.came, 0) + (SELECT coalesce(sum(rank), 0) FROM r{i} WHERE id NOT IN (SELECT src FROM deg)) / (SELECT count(*) FROM ids)) AS rank
            FROM ids LEFT JOIN (SELECT l.dst, sum(r.rank / d.o) AS came FROM links l JOIN r{i} r ON r.id = l.src JOIN deg d ON d.src = l.src GROUP BY l.dst) c ON c.dst = ids.id)""")
    return ", " + ", ".join(ctes) + f" SELECT id, round(rank, 9) AS rank FROM r{rounds}"


@query("gr_3_pagerank", _pagerank_sql(20), ("g_links",))
def _(v: Views):
    return G.pagerank(v.g_links).select("id", F.round("rank", 9).alias("rank"))


PATH = """, links AS (SELECT src, dst FROM g_links), reach(id, depth) AS (SELECT 'order:7', 0 UNION SELECT l.dst, r.depth + 1 FROM reach r JOIN links l ON l.src = r.id WHERE r.depth < 4),
    level AS MATERIALIZED (SELECT id, min(depth) AS depth FROM reach GROUP BY id), back(id, depth) AS (SELECT id, depth FROM level WHERE id = 'region:2'
    UNION ALL SELECT (SELECT min(l.src) FROM links l JOIN level x ON x.id = l.src AND x.depth = b.depth - 1 WHERE l.dst = b.id), b.depth - 1 FROM back b WHERE b.depth > 0)
    SELECT cast(depth AS bigint) AS step, id FROM back"""


@query("gr_4_shortest_path", PATH, ("g_links",))
def _(v: Views):
    return G.shortest_path(v.g_links, "order:7", "region:2")


REL = ", rel AS (SELECT source_id AS src, target_id AS dst FROM relations), sym AS (SELECT src, dst FROM rel UNION SELECT dst, src FROM rel)"


def _relations(v: Views):
    return v.relations.select(F.col("source_id").cast("string").alias("src"), F.col("target_id").cast("string").alias("dst"))


@query("gr_5_neighbourhood", REL + """, live AS (SELECT position AS id FROM entities WHERE status <> 'archived'), reach(id, depth) AS (SELECT 4, 0 UNION SELECT 8, 0 UNION SELECT s.dst, r.depth + 1 FROM reach r JOIN sym s ON s.src = r.id WHERE r.depth < 2 AND s.dst IN (SELECT id FROM live))
    SELECT cast(id AS varchar) AS id, cast(min(depth) AS int) AS depth FROM reach GROUP BY id""", ("relations", "entities"))
def _(v: Views):
    live = v.entities.filter("status <> 'archived'").select(F.col("position").cast("string").alias("id"))
    return G.neighbourhood(_relations(v), _ids(v, "4", "8"), live, 2, 500)


@query("gr_6_graph_slice", REL + """, reach(id, depth) AS (SELECT 4, 0 UNION SELECT s.dst, r.depth + 1 FROM reach r JOIN sym s ON s.src = r.id WHERE r.depth < 3), got AS (SELECT DISTINCT id FROM reach)
    SELECT cast(src AS varchar) AS src, cast(dst AS varchar) AS dst FROM rel WHERE src IN (SELECT id FROM got) AND dst IN (SELECT id FROM got)""", ("relations",))
def _(v: Views):
    all_ids = v.documents.select(F.col("doc_id").cast("string").alias("id"))
    return G.slice_of(_relations(v), G.neighbourhood(_relations(v), _ids(v, "4"), all_ids, 3, 500))


@query("gr_7_backlinks", "SELECT source_id, target_id, type FROM (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY source_id, type) AS nth FROM relations) WHERE nth <= 200", ("relations",))
def _(v: Views):
    from marlstone.operators.ranking import ranked

    return ranked(v.relations, ["source_id", "type"], ["target_id"], 200).select("source_id", "target_id", "type")


CHAIN = [("spec", "derived_from", "requirement"), ("spec", "refines", "requirement"), ("decision", "refines", "spec")]


@query("gr_8_traceability", " UNION ALL ".join(f"SELECT DISTINCT {i} AS hop, e.position AS source, r.target_id AS target FROM entities e LEFT JOIN (SELECT * FROM relations JOIN entities t ON t.position = target_id AND t.type = '{b}' WHERE relations.type = '{k}') r ON r.source_id = e.position WHERE e.type = '{a}'" for i, (a, k, b) in enumerate(CHAIN)), ("entities", "relations"))
def _(v: Views):
    types = v.entities.select(F.col("position").alias("id"), "type")
    return G.trace_closure(v.relations.select(F.col("source_id").alias("source"), F.col("target_id").alias("target"), "type"), types, CHAIN)


@query("gr_9_hierarchy", """, reach(id, root) AS (SELECT target_id, target_id FROM relations WHERE type <> 'supersedes' UNION SELECT r.source_id, x.root FROM reach x JOIN relations r ON r.target_id = x.id AND r.type <> 'supersedes')
    SELECT cast(id AS varchar) AS id, count(*) AS roots FROM reach GROUP BY id""", ("relations",))
def _(v: Views):
    up = v.relations.filter("type <> 'supersedes'").select(F.col("target_id").cast("string").alias("src"), F.col("source_id").cast("string").alias("dst")).distinct()
    reach = up.select(F.col("src").alias("id"), F.col("src").alias("root")).distinct()
    reach = frontier = G.materialize(reach, "reach")
    while not frontier.isEmpty():  # one round for each level of the hierarchy
        step = frontier.withColumnRenamed("id", "src").join(up, "src").select(F.col("dst").alias("id"), "root").distinct()
        frontier = G.materialize(step.join(reach, ["id", "root"], "left_anti"), "frontier")
        reach = G.materialize(reach.unionByName(frontier), "reach")
    return reach.groupBy("id").agg(F.count(F.lit(1)).alias("roots"))


CLOSURE = ", nxt AS (SELECT id, supersedes AS next FROM chain WHERE supersedes IS NOT NULL), clo(a, b) AS (SELECT id, next FROM nxt UNION SELECT c.a, n.next FROM clo c JOIN nxt n ON n.id = c.b)"


@query("gr_10_cycles", CLOSURE + " SELECT a AS id, min(b) AS cycle, count(*) AS length FROM clo WHERE a IN (SELECT a FROM clo WHERE a = b) GROUP BY a", ("chain",))
def _(v: Views):
    return G.functional_cycles(v.chain.select("id", F.col("supersedes").alias("next"))).select("id", "cycle", "length")


@query("gr_11_supersession", """, walk(id, to_id, steps) AS (SELECT id, id, 0 FROM chain WHERE supersedes IS NULL UNION ALL SELECT c.id, w.to_id, w.steps + 1 FROM walk w JOIN chain c ON c.supersedes = w.id)
    SELECT id, to_id AS oldest, cast(steps AS bigint) AS ordinal, id NOT IN (SELECT supersedes FROM chain WHERE supersedes IS NOT NULL AND supersedes <> id) AS current FROM walk""", ("chain",))
def _(v: Views):
    return G.chain_ordinals(v.chain.select("id", F.col("supersedes").alias("next")))


@query("gr_12_mount_paths", """, up(id, parent, path) AS (SELECT id, container_id, '/' || name FROM g_nodes WHERE kind IN ('file', 'module', 'function') UNION ALL SELECT u.id, n.container_id, '/' || n.name || u.path FROM up u JOIN g_nodes n ON n.id = u.parent)
    SELECT id, path FROM up WHERE parent IS NULL""", ("g_nodes",))
def _(v: Views):
    parts = v.g_nodes.filter("kind in ('file', 'module', 'function')").select("id", F.col("container_id").alias("parent"), F.col("name").alias("prefix"))
    return G.mount_paths(parts)


@query("gr_13_alias_closure", """, nxt AS (SELECT id AS a, supersedes AS b FROM chain WHERE supersedes IS NOT NULL), clo(a, b, hops) AS (SELECT a, b, 1 FROM nxt UNION SELECT c.a, n.b, c.hops + 1 FROM clo c JOIN nxt n ON n.a = c.b WHERE c.hops < 4)
    SELECT a, b, cast(min(hops) AS int) AS hops FROM clo WHERE a <> b GROUP BY ALL""", ("chain",))
def _(v: Views):
    return G.hop_closure(v.chain.filter("supersedes is not null").select(F.col("id").alias("a"), F.col("supersedes").alias("b")), 4)


@query("gr_14_overrides", """WITH m AS (SELECT p_partkey AS member, p_name AS name, cast(substr(p_brand, 7) AS int) AS owner FROM part), c AS (SELECT owner, name, min(member) AS class_id, count(*) AS n FROM m GROUP BY ALL)
    SELECT member, c.class_id, b.class_id AS base_id, coalesce(b.n, 0) AS links FROM m JOIN c ON c.owner IS NOT DISTINCT FROM m.owner AND c.name IS NOT DISTINCT FROM m.name LEFT JOIN c b ON b.name = m.name AND m.owner > 1 AND b.owner = m.owner // 2""")
def _(v: Views):
    brand = F.substring("p_brand", 7, 9).cast("int")
    extends = v.part.select(brand.alias("sub")).distinct().filter("sub > 1").withColumn("base", F.floor(F.col("sub") / 2).cast("int"))
    return G.override_classes(extends, v.part.select(brand.alias("owner"), F.col("p_name").alias("name"), F.col("p_partkey").alias("id")))


@query("gr_15_trait_dispatch", """SELECT supplier AS type_id, name, min(member) AS member FROM (SELECT s_nationkey AS supplier, p_name AS name, p_partkey AS member FROM supplier JOIN part ON p_size = s_suppkey % 50 + 1) GROUP BY 1, 2 HAVING count(*) = 1""")
def _(v: Views):
    impls = v.supplier.join(v.part, F.col("p_size") == F.col("s_suppkey") % 50 + 1)
    unique = impls.groupBy(F.col("s_nationkey").alias("type_id"), F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("member"), F.count(F.lit(1)).alias("n"))
    return unique.filter("n = 1").drop("n")


@query("gr_16_reexports", """, walk(id, target, hops) AS (SELECT id, id, 0 FROM chain UNION ALL SELECT w.id, c.supersedes, hops + 1 FROM walk w JOIN chain c ON c.id = w.target WHERE c.supersedes IS NOT NULL AND hops < 8)
    SELECT id, arg_max(target, hops) AS target FROM walk GROUP BY id""", ("chain",))
def _(v: Views):
    return G.follow(v.chain.select("id", F.col("supersedes").alias("next")), 8)


NEAR = """, both_ways AS (SELECT src, dst, max(confidence) AS confidence FROM (SELECT source AS src, target AS dst, confidence FROM g_edges WHERE confidence >= 0.8 UNION ALL SELECT target, source, confidence FROM g_edges WHERE confidence >= 0.8) GROUP BY ALL),
    near AS MATERIALIZED (SELECT src, dst FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY confidence DESC, dst) AS nth FROM both_ways) WHERE nth <= 18)"""


@query("gr_17_gated_expansion", NEAR + """, h1 AS (SELECT DISTINCT dst AS id FROM near WHERE src IN ('part:7', 'order:5') AND dst NOT IN ('part:7', 'order:5')), h2 AS (SELECT DISTINCT dst AS id FROM near WHERE src IN (SELECT id FROM h1) AND dst NOT IN (SELECT id FROM h1) AND dst NOT IN ('part:7', 'order:5'))
    SELECT 'part:7' AS id, 0 AS hop UNION ALL SELECT 'order:5', 0 UNION ALL SELECT id, 1 FROM h1 UNION ALL SELECT id, 2 FROM h2""", ("g_edges",))
def _(v: Views):
    return G.gated_expansion(v.g_edges, _ids(v, "part:7", "order:5"))


@query("gr_18_paths", """, nxt AS (SELECT source, target FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY confidence DESC, target) AS nth FROM (SELECT source, target, max(confidence) AS confidence FROM g_edges WHERE confidence >= 0.8 GROUP BY ALL)) WHERE nth <= 8),
    walk(path, hops) AS (SELECT [source, target], 1 FROM nxt WHERE source IN ('order:1', 'order:2', 'order:3') AND source <> target UNION ALL SELECT list_append(path, n.target), hops + 1 FROM walk JOIN nxt n ON n.source = path[-1] WHERE hops < 7 AND NOT list_contains(path, n.target))
    SELECT array_to_string(path, '>') AS path, hops FROM walk""", ("g_edges",))
def _(v: Views):
    return G.path_expansion(v.g_edges, _ids(v, "order:1", "order:2", "order:3")).select(F.array_join("path", ">").alias("path"), "hops")


@query("gr_18_flows")
def _(v: Views):
    """Flows from eight orders; lines of orders are the call sites of the query, classes its relevant declarations."""
    kind = F.col("kind")
    edges = v.g_edges.withColumns({"rank": F.when(kind == "calls", F.col("line")), "weight": F.when(F.col("line") <= 3, 1.0).otherwise(0.25)})
    nodes = v.g_nodes.select("id", "file_path", "name", kind.isin("class", "module").alias("exported"), F.when(kind == "class", 1.0).when(kind == "method", 0.6).otherwise(0.1).alias("relevance"), (kind == "variable").alias("selected"), F.array("kind").alias("terms"))
    seeds = v._spark.createDataFrame([(f"order:{i}", i) for i in range(8)], "id string, place long")
    return FL.flows(edges, nodes, seeds, [("order:1", "part:5")], {"class": 2.0, "method": 1.0, "module": 0.5})


@query("agg_17_components", """, e AS (SELECT source_id AS a, target_id AS b FROM relations WHERE type = 'refines' AND source_id <> target_id), sym AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
    reach(id, r) AS (SELECT a, a FROM sym UNION SELECT s.b, x.r FROM reach x JOIN sym s ON s.a = x.id) SELECT id, min(r) AS component FROM reach GROUP BY id""", ("relations",))
def _(v: Views):
    links = v.relations.filter("type = 'refines'").select(F.col("source_id").alias("src"), F.col("target_id").alias("dst"))
    return G.components(links)


@query("dl_rules", """, reach(x, y) AS (SELECT source_id, target_id FROM relations WHERE type = 'refines' UNION SELECT r.x, e.target_id FROM reach r JOIN relations e ON e.source_id = r.y AND e.type = 'refines') SELECT x, count(y) AS n FROM reach WHERE x NOT IN (SELECT entity_id FROM groundings WHERE health = 'missing') GROUP BY x""", ("relations", "groundings"))
def _(v: Views):
    from marlstone.plans.datalog import run

    program = """
        edge(a, b) :- relations(source_id: a, target_id: b, type: 'refines').
        reach(a, b) :- edge(a, b).
        reach(a, c) :- reach(a, b), edge(b, c).
        bad(a) :- groundings(entity_id: a, health: 'missing').
        ?(x, count(y)) :- reach(x, y), not bad(x).
    """
    return run(program, {"relations": v.relations, "groundings": v.groundings}).toDF("x", "n")


@query("dl_filters_and_limits", "SELECT id, line FROM (SELECT n.id, e.line FROM g_edges e JOIN g_nodes n ON n.id = e.source WHERE e.kind = 'calls' AND e.line >= 4 AND n.file_path <> 'tests/5-LOW/0' UNION SELECT s.id, 0 FROM g_nodes s WHERE s.kind = 'method') ORDER BY line DESC, id LIMIT 40", ("g_nodes", "g_edges"))
def _(v: Views):
    from marlstone.plans.datalog import run

    program = """
        ?(id, line) :- g_edges(source: id, kind: 'calls', line: line), g_nodes(id: id, file_path: p), line >= $least, p != '5-LOW', p != 'tests/5-LOW/0'.
        ?(id, line) :- g_nodes(id: id, kind: 'method'), line = 0.
        :order -line, id
        :limit 40
    """
    return run(program, {"g_edges": v.g_edges, "g_nodes": v.g_nodes}, {"least": 4}).select("id", F.col("line").cast("long").alias("line"))
