"""Windows, top-k, budgets and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.operators import ranking as R
from marlstone.plans.registry import query
from marlstone.plans.views import Views


@query("win_1_shadowing", "SELECT position, id, row_number() OVER (PARTITION BY id ORDER BY file, position) > 1 AS shadowed FROM entities", ("entities",))
def _(v: Views):
    return R.first_claims(v.entities, "id", "file", "position").select("position", "id", "shadowed")


FUSED = """SELECT id, round(sum(w / (60 + rank)), 9) AS score, count(*) AS n FROM (
    SELECT o_orderkey AS id, 1.0 AS w, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders
    UNION ALL SELECT o_orderkey, 0.5, row_number() OVER (ORDER BY o_orderdate, o_orderkey) FROM orders) WHERE rank <= 200 GROUP BY id"""


@query("win_2_reciprocal_ranks", FUSED)
def _(v: Views):
    top = lambda by, channel, weight: v.orders.orderBy(*by).limit(200).select(F.lit(channel).alias("channel"), F.col("o_orderkey").alias("id"), F.lit(weight).alias("weight"), *by_columns)
    by_columns = ("o_totalprice", "o_orderdate", "o_orderkey")
    price = R.ranked(top([F.desc("o_totalprice"), "o_orderkey"], "price", 1.0), [F.desc("o_totalprice"), "o_orderkey"], ["channel"])
    date = R.ranked(top(["o_orderdate", "o_orderkey"], "date", 0.5), ["o_orderdate", "o_orderkey"], ["channel"])
    fused = R.fuse(price.unionByName(date).select("channel", "id", "rank", "weight"))
    return fused.select("id", F.round("score", 9).alias("score"), F.size("channels").cast("long").alias("n"))


@query("win_3_top_per_file", "SELECT p_brand, p_partkey, rank FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part) WHERE rank <= 3")
def _(v: Views):
    return R.ranked(v.part, [F.desc("p_retailprice"), "p_partkey"], ["p_brand"], 3).select("p_brand", "p_partkey", "rank")


@query("win_4_best_per_group", "SELECT c_nationkey, arg_max(c_custkey, row(c_acctbal, -c_custkey)) AS c_custkey FROM customer GROUP BY c_nationkey")
def _(v: Views):
    return v.customer.groupBy("c_nationkey").agg(F.max_by("c_custkey", F.struct("c_acctbal", -F.col("c_custkey"))).alias("c_custkey"))


PAIRS = "SELECT 1 AS grp, l_partkey AS a, l_suppkey AS b, sum(cast(l_quantity AS bigint)) AS score FROM lineitem GROUP BY ALL"


@query("win_5_capped_pairs")
def _(v: Views):
    pairs = v.lineitem.groupBy(F.lit(1).alias("grp"), F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b")).agg(F.sum(F.col("l_quantity").cast("long")).alias("score"))
    return R.capped_pairs(pairs, "score", 2, "grp")


@query("win_6_near_ties", """SELECT grp, id, score, max(CASE WHEN place = 1 THEN score - nxt END) OVER (PARTITION BY grp) AS runner_up_gap FROM (SELECT *, row_number() OVER w AS place, lead(score) OVER w AS nxt, max(score) OVER (PARTITION BY grp) AS best
    FROM (SELECT o_custkey AS grp, o_orderkey AS id, cast(round(o_totalprice * 100) AS bigint) AS score FROM orders) WINDOW w AS (PARTITION BY grp ORDER BY score DESC, id)) QUALIFY best - score < 800000""")
def _(v: Views):
    rows = v.orders.select(F.col("o_custkey").alias("grp"), F.col("o_orderkey").alias("id"), F.round(F.col("o_totalprice") * 100).cast("long").alias("score"))
    return R.near_ties(rows, "grp", "score", 800_000)


@query("win_7_budget_prefix", """SELECT source, doc_id, cast(running AS bigint) AS running_cost FROM (SELECT source, doc_id, sum(ceil(length(text) / 4)) OVER (PARTITION BY source ORDER BY doc_id) AS running FROM documents) WHERE running <= 4500""")
def _(v: Views):
    from marlstone.functions.text import token_estimate

    return R.within_budget(v.documents, token_estimate(F.col("text")), 4500, ["doc_id"], ["source"]).select("source", "doc_id", "running_cost")


def _in_turn(rows: str, group: str, key: str, cost: str, order: str, budget: int, most: int = 200) -> str:
    """Rows of a group one by one: what still fits is taken, the rest skipped."""
    return f"""WITH RECURSIVE src AS ({rows}), r AS (SELECT {group} AS g, {key} AS k, {cost} AS c, row_number() OVER (PARTITION BY {group} ORDER BY {order}) AS n FROM src),
    run AS (SELECT DISTINCT g, 0::bigint AS n, 0::bigint AS spent, NULL::bigint AS k, NULL::bigint AS c FROM r UNION ALL SELECT run.g, r.n, spent + CASE WHEN spent + r.c <= {budget} THEN r.c ELSE 0 END, CASE WHEN spent + r.c <= {budget} THEN r.k END, r.c FROM run JOIN r ON r.g = run.g AND r.n = run.n + 1 WHERE r.n <= {most})
    SELECT g AS {group}, k AS {key}, c AS {cost} FROM run WHERE k IS NOT NULL"""


@query("win_8_skip_to_fit", _in_turn("SELECT source, doc_id, n_chars FROM documents", "source", "doc_id", "n_chars", "doc_id", 20_000))
def _(v: Views):
    rows = v.documents.select("source", "doc_id", "n_chars")
    return R.skip_to_fit(rows, "n_chars", 20_000, ["doc_id"], "source").select("source", "doc_id", "n_chars")


@query("win_9_flow_budget", _in_turn("SELECT o_custkey, o_orderkey, count(*) AS steps FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL", "o_custkey", "o_orderkey", "steps", "o_orderkey", 8))
def _(v: Views):
    flows = v.orders.join(v.lineitem, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_custkey", "o_orderkey").agg(F.count(F.lit(1)).alias("steps"))
    return R.skip_to_fit(flows, "steps", 8, ["o_orderkey"], "o_custkey").select("o_custkey", "o_orderkey", "steps")


@query("top_1_total_order", "SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey LIMIT 100")
def _(v: Views):
    return v.lineitem.orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_partkey").limit(100).select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")


@query("top_5_truncation_flag", "SELECT kind, n > 100 AS truncated FROM (SELECT kind, count(*) AS n FROM g_nodes GROUP BY kind)", ("g_nodes",))
def _(v: Views):
    return R.ranked(v.g_nodes.select("kind", "id"), ["id"], ["kind"], 101).groupBy("kind").agg((F.count(F.lit(1)) > 100).alias("truncated"))


@query("page_1_offset_page", """SELECT o_orderkey, o_totalprice, total, total > 60 AS truncated, CASE WHEN total > 60 THEN 60 END AS next_offset FROM (SELECT *, count(*) OVER () AS total FROM orders WHERE o_orderstatus = 'F') ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40""")
def _(v: Views):
    return R.page(v.orders.filter("o_orderstatus = 'F'").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), "o_orderkey"], 40, 20)


@query("page_2_cursor_page", "SELECT s_suppkey, s_name, (SELECT count(*) FROM supplier) AS total FROM supplier ORDER BY s_name, s_suppkey LIMIT 4 OFFSET 4")
def _(v: Views):
    rows = v.supplier.select("s_suppkey", "s_name")
    _, cursor = R.cursor_page(rows, ["s_name", "s_suppkey"], ["s_suppkey", "s_name"], 4)
    return R.cursor_page(rows, ["s_name", "s_suppkey"], ["s_suppkey", "s_name"], 4, cursor)[0].select("s_suppkey", "s_name", "total")


@query("sc_19_merged_windows", """SELECT l_suppkey AS grp, island, min(f) AS first, max(l) AS last, count(*) AS merged FROM (SELECT *, cast(sum(new) OVER (PARTITION BY l_suppkey ORDER BY f, l DESC, k ROWS UNBOUNDED PRECEDING) AS bigint) AS island FROM (
    SELECT *, CASE WHEN coalesce(f > 10 + max(l) OVER (PARTITION BY l_suppkey ORDER BY f, l DESC, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) THEN 1 ELSE 0 END AS new
    FROM (SELECT l_suppkey, l_orderkey % 4000 AS f, l_orderkey % 4000 + l_linenumber AS l, row_number() OVER () AS k FROM lineitem WHERE l_linenumber = 4))) GROUP BY ALL""")
def _(v: Views):
    ranges = v.lineitem.filter("l_linenumber = 4").select(F.col("l_suppkey").alias("grp"), (F.col("l_orderkey") % 4000).alias("first"), (F.col("l_orderkey") % 4000 + F.col("l_linenumber")).alias("last"))
    return R.gaps_and_islands(ranges, "grp", 10)
