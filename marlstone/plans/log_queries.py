"""Timelines, feeds, catch-up, and their streaming forms."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from marlstone.operators import timeline as L
from marlstone.plans.registry import query
from marlstone.plans.views import Views
from marlstone.work import materialize, shared_dir


@query("flt_5_timeline_filter", "SELECT event_id, kind, ts FROM timeline WHERE superseded_by IS NULL AND lower(props) LIKE '%7%' AND kind IN ('error', 'purchase') AND ts >= timestamp '2024-01-15'", ("timeline",))
def _(v: Views):
    return L.matching(v.timeline, text="7", kinds=("error", "purchase"), since=F.lit("2024-01-15").cast("timestamp"), texts=("props",)).select("event_id", "kind", "ts")


@query("flt_12_feed", "SELECT event_id, kind, user_id FROM events_feed ORDER BY event_id".replace("events_feed", "(SELECT event_id, event_type AS kind, user_id FROM events WHERE event_type IN ('click', 'view') AND ts >= timestamp '2024-01-28')"))
def _(v: Views):
    return L.feed(v.timeline, {"traffic": ("click", "view"), "money": ("purchase",)}, "traffic", F.lit("2024-01-28").cast("timestamp")).select("event_id", "kind", "user_id")


@query("set_8_merged_timeline", """SELECT origin, cast(key AS bigint) AS key, kind FROM (SELECT 'log' AS origin, event_id AS key, event_type AS kind FROM events UNION ALL SELECT 'chat', conv_id * 1000 + turn, role FROM conversations)""")
def _(v: Views):
    log = v.events.select(F.lit("log").alias("origin"), F.col("event_id").alias("key"), F.col("event_type").alias("kind"), "ts")
    chat = v.conversations.select(F.lit("chat").alias("origin"), (F.col("conv_id") * 1000 + F.col("turn")).alias("key"), F.col("role").alias("kind"))
    return L.merged(log, chat).select("origin", "key", "kind")


@query("x_19_timeline_limit", """SELECT event_id, total_matched, total_matched > 50 AS truncated FROM (SELECT event_id, ts, count(*) OVER () AS total_matched FROM timeline WHERE superseded_by IS NULL AND kind = 'error') ORDER BY ts DESC, event_id DESC LIMIT 50""", ("timeline",))
def _(v: Views):
    return L.newest(L.matching(v.timeline, kinds=("error",)), 50).select("event_id", "total_matched", "truncated")


@query("x_19_timeline_bytes")
def _(v: Views):
    return L.timeline(v.timeline, 200, 10_000, kinds=("error",)).select("event_id", "bytes", "total_matched")


@query("st_3_catch_up", """SELECT "group", CASE "group" WHEN 'purchase' THEN 0 WHEN 'error' THEN 1 ELSE 2 END AS group_order, key, ts, id, count(*) OVER (PARTITION BY "group") AS n, row_number() OVER (PARTITION BY "group" ORDER BY ts DESC, id) AS place FROM (
    SELECT event_type AS "group", value::bigint % 50 AS key, max(ts) AS ts, arg_max(event_id, row(ts, event_id)) AS id FROM events WHERE user_id <> 7 AND event_type IN ('purchase', 'error', 'signup') AND ts > (SELECT max(ts) FROM events WHERE user_id = 7 AND ts < timestamp '2024-01-20') GROUP BY 1, 2)""".replace("value::bigint", "cast(floor(value) AS bigint)"))
def _(v: Views):
    items = v.events.select(F.col("user_id").cast("string").alias("actor"), "ts", F.col("event_type").alias("group"), (F.floor("value").cast("long") % 50).alias("key"), F.col("event_id").alias("id"))
    cursors = v.events.filter("ts < timestamp '2024-01-20'").select(F.col("user_id").cast("string").alias("actor"), F.col("ts").alias("at"))
    return L.catch_up(items, cursors, "7", ["purchase", "error", "signup"])


@query("src_15_commit_events", """SELECT 'commit-' || o_orderkey AS id, CASE o_orderkey % 9 WHEN 1 THEN 'decision' WHEN 2 THEN 'discovery' WHEN 4 THEN 'decision' WHEN 5 THEN 'discovery' WHEN 7 THEN 'decision' ELSE 'note' END AS kind FROM orders WHERE o_orderkey % 3 <> 0""")
def _(v: Views):
    subjects = ["tidy up", "Fix: urgent", "feat: high", "", "Debug the bugs", "Add a page", "fixes", "Breaking: new ADR", "say why"]
    subject = F.element_at(F.array(*map(F.lit, subjects)), (F.col("o_orderkey") % 9).cast("int") + 1)
    log = v.orders.select(F.col("o_orderkey").cast("string").alias("hash"), F.col("o_orderdate").alias("ts"), subject.alias("subject"))
    known = L.classify_commits(log.filter("cast(hash as bigint) % 3 = 0"))
    return L.new_commits(L.classify_commits(log), known).select("id", "kind")


@query("src_16_file_ages", "SELECT file, max(ts) AS last_commit, count(*) AS commits FROM commits GROUP BY file", ("commits",))
def _(v: Views):
    return L.file_ages(v.commits)


@query("st_1_stream_equals_batch", "SELECT date_trunc('day', ts) AS day, event_type AS kind, count(*) AS n FROM events GROUP BY ALL")
def _(v: Views):
    """The log as a stream of files, counted by day batch by batch, then added up."""
    from marlstone.streaming import timeline as S

    base = f"{shared_dir(v._spark)}/stream-{uuid.uuid4().hex}"
    v.timeline.select("ts", "kind", "value").repartition(4).write.parquet(f"{base}/in")
    stream = S.event_stream(v._spark, f"{base}/in", "ts timestamp, kind string, value double", "parquet", 2)

    def each(batch, number):
        part = batch.groupBy(F.date_trunc("day", "ts").alias("day"), "kind").agg(F.count(F.lit(1)).alias("n"))
        S.append_to(f"{base}/out")(part, number)

    S.run_to_end(stream, f"{base}/checkpoint", each)
    parts = v._spark.read.schema("day timestamp, kind string, n long, batch int").parquet(f"{base}/out")
    return parts.groupBy("day", "kind").agg(F.sum("n").alias("n"))


@query("st_2_incremental_refresh", "SELECT count(*) AS n, count(DISTINCT sha256(text)) AS hashes FROM documents")
def _(v: Views):
    """Sources arrive in two halves, the second with all of the first again; each is extracted once."""
    from marlstone.streaming import timeline as S

    base = f"{shared_dir(v._spark)}/refresh-{uuid.uuid4().hex}"
    files = v.documents.select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"))
    extract = lambda fresh: fresh.select("path", "hash", F.length("content").alias("chars"))
    for half in (files.filter("cast(path as int) % 2 = 0"), files):
        half.write.mode("append").parquet(f"{base}/in")
        S.refresh(S.event_stream(v._spark, f"{base}/in", "path string, content string", "parquet"), f"{base}/cache", extract, f"{base}/checkpoint")
    cached = materialize(v._spark.read.parquet(f"{base}/cache").drop("batch"), "cache")
    return cached.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("hash").alias("hashes"))
