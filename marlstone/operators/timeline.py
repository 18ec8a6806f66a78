"""Timelines: filters, merges of several logs, catch-up digests, activity feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MAX_ENTRIES, MAX_BYTES = 200, 64 * 1024


def matching(events: DataFrame, text: str | None = None, kinds: tuple[str, ...] = (), files: tuple[str, ...] = (), since: Column | None = None, instant: str = "ts", texts: tuple[str, ...] = ("summary",)) -> DataFrame:
    """Events not superseded that match every given filter; text is looked for in any of the columns texts, whatever the case."""
    out = events.filter(F.col("superseded_by").isNull())
    if text:
        hit = F.lit(False)
        for c in texts:
            hit = hit | F.coalesce(F.contains(F.lower(F.col(c)), F.lit(text.lower())), F.lit(False))
        out = out.filter(hit)
    if kinds:
        out = out.filter(F.col("kind").isin(*kinds))
    if files:
        out = out.filter(F.arrays_overlap("files", F.array(*map(F.lit, files))))
    if since is not None:
        out = out.filter(F.col(instant) >= since)
    return out


def newest(events: DataFrame, limit: int, instant: str = "ts", key: str = "event_id") -> DataFrame:
    """The newest events, and on each row how many matched in all."""
    total = events.agg(F.count(F.lit(1)).alias("total_matched"))  # one row
    return events.orderBy(F.desc(instant), F.desc(key)).limit(max(1, min(MAX_ENTRIES, limit))).join(F.broadcast(total)).withColumn("truncated", F.col("total_matched") > limit)


def timeline(events: DataFrame, limit: int = 50, budget: int = MAX_BYTES - 512, **filters) -> DataFrame:
    """matching, newest, then whole entries within the byte budget: one too large is skipped, later ones may fit."""
    from marlstone.operators.ranking import skip_to_fit

    rows = newest(matching(events, **filters), limit)
    sized = rows.withColumn("bytes", F.octet_length(F.to_json(F.struct("*")))).withColumn("all", F.lit(1)).withColumn("back", -F.unix_micros(F.col("ts").cast("timestamp")))
    return skip_to_fit(sized, "bytes", budget, ["back", "event_id"], "all", MAX_ENTRIES).drop("all", "back", "place")


def merged(*logs: DataFrame) -> DataFrame:
    """Several logs as one, columns that one lacks as nulls."""
    out = logs[0]
    for log in logs[1:]:
        out = out.unionByName(log, allowMissingColumns=True)
    return out


def feed(events: DataFrame, classes: dict[str, tuple[str, ...]], wanted: str, since: Column) -> DataFrame:
    """Events of a class of kinds since an instant, newest first."""
    return events.filter(F.col("kind").isin(*classes[wanted]) & (F.col("ts") >= since)).orderBy(F.desc("ts"), F.desc("event_id"))


def catch_up(items: DataFrame, cursors: DataFrame, actor: str, groups: list[str], days: int = 7, now: Column | None = None) -> DataFrame:
    """What others did since the actor's cursor (actor, at), or in the last `days`: items(actor, ts, group, key, id), an action
    that covers the same key once, by group in a fixed order, then newest first; with each group's count and place."""
    now = F.current_timestamp() if now is None else now
    cursor = cursors.filter(F.col("actor") == actor).agg(F.max("at").alias("cursor"))  # one row
    fresh = items.filter(F.col("actor") != actor).join(F.broadcast(cursor)).filter(F.col("ts") > F.coalesce("cursor", now - F.make_dt_interval(F.lit(days))))
    order = F.lit(None).cast("int")
    for i, g in enumerate(groups):
        order = F.when(F.col("group") == g, i).otherwise(order)
    latest = fresh.filter(F.col("group").isin(*groups)).groupBy("group", "key").agg(F.max(F.struct("ts", "id")).alias("last"))
    w = W.partitionBy("group")
    return latest.select("group", order.alias("group_order"), "key", F.col("last.ts").alias("ts"), F.col("last.id").alias("id")).withColumns({"n": F.count(F.lit(1)).over(w), "place": F.row_number().over(w.orderBy(F.desc("ts"), "id")).cast("long")})


def file_context(events: DataFrame, path: str) -> DataFrame:
    """Events one of whose files contains the path or is contained in it, or whose summary mentions it."""
    near = F.exists("files", lambda f: F.contains(f, F.lit(path)) | F.contains(F.lit(path), f))
    return events.filter(near | F.contains(F.col("summary"), F.lit(path)))


def classify_commits(log: DataFrame) -> DataFrame:
    """Commits (hash, ts, subject) as events: the kind by the subject, tags that keep a commit from being taken twice, and the tag of
    its whole hash; lines without hash or subject are left out."""
    s = F.lower("subject")
    kind = F.when(s.rlike("^fix|bug|resolve"), "decision").when(s.rlike("^(feat|add)"), "discovery").when(s.rlike("refactor|rfc|adr|breaking"), "decision").otherwise("note")
    known = log.filter((F.trim("hash") != "") & (F.trim("subject") != ""))
    tags = F.array(F.concat(F.lit("commit:"), F.substring("hash", 1, 8)), F.lit("harvested:git"))
    return known.select(F.concat(F.lit("commit-"), "hash").alias("id"), "ts", kind.alias("kind"), F.col("subject").alias("summary"), tags.alias("tags"), F.concat(F.lit("commit:"), "hash").alias("whole"))


def new_commits(events: DataFrame, known: DataFrame) -> DataFrame:
    """Events whose commit no known event is tagged with, by its short or its whole hash."""
    have = known.select(F.explode("tags").alias("tag")).filter("tag like 'commit:%'").distinct()
    fresh = events.withColumn("tag", F.element_at("tags", 1)).join(have, "tag", "left_anti").drop("tag")
    return fresh.join(have.withColumnRenamed("tag", "whole"), "whole", "left_anti").drop("whole")


def file_ages(commits: DataFrame) -> DataFrame:
    """file, last commit, commits."""
    return commits.groupBy("file").agg(F.max("ts").alias("last_commit"), F.count(F.lit(1)).alias("commits"))
