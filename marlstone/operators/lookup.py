"""Single things and lists of them: sources of declarations, staleness, pages bound to a request, details, diagnostics.

A page is OFFSET and LIMIT in the plan, then the leading rows within a token budget; its cursor names the operation, the
request and the revisions it was given for."""

from __future__ import annotations

import base64
import hashlib
import json
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marlstone.functions import text as T

#: Most lines of a source, rows of a page, and bytes and offset of a cursor.
MAX_LINES, MAX_PAGE, MAX_CURSOR_BYTES, MAX_OFFSET = 400, 200, 4096, 100_000
SEVERITIES = ("error", "warning", "info")


def canonical_json(value: Any) -> str:
    """JSON with sorted keys and no white space, the same for equal values."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def without_comments(text: str) -> str:
    """JSON with comments and trailing commas as plain JSON; strings are left alone."""
    import re

    plain = re.sub(r'("(?:[^"\\]|\\.)*")|//[^\n]*|/\*.*?(?:\*/|\Z)', lambda m: m[1] or " ", text, flags=re.S)
    return re.sub(r'("(?:[^"\\]|\\.)*")|,(\s*[}\]])', lambda m: m[1] or m[2], plain, flags=re.S)


def with_source(nodes: DataFrame, files: DataFrame, most: int = 120) -> DataFrame:
    """nodes with source (their lines of files(path, content, recorded_hash), `most` at most), the lines it covers, whether it was cut
    and whether the file has changed since it was recorded.  Nodes without a file or a line keep their lines and have no source."""
    most = max(1, min(MAX_LINES, most))
    lines = F.split(F.regexp_replace("content", "\n$", ""), "\n")
    held = files.select(F.col("path").alias("file_path"), "content", lines.alias("lines"), (~F.col("recorded_hash").eqNullSafe(F.sha2("content", 256))).alias("is_stale"))
    rows = nodes.join(held, "file_path", "left")
    n = F.when(F.col("content") == "", 0).otherwise(F.size("lines"))
    first = F.least(F.greatest(F.col("start_line"), F.lit(1)), F.greatest(n, F.lit(1)))
    end = F.least(F.greatest("end_line", "start_line"), n)
    cap = F.least(first + most - 1, end)
    has = F.col("content").isNotNull() & (F.col("start_line") > 0)
    text = F.when(first <= cap, F.array_join(F.slice("lines", first.cast("int"), F.greatest(cap - first + 1, F.lit(0)).cast("int")), "\n")).otherwise("")
    return rows.select(
        *nodes.columns,
        F.when(has, text).alias("source"),
        F.when(has, first).otherwise(F.col("start_line")).cast("long").alias("source_start"),
        F.when(has, cap).otherwise(F.col("end_line")).cast("long").alias("source_end"),
        F.coalesce(has & (cap < end), F.lit(False)).alias("truncated"),
        F.coalesce(has & F.col("is_stale"), F.lit(False)).alias("stale"),
    )


def get(nodes: DataFrame, wanted: DataFrame, files: DataFrame, most: int = 120) -> DataFrame:
    """wanted(ref) by id, else by readable reference if it names one node alone; those found, with their source."""
    by_id = wanted.join(nodes.withColumn("ref", F.col("id")), "ref")
    named = nodes.withColumn("ref", T.readable_ref(F.col("kind"), F.col("file_path"), F.col("qualified_name")))
    single = named.withColumn("n", F.count(F.lit(1)).over(W.partitionBy("ref"))).filter("n = 1").drop("n")
    by_ref = wanted.join(nodes.select(F.col("id").alias("ref")), "ref", "left_anti").join(single, "ref")
    return with_source(by_id.unionByName(by_ref), files, most)


def staleness(recorded: DataFrame, present: DataFrame) -> DataFrame:
    """path, stale: recorded(path, content_hash) whose file is gone from present(path, content) or has other content, and present
    files that nothing recorded."""
    now = present.select("path", F.sha2("content", 256).alias("now"))
    both = recorded.select("path", "content_hash").join(now, "path", "full")
    return both.select("path", (F.col("content_hash").isNull() | F.col("now").isNull() | (F.col("content_hash") != F.col("now"))).alias("stale"))


class BadCursor(ValueError):
    """The cursor is none, belongs to another request, or to another revision of the list."""


@dataclass(frozen=True)
class Request:
    """What a page is asked for; revision stands for the state of the list."""

    operation: str
    arguments: tuple
    revision: str

    def digest(self) -> str:
        return hashlib.sha256(canonical_json([self.operation, self.arguments]).encode()).hexdigest()

    def cursor(self, offset: int) -> str:
        return base64.urlsafe_b64encode(canonical_json({"v": 1, "operation": self.operation, "request": self.digest(), "revision": self.revision, "offset": offset}).encode()).decode().rstrip("=")

    def offset(self, cursor: str | None) -> int:
        if not cursor:
            return 0
        try:
            if len(cursor) > MAX_CURSOR_BYTES:
                raise ValueError
            held = json.loads(base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)))
            offset = held["offset"]
            if held["v"] != 1 or not isinstance(offset, int) or not 0 <= offset <= MAX_OFFSET:
                raise ValueError
        except (ValueError, KeyError, TypeError):
            raise BadCursor("not a cursor") from None
        if held["operation"] != self.operation or held["request"] != self.digest():
            raise BadCursor("the cursor belongs to another request")
        if held["revision"] != self.revision:
            raise BadCursor("the list has changed since the cursor was given")
        return offset


def bounded_page(rows: DataFrame, order: list, request: Request, limit: int = 50, tokens: int | None = None, cursor: str | None = None) -> tuple[DataFrame, str | None]:
    """(page, next cursor): at most limit rows in order, cut to a budget of tokens, a quarter of a row's JSON each; the first row
    always fits."""
    limit, offset = max(1, min(MAX_PAGE, limit)), request.offset(cursor)
    names = rows.columns
    top = rows.orderBy(*order).offset(offset).limit(limit + 1)  # one more tells whether there is more
    at = W.partitionBy(F.lit(1)).orderBy(*order)  # over at most limit + 1 rows
    top = top.withColumn("place", F.row_number().over(at)).withColumn("tokens", F.ceil(F.length(F.to_json(F.struct(*names))) / 4))
    top = top.withColumn("running", F.sum("tokens").over(at.rowsBetween(W.unboundedPreceding, 0)))
    fits = F.col("place") <= limit
    if tokens is not None:
        fits = fits & ((F.col("place") == 1) | (F.col("running") <= tokens))
    top = top.withColumn("fits", fits)
    sizes = top.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("fits"), 1)).alias("kept")).first()
    page = top.filter("fits").select(*names, F.col("place").cast("long").alias("place"), F.col("running").cast("long").alias("estimated_tokens"))
    return page, request.cursor(offset + sizes["kept"]) if sizes["kept"] < sizes["n"] else None


def link_page(links: DataFrame, entity: str, order: list[str], limit: int, offset: int) -> DataFrame:
    """Every entity's page of its links (rows with the column entity): place, total, truncated and next_offset on each row."""
    w = W.partitionBy(entity)
    rows = links.withColumns({"place": F.row_number().over(w.orderBy(*order)).cast("long"), "total": F.count(F.lit(1)).over(w)})
    more = F.col("total") > offset + limit
    rows = rows.filter((F.col("place") > offset) & (F.col("place") <= offset + limit))
    return rows.withColumns({"truncated": more, "next_offset": F.when(more, F.lit(offset + limit).cast("long"))})


def diagnostics(found: DataFrame, entities: tuple[str, ...] = (), paths: tuple[str, ...] = (), limit: int = 100) -> DataFrame:
    """Diagnostics (severity, code, entity, file, message) of any of the entities and below any of the paths, worst first; at most
    limit, each with whether there were more."""
    out = found
    if entities:
        out = out.filter(F.col("entity").isin(*entities))
    if paths:
        hit = F.lit(False)
        for p in paths:
            hit = hit | (F.col("file") == p) | F.col("file").startswith(p.rstrip("/") + "/")
        out = out.filter(hit)
    rank = F.lit(len(SEVERITIES))
    for i, s in enumerate(SEVERITIES):
        rank = F.when(F.col("severity") == s, i).otherwise(rank)
    total = out.agg(F.count(F.lit(1)).alias("total"))  # one row
    top = out.orderBy(rank, "file", "code", "entity", "message").limit(limit)
    return top.join(F.broadcast(total)).withColumn("truncated", F.col("total") > limit).drop("total")


def grounding_rows(groundings: DataFrame, entities: DataFrame) -> DataFrame:
    """The groundings of entities(entity_id) by ordinal, with what was recorded for each."""
    return groundings.join(entities.select("entity_id"), "entity_id", "left_semi").orderBy("entity_id", "ordinal")


def spec_rollup(specs: DataFrame, members: DataFrame, groundings: DataFrame) -> DataFrame:
    """spec, health, n: groundings by health of each spec and of its members(spec, entity_id)."""
    every = members.select("spec", "entity_id").union(specs.select("spec", F.col("spec").alias("entity_id"))).distinct()
    return every.join(groundings.select("entity_id", "health"), "entity_id").groupBy("spec", "health").agg(F.count(F.lit(1)).alias("n"))


def status(found: DataFrame, recorded: DataFrame, bounds: dict[str, int] | None = None) -> DataFrame:
    """One row on an index against its sources: added, changed and removed of found(path, hash) against recorded(path, hash), the state
    (missing, stale, fresh) and what to do about it; over the bound of files the index keeps its state and is degraded."""
    limit = (bounds or {}).get("files")
    both = found.select("path", F.col("hash").alias("now")).join(recorded.select("path", F.col("hash").alias("was")), "path", "full")
    n = lambda c, name: F.count(F.when(c, 1)).alias(name)
    counts = both.agg(n(F.col("was").isNull(), "added"), n(F.col("now").isNull(), "removed"), n(F.col("was") != F.col("now"), "changed"), n(F.col("was").isNotNull(), "indexed"), n(F.col("now").isNotNull(), "files"))
    differs = (F.col("added") + F.col("removed") + F.col("changed")) > 0
    over = F.lit(False) if limit is None else F.col("files") > limit
    state = F.when(F.col("indexed") == 0, "missing").when(over, "degraded").when(differs, "stale").otherwise("fresh")
    job = F.when(F.col("indexed") == 0, "rebuild").when(differs & ~over, "refresh")
    return counts.select("added", "changed", "removed", state.alias("state"), job.alias("job"), over.alias("limit_exceeded"))


def health_report(parts: dict[str, DataFrame]) -> DataFrame:
    """part, state, job, changes of several indexes, worst first."""
    order = {s: i for i, s in enumerate(INDEX_STATES)}
    rank = F.lit(len(order))
    for s, i in order.items():
        rank = F.when(F.col("state") == s, i).otherwise(rank)
    rows = [df.select(F.lit(name).alias("part"), "state", "job", (F.col("added") + F.col("changed") + F.col("removed")).alias("changes")) for name, df in parts.items()]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.orderBy(rank, "part")


# States of an index, worst first.
INDEX_STATES = ("corrupt", "rebuild_required", "missing", "migration_required", "stale", "degraded", "fresh")


def index_state(readable: Column, version: Column, current: int, oldest: int, differs: Column, warnings: Column, exists: Column) -> Column:
    """The state of an index from what is known of it: absent, unreadable, of a version to rebuild or migrate, differing from its
    sources, with warnings, or none of these."""
    return (
        F.when(~exists, "missing").when(~readable, "corrupt").when(version < oldest, "rebuild_required").when(version < current, "migration_required").when(differs, "stale").when(warnings > 0, "degraded").otherwise("fresh")
    )


def posting_integrity(docs: DataFrame, key: str, column: str, postings: DataFrame) -> DataFrame:
    """doc, problem: documents whose terms and stored postings(doc, term) differ; none says that the index is whole."""
    terms = docs.select(F.col(key).alias("doc"), F.explode(F.array_distinct(T.words(F.coalesce(F.col(column), F.lit(""))))).alias("term"), F.lit(True).alias("held"))
    both = terms.unionByName(postings.select("doc", "term", F.lit(False).alias("held"))).groupBy("doc", "term").agg(F.min("held").alias("least"), F.max("held").alias("most"))
    return both.filter(F.col("least") == F.col("most")).select("doc", F.when(F.col("most"), "lost").otherwise("extra").alias("problem")).distinct()


def explained(nodes: DataFrame, evidence: DataFrame) -> DataFrame:
    """nodes with why they were found: the reasons of evidence(id, channel, rank), best rank first, as one text."""
    best = evidence.groupBy("id", "channel").agg(F.min("rank").alias("rank"))
    why = best.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "channel"))), lambda x: F.concat(x["channel"], F.lit(" #"), x["rank"].cast("string"))), ", ").alias("why"))
    return nodes.join(why, "id")
