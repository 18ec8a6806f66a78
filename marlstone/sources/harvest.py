"""Events harvested from documents of decisions and from changelogs: one for each that no event carries the tag of yet.

files: path, content.  existing: tags (array) of the events there are.  Events: kind, summary, details, tags, files, actor, confidence,
provenance; whoever appends them gives ids and times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Folders of decision records and names of changelogs.
DECISION_FOLDERS = ("docs/adr", "docs/adrs", "doc/adr", "doc/adrs", "adr")
CHANGELOGS = ("CHANGELOG.md", "CHANGES.md")
EXCERPT_LINES = 15


def _lines(content: Column) -> Column:
    return F.split(F.regexp_replace(F.coalesce(content, F.lit("")), r"\r?\n$", ""), r"\r?\n")


def _events(rows: DataFrame, existing: DataFrame, kind: str, family: str, confidence: float, origin: str) -> DataFrame:
    """Events of rows (path, tag, summary, details) whose tag none of the existing has."""
    known = existing.select(F.explode("tags").alias("tag")).filter(F.col("tag").startswith(f"{family}:")).distinct()
    fresh = rows.join(known, "tag", "left_anti")
    tags = F.array(F.lit(family), F.lit("harvested:doc"), F.col("tag"))
    return fresh.select(F.lit(kind).alias("kind"), "summary", "details", tags.alias("tags"), F.array("path").alias("files"), F.lit("team").alias("actor"), F.lit(confidence).alias("confidence"), F.concat(F.lit(f"{origin} file "), "path").alias("provenance"))


def decision_records(files: DataFrame, existing: DataFrame) -> DataFrame:
    """A decision for each Markdown file directly in a folder of decision records: its first heading, or its name, and its beginning."""
    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    name = F.regexp_extract("path", r"([^/]*)\.md$", 1)
    rows = files.filter(F.col("path").endswith(".md") & folder.isin(*DECISION_FOLDERS)).withColumn("lines", _lines(F.col("content")))
    head = F.filter("lines", lambda x: F.trim(x).startswith("# "))
    title = F.when(F.size(head) > 0, F.trim(F.regexp_replace(F.trim(head[0]), "^#+", ""))).otherwise(name)
    rows = rows.select("path", F.concat(F.lit("adr:"), "path").alias("tag"), F.concat(F.lit("ADR: "), title).alias("summary"), F.array_join(F.slice("lines", 1, EXCERPT_LINES), "\n").alias("details"))
    return _events(rows, existing, "decision", "adr", 1.0, "ADR")


def changelog_sections(files: DataFrame, existing: DataFrame) -> DataFrame:
    """A discovery for each section of a changelog at the root: its heading and its lines that are not blank.  A heading that stands twice
    is one event, the first."""
    rows = files.filter(F.col("path").isin(*CHANGELOGS)).select("path", F.posexplode(_lines(F.col("content"))).alias("at", "line")).withColumn("line", F.trim("line"))
    begins = F.col("line").startswith("## ")
    w = W.partitionBy("path").orderBy("at")  # the lines of one of two files
    rows = rows.withColumn("section", F.sum(begins.cast("int")).over(w)).filter("section > 0")
    heading = F.min(F.when(begins, F.trim(F.regexp_replace("line", "^#+", ""))))
    body = F.collect_list(F.when(~begins & (F.col("line") != ""), F.struct("at", "line")))
    found = rows.groupBy("path", "section").agg(heading.alias("name"), F.array_join(F.transform(F.array_sort(body), lambda x: x["line"]), "\n").alias("details"))
    first = F.row_number().over(W.partitionBy("name").orderBy("path", "section"))
    found = found.withColumn("nth", first).filter("nth = 1")
    rows = found.select("path", F.concat(F.lit("changelog:"), "name").alias("tag"), F.concat(F.lit("Changelog: "), "name").alias("summary"), "details")
    return _events(rows, existing, "discovery", "changelog", 0.9, "Changelog")
