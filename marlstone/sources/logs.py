"""Event logs (JSON lines), directories of JSON documents, text and binary corpora, and their sinks.

Everything is read by Spark's readers with explicit schemas, so any store Spark reaches will do, and malformed lines
are skipped where a log is read tolerantly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions.text import glob_to_regex, ignored

# Kinds of events.
EVENT_KINDS = ("decision", "discovery", "note", "risk", "todo")
EVENT = """id string, timestamp string, kind string, summary string, details string, tags array<string>, files array<string>, actor string, session_id string,
    supersedes string, superseded_by string, confidence double, provenance string, source string, status string, cwd string"""


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """The whole log; lines that are no records are left out."""
    return spark.read.schema(EVENT).option("mode", "DROPMALFORMED").json(path).filter(F.col("id").isNotNull())


def read_recent_events(spark: SparkSession, path: str, most_lines: int = 10_000, most_bytes: int = 8 << 20) -> DataFrame:
    """The newest lines of a log that parse, in log order, with `source_truncated`: older lines were not looked at.

    Lines are numbered by file and place; the newest ones are a top-k, not a sort of the log, and of these as many as lie whole within
    the newest most_bytes."""
    from pyspark.sql import Window as W

    lines = spark.read.text(path).filter(F.trim("value") != "").select("value", F.struct(F.col("_metadata.file_modification_time").alias("file_time"), F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line")).alias("at"))
    total = lines.agg(F.count(F.lit(1)).alias("lines"))  # one row
    newest = lines.orderBy(F.desc("at")).limit(most_lines)
    running = F.sum(F.octet_length("value") + 1).over(W.partitionBy(F.lit(1)).orderBy(F.desc("at")).rowsBetween(W.unboundedPreceding, 0))  # over at most most_lines rows
    newest = newest.withColumn("running", running).filter(F.col("running") <= most_bytes)
    held = F.count(F.lit(1)).over(W.partitionBy(F.lit(1)))
    parsed = newest.withColumn("held", held).join(F.broadcast(total)).select("at", F.from_json("value", EVENT).alias("e"), (F.col("lines") > F.col("held")).alias("source_truncated"))
    return parsed.filter("e.id is not null").orderBy("at").select("e.*", "source_truncated")


def read_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A directory of JSON documents, one a file; files that do not parse are left out."""
    return spark.read.schema(f"{schema}, _bad string").option("multiLine", True).option("columnNameOfCorruptRecord", "_bad").json(path).filter("_bad is null").drop("_bad")


def normal_kind(kind: Column) -> Column:
    """A kind in lower case without white space around it; null for what is no kind, or longer than 16 bytes as written."""
    clean = F.lower(F.trim(kind))
    return F.when((F.octet_length(kind) <= 16) & clean.isin(*EVENT_KINDS), clean)


def normal_file(file: Column) -> Column:
    """A path below the project with forward slashes and without `.` segments; `.` for the project itself."""
    parts = F.filter(F.split(F.regexp_replace(F.trim(file), r"\\", "/"), "/"), lambda p: ~p.isin("", "."))
    # a `..` takes back the part before it, or stays where there is none
    fold = F.aggregate(parts, F.array().cast("array<string>"), lambda out, p: F.when((p == "..") & (F.size(out) > 0) & (F.coalesce(F.try_element_at(out, F.lit(-1)), F.lit("")) != ".."), F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0)))).otherwise(F.array_append(out, p)))
    return F.when(F.size(fold) == 0, ".").otherwise(F.array_join(fold, "/"))


def append_event(spark: SparkSession, path: str, events: DataFrame) -> None:
    """Append records; kinds outside the vocabulary are refused before anything is written."""
    bad = events.filter(normal_kind(F.col("kind")).isNull()).select("kind").limit(1).collect()
    if bad:
        raise ValueError(f"unknown kind {bad[0]['kind']!r}")
    events = events.withColumn("kind", normal_kind(F.col("kind")))
    clean = events.withColumn("files", F.transform("files", normal_file))
    clean.write.mode("append").json(path)


def superseded(events: DataFrame) -> DataFrame:
    """Events with superseded_by set where a later record says that it supersedes them; the least such id."""
    by = events.filter("supersedes is not null").groupBy(F.col("supersedes").alias("id")).agg(F.min("id").alias("by"))
    return events.join(by, "id", "left").withColumn("superseded_by", F.coalesce("superseded_by", "by")).drop("by")


class CorpusLimit(ValueError):
    """The corpus has more files or bytes than its policy admits."""


def scan_corpus(spark: SparkSession, root: str, ignore: tuple[str, ...] = (), ignore_lines: tuple[str, ...] = (), max_files: int = 20_000, max_file_bytes: int = 2 << 20, max_total_bytes: int = 512 << 20) -> DataFrame:
    """path, bytes, content of the text files under root: ignored globs, what the lines of an ignore file leave out, oversized and binary files drop out; too many files
    or bytes in all are an error.  Sizes are judged on file metadata before any content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    relative = F.regexp_replace(F.col("path"), F.concat(F.lit("^.*?"), F.lit(_quoted(root.rstrip("/").split("://")[-1].lstrip("/"))), F.lit("/")), "")
    files = files.withColumn("relative", relative)
    for glob in ignore:
        files = files.filter(~F.col("relative").rlike(glob_to_regex(glob)))
    files = files.filter(~ignored(F.col("relative"), list(ignore_lines)))
    sized = files.filter(F.col("length") <= max_file_bytes)
    n, total = sized.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
    if n > max_files or total > max_total_bytes:
        raise CorpusLimit(f"{n} files, {total} bytes")
    text = sized.filter(~F.contains(F.substring("content", 1, 8192), F.lit(b"\x00")))
    return text.select(F.col("relative").alias("path"), F.col("length").alias("bytes"), F.decode("content", "UTF-8").alias("content"))


def discover(files: DataFrame, exclude: tuple[str, ...] = (), max_files: int = 10_000, max_depth: int = 64, max_file_bytes: int = 8 << 20, max_total_bytes: int = 256 << 20) -> tuple[DataFrame, DataFrame]:
    """(corpus, one row of limits) of files(path, bytes): Markdown below no folder that begins with a dot and not in `local`, without
    excluded globs, not too deep and not too large; past the bounds on files and bytes in all, by path, nothing more is taken and
    limit_exceeded says so.  Too large files are counted as skipped."""
    from pyspark.sql import Window as W

    parts = F.split("path", "/")
    kept = files.filter(F.lower("path").rlike(r"\.mdx?$") & ~F.exists(parts, lambda p: p.startswith(".")) & (parts[0] != "local") & (F.size(parts) <= max_depth))
    for glob in exclude:
        kept = kept.filter(~F.col("path").rlike(glob_to_regex(glob)))
    kept = kept.withColumn("large", F.col("bytes") > max_file_bytes)
    top = kept.filter(~F.col("large")).orderBy("path").limit(max_files)
    w = W.partitionBy(F.lit(1)).orderBy("path").rowsBetween(W.unboundedPreceding, 0)  # over at most max_files rows
    corpus = top.withColumn("running", F.sum("bytes").over(w)).filter(F.col("running") <= max_total_bytes).select("path", "bytes")
    sizes = kept.agg(F.count(F.when(~F.col("large"), 1)).alias("files"), F.coalesce(F.sum(F.when(~F.col("large"), F.col("bytes"))), F.lit(0)).alias("total"), F.count(F.when(F.col("large"), 1)).alias("skipped"))
    return corpus, sizes.select("files", "skipped", ((F.col("files") > max_files) | (F.col("total") > max_total_bytes)).alias("limit_exceeded"))


def _quoted(text: str) -> str:
    import re

    return re.escape(text)


def coverage(files: DataFrame, path: str, indexed: tuple[str, ...]) -> DataFrame:
    """extension, n of files that no extractor reads; most first."""
    extension = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9_]+)$", 1))
    return files.groupBy(extension.alias("extension")).agg(F.count(F.lit(1)).alias("n")).filter(~F.col("extension").isin("", *indexed)).orderBy(F.desc("n"), "extension")


def export_bundle(pages: DataFrame, path: str, max_files: int = 200, max_bytes: int = 1 << 20) -> DataFrame:
    """Write the leading pages (path, text), by path, that stay within the caps as one text file; returns what was written."""
    from pyspark.sql import Window as W

    few = pages.orderBy("path").limit(max_files)
    running = F.sum(F.octet_length("text")).over(W.partitionBy(F.lit(1)).orderBy("path").rowsBetween(W.unboundedPreceding, 0))  # over at most max_files rows
    kept = few.withColumn("bytes_so_far", running).filter(F.col("bytes_so_far") <= max_bytes)
    kept.orderBy("path").select(F.concat(F.lit("# "), "path", F.lit("\n"), "text").alias("value")).coalesce(1).write.text(path)
    return kept
