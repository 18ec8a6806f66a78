"""Digests of build inputs as a tree over folders: a changed digest tells which folders changed, and equal folders are never opened.

A node's digest is that of its children's names and digests, combined by exclusive or of four 64-bit parts and their number, so that
folders of any size are added up before any shuffle.  The tree is stored by depth; a comparison goes down level by level and reads the
children of changed folders alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.work import materialize

_PARTS = ("a", "b", "c", "d")


def folder_tree(files: DataFrame) -> DataFrame:
    """path, parent, depth, is_file, digest of files (path, hash) and of all their folders; the root is ''.  Repeated paths count as one
    file whose hash is the digest of all."""
    parent = lambda p: F.regexp_replace(p, r"(^|/)[^/]*$", "")
    one = files.groupBy("path").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.coalesce("hash", F.lit("")))), ","), 256).alias("digest"))
    level = materialize(one.select("path", parent(F.col("path")).alias("parent"), F.size(F.split("path", "/")).alias("depth"), F.lit(True).alias("is_file"), "digest"), "files")
    out, deepest = level, level.agg(F.max("depth")).first()[0] or 0
    folders = None
    for depth in range(deepest, 0, -1):
        here = level.filter(F.col("depth") == depth)
        here = here if folders is None else here.unionByName(folders)
        line = F.sha2(F.concat_ws("\x1f", "path", "digest", F.col("is_file").cast("string")), 256)
        parts = [F.bit_xor(F.conv(F.substring(line, 1 + 15 * i, 15), 16, 10).cast("long")).alias(c) for i, c in enumerate(_PARTS)]
        above = here.groupBy("parent").agg(*parts, F.count(F.lit(1)).alias("n"))
        digest = F.sha2(F.concat_ws(",", *_PARTS, "n"), 256)
        folders = materialize(above.select(F.col("parent").alias("path"), parent(F.col("parent")).alias("parent"), F.lit(depth - 1).alias("depth"), F.lit(False).alias("is_file"), digest.alias("digest")), "folders")
        out = out.unionByName(folders)
    return out


def store_tree(files: DataFrame, path: str) -> None:
    folder_tree(files).repartition("depth", F.pmod(F.xxhash64("parent"), F.lit(64))).sortWithinPartitions("parent").write.mode("overwrite").partitionBy("depth").parquet(path)


def stored_tree(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("path string, parent string, is_file boolean, digest string, depth int").parquet(path)


def root_digest(tree: DataFrame) -> str | None:
    row = tree.filter("depth = 0").first()
    return row["digest"] if row else None


def changed(old: DataFrame, new: DataFrame) -> DataFrame:
    """path, is_file, change (added, removed, changed) of every folder and file that differs between two trees."""
    side = lambda tree, name: tree.select("path", "is_file", "parent", F.col("digest").alias(name))

    def compared(depth: int, within: DataFrame | None) -> DataFrame:
        rows = [side(t.filter(F.col("depth") == depth), n) for t, n in ((old, "was"), (new, "now"))]
        if within is not None:
            rows = [r.join(within, "parent", "left_semi") for r in rows]
        both = rows[0].join(rows[1].drop("parent"), ["path", "is_file"], "full").filter(~F.col("was").eqNullSafe(F.col("now")))
        what = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").otherwise("changed")
        return materialize(both.select("path", "is_file", what.alias("change")), "changed")

    out = front = compared(0, None)
    depth = 0
    while not front.isEmpty():
        depth += 1
        front = compared(depth, front.filter("not is_file").select(F.col("path").alias("parent")))
        out = out.unionByName(front)
    return out
