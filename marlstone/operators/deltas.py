"""Snapshots, deltas between them and their publication.

A delta is one full outer join on the key with null-safe comparison: it shuffles either snapshot once, by key, and a
table bucketed by its key not at all.  Applying a delta reads the old snapshot and writes the new version to a directory
of its own; readers follow a pointer, so that they keep the version they began with.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def keyed_delta(old: DataFrame, new: DataFrame, keys: list[str], ignore: tuple[str, ...] = ()) -> DataFrame:
    """op (D, I, U), the keys and the new values; columns in ignore do not make a row changed."""
    values = [c for c in new.columns if c not in keys]
    compared = [c for c in values if c not in ignore]
    a = old.select(*keys, F.struct(*compared).alias("old_row"), F.lit(True).alias("in_old"))
    b = new.select(*keys, F.struct(*compared).alias("new_row"), *values, F.lit(True).alias("in_new"))
    op = F.when(F.col("in_new").isNull(), "D").when(F.col("in_old").isNull(), "I").when(~F.col("old_row").eqNullSafe(F.col("new_row")), "U")
    return a.join(b, keys, "full").withColumn("op", op).filter(F.col("op").isNotNull()).select("op", *keys, *values)


def apply_delta(old: DataFrame, delta: DataFrame, keys: list[str]) -> DataFrame:
    """old with the delta applied: what a rebuild of the new snapshot would hold."""
    untouched = old.join(delta.select(*keys), keys, "left_anti")
    return untouched.unionByName(delta.filter("op <> 'D'").drop("op"))


def stale_and_missing(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """op (D: only in old, I: only in new) and the keys."""
    gone = old.select(*keys).join(new.select(*keys), keys, "left_anti").withColumn("op", F.lit("D"))
    came = new.select(*keys).join(old.select(*keys), keys, "left_anti").withColumn("op", F.lit("I"))
    return gone.unionByName(came)


def set_delta(old: DataFrame, new: DataFrame) -> DataFrame:
    """op and whole rows, by set difference; repeated rows count once."""
    return old.subtract(new).withColumn("op", F.lit("D")).unionByName(new.subtract(old).withColumn("op", F.lit("I")))


def invalidated(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Keys with any row on one side only: their derived rows are to be replaced."""
    return old.subtract(new).union(new.subtract(old)).select(key).distinct()


def delta_statistics(deltas: dict[str, DataFrame]) -> DataFrame:
    """table, op, n over several deltas."""
    out = None
    for name, delta in deltas.items():
        part = delta.groupBy(F.lit(name).alias("table"), "op").agg(F.count(F.lit(1)).alias("n"))
        out = part if out is None else out.unionByName(part)
    return out


def classify_sources(recorded: DataFrame, present: DataFrame, key: str, digest: str) -> DataFrame:
    """key, change: added, modified, deleted or same, by digest."""
    a, b = recorded.select(key, F.col(digest).alias("was")), present.select(key, F.col(digest).alias("now"))
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "deleted").when(F.col("was") != F.col("now"), "modified").otherwise("same")
    return a.join(b, key, "full").select(key, change.alias("change"))


def upsert_revisions(marks: DataFrame, seen: DataFrame) -> DataFrame:
    """Revision marks (id, revision, at): a seen row replaces the mark only if its revision differs."""
    s = seen.select("id", F.col("revision").alias("new_revision"), F.col("at").alias("new_at"))
    changed = F.col("new_revision").isNotNull() & ~F.col("revision").eqNullSafe(F.col("new_revision"))
    return marks.join(s, "id", "full").select("id", F.when(changed, F.col("new_revision")).otherwise(F.col("revision")).alias("revision"), F.when(changed, F.col("new_at")).otherwise(F.col("at")).alias("at"))


class Publication:
    """Versions of a table under a directory, and the pointer that readers follow.

    A version is written completely before the pointer names it; a failed or lost writer leaves the old one in place.
    All file access goes through Hadoop's file systems, so the directory may be in any store Spark reads."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def current(self) -> str | None:
        """The published version's directory."""
        names = sorted(s.getPath().getName() for s in (self._fs.globStatus(self._path(f"{self.root}/pointer-*")) or ()))
        if not names:
            return None
        row = self.spark.read.text(f"{self.root}/{names[-1]}").first()
        return json.loads(row[0])["path"]

    def read(self) -> DataFrame:
        """The published version; the DataFrame stays on it whatever is published later."""
        if not (path := self.current()):
            raise FileNotFoundError(f"nothing is published under {self.root}")
        return self.spark.read.parquet(path)

    def publish(self, df: DataFrame, *partition_by: str) -> str:
        path = f"{self.root}/version-{uuid.uuid4().hex}"
        writer = df.write.partitionBy(*partition_by) if partition_by else df.write
        writer.parquet(path)
        name = f"pointer-{time.time_ns():020d}"
        out = self._fs.create(self._path(f"{self.root}/.{name}"), False)
        out.write(bytearray(json.dumps({"path": path}).encode()))
        out.close()
        if not self._fs.rename(self._path(f"{self.root}/.{name}"), self._path(f"{self.root}/{name}")):
            raise OSError(f"the pointer under {self.root} did not move")
        return path

    def publish_delta(self, delta: DataFrame, keys: list[str]) -> str:
        return self.publish(apply_delta(self.read(), delta, keys))
