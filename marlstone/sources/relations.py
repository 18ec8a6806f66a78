"""Stored relations: keyed tables in the shared folder, by versions.

A write makes a new version beside the old ones and then names it; readers keep the version that they opened, so a lost
executor or a failed write leaves the relation as it was."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class RelationError(ValueError):
    pass


class Relations:
    """Relations below a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _folder(self, name: str):
        if not re.fullmatch(r"[a-z_][a-z0-9_]*", name):
            raise RelationError(f"not a name: {name!r}")
        return self._path(f"{self.root}/{name}")

    def names(self) -> list[str]:
        if not self._fs.exists(self._path(self.root)):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(self.root)) if s.isDirectory())

    def _versions(self, name: str) -> list[int]:
        """Versions that are whole: a writer marks them when it is done."""
        folder = self._folder(name)
        if not self._fs.exists(folder):
            raise RelationError(f"no relation {name}")
        found = [s.getPath() for s in self._fs.listStatus(folder) if s.getPath().getName().startswith("v")]
        return sorted(int(p.getName()[1:]) for p in found if self._fs.exists(self._path(p, "_SUCCESS")))

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}/v{self._versions(name)[-1]}")

    def columns(self, name: str) -> dict[str, str]:
        """Types by column."""
        return dict(self.table(name).dtypes)

    def _write(self, name: str, rows: DataFrame, version: int) -> None:
        """The new version under a name of its own first, so that two writers never mix."""
        at = f"{self.root}/{name}/.{uuid.uuid4().hex}"
        rows.write.parquet(at)
        if not self._fs.rename(self._path(at), self._path(f"{self.root}/{name}/v{version}")):
            self._fs.delete(self._path(at), True)
            raise RelationError(f"{name} was written by another at the same time")

    def create(self, name: str, schema: str, tolerant: bool = True) -> bool:
        """An empty relation; one that exists stays as it is, or is an error."""
        if self._fs.exists(self._folder(name)):
            if not tolerant:
                raise RelationError(f"{name} exists")
            return False
        self._fs.mkdirs(self._folder(name))
        self._write(name, self.spark.createDataFrame([], StructType.fromDDL(schema)), 1)
        return True

    def put(self, name: str, rows: DataFrame, keys: list[str]) -> None:
        """Insert rows, or replace those with the same keys; of rows with one key the greatest counts.  One pass for all rows: a version
        is the transaction, whatever their number."""
        held = self.table(name)
        if missing := [c for c in held.columns if c not in rows.columns]:
            raise RelationError(f"{name} lacks {missing}")
        rest = [c for c in held.columns if c not in keys]
        fresh = rows.select(*(F.col(c).cast(t).alias(c) for c, t in held.dtypes))
        fresh = fresh.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("row")).select(*keys, *(F.col(f"row.{c}").alias(c) for c in rest)) if rest else fresh.distinct()
        kept = held.join(fresh.select(*keys), keys, "left_anti")
        self._write(name, kept.select(*held.columns).unionByName(fresh), self._versions(name)[-1] + 1)

    def remove(self, name: str, rows: DataFrame, keys: list[str]) -> None:
        """Remove the rows whose keys are among rows."""
        held = self.table(name)
        self._write(name, held.join(rows.select(*keys).distinct(), keys, "left_anti").select(*held.columns), self._versions(name)[-1] + 1)

    def drop(self, name: str) -> bool:
        return self._fs.delete(self._folder(name), True)


def upsert_stream(store: Relations, name: str, keys: list[str]):
    """What foreachBatch takes: each batch goes into the relation, and a batch that is run again changes nothing."""

    def write(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            store.put(name, batch, keys)

    return write
