"""A stored index for approximate vector search: trained centroids with inverted lists, probed by partition pruning.

Tables under the index's path, plain Parquet: `centroids` (list, centre), fitted by k-means on a bounded sample of the distinct vectors (SAMPLE a
centroid, the smallest hashes of the key) and fixed from then on; `lists` (key, vector, same: a digest that equal vectors share), one folder `gen=n/list=c` for each build or delta and centroid,
so that a search opens the folders of its probes alone; `deletes` (key, gen that held it).  Every vector is indexed, in the list of its
nearest centroid, as its direction, so that products are cosines.  How many lists a search probes is calibrated at build: the fewest whose
recall on sampled queries, against all vectors, reaches RECALL.

Lists are scored as products of matrices, a part of a list at a time: a list that holds a third of all rows is as many parts as its size
asks for, and the queries that probe it go to each.  Equal vectors are scored, and placed, once, and equal queries ask once.  Vectors without direction (null, empty, zero or not finite) are not indexed."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from marlstone.operators.vectors import least_keys, of_classes, rows_by_length, spread, with_digests
from marlstone.work import bounded_batches, materialize

#: Sampled rows of a centroid in the fit, the most centroids, rows of a part of a list, and queries and recall of the calibration.
SAMPLE, CENTROIDS, PART_ROWS, ASKED, RECALL = 256, 4096, 20_000, 100, 0.95


def directions(vectors: DataFrame, key: str, column: str) -> DataFrame:
    """key, vector of length one, same."""
    kept = vectors.select(F.col(key).alias("key"), column)
    out = StructType([kept.schema["key"], *StructType.fromDDL("vector array<double>").fields])

    def run(batches):
        for batch in batches:
            for length, (at, x) in rows_by_length(batch.column(1)).items():
                norm = np.sqrt((x * x).sum(axis=1))
                sound = (norm > 0) & np.isfinite(norm)
                unit = x[sound] / norm[sound][:, None]
                ends = pa.array(np.arange(len(unit) + 1, dtype=np.int32) * length)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at[sound])), pa.ListArray.from_arrays(ends, pa.array(unit.ravel()))], names=out.names)

    bounded_batches(vectors.sparkSession)
    return with_digests(kept.mapInArrow(run, out), "vector")


def _distinct(rows: DataFrame, *by: str) -> DataFrame:
    """same, vector, key (the least) and n (how many) of equal vectors."""
    return rows.groupBy(*by, "same", "vector").agg(F.min("key").alias("key"), F.count(F.lit(1)).alias("n"))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    rows = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(rows.flatten(), np.float64).reshape(len(rows), -1)


class VectorIndex:
    """Inverted lists of the vectors of a table with a long key."""

    def __init__(self, spark: SparkSession, path: str, key: str = "vec_id", column: str = "embedding"):
        self.spark, self.path, self.key, self.column = spark, path.rstrip("/"), key, column
        self._centres: np.ndarray | None = None

    def centres(self) -> np.ndarray:
        """The centroids, CENTROIDS rows at most."""
        if self._centres is None:
            rows = self.spark.read.parquet(f"{self.path}/centroids").orderBy("list").collect()
            self._centres = np.array([r["centre"] for r in rows]).reshape(len(rows), -1)
        return self._centres

    def probes(self) -> int:
        return self.spark.read.parquet(f"{self.path}/probes").first()["probes"]

    def _gens(self) -> int:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/deletes")
        files = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return sum(s.isDirectory() for s in files.listStatus(at)) if files.exists(at) else 0

    def stored(self) -> DataFrame:
        """key, vector, same, list, gen of all that is indexed and not deleted; filters on list prune folders."""
        gens = range(self._gens())
        rows = self.spark.read.schema("key long, vector array<double>, same binary, gen int, list int").option("basePath", f"{self.path}/lists").parquet(*(f"{self.path}/lists/gen={g}" for g in gens))
        dead = self.spark.read.schema("key long, dead int, gen int").option("basePath", f"{self.path}/deletes").parquet(*(f"{self.path}/deletes/gen={g}" for g in gens))
        return rows.join(dead.select("key", F.col("dead").alias("gen")), ["key", "gen"], "left_anti")

    def build(self, vectors: DataFrame, centroids: int | None = None, seed: int = 7) -> VectorIndex:
        """Fit the centroids, index every vector and calibrate the probes."""
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        rows = materialize(directions(spread(vectors), self.key, self.column), "directions")
        kinds, n = materialize(_distinct(rows), "distinct"), rows.count()
        c = max(1, min(CENTROIDS, kinds.count(), centroids or round(2 * math.sqrt(n))))
        sample = kinds.orderBy(F.xxhash64("key"), "key").limit(c * SAMPLE).select(array_to_vector("vector").alias("features"))
        if n:
            model = KMeans(k=c, seed=seed, maxIter=12, distanceMeasure="cosine").fit(materialize(sample, "sample"))
            centres = np.array([x for x in model.clusterCenters() if np.linalg.norm(x) > 0])
            centres = centres / np.linalg.norm(centres, axis=1, keepdims=True)
        else:
            centres = np.zeros((0, 0))
        self._centres = centres
        self.spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(centres)], "list int, centre array<double>").write.mode("overwrite").parquet(f"{self.path}/centroids")
        self._write(rows, rows.limit(0).select("key", F.lit(0).alias("dead")), 0)
        self.calibrate(rows)
        return self

    def apply(self, changed: DataFrame, removed: DataFrame) -> VectorIndex:
        """Delete the keys of removed and changed, and index changed under the centroids there are."""
        rows = materialize(directions(changed, self.key, self.column), "directions")
        gone = removed.select(F.col(self.key).alias("key")).union(changed.select(self.key)).distinct()
        dead = materialize(self.stored().join(gone, "key", "left_semi").select("key", F.col("gen").alias("dead")), "dead")
        self._write(rows, dead, self._gens())
        return self

    def _write(self, rows: DataFrame, dead: DataFrame, gen: int) -> None:
        lists = materialize(self.nearest(spread(_distinct(rows)), 1).select("key", F.col("near").alias("list")), "placed")
        lists = lists.join(rows.select("key", "same"), "key").select("same", "list")  # a row a distinct vector
        placed = materialize(rows.join(lists, "same").select("key", "vector", "same", "list"), "placed")
        sizes = placed.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / PART_ROWS).alias("files"))  # CENTROIDS rows at most
        placed = placed.join(F.broadcast(sizes), "list")
        file = F.pmod(F.xxhash64("key"), F.col("files"))  # a hot list is written by several tasks, any other as one file
        placed.repartition("list", file).drop("files").write.mode("overwrite").partitionBy("list").parquet(f"{self.path}/lists/gen={gen}")
        dead.write.mode("overwrite").parquet(f"{self.path}/deletes/gen={gen}")

    def nearest(self, rows: DataFrame, probes: int) -> DataFrame:
        """key, vector, near, place: a row for each of the nearest `probes` centroids, with its place among them."""
        shared = self.spark.sparkContext.broadcast(self.centres())  # CENTROIDS rows at most
        schema = pa.schema([("key", pa.int64()), ("vector", pa.list_(pa.float64())), ("near", pa.int32()), ("place", pa.int32())])

        def run(batches):
            centres = shared.value
            m = min(probes, len(centres))
            for batch in batches:
                if batch.num_rows and m:
                    score = _matrix(batch.column("vector")) @ centres.T
                    near = np.argsort(-score, axis=1, kind="stable")[:, :m] if m > 1 else score.argmax(axis=1)[:, None]
                    at = pa.array(np.repeat(np.arange(batch.num_rows), m))
                    yield pa.RecordBatch.from_arrays([batch.column("key").take(at), batch.column("vector").take(at), pa.array(near.ravel().astype(np.int32)), pa.array(np.tile(np.arange(m, dtype=np.int32), batch.num_rows))], schema=schema)

        return rows.select("key", "vector").mapInArrow(run, "key long, vector array<double>, near int, place int")

    def calibrate(self, rows: DataFrame) -> None:
        """Store the fewest probes whose recall at ten reaches RECALL on ASKED sampled queries: one search of all lists, and the place of
        each neighbour's list among its query's."""
        sample = materialize(rows.orderBy(F.xxhash64("key", F.lit("asked")), "key").limit(ASKED), "sampled")
        most, probes = len(self.centres()), 1
        if most:
            asked = sample.select(F.col("key").alias(self.key), F.col("vector").alias(self.column))
            truth = self.search(asked, 10, most).select("query_id", F.col(self.key).alias("key")).join(self.stored().select("key", "list"), "key")
            places = self.nearest(sample, most).select(F.col("key").alias("query_id"), F.col("near").alias("list"), "place")
            counts = {r["place"]: r["n"] for r in truth.join(places, ["query_id", "list"]).groupBy("place").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a list
            needed, found = RECALL * sum(counts.values()), 0
            for place in sorted(counts):
                found, probes = found + counts[place], place + 1
                if found >= needed:
                    break
        self.spark.createDataFrame([(probes,)], "probes int").write.mode("overwrite").parquet(f"{self.path}/probes")

    def search(self, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
        """query_id, key, similarity, rank: the k most similar of each query's probed lists, its own key left out."""
        return self.search_read(queries, k, probes)[0]

    def search_read(self, queries: DataFrame, k: int, probes: int | None = None) -> tuple[DataFrame, DataFrame]:
        """search, and query_id, read: the rows of the lists that each query probed."""
        rows, probes = materialize(directions(queries, self.key, self.column), "queries"), probes or self.probes()
        every = probes >= len(self.centres())  # all lists are one then: a query goes to each part of it, not to each list
        kinds = _distinct(rows).select("key", "vector", "same")
        near = kinds.withColumn("near", F.lit(0)) if every else self.nearest(spread(kinds), probes).join(rows.select("key", "same"), "key")
        asked = materialize(near.select(F.col("same").alias("asked"), F.col("vector").alias("sought"), F.col("near").alias("list")), "asked")
        if every:
            held = self.stored().withColumn("list", F.lit(0))
        else:
            wanted = [r["list"] for r in asked.select("list").distinct().collect()]  # CENTROIDS rows at most
            held = self.stored().filter(F.col("list").isin(wanted))
        groups = materialize(_distinct(held, "list"), "held")
        sizes = materialize(groups.groupBy("list").agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("kinds")), "sizes")
        parts = F.ceil(F.col("kinds") / PART_ROWS).cast("int")
        read = asked.join(F.broadcast(sizes), "list").groupBy("asked").agg(F.sum("rows").alias("read"))
        askers = rows.select(F.col("same").alias("asked"), F.col("key").alias("query_id"))
        read = askers.join(read, "asked").select("query_id", "read")
        a = asked.join(F.broadcast(sizes), "list").select("asked", "sought", "list", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
        b = groups.join(F.broadcast(sizes), "list").select("key", "vector", "same", "list", F.pmod(F.xxhash64("key"), parts).cast("int").alias("part"))
        most = k + 1
        schema = pa.schema([("asked", pa.binary()), ("same", pa.binary()), ("key", pa.int64()), ("similarity", pa.float64())])

        def best(left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows or not right.num_rows:
                return schema.empty_table()
            keys, out = right.column("key").to_numpy(), []
            held = _matrix(right.column("vector"))
            for first in range(0, left.num_rows, 512):
                score = np.round(_matrix(left.column("sought").slice(first, 512)) @ held.T, 12)
                for q, s in enumerate(score, first):
                    at = np.flatnonzero(s >= np.partition(s, -most)[-most]) if len(s) > most else np.arange(len(s))
                    at = at[np.lexsort((keys[at], -s[at]))][:most]
                    out.append((np.full(len(at), q), at, s[at]))
            row, at, value = (np.concatenate(c) for c in zip(*out))
            at = pa.array(at)
            return pa.Table.from_arrays([left.column("asked").take(pa.array(row)), right.column("same").take(at), right.column("key").take(at), pa.array(value)], schema=schema)

        found = a.groupBy("list", "part").cogroup(b.groupBy("list", "part")).applyInArrow(best, "asked binary, same binary, key long, similarity double")
        nth = F.row_number().over(W.partitionBy("asked").orderBy(F.desc("similarity"), "key"))
        met = materialize(found.withColumn("nth", nth).filter(F.col("nth") <= most).select("asked", "same", "similarity"), "met")
        top = of_classes(met, least_keys(held, ["same"], "key", most), askers, k, "key")
        return top.select("query_id", F.col("key").alias(self.key), "similarity", "rank"), read
