"""Structured Streaming forms of the logs: a growing log as a stream, incremental counts, supersession, incremental refresh.

Each stream runs with a checkpoint of its own and an available-now trigger by default, so that it takes up where it
stopped; sinks are idempotent (a batch is written under its number)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery


def event_stream(spark: SparkSession, path: str, schema, file_format: str = "json", files_per_trigger: int = 64) -> DataFrame:
    """A directory of log files as a stream; new files are taken as they come."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).format(file_format).load(path)


def windowed_counts(events: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Events by window and kind; rows later than the watermark are left out, so that state stays bounded."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "kind").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))


def run_to_end(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], mode: str = "append") -> StreamingQuery:
    """Process what is there, batch by batch, and stop."""
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start()
    query.awaitTermination()
    return query


def append_to(path: str) -> Callable[[DataFrame, int], None]:
    """A sink of Parquet parts, one directory a batch: a batch that is replayed replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def refresh(sources: DataFrame, cache_path: str, extract: Callable[[DataFrame], DataFrame], checkpoint: str) -> StreamingQuery:
    """Incremental refresh: each batch of sources(path, content) is extracted only where its content hash is not in the cache
    (path, hash, extracted columns) yet.  A batch that is replayed is held against the batches before it alone, never against its own
    rows, and so replaces its folder by the same rows."""
    spark = sources.sparkSession

    def each(batch: DataFrame, number: int) -> None:
        fresh = batch.withColumn("hash", F.sha2("content", 256))
        if _exists(spark, cache_path):  # not before the first batch
            known = spark.read.parquet(cache_path).filter(F.col("batch") < number).select("path", "hash")
            fresh = fresh.join(known, ["path", "hash"], "left_anti")
        extract(fresh).write.mode("overwrite").parquet(f"{cache_path}/batch={number}")

    return run_to_end(sources, checkpoint, each)


class Superseded(StatefulProcessor):
    """For each record id: its first record, its own mark and the least id that claims to supersede it.  A change is given out when the
    record comes and whenever its mark changes."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "record string, own string, by string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        record, own, by = self.held.get() if self.held.exists() else (None, None, None)
        before = record is not None, own or by
        for part in rows:
            for r, o, b in zip(part["record"], part["own"], part["by"]):
                if isinstance(r, str) and record is None:
                    record, own = r, o if isinstance(o, str) else None
                if isinstance(b, str) and (by is None or b < by):
                    by = b
        self.held.update((record, own, by))
        if record is not None and before != (True, own or by):
            yield pd.DataFrame({"id": [key[0]], "record": [record], "superseded_by": [own or by]})

    def close(self) -> None:
        pass


def supersede(events: DataFrame, changes_path: str, checkpoint: str) -> StreamingQuery:
    """Follow events (id, supersedes, superseded_by, more) and write the changes of each batch: records as they come, and again whenever
    a later one supersedes them, at changes_path/batch=n.  State is kept by record id in a RocksDB store, so that a batch costs what it
    holds, however many events came before; a replayed batch replaces its folder."""
    spark = events.sparkSession
    record = F.to_json(F.struct(*(c for c in events.columns if c != "superseded_by")))
    none = F.lit(None).cast("string")
    own = events.select("id", record.alias("record"), F.col("superseded_by").cast("string").alias("own"), none.alias("by"), F.col("supersedes").alias("of"))
    each = F.explode(F.array(F.struct("id", "record", "own", none.alias("by")), F.struct(F.col("of").alias("id"), none.alias("record"), none.alias("own"), F.col("id").alias("by"))))
    routed = own.select(each.alias("x")).select("x.*").filter("id is not null")  # a claim goes to the record that it names
    changes = routed.groupBy("id").transformWithStateInPandas(Superseded(), "id string, record string, superseded_by string", "Update", "None")
    provider = "spark.sql.streaming.stateStore.providerClass"
    usual = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        return run_to_end(changes, checkpoint, append_to(changes_path), "update")
    finally:
        spark.conf.set(provider, usual)


def current(spark: SparkSession, changes_path: str, schema: str) -> DataFrame:
    """The records (schema) with superseded_by as the last of their changes says."""
    changes = spark.read.parquet(changes_path)
    last = changes.groupBy("id").agg(F.max_by(F.struct("record", "superseded_by"), "batch").alias("x"))
    return last.select(F.from_json("x.record", schema).alias("r"), "x.superseded_by").select("r.*", "superseded_by")
