"""Work tables in the folder all executors share."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder of our own only where the session names none and all its tasks run on this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if known.isDefined():
            return known.get().rstrip("/")
        if not (spark.sparkContext.master or "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='marlstone-')}"
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


#: Rows and bytes of one Arrow batch: these bound what a Python worker holds.
BATCH_ROWS, BATCH_BYTES = 2000, 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session by rows and by bytes."""
    conf = spark.conf
    rows = int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", None) or 10000)
    if rows <= 0 or rows > BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df as a work table and read it back, which ends its lineage; the loops of iterative operators run on these."""
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def bucketed(spark: SparkSession, parts: int):
    """A function that writes a DataFrame in `parts` buckets of a column to the shared folder and reads it back, so that joins on that
    column need no shuffle; the catalog forgets these tables at the end, the files stay.  Rows that lie in these buckets already, for
    they come from such a table by steps that keep its partitions, are written as they lie (dealt)."""
    names: list[str] = []

    def keep(df: DataFrame, by: str, dealt: bool = False) -> DataFrame:
        names.append(f"marlstone_{uuid.uuid4().hex}")
        rows = df if dealt else df.repartition(parts, by)
        rows.write.bucketBy(parts, by).option("path", f"{shared_dir(spark)}/{names[-1]}").format("parquet").saveAsTable(names[-1])
        return spark.table(names[-1])

    try:
        yield keep
    finally:
        for name in names:
            spark.sql(f"drop table if exists {name}")
