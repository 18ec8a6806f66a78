"""What the operators of this subpackage share: input columns, work tables, Arrow batches and group streams."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.work import BATCH_BYTES, BATCH_ROWS, bounded_batches, materialize, shared_dir  # noqa: F401  (for the operators)

#: Bytes of the texts that an operator works on at once.
CHUNK_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def byte_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    return [b or b"" for b in column.cast(pa.binary()).to_pylist()]


def byte_slices(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices whose texts in column hold about most bytes; a longer text is a slice of its own."""
    import pyarrow.compute as pc

    first = held = 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()):
        if held and held + n > most:
            yield batch.slice(first, i - first)
            first, held = i, 0
        held += n
    yield batch.slice(first)


def str_texts(column: pa.Array) -> list[str]:
    return [t or "" for t in column.to_pylist()]


def map_batches(df: DataFrame, schema: str, per_batch: Callable[[], Callable[[pa.RecordBatch], Iterable[dict]]]) -> DataFrame:
    """mapInArrow with state for a task: per_batch() runs once in each task and returns a function from a batch to columns.  Batches
    come in slices of CHUNK_BYTES of the column text or html, where there is one."""
    bounded_batches(df.sparkSession)
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    out = to_arrow_schema(StructType.fromDDL(schema))
    long = next((c for c in ("text", "html") if c in df.columns), None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = per_batch()
        for batch in batches:
            for part in byte_slices(batch, long, CHUNK_BYTES) if long else (batch,):
                if part.num_rows:
                    for columns in each(part):
                        yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in out], schema=out)

    return df.mapInArrow(run, schema)


def sorted_groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, Iterator[dict]]]:
    """(key, rows) of batches that come sorted by key; rows stream, so that a group is never held as a whole."""
    rows = (row for batch in batches for row in batch.to_pylist())
    current = next(rows, None)

    def members(key: tuple) -> Iterator[dict]:
        nonlocal current
        while current is not None and tuple(current[k] for k in keys) == key:
            row, current = current, next(rows, None)
            yield row

    while current is not None:
        key = tuple(current[k] for k in keys)
        group = members(key)
        yield key, group
        for _ in group:
            pass


def crc32_of_id(column: str = "doc_id"):
    """crc32 of an id as decimal text, the split all learning operators use."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def hash_sample(df: DataFrame, key: str, size: int, *ties: str) -> DataFrame:
    """The `size` rows with the smallest hashes of key, or all if they are fewer.  A threshold on the hash, from the number of
    rows, leaves little more than the sample before anything is sorted."""
    n = df.count()
    h = F.xxhash64(key)
    if n > 2 * size:
        df = df.filter(F.pmod(h, F.lit(1 << 30)) < int((1.5 * size + 200) / n * (1 << 30)))
    return df.orderBy(F.pmod(h, F.lit(1 << 30)), h, key, *ties).limit(size)
