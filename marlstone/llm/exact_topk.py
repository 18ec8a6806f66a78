"""Exact top-k search by exhaustive term-at-a-time accumulation.

Every vector is a sparse row of integer weights, floor(scale * x) by dimension.  Candidates are dealt to tasks once and
stream through them in blocks; a block is turned into posting lists, for each dimension the candidates with a weight
there and these weights.  Queries come in groups of bounded size, which are broadcast.  For each query its terms, one
after another, scatter their posting list times the query's weight into a dense array of scores, some queries at a
time; the block's best k are selected by partition and merged into the task's best k, and the tasks' by query.  A
posting list that holds most of a block is kept as a full row, zeros and all, so that its scatter is one run of memory.

The work is queries times candidates, as an exhaustive search has it; a group of queries is one pass over the
candidates, which are not shuffled again.

Defined cases: vectors that are null or hold null or non-finite components, and rows without vec_id, take no part;
missing dimensions weigh nothing; all candidates are returned where there are fewer than k; ties go to the smaller
vec_id; of repeated rows each is a candidate, those with the query's own id are not, and a repeated query id is asked
once, with its smallest vector; scores beyond a long are clipped; empty tables give an empty result; extra columns
are ignored.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marlstone.llm.common import bounded_batches, materialize, shared_dir

#: Candidates in a block, queries that accumulate at once, and bytes of a group of queries.
CANDIDATE_BLOCK, QUERIES_AT_ONCE, GROUP_BYTES = 4096, 256, 8 << 20
_FAR = np.iinfo(np.int64)
_FOUND = "query_id long, vec_id long, score long"


def integer_rows(vectors: list, scale: int) -> np.ndarray:
    """Row-major weights: int64, or Python integers where one does not fit."""
    dims = max(map(len, vectors), default=0)
    x = np.zeros((len(vectors), dims))
    for row, v in zip(x, vectors):
        row[: len(v)] = v
    x = np.floor(scale * x)
    if x.size and np.abs(x).max() >= 2.0**62:
        return np.asarray([[int(c) for c in row] for row in x], object)
    return x.astype(np.int64)


def largest(x: np.ndarray) -> int:
    return int(np.abs(x).max()) if x.size else 0


def posting_lists(weights: np.ndarray, kind) -> list[tuple[np.ndarray | None, np.ndarray]]:
    """For each dimension the rows with a weight there, None for a full row, and the weights."""
    lists = []
    for column in np.ascontiguousarray(weights.T).astype(kind):
        at = np.flatnonzero(column)
        lists.append((None, column) if 2 * len(at) > len(column) else (at, column[at]))
    return lists


def accumulate(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Scores of all candidates for each query, a term at a time."""
    dims = min(queries.shape[1], candidates.shape[1])
    top = largest(queries) * largest(candidates) * max(dims, 1)
    kind = np.int32 if top < 2**31 else np.int64 if top < 2**63 else object
    return scatter(queries.astype(kind), posting_lists(candidates, kind), len(candidates))


def scatter(queries: np.ndarray, lists: list[tuple[np.ndarray | None, np.ndarray]], n: int) -> np.ndarray:
    scores = np.zeros((len(queries), n), queries.dtype)
    buffer = np.empty((16, n), queries.dtype)
    for first in range(0, len(queries), 16):  # scores of some queries stay in the processor's cache
        part, asked = scores[first : first + 16], queries[first : first + 16]
        for (at, weights), terms in zip(lists, asked.T):
            if not len(weights) or not terms.any():
                continue
            if at is None:
                part += np.multiply.outer(terms, weights, out=buffer[: len(part)])
            else:
                part[:, at] += np.multiply.outer(terms, weights)
    return scores


def select(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(scores, ids) of each query's best k in the block, in no order; ids rise, own are the queries' ids.  What is no candidate
    has the least score."""
    n = len(ids)
    if scores.dtype == object:
        scores = np.asarray([[min(max(int(s), _FAR.min + 1), _FAR.max) for s in row] for row in scores], np.int64).reshape(scores.shape)
    scores = scores.astype(np.int64)
    scores[own[:, None] == ids[None, :]] = _FAR.min
    if n <= k:
        return scores, np.broadcast_to(ids, scores.shape)
    if largest(np.where(scores == _FAR.min, 0, scores)) < 2**62 // n:
        key = np.where(scores == _FAR.min, _FAR.min, scores * n + (n - 1 - np.arange(n)))
        best = np.argpartition(key, n - k, axis=1)[:, n - k :]
    else:
        best = np.stack([np.lexsort((ids, ~s))[:k] for s in scores])  # ~s rises as s falls
    return np.take_along_axis(scores, best, 1), ids[best]


def merged(a: tuple[np.ndarray, np.ndarray] | None, b: tuple[np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    """The best k of two selections by query, by falling score, then rising id."""
    scores, ids = b if a is None else (np.concatenate([x, y], axis=1) for x, y in zip(a, b))
    order = np.lexsort((ids, ~scores), axis=1)[:, :k]
    return np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)


def _candidate_blocks(batches, rows: int):
    """(ids, vectors) of at most rows candidates, ids rising."""
    held: list = []
    for batch in batches:
        held += zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
        while len(held) >= rows:
            yield sorted(held[:rows], key=lambda r: r[0])
            held = held[rows:]
    if held:
        yield sorted(held, key=lambda r: r[0])


def search_group(candidates: DataFrame, own: np.ndarray, asked: np.ndarray, k: int, scale: int) -> DataFrame:
    """query_id, vec_id, score: the best k in each task's candidates for the queries own with weights asked."""
    shared = candidates.sparkSession.sparkContext.broadcast((own, asked))  # about GROUP_BYTES
    bounded_batches(candidates.sparkSession)
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(batches):
        own, asked = shared.value
        best: dict[int, tuple] = {}
        bound = largest(asked)
        for block in _candidate_blocks(batches, CANDIDATE_BLOCK):
            ids = np.asarray([i for i, _ in block], np.int64)
            weights = integer_rows([v for _, v in block], scale)
            top = bound * largest(weights) * max(min(asked.shape[1], weights.shape[1]), 1)
            kind = np.int32 if top < 2**31 else np.int64 if top < 2**63 else object
            lists = posting_lists(weights, kind)
            for at in range(0, len(own), QUERIES_AT_ONCE):
                scores = scatter(asked[at : at + QUERIES_AT_ONCE].astype(kind), lists, len(ids))
                best[at] = merged(best.get(at), select(scores, ids, own[at : at + QUERIES_AT_ONCE], k), k)
        for at, (scores, ids) in best.items():
            rows, columns = np.nonzero(scores != _FAR.min)
            yield pa.RecordBatch.from_arrays([pa.array(own[at + rows]), pa.array(ids[rows, columns]), pa.array(scores[rows, columns])], schema=schema)

    return candidates.select("vec_id", "embedding").mapInArrow(run, _FOUND)


def search(vectors: DataFrame, is_query, k: int = 20, scale: int = 64) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates among vectors for each row of vectors where is_query holds."""
    spark = vectors.sparkSession
    usable = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    clean = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).filter(F.col("vec_id").isNotNull() & usable)
    clean = materialize(clean, "vectors")
    candidates = materialize(clean.repartition(max(1, -(-clean.count() // CANDIDATE_BLOCK))), "candidates")
    asked = materialize(clean.filter(is_query).groupBy("vec_id").agg(F.min("embedding").alias("embedding")), "asked")
    size = asked.agg(F.sum(8 * (F.size("embedding") + 1))).first()[0] or 0
    groups = max(1, -(-size // GROUP_BYTES))
    path = f"{shared_dir(spark)}/groups-{uuid.uuid4().hex}"
    asked.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(groups))).write.partitionBy("part").parquet(path)
    found = f"{shared_dir(spark)}/found-{uuid.uuid4().hex}"
    for part in range(groups):
        rows = sorted((r["vec_id"], r["embedding"]) for r in spark.read.schema("vec_id long, embedding array<double>, part long").parquet(path).filter(F.col("part") == part).collect())  # about GROUP_BYTES
        own, weights = np.asarray([i for i, _ in rows], np.int64), integer_rows([v for _, v in rows], scale)
        search_group(candidates, own, weights, k, scale).write.mode("append").parquet(found)
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return spark.read.schema(_FOUND).parquet(found).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
