"""Whitening of embeddings by their leading principal components.

Entries become integers, x = floor(scale * c).  The fit runs over each distinct vector once: n vectors with exact sums S, so that a
centred vector is (n * x - S) / n, an exact integer divided once, whatever the mean.  A randomised range finder draws a Gaussian test
matrix with OVERSAMPLING columns more than components; each power pass multiplies the covariance with the basis in one pass over all
centred rows (every task sums its rows' share of the product, Spark sums the shares by cell), and Rayleigh-Ritz on the result gives
eigenvalues, vectors and residuals.  Passes go on while the residuals fall fast enough to reach TOLERANCE within PASSES; otherwise the
basis is expanded to the full dimension, where Rayleigh-Ritz is the eigendecomposition of the whole covariance.  The driver holds
matrices of dimension by basis alone, never rows.

Defined cases: vectors that are null or hold null or non-finite entries take no part; missing trailing entries are zeros; entries beyond
a long are cut to its range; copies count once for the fit and are each given back, as are rows without vec_id; equal eigenvalues share
any basis of their space; components without variance (rank below the number asked) are left out, so that a table of equal vectors, or an
empty one, gives an empty result; deviations beyond a long are cut to it; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import bounded_batches, materialize

#: Columns of the basis beyond the components, power passes at most, residuals allowed as shares of the largest eigenvalue, and the seed.
OVERSAMPLING, PASSES, TOLERANCE, SEED = 10, 8, 1e-13, 20
#: An eigenvalue counts as variance from this share of the trace on.
LEAST_SHARE = 1e-14
_LONG = np.iinfo(np.int64)


class Centre:
    """n and the sums of the fitted vectors; centred() gives n * x - S exactly."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums = n, sums

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - S for rows of x: int64 where all fits, else Python integers."""
        far = max(map(abs, self.sums), default=0) + self.n * (max(abs(int(x.max())), abs(int(x.min()))) if x.size else 0)
        if far < 2**62:
            return self.n * x - np.asarray(self.sums, np.int64)
        return self.n * x.astype(object) - np.asarray(self.sums, object)

    def rows(self, x: np.ndarray) -> np.ndarray:
        return (self.centred(x) / self.n).astype(np.float64)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column of one length."""
    return np.asarray(column.flatten(), np.int64).reshape(len(column), width)


def integer_vectors(embeddings: DataFrame, scale: int) -> DataFrame:
    """vec_id, x (array of long) of the rows that take part, all of one length."""
    c = F.col("embedding")
    finite = F.forall(c, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) < float("inf")))
    rows = embeddings.filter(c.isNotNull() & finite).select("vec_id", F.transform(c, lambda e: F.floor(scale * e.cast("double"))).alias("x"))
    width = F.lit(rows.agg(F.max(F.size("x"))).first()[0] or 0)
    return rows.select("vec_id", F.concat("x", F.array_repeat(F.lit(0).cast("long"), width - F.size("x"))).alias("x"))


def summed(rows: DataFrame, shape: tuple[int, ...], share: Callable[[np.ndarray], np.ndarray], width: int) -> np.ndarray:
    """The sum of share(x) over blocks of rows; each task adds up its own blocks, cells are summed by Spark."""
    bounded_batches(rows.sparkSession)
    schema = pa.schema([("cell", pa.int64()), ("value", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            total += share(matrix(batch.column(0), width))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel()[at])], schema=schema)

    out = np.zeros(shape)
    for r in rows.select("x").mapInArrow(run, "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect():
        out.flat[r["cell"]] = r["value"]  # as many rows as the matrix has cells
    return out


def centre_of(rows: DataFrame, width: int) -> Centre:
    """Exact sums of the distinct vectors."""
    bounded_batches(rows.sparkSession)
    schema = pa.schema([("cell", pa.int64()), ("value", pa.decimal128(38, 0))])

    def run(batches):
        total = [0] * (width + 1)
        for batch in batches:
            x = matrix(batch.column(0), width)
            exact = x if not x.size or np.abs(x.astype(np.float64)).max() < 2.0**40 else x.astype(object)  # 2000 rows a batch
            total = [a + int(b) for a, b in zip(total, [*exact.sum(0), len(x)])]
        yield pa.RecordBatch.from_arrays([pa.array(range(width + 1), pa.int64()), pa.array(map(Decimal, total), schema[1].type)], schema=schema)

    found = {r["cell"]: int(r["value"]) for r in rows.mapInArrow(run, "cell long, value decimal(38,0)").groupBy("cell").agg(F.sum("value").alias("value")).collect()}
    return Centre(found.get(width, 0), [found.get(i, 0) for i in range(width)])


class Components:
    """Unit vectors (columns) by falling eigenvalue, the trace of the covariance and how the fit went."""

    def __init__(self, vectors: np.ndarray, values: np.ndarray, trace: float, passes: int, full: bool):
        self.vectors, self.values, self.trace, self.passes, self.full = vectors, values, trace, passes, full

    def whitened(self, centre: Centre, x: np.ndarray) -> np.ndarray:
        return centre.rows(x) @ self.vectors / np.sqrt(self.values)


def rayleigh_ritz(basis: np.ndarray, product: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Ritz values and vectors of the leading components, and their largest residual norm."""
    small = basis.T @ product
    values, inner = np.linalg.eigh((small + small.T) / 2)
    values, inner = values[::-1][:most], inner[:, ::-1][:, :most]
    vectors = basis @ inner
    residual = np.linalg.norm(product @ inner - vectors * values, axis=0).max() if most else 0.0
    return values, vectors / np.linalg.norm(vectors, axis=0), residual


def fit_components(fit: DataFrame, centre: Centre, most: int) -> Components:
    """The leading components of the covariance of the rows of fit."""
    width, n = len(centre.sums), centre.n
    most = min(most, width)
    spark = fit.sparkSession

    def product(basis: np.ndarray) -> tuple[np.ndarray, float]:
        """Covariance times basis, and the trace: one pass over all centred rows."""
        shared = spark.sparkContext.broadcast(basis)

        def share(x: np.ndarray) -> np.ndarray:
            rows = centre.rows(x)
            return np.vstack([rows.T @ (rows @ shared.value), np.full((1, shared.value.shape[1]), (rows * rows).sum())])

        total = summed(fit, (width + 1, basis.shape[1]), share, width) / n
        shared.destroy()
        return total[:-1], float(total[-1, 0])

    size = min(width, most + OVERSAMPLING)
    basis, full, last = np.random.default_rng(SEED).standard_normal((width, size)), size == width, None
    basis = np.eye(width) if full else np.linalg.qr(basis)[0]
    for done in range(1, PASSES + 2):
        found, trace = product(basis)
        values, vectors, residual = rayleigh_ritz(basis, found, most)
        allowed = TOLERANCE * max(abs(values[0]), 1e-300)
        if full or residual <= allowed:
            break
        left = PASSES - done
        if left <= 0 or (last is not None and residual * (residual / last) ** left > allowed):
            basis, full = np.eye(width), True
        else:
            basis, last = np.linalg.qr(found)[0], residual
    keep = values > LEAST_SHARE * trace
    values, vectors = values[keep], vectors[:, keep]
    lead = np.abs(vectors).argmax(0) if vectors.size else []
    vectors = vectors * np.where(vectors[lead, np.arange(vectors.shape[1])] < 0, -1.0, 1.0)
    return Components(vectors, values, trace, done, full)


def identity_error(fit: DataFrame, centre: Centre, components: Components) -> float:
    """The largest entry of the whitened rows' covariance minus the identity, in absolute terms."""
    k, width = len(components.values), len(centre.sums)
    mean = summed(fit, (k,), lambda x: components.whitened(centre, x).sum(0), width) / centre.n

    def share(x: np.ndarray) -> np.ndarray:
        w = components.whitened(centre, x) - mean
        return w.T @ w

    return float(np.abs(summed(fit, (k, k), share, width) / centre.n - np.eye(k)).max())


def whiten(embeddings: DataFrame, most: int = 4, scale: int = 256) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error for each row and component."""
    spark = embeddings.sparkSession
    bounded_batches(spark)
    rows = materialize(integer_vectors(embeddings, scale), "vectors")
    fit = materialize(rows.select("x").distinct(), "fit")
    head = fit.select(F.size("x")).first()
    out_schema = pa.schema([("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())])
    ddl = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if head is None or not head[0]:
        return spark.createDataFrame([], ddl)
    width = head[0]
    centre = centre_of(fit, width)
    components = fit_components(fit, centre, most)
    k = len(components.values)
    if not k:
        return spark.createDataFrame([], ddl)
    error = identity_error(fit, centre, components)
    explained = components.values / components.trace

    def run(batches):
        for batch in batches:
            x = matrix(batch.column("x"), width)
            u = centre.centred(x)
            squares = ((u if _squares_fit(u) else u.astype(object)) ** 2).sum(1)
            deviation = np.asarray([min(int(s), _LONG.max) for s in squares], np.int64)
            w = components.whitened(centre, x)
            m = len(x)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id").take(pa.array(np.repeat(np.arange(m), k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, centre.n)),
                    pa.array(np.repeat(deviation, k)),
                    pa.array(w.ravel()),
                    pa.array(np.tile(explained, m)),
                    pa.array(np.full(m * k, error)),
                ],
                schema=out_schema,
            )

    return rows.mapInArrow(run, ddl)


def _squares_fit(u: np.ndarray) -> bool:
    """Whether a row's sum of squares stays within a long."""
    return u.dtype != object and (not u.size or float(np.abs(u.astype(np.float64)).max()) ** 2 * u.shape[1] < 2.0**62)
