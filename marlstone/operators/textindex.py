"""A stored inverted index over weighted fields, with delta maintenance and exact top-k that skips blocks by their bound.

Tables under the index's path, all plain Parquet, one part `gen=n` for each build or delta:

* postings, partitioned by bucket (of a term's lead of LEAD characters) and sorted by term: one row a block, that is the postings of a
  term in a slice of SLICE documents, with the block's greatest term frequency and least document length;
* documents: doc, slice, dl (its words, unweighted), terms; slices are cut in order of length, so that blocks' bounds differ;
* frequencies, partitioned by bucket: df of each term, negative in the deltas that delete;
* sizes: documents and words added, negative where deleted;
* deletes: doc and the part that held it.

A search reads the buckets of its terms alone.  It first reads the blocks' bounds without their postings, scores the slices with the
highest bounds, and then only those further slices whose bound reaches the k-th score: scores and order equal those of BM25 over the
texts.  A changed document is deleted and added in one delta; nothing of older parts is rewritten."""

from __future__ import annotations

import math
import zlib
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marlstone.functions import text as T
from marlstone.operators.fulltext import B, K1
from marlstone.operators.ranking import numbered
from marlstone.work import bounded_batches, materialize

BUCKETS, LEAD, SLICE = 64, 3, 128
#: Decimal places of scores.
PLACES = 9
#: Weights of a declaration's fields.
NODE_FIELDS = {"id": 0.0, "name": 10.0, "qualified_name": 4.0, "docstring": 1.0, "signature": 2.0}

_SCHEMAS = {
    "postings": "term string, slice long, n int, max_tf double, min_dl long, docs array<string>, tfs array<double>, dls array<long>, gen int, bucket int",
    "documents": "doc string, slice long, dl long, terms array<string>, gen int",
    "frequencies": "term string, df long, gen int, bucket int",
    "sizes": "n long, words long, gen int",
    "deletes": "doc string, dead int, gen int",
}


def bucket_of(term: Column) -> Column:
    return (F.crc32(F.substring(term, 1, LEAD).cast("binary")) % BUCKETS).cast("int")


def bucket_of_word(term: str) -> int:
    return zlib.crc32(term[:LEAD].encode()) % BUCKETS


_COUNTED = "doc string, dl long, terms array<string>, tfs array<double>"
_BLOCK = "term string, slice long, n int, max_tf double, min_dl long, docs array<string>, tfs array<double>, dls array<long>"


def _counted(docs: DataFrame, key: str, fields: dict[str, float]) -> DataFrame:
    """doc, dl, its terms and their weighted frequencies, in one pass over the texts in which only counts leave a document."""
    bounded_batches(docs.sparkSession)
    weights = list(fields.values())

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            words = [T.split_words(batch.column(1 + i)) for i in range(len(weights))]
            sizes = [pc.list_value_length(w).to_numpy(zero_copy_only=False).astype(np.int64) for w in words]
            held = pa.concat_arrays([w.flatten() for w in words]).dictionary_encode()
            row = np.concatenate([np.repeat(np.arange(n), s) for s in sizes])
            weight = np.repeat(np.array(weights, np.float64), [int(s.sum()) for s in sizes])
            kinds = max(1, len(held.dictionary))
            pair, at = np.unique(row * kinds + held.indices.to_numpy(zero_copy_only=False).astype(np.int64), return_inverse=True)
            ends = pa.array(np.searchsorted(pair, np.arange(n + 1) * kinds).astype(np.int32))
            terms = pa.ListArray.from_arrays(ends, held.dictionary.take(pa.array(pair % kinds)))
            tfs = pa.ListArray.from_arrays(ends, pa.array(np.bincount(at, weights=weight, minlength=len(pair))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.sum(sizes, axis=0)), terms, tfs], names=["doc", "dl", "terms", "tfs"])

    texts = [F.lower(F.coalesce(F.col(f).cast("string"), F.lit(""))).alias(f"f{i}") for i, f in enumerate(fields)]
    return docs.select(F.col(key).cast("string").alias("doc"), *texts).mapInArrow(run, _COUNTED)


def _blocks(rows: pa.Table) -> pa.Table:
    """The blocks of a slice's documents (doc, dl, terms, tfs, slice): a row a term, documents in order."""
    rows = rows.sort_by("doc")
    terms, tfs, doc = (rows.column(c).combine_chunks() for c in ("terms", "tfs", "doc"))
    row = np.repeat(np.arange(rows.num_rows), pc.list_value_length(terms).to_numpy(zero_copy_only=False))
    held = terms.flatten().dictionary_encode()
    code = held.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(code, kind="stable")
    code, row, tf = code[order], row[order], tfs.flatten().to_numpy(zero_copy_only=False)[order]
    first = np.flatnonzero(np.diff(code, prepend=-1))
    dl = rows.column("dl").to_numpy()[row]
    ends = pa.array(np.append(first, len(code)).astype(np.int32))
    greatest, least = (np.maximum.reduceat(tf, first), np.minimum.reduceat(dl, first)) if len(first) else (tf, dl)
    columns = {
        "term": held.dictionary.take(pa.array(code[first])), "slice": pa.array(np.full(len(first), rows.column("slice")[0].as_py(), np.int64)), "n": pa.array(np.diff(np.append(first, len(code))).astype(np.int32)),
        "max_tf": pa.array(greatest), "min_dl": pa.array(least), "docs": pa.ListArray.from_arrays(ends, doc.take(pa.array(row))), "tfs": pa.ListArray.from_arrays(ends, pa.array(tf)), "dls": pa.ListArray.from_arrays(ends, pa.array(dl)),
    }
    return pa.table(columns)


class TextIndex:
    """An index of documents by a string key, over fields with weights."""

    def __init__(self, spark: SparkSession, path: str, fields: dict[str, float], slice_size: int = SLICE):
        self.spark, self.path, self.fields, self.slice_size = spark, path.rstrip("/"), dict(fields), slice_size

    def table(self, name: str) -> DataFrame:
        """A stored table; partition columns prune the scan."""
        return self.spark.read.schema(_SCHEMAS[name]).option("basePath", f"{self.path}/{name}").parquet(*(f"{self.path}/{name}/gen={g}" for g in range(self.parts(name))))

    def parts(self, name: str = "sizes") -> int:
        """How many parts the index has; a part is there once its sizes are written, which comes last."""
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/sizes")
        files = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not files.exists(at):
            return 0
        names = (str(s.getPath().getName()) for s in files.listStatus(at) if s.isDirectory())
        return 1 + max((int(n.removeprefix("gen=")) for n in names if n.startswith("gen=")), default=-1)

    def _write(self, name: str, rows: DataFrame, gen: int) -> None:
        by = ["bucket"] if "bucket" in rows.columns else []
        if by:
            rows = rows.repartition("bucket").sortWithinPartitions("bucket", "term")
        rows.write.mode("overwrite").partitionBy(*by).parquet(f"{self.path}/{name}/gen={gen}")

    def build(self, docs: DataFrame, key: str) -> TextIndex:
        """Index all documents; an index at the path is replaced."""
        none = docs.limit(0)
        for name in ("sizes", "postings", "documents", "frequencies", "deletes"):
            at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
            at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        self._add(docs, none.select(F.col(key).cast("string").alias("doc")), key, 0)
        return self

    def apply(self, changed: DataFrame, removed: DataFrame, key: str) -> TextIndex:
        """Delete the documents of removed(key) and changed, and add changed; documents never indexed may be among either."""
        gone = removed.select(F.col(key).cast("string").alias("doc")).union(changed.select(F.col(key).cast("string"))).distinct()
        self._add(changed, gone, key, self.parts())
        return self

    def live(self) -> DataFrame:
        """The indexed documents that no delta deleted: doc, slice, dl, terms, gen."""
        dead = self.table("deletes").select("doc", F.col("dead").alias("gen"))
        return self.table("documents").join(dead, ["doc", "gen"], "left_anti")

    def _add(self, docs: DataFrame, gone: DataFrame, key: str, gen: int) -> None:
        counted = materialize(_counted(docs, key, self.fields), "words")
        placed = numbered(counted, ["dl", "doc"], "place").withColumn("slice", F.floor(F.col("place") / self.slice_size)).drop("place")
        placed = materialize(placed, "slices")
        blocks = placed.filter("doc is not null").groupBy("slice").applyInArrow(_blocks, _BLOCK)  # at most a slice of documents
        self._write("postings", blocks.withColumn("bucket", bucket_of(F.col("term"))), gen)
        self._write("documents", placed.select("doc", "slice", "dl", "terms"), gen)
        dead = materialize((self.live().join(gone, "doc", "left_semi") if gen else self.spark.createDataFrame([], _SCHEMAS["documents"])), "dead")
        self._write("deletes", dead.select("doc", F.col("gen").alias("dead")), gen)
        held = self.spark.read.schema(_SCHEMAS["postings"]).parquet(f"{self.path}/postings/gen={gen}").select("term", F.col("n").alias("d"))
        df = held.union(dead.select(F.explode("terms"), F.lit(-1))).groupBy("term").agg(F.sum("d").alias("df"))
        self._write("frequencies", df.filter("df <> 0").withColumn("bucket", bucket_of(F.col("term"))), gen)
        change = placed.select(F.lit(1).alias("d"), "dl").union(dead.select(F.lit(-1), "dl"))
        sizes = change.agg(F.coalesce(F.sum("d"), F.lit(0)).cast("long").alias("n"), F.coalesce(F.sum(F.col("d") * F.col("dl")), F.lit(0)).cast("long").alias("words"))
        self._write("sizes", sizes, gen)

    def _of_terms(self, name: str, terms: list[str], prefix: bool) -> DataFrame:
        """The rows of a table for terms, or for all words that begin with one, from the terms' buckets alone."""
        rows = self.table(name)
        if not prefix:
            return rows.filter(F.col("bucket").isin(*{bucket_of_word(t) for t in terms}) & F.col("term").isin(*terms))
        if all(len(t) >= LEAD for t in terms):  # a shorter prefix has words in all buckets
            rows = rows.filter(F.col("bucket").isin(*{bucket_of_word(t) for t in terms}))
        return rows.filter(reduce(lambda a, b: a | b, (F.col("term").startswith(t) for t in terms)))

    def _alive(self, rows: DataFrame) -> DataFrame:
        return rows.join(self.table("deletes").select("doc", F.col("dead").alias("gen")), ["doc", "gen"], "left_anti")

    def _postings(self, terms: list[str], prefix: bool, slices: DataFrame | None = None) -> DataFrame:
        """doc, asked, tf, dl of the live postings, in the given slices (gen, slice)."""
        blocks = self._of_terms("postings", terms, prefix)
        if slices is not None:
            blocks = blocks.join(slices.select("gen", "slice"), ["gen", "slice"], "left_semi")
        each = blocks.select("gen", "term", F.explode(F.arrays_zip("docs", "tfs", "dls")).alias("p")).select("gen", "term", F.col("p.docs").alias("doc"), F.col("p.tfs").alias("tf"), F.col("p.dls").alias("dl"))
        each = self._alive(each)
        if not prefix:
            return each.select("doc", F.col("term").alias("asked"), "tf", "dl")
        begun = F.explode(F.filter(F.array(*map(F.lit, terms)), lambda t: F.col("term").startswith(t))).alias("asked")
        return each.select("doc", begun, "tf", "dl").groupBy("doc", "asked").agg(F.sum("tf").alias("tf"), F.max("dl").alias("dl"))

    def _weights(self, terms: list[str]) -> tuple[dict[str, float], float]:
        """idf of each term that a live document holds, and the mean length: a row a term at most, one row."""
        size = self.table("sizes").agg(F.sum("n").alias("n"), F.sum("words").alias("words")).first()
        n, words = size["n"] or 0, size["words"] or 0
        idf = F.log1p((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        found = self._of_terms("frequencies", terms, False).groupBy("term").agg(F.sum("df").alias("df")).filter("df > 0").select("term", idf.alias("idf"))
        return {r["term"]: r["idf"] for r in found.collect()}, words / n if n else 0.0

    def search(self, terms: list[str], limit: int, prefix: bool = False) -> DataFrame:
        """doc, score, matched of the `limit` best documents that hold any of the terms, best first."""
        return self.search_read(terms, limit, prefix)[0]

    def search_read(self, terms: list[str], limit: int, prefix: bool = False) -> tuple[DataFrame, int, int]:
        """search, and how many of its terms' slices were scored, of how many (-1 of -1 for prefixes, whose frequencies are not stored:
        they score all blocks of their buckets)."""
        terms = list(dict.fromkeys(t.lower() for t in terms))
        if prefix:
            n = self.table("sizes").agg(F.sum("n").alias("n"), (F.sum("words") / F.sum("n")).alias("avgdl")).first()
            held = materialize(self._postings(terms, True), "matches")
            counts = {r["asked"]: r["df"] for r in held.groupBy("asked").agg(F.count(F.lit(1)).alias("df")).collect()}  # a row a term
            idf = {t: math.log1p((n["n"] - d + 0.5) / (d + 0.5)) for t, d in counts.items()}
            return self._best(held, idf, n["avgdl"] or 0.0, limit), -1, -1
        idf, mean = self._weights(terms)
        if not idf:
            return self.spark.createDataFrame([], "doc string, score double, matched long"), 0, 0
        terms = sorted(idf)
        heads = self._of_terms("postings", terms, False).select("gen", "slice", "term", "n", "max_tf", "min_dl")
        bound = heads.groupBy("gen", "slice").agg(F.sum(impact(self._idf(idf, "term"), F.col("max_tf"), F.col("min_dl"), mean)).alias("bound"), F.max("n").alias("held"))
        bound = materialize(bound, "bounds")
        best = [F.desc("bound"), "gen", "slice"]
        before = F.coalesce(F.sum("held").over(W.orderBy(*best).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        first = bound.orderBy(*best).limit(limit).withColumn("before", before)  # a slice holds a document at least
        first = materialize(first.filter(F.col("before") < limit).select("gen", "slice"), "first")
        scored = materialize(self._best(self._postings(terms, False, first), idf, mean, limit), "best")
        last = scored.agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("s")).first()  # one row
        least = last["s"] if last["n"] >= limit else float("-inf")
        more = bound.filter(F.col("bound") >= least - 10**-PLACES if least > 0 else F.lit(True)).join(first, ["gen", "slice"], "left_anti")
        more = materialize(more, "more")
        both = scored.unionByName(self._best(self._postings(terms, False, more), idf, mean, limit))
        return both.orderBy(F.desc("score"), "doc").limit(limit), first.count() + more.count(), bound.count()

    @staticmethod
    def _idf(idf: dict[str, float], column: str) -> Column:
        return reduce(lambda c, t: c.when(F.col(column) == t, idf[t]), idf, F.when(F.lit(False), 0.0))

    def _best(self, postings: DataFrame, idf: dict[str, float], mean: float, limit: int) -> DataFrame:
        part = impact(self._idf(idf, "asked"), F.col("tf"), F.col("dl"), mean)
        # rounded, so that the order of a sum's terms decides no tie
        return postings.groupBy("doc").agg(F.round(F.sum(part), PLACES).alias("score"), F.count(F.lit(1)).alias("matched")).orderBy(F.desc("score"), "doc").limit(limit)


def impact(idf: Column, tf: Column, dl: Column, mean: float) -> Column:
    """What a term adds to a document's score; it grows with tf and falls with dl, so that a block's greatest tf and least dl bound it."""
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / F.lit(mean or 1.0)))
