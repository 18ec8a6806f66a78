"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

A text's letters, lower-cased, with all else as single spaces, give n-grams of ORDERS characters, hashed to FEATURES columns.  A feature's
value is its share of the text's n-grams times its inverse document frequency, which is counted over all labelled training texts.  The
weights are fitted by follow-the-regularised-leader with per-coordinate rates, an L1 and an L2 penalty on at most SAMPLE labelled rows, as
many of each language where there are enough: in every round SHARDS tasks each run the online updates over their rows from the same
state, and the changes are averaged in the order of the shards.  A temperature, the one with the least log loss on rows of the sample
that took no part in the fit, then scales the scores.  Everything else runs over all rows, on whole texts.

Only the text enters a prediction.  Rows whose crc32 of doc_id modulo 4 is 2 are held out: neither counts, nor fit, nor temperature see
them.

Defined cases: texts that are null or hold no letter are `und` with score 0; very long texts are read whole; rows without language are
predicted alike; of several rows of one doc_id each is predicted; a text of letters never seen gets the language of the bias; with one
language every text with letters is of it, with no labelled row all are `und`; ties go to the first language by name; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marlstone.llm.common import CHUNK_BYTES, bounded_batches, byte_slices, crc32_of_id, map_batches
from marlstone.work import bucketed

#: Characters of an n-gram, hashed columns (a power of two), and the factor that brings shares of n-grams near one.
ORDERS, FEATURES, SHARE = (1, 2, 3), 1 << 16, 30.0
#: Labelled rows of the fit, shards of a round, rounds, and one in how many rows sets the temperature.
SAMPLE, SHARDS, ROUNDS, HELD_FOR_TEMPERATURE = 20_000, 8, 4, 5
#: Follow-the-regularised-leader: rate, its smoothing, and the penalties.
ALPHA, BETA, L1, L2 = 0.5, 0.1, 0.02, 0.01
TEMPERATURES = np.exp(np.linspace(np.log(0.05), np.log(20), 121))
UNKNOWN = "und"


@functools.lru_cache(maxsize=1)
def letter_table() -> np.ndarray:
    """For each code point its lower-case letter or mark, or a space; letters are told apart from marks by the highest bit."""
    out = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            out[c] = ord(chr(c).lower()[0]) | 1 << 31
        elif kind == "M":
            out[c] = c
    return out


def text_codes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of all texts in a row, each between spaces, runs of spaces as one; where each text starts, with the end of all; and whether
    it holds a letter."""
    parts = [f" {t or ''} " for t in texts]
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    codes = letter_table()[np.frombuffer("".join(parts).encode("utf-32-le", "replace"), "<u4")]
    starts = np.concatenate([[0], np.cumsum(sizes)])
    letter = codes >= 1 << 31
    has = np.add.reduceat(letter, starts[:-1]) > 0 if len(parts) else np.zeros(0, bool)
    space = codes == 32
    keep = np.ones(len(codes), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    keep[starts[:-1]] = True
    kept = np.concatenate([[0], np.cumsum(keep)])
    return codes[keep] & 0x7FFFFFFF, kept[starts], has


def ngram_columns(codes: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order the hashed column of the n-gram at each place, and a mask of those within one text."""
    shift = np.uint32(32 - FEATURES.bit_length() + 1)
    codes = codes.astype(np.uint32)
    rolled = np.zeros(len(codes), np.uint32)
    for n in range(1, max(ORDERS) + 1):
        rolled = rolled[: len(codes) - n + 1] * np.uint32(0x01000193) + codes[n - 1 :] + np.uint32(n)
        if n in ORDERS:
            inside = np.ones(len(rolled), bool)
            for back in range(1, n):
                at = starts[1:-1] - back
                inside[at[(at >= 0) & (at < len(inside))]] = False
            mixed = (rolled ^ (rolled >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            yield (mixed ^ (mixed >> np.uint32(12))) * np.uint32(0x297A2D39) >> shift, inside


def text_features(texts: list[str | None]) -> Iterator[tuple[np.ndarray, bool]]:
    """The columns of all n-grams of each text, and whether it holds a letter."""
    codes, starts, has = text_codes(texts)
    found = [(c, i) for c, i in ngram_columns(codes, starts)]
    for k in range(len(texts)):
        s, e = starts[k], starts[k + 1]
        yield np.concatenate([c[s : max(s, e - n + 1)] for n, (c, _) in zip(ORDERS, found)]), bool(has[k])


def text_scores(texts: list[str | None], table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sum of the table's rows over the n-grams of each text, their number, and whether the text holds a letter."""
    codes, starts, has = text_codes(texts)
    sums, numbers = np.zeros((len(texts), table.shape[1])), np.zeros(len(texts))
    for columns, inside in ngram_columns(codes, starts):
        at = np.minimum(starts[:-1], len(columns) - 1)
        numbers += np.add.reduceat(inside, at, dtype=np.int64)
        for k in range(table.shape[1]):
            sums[:, k] += np.add.reduceat(np.where(inside, table[columns, k], 0.0), at)
    return sums, numbers, has


def document_frequencies(training: DataFrame) -> tuple[int, np.ndarray]:
    """How many training texts hold letters, and how many hold each column."""
    bounded_batches(training.sparkSession)
    schema = pa.schema([("cell", pa.int64()), ("n", pa.int64())])

    def run(batches):
        counts, mark = np.zeros(FEATURES + 1, np.int64), np.zeros(FEATURES, np.int64)
        for batch in batches:
            for part in byte_slices(batch, "text", CHUNK_BYTES):
                for columns, has in text_features(part.column("text").to_pylist()) if part.num_rows else ():
                    if has:
                        place = np.arange(len(columns))
                        mark[columns] = place
                        counts[columns[mark[columns] == place]] += 1
                        counts[-1] += 1
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], schema=schema)

    counts = np.zeros(FEATURES + 1, np.int64)
    for r in training.select("text").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        counts[r["cell"]] = r["n"]  # at most FEATURES + 1 rows
    return int(counts[-1]), counts[:-1]


def balanced_sample(training: DataFrame, counts: dict[str, int], size: int) -> DataFrame:
    """label, text, h: at most size rows, as many of each language where there are enough, by the smallest hashes of doc_id and text."""
    quota = max(1, size // max(1, len(counts)))
    names = sorted(counts)
    at, below = F.lit(None).cast("int"), F.lit(0)
    for i, name in enumerate(names):
        share = min(1.0, (1.5 * quota + 200) / counts[name])
        at, below = F.when(F.col("lang") == name, i).otherwise(at), F.when(F.col("lang") == name, int(share * (1 << 30))).otherwise(below)
    rows = training.select(at.alias("label"), below.alias("below"), F.xxhash64("doc_id", "text").alias("h"), "text").filter(F.pmod("h", F.lit(1 << 30)) <= F.col("below"))
    ranked = rows.withColumn("nth", F.row_number().over(W.partitionBy("label").orderBy("h", "text")))
    return ranked.filter(F.col("nth") <= quota).select("label", "text", "h")


def feature_rows(sample: DataFrame) -> DataFrame:
    """label, h, columns, counts: the n-grams of each sampled text that holds a letter."""

    def start():
        def each(batch):
            out = {"label": [], "h": [], "columns": [], "counts": []}
            for label, h, (columns, has) in zip(batch.column("label").to_pylist(), batch.column("h").to_pylist(), text_features(batch.column("text").to_pylist())):
                if has:
                    for k, x in zip(out, (label, h, *np.unique(columns, return_counts=True))):
                        out[k].append(x)
            yield out

        return each

    return map_batches(sample, "label int, h long, columns array<int>, counts array<int>", start)


def values_of(columns: pa.Scalar, counts: pa.Scalar, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Columns of a text and their TF-IDF values."""
    at, n = np.asarray(columns.values), np.asarray(counts.values)
    return at, SHARE * n / n.sum() * idf[at]


class Leader:
    """State of follow-the-regularised-leader: z and n by column (the last is the bias) and language."""

    def __init__(self, z: np.ndarray, n: np.ndarray):
        self.z, self.n = z, n

    @classmethod
    def empty(cls, languages: int) -> Leader:
        return cls(np.zeros((FEATURES + 1, languages)), np.zeros((FEATURES + 1, languages)))

    @staticmethod
    def weights_of(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The proximal step: zero where |z| stays within L1, shrunk by L2 and the rate elsewhere."""
        return -np.sign(z) * np.maximum(np.abs(z) - L1, 0) / ((BETA + np.sqrt(n)) / ALPHA + L2)

    def weights(self) -> np.ndarray:
        return self.weights_of(self.z, self.n)

    def learn(self, columns: np.ndarray, values: np.ndarray, label: int) -> None:
        """One online update; the bias column has value one."""
        at, x = np.append(columns, FEATURES), np.append(values, 1.0)[:, None]
        z, n = self.z[at], self.n[at]
        w = self.weights_of(z, n)
        p = softmax((w * x).sum(0)[None])[0]
        p[label] -= 1
        g = x * p
        self.z[at] = z + g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(rows: DataFrame, idf: np.ndarray, languages: int) -> Leader:
    """ROUNDS of online updates in shards, their changes averaged; rows: label, h, shard, columns, counts."""
    spark, state = rows.sparkSession, Leader.empty(languages)
    schema = pa.schema([("shard", pa.int32()), ("cell", pa.int64()), ("z", pa.float64()), ("n", pa.float64())])
    for _ in range(ROUNDS):
        shared = spark.sparkContext.broadcast((state.z, state.n, idf))

        def learned(group: pa.Table) -> pa.Table:
            z, n, idf = shared.value
            own = Leader(z.copy(), n.copy())
            group = group.sort_by([("h", "ascending"), ("label", "ascending")])  # at most SAMPLE rows in all shards
            for label, columns, counts in zip(group.column("label").to_pylist(), group.column("columns"), group.column("counts")):
                own.learn(*values_of(columns, counts, idf), label)
            dz, dn = (own.z - z).ravel(), (own.n - n).ravel()
            at = np.flatnonzero((dz != 0) | (dn != 0))
            shard = np.full(len(at), group.column("shard")[0].as_py(), np.int32)
            return pa.Table.from_arrays([pa.array(shard), pa.array(at), pa.array(dz[at]), pa.array(dn[at])], schema=schema)

        changes = rows.groupBy("shard").applyInArrow(learned, "shard int, cell long, z double, n double")
        ordered = F.array_sort(F.collect_list(F.struct("shard", "z", "n")))  # at most SHARDS entries
        total = {"z": F.aggregate("all", F.lit(0.0), lambda s, x: s + x["z"]), "n": F.aggregate("all", F.lit(0.0), lambda s, x: s + x["n"])}
        z, n = state.z.copy(), state.n.copy()
        found = changes.groupBy("cell").agg(ordered.alias("all")).select("cell", *(t.alias(c) for c, t in total.items())).toArrow()  # cells of the model
        at = found.column("cell").to_numpy()
        z.ravel()[at] += found.column("z").to_numpy() / SHARDS
        n.ravel()[at] += found.column("n").to_numpy() / SHARDS
        state = Leader(z, n)
        shared.destroy()
    return state


def temperature(rows: DataFrame, idf: np.ndarray, weights: np.ndarray) -> float:
    """The temperature with the least log loss over rows (label, columns, counts); 1 without rows."""
    shared = rows.sparkSession.sparkContext.broadcast((weights, idf))
    schema = pa.schema([("at", pa.int32()), ("loss", pa.float64())])

    def run(batches):
        losses = np.zeros(len(TEMPERATURES))
        w, idf = shared.value
        for batch in batches:
            for label, columns, counts in zip(batch.column("label").to_pylist(), batch.column("columns"), batch.column("counts")):
                at, values = values_of(columns, counts, idf)
                logits = values @ w[at] + w[-1]
                scaled = logits[None] / TEMPERATURES[:, None]
                top = scaled.max(1)
                losses += top + np.log(np.exp(scaled - top[:, None]).sum(1)) - scaled[:, label]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(TEMPERATURES)), pa.int32()), pa.array(losses)], schema=schema)

    found = rows.select("label", "columns", "counts").mapInArrow(run, "at int, loss double").groupBy("at").agg(F.round(F.sum("loss"), 6).alias("loss")).collect()
    if not any(r["loss"] for r in found):
        return 1.0
    return float(TEMPERATURES[min(found, key=lambda r: (r["loss"], abs(np.log(TEMPERATURES[r["at"]]))))["at"]])


class Model:
    """languages, table (weights times inverse document frequencies by column and language), bias and temperature."""

    def __init__(self, languages: list[str], table: np.ndarray, bias: np.ndarray, heat: float):
        self.languages, self.table, self.bias, self.heat = languages, table, bias, heat

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        sums, numbers, has = text_scores(texts, self.table)
        p = softmax((SHARE * sums / np.maximum(numbers, 1)[:, None] + self.bias) / self.heat)
        best = p.argmax(1)
        return [self.languages[k] if h else UNKNOWN for k, h in zip(best, has)], np.where(has, p[np.arange(len(p)), best], 0.0)


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Fit to the rows of docs (doc_id, text, lang) that are not held out; None without languages."""
    training = docs.filter(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    counts = {r["lang"]: r["n"] for r in training.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a language
    if not counts:
        return None
    texts, held = document_frequencies(training)
    idf = np.log((1 + texts) / (1 + held)) + 1
    shard, part = F.pmod(F.shiftright("h", 8), F.lit(SHARDS)).cast("int"), F.pmod(F.shiftright("h", 24), F.lit(HELD_FOR_TEMPERATURE))
    with bucketed(docs.sparkSession, SHARDS) as keep:
        rows = keep(feature_rows(balanced_sample(training, counts, sample)).withColumns({"shard": shard, "set": part}), "shard")
        weights = train(rows.filter("set > 0").drop("set"), idf, len(counts)).weights()
        heat = temperature(rows.filter("set = 0"), idf, weights)
    return Model(sorted(counts), weights[:-1] * idf[:, None], weights[-1], heat)


def held_out():
    return F.coalesce(crc32_of_id() % 4 == 2, F.lit(False))


def predict_documents(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each document."""
    model = fit(docs, sample)
    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    if model is None:
        return rows.select("doc_id", "held_out", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        def each(batch):
            names, scores = shared.value.predict(batch.column("text").to_pylist())
            yield {"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "lang_pred": names, "score": scores}

        return each

    return map_batches(rows, "doc_id long, held_out boolean, lang_pred string, score double", start)
