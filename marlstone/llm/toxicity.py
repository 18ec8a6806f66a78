"""Toxicity: a weighted lexicon matched by Aho-Corasick on folded text, normalised by length, with exception phrases.

Folding lower-cases, drops accents, turns look-alike letters of other alphabets and digits or marks used as letters
into Latin letters, and joins what is left with single spaces, so that an entry matches at word starts (a stem) or as
a whole word.  The lexicon is learned from labelled rows: words and word starts that toxic rows hold far more often
than others, weighted by log odds.  A word weighs as much as its heaviest entry.  Phrases of such a word and its
neighbour that occur in clean rows are exceptions: in them the word weighs nothing, however many phrases hold it.  Two
numbers of a text, the matched weight and the weight per word, go through a logistic curve fitted to the same rows.

Labelled rows for the fit are a sample of at most SAMPLE rows (the smallest hashes of doc_id), read with the texts
whole; everything else covers all rows.  Only the text enters a score.

Defined cases: null and empty texts score as texts without a match; very long texts are matched whole; rows without
label are scored alike; of several labels or texts of one doc_id the smallest counts for the fit (each row is scored);
null labels and labels without text do not count; with no toxic or no clean label the lexicon is empty and every score
is the share of toxic labels (0 without labels); extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import crc32_of_id, hash_sample, map_batches, materialize, str_texts

#: Labelled rows, lexicon entries and exception phrases at most.
SAMPLE, ENTRIES, EXCEPTIONS = 20_000, 3_000, 3_000
#: Least toxic rows of an entry, least odds ratio, and lengths of word starts that may be entries.
MIN_ROWS, MIN_ODDS, STEMS = 8, 8.0, (4, 5, 6, 7)

# Letters of other alphabets, digits and marks that stand in for Latin letters.
_LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ѐ": "e", "ё": "e", "ғ": "f", "һ": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "п": "n",
    "н": "h", "о": "o", "р": "p", "ԛ": "q", "г": "r", "ѕ": "s", "т": "t", "у": "y", "ѵ": "v", "ԝ": "w", "х": "x",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w",
    "ı": "i", "ł": "l", "ø": "o", "đ": "d", "ħ": "h", "ß": "ss", "æ": "ae", "œ": "oe", "ɑ": "a", "ɡ": "g", "ɩ": "i", "ʟ": "l", "ᴏ": "o",
}
_DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "l", "+": "t"}


class _Folds(dict):
    """Code point to folded text, worked out when first met; other characters than letters and stand-ins become spaces."""

    def __missing__(self, point: int) -> str:
        c = chr(point)
        if unicodedata.category(c) in ("Mn", "Cf"):
            out = ""  # combining marks and invisible characters inside words
        else:
            out = "".join(_LOOKALIKES.get(x, x) for x in unicodedata.normalize("NFKD", c).lower() if unicodedata.category(x) != "Mn")
            out = "".join(x if x.isalpha() else x if x in _DIGITS else " " for x in out) or " "
        self[point] = out
        return out


_FOLDS = _Folds()
_STAND_IN = re.compile(r"(?<=[^\W\d_])[013457893@$!|+]+(?=[^\W\d_])|(?<![^\s])[013457893@$]+(?=[^\W\d_])|(?<=[^\W\d_]{2})[0134@$]+(?![^\s])")
_REST = re.compile(r"[^a-z\x80-\U0010FFFF]+")


def fold(text: str) -> str:
    """Folded words between single spaces, with a space at either end."""
    t = text.lower().translate(_FOLDS)
    t = _STAND_IN.sub(lambda m: "".join(_DIGITS.get(c, c) for c in m[0]), t)
    return f" {_REST.sub(' ', t).strip(' ')} "


def entries_of(word: str) -> list[str]:
    """The lexicon entries a word can hold: its starts and the whole word."""
    return [f" {word[:n]}" for n in STEMS if len(word) >= n] + [f" {word} "]


class Lexicon:
    """weights by entry, exceptions (phrases of two words, with the place of the word that weighs nothing in them), and the
    curve (bias, factor of the weight, factor of the weight per word)."""

    def __init__(self, weights: dict[str, float], exceptions: set[tuple[str, int]], curve: tuple[float, float, float]):
        self.weights, self.exceptions, self.curve = weights, exceptions, curve

    def matcher(self):
        """An automaton of entries and exceptions, or None."""
        import ahocorasick

        held: dict[str, tuple[float, list[int]]] = {k: (w, []) for k, w in self.weights.items()}
        for phrase, place in sorted(self.exceptions):
            held.setdefault(phrase, (0.0, []))[1].append(place)
        if not held:
            return None
        found = ahocorasick.Automaton()
        for k, (w, places) in held.items():
            found.add_word(k, (len(k), w, places))
        found.make_automaton()
        return found

    @staticmethod
    def matched(folded: str, matcher) -> dict[int, float]:
        """Weight by the place of each word that weighs."""
        at: dict[int, float] = {}
        excused = set()
        for end, (size, weight, places) in matcher.iter(folded):
            start = end - size + 1
            if weight > at.get(start, 0.0):
                at[start] = weight
            for place in places:
                excused.add(start + place)
        for place in excused:
            at.pop(place, None)
        return at

    def features(self, texts: list[str], matcher) -> np.ndarray:
        """For each text log(1 + matched weight) and the same of the weight per hundred words."""
        out = np.zeros((len(texts), 2))
        if matcher is None:
            return out
        for i, text in enumerate(texts):
            folded = fold(text)
            at = self.matched(folded, matcher)
            if at:
                total = sum(w for _, w in sorted(at.items()))
                out[i] = math.log1p(total), math.log1p(100 * total / (10 + folded.count(" ")))
        return out

    def scores(self, features: np.ndarray) -> np.ndarray:
        bias, a, b = self.curve
        return 1 / (1 + np.exp(-np.clip(bias + features @ np.asarray([a, b]), -30, 30)))


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """label_id, text, toxic of the sampled training rows; the sample's ids are bounded, so they go to the scan of docs."""
    train = labels.select(F.col("doc_id").alias("label_id"), F.col("toxic").cast("int").alias("toxic")).filter(F.col("label_id").isNotNull() & F.col("toxic").isin(0, 1) & (crc32_of_id("label_id") % 5 != 0))
    train = materialize(hash_sample(train, "label_id", sample, "toxic"), "labels")
    rows = docs.select("doc_id", "text").filter(F.col("text").isNotNull()).join(F.broadcast(train), F.col("doc_id") == F.col("label_id"))
    one = rows.groupBy("label_id").agg(F.min(F.struct("toxic", "text")).alias("row"))  # so that there are at most sample rows
    return materialize(one.select("label_id", "row.text", "row.toxic"), "labelled")


def _entry_counts(sample: DataFrame) -> DataFrame:
    """entry, toxic rows and clean rows that hold it."""

    def start():
        def each(batch):
            counts: dict[int, Counter] = {0: Counter(), 1: Counter()}
            for text, toxic in zip(str_texts(batch.column("text")), batch.column("toxic").to_pylist()):
                counts[toxic].update({e for w in set(fold(text).split()) if 4 <= len(w) <= 40 for e in entries_of(w)})
            keys = list(counts[0].keys() | counts[1].keys())
            yield {"entry": keys, "n_toxic": [counts[1][k] for k in keys], "n_clean": [counts[0][k] for k in keys]}

        return each

    return map_batches(sample, "entry string, n_toxic long, n_clean long", start).groupBy("entry").agg(F.sum("n_toxic").alias("n_toxic"), F.sum("n_clean").alias("n_clean"))


def _phrase_counts(sample: DataFrame, weights: dict[str, float]) -> DataFrame:
    """phrase (a word that weighs and its right or left neighbour), place of the word in it, rows of either label."""

    def start():
        def each(batch):
            counts: dict[int, Counter] = {0: Counter(), 1: Counter()}
            for text, toxic in zip(str_texts(batch.column("text")), batch.column("toxic").to_pylist()):
                words, seen = fold(text).split(), set()
                for i, w in enumerate(words):
                    if any(e in weights for e in entries_of(w)):
                        if i + 1 < len(words):
                            seen.add((f" {w} {words[i + 1]} ", 0))
                        if i:
                            seen.add((f" {words[i - 1]} {w} ", len(words[i - 1]) + 1))
                counts[toxic].update(seen)
            keys = list(counts[0].keys() | counts[1].keys())
            yield {"phrase": [k[0] for k in keys], "place": [k[1] for k in keys], "n_toxic": [counts[1][k] for k in keys], "n_clean": [counts[0][k] for k in keys]}

        return each

    return map_batches(sample, "phrase string, place int, n_toxic long, n_clean long", start).groupBy("phrase", "place").agg(F.sum("n_toxic").alias("n_toxic"), F.sum("n_clean").alias("n_clean"))


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Ridge logistic regression by Newton steps."""
    a = np.c_[np.ones(len(x)), x]
    w = np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a + 1e-3 * np.eye(3)
        w += np.linalg.solve(h, a.T @ (y - p) - 1e-3 * w)
    return float(w[0]), float(w[1]), float(w[2])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Lexicon:
    rows = labelled_sample(docs, labels, sample)
    n = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = n.get(1, 0), n.get(0, 0)
    if not toxic or not clean:
        return Lexicon({}, set(), (math.log((toxic + 1e-9) / (clean + 1e-9)) if toxic or clean else -30.0, 0.0, 0.0))
    odds = ((F.col("n_toxic") + 0.5) / (toxic - F.col("n_toxic") + 0.5)) / ((F.col("n_clean") + 0.5) / (clean - F.col("n_clean") + 0.5))
    least = min(MIN_ROWS, max(2, toxic // 20))
    counts = _entry_counts(rows).filter(F.col("n_toxic") >= least).withColumn("odds", odds).filter(F.col("odds") >= MIN_ODDS)
    top = counts.orderBy(F.desc(F.col("n_toxic") * F.log("odds")), "entry").limit(ENTRIES).collect()  # at most ENTRIES rows
    weights = {r["entry"]: math.log(r["odds"]) for r in top}
    exceptions: set[tuple[str, int]] = set()
    if weights:
        phrases = _phrase_counts(rows, weights).filter((F.col("n_clean") >= 3) & (F.col("n_clean") * toxic > 4 * F.col("n_toxic") * clean))
        exceptions = {(r["phrase"], r["place"]) for r in phrases.orderBy(F.desc("n_clean"), "phrase", "place").limit(EXCEPTIONS).collect()}  # at most EXCEPTIONS rows
    lexicon = Lexicon(weights, exceptions, (0.0, 0.0, 0.0))

    def start():
        matcher = lexicon.matcher()

        def each(batch):
            x = lexicon.features(str_texts(batch.column("text")), matcher)
            yield {"x1": x[:, 0], "x2": x[:, 1], "y": batch.column("toxic")}

        return each

    points = map_batches(rows, "x1 double, x2 double, y int", start).toPandas().sort_values(["x1", "x2", "y"])  # at most sample rows of three numbers
    lexicon.curve = _logistic(points[["x1", "x2"]].to_numpy(), points["y"].to_numpy(float))
    return lexicon


def score_documents(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, sample))  # bounded by ENTRIES and EXCEPTIONS

    def start():
        lexicon = shared.value
        matcher = lexicon.matcher()

        def each(batch):
            score = lexicon.scores(lexicon.features(str_texts(batch.column("text")), matcher))
            yield {"doc_id": batch.column("doc_id"), "score": score, "predicted": (score >= 0.5).astype(np.int32)}

        return each

    scored = map_batches(docs.select("doc_id", "text"), "doc_id long, score double, predicted int", start)
    return scored.select("doc_id", F.coalesce(crc32_of_id() % 5 == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def keep_clean(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of docs not predicted toxic, with the columns of docs; one pass, nothing is shuffled.

    Null and empty texts score as texts without a match; repeated rows share their fate; without labels all stay; an
    empty table stays empty; columns of any name are kept as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, sample))  # bounded by ENTRIES and EXCEPTIONS
    names = docs.columns

    def start():
        lexicon = shared.value
        matcher = lexicon.matcher()

        def each(batch):
            score = lexicon.scores(lexicon.features(str_texts(batch.column("text")), matcher))
            kept = batch.filter(pa.array(score < 0.5))
            yield {n: kept.column(n) for n in names}

        return each

    return map_batches(docs, docs.schema.toDDL(), start)
