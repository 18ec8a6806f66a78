"""Packing: best-fit decreasing into windows of at most WIDTH tokens.

Documents are tokenized, each closed by an end token, and cut into full windows and a rest.  Best-fit decreasing
places pieces by falling length into the tightest open window.  Pieces of one length are alike to it, so the
driver runs it on counts of lengths alone (at most WIDTH of them): a segment tree indexed by remaining capacity
holds how many windows are open at each capacity and finds the tightest that fits, and one step places as many
pieces as all windows of that capacity take.  The resulting plan has some steps for each length, whatever the
number of documents; every piece finds its window from its rank among the pieces of its length by doc_id, start and
checksum, so that neither partitions nor files decide where it goes.

Defined cases: null and empty texts are one piece holding the end token; a very long text is cut into full
windows; repeated rows are packed each; pieces without doc_id come first among those of their length; an empty table
packs into nothing; extra columns are ignored.
"""

from __future__ import annotations

import functools
import os
import re
import zlib
from array import array

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marlstone.llm.common import byte_texts, map_batches, materialize

WIDTH = 2048
END_ID = 1
#: Words whose ids a worker remembers, about 200 bytes each, and bytes of the longest of these.
CACHE_WORDS, CACHE_BYTES = 300_000, 40
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class FitTree:
    """Segment tree over remaining capacities: the smallest capacity of at least c at which a window is open."""

    def __init__(self, width: int):
        self.size = 1 << width.bit_length()
        self.any = bytearray(2 * self.size)

    def set(self, capacity: int, is_open: bool) -> None:
        i = self.size + capacity
        self.any[i] = is_open
        while i > 1:
            i >>= 1
            self.any[i] = self.any[2 * i] | self.any[2 * i + 1]

    def tightest(self, least: int) -> int | None:
        i = self.size + least
        if self.any[i]:
            return least
        while i > 1:
            if not i & 1 and self.any[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.any[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return None


def best_fit_plan(histogram: dict[int, int], width: int = WIDTH) -> list[tuple[int, int, int, int, int, int]]:
    """Steps (length, first rank, pieces, first window, pieces to a window, offset in it) of best-fit decreasing.

    Windows of one capacity are kept as runs of consecutive numbers; a step fills a run, or its first windows."""
    open_runs: list[list[tuple[int, int]]] = [[] for _ in range(width + 1)]  # capacity -> [(first window, windows)]
    tree, windows, steps = FitTree(width), 0, []

    def put(capacity: int, run: tuple[int, int]) -> None:
        if capacity and run[1]:
            open_runs[capacity].append(run)
            tree.set(capacity, True)

    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            capacity = tree.tightest(length)
            if capacity is None:
                capacity, run = width, (windows, -(-left // (width // length)))
                windows += run[1]
            else:
                run = open_runs[capacity].pop()
                tree.set(capacity, bool(open_runs[capacity]))
            each = capacity // length  # the window stays the tightest until no more of this length fits
            full = min(run[1], left // each)
            if full:
                steps.append((length, rank, full * each, run[0], each, width - capacity))
                put(capacity - each * length, (run[0], full))
                rank, left = rank + full * each, left - full * each
            rest = (run[0] + full, run[1] - full)
            if rest[1] and left:  # fewer than each are left: one window takes them
                steps.append((length, rank, left, rest[0], each, width - capacity))
                put(capacity - left * length, (rest[0], 1))
                rest, rank, left = (rest[0] + 1, rest[1] - 1), rank + left, 0
            put(capacity, rest)
    return steps


class WordIds(dict):
    """Ids of a text as little-endian unsigned 32-bit bytes, by ids of its words; a dict of the words seen so far.

    The tokenizer drops white space and splits at it, so a text's ids are its words' ids in a row; texts that may
    hold a special token's string go to the tokenizer whole.  A word of Latin letters with ASCII marks after it is
    two of the tokenizer's own pre-tokens, which its model merges without the general normalizer."""

    _PLAIN = re.compile(r"([a-zß-öø-ÿ]+)([!-/:-@\[-`{-~]*)")

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {c: level.pre_tokenize_str(chr(c))[0][0] for c in range(0x21, 0x7F)}
        for c in range(0xDF, 0x100):
            self.letters[c] = level.pre_tokenize_str(chr(c))[0][0]

    def _whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, word: bytes) -> bytes:
        text = word.decode()
        plain = self._PLAIN.fullmatch(text.lower()) if len(text) < 64 else None
        if plain is None:
            ids = self._whole(text)
        else:
            ids = array("I", [t.id for part in plain.groups() if part for t in self.model.tokenize(part.translate(self.letters))]).tobytes()
        if len(word) <= CACHE_BYTES and len(self) < CACHE_WORDS:
            self[word] = ids
        return ids

    def encode(self, texts: list[bytes]) -> list[bytes]:
        get = self.__getitem__
        return [self._whole(t.decode()) if b"<|" in t else b"".join(map(get, t.lower().split())) for t in texts]


@functools.lru_cache(maxsize=1)
def worker_ids(tokenizer_path: str) -> WordIds:
    """The words a Python worker remembers serve all its tasks."""
    return WordIds(tokenizer_path)


def pieces(docs: DataFrame, tokenizer_path: str, width: int = WIDTH) -> DataFrame:
    """PIECES: the full windows and the rest of each document."""

    def start():
        ids = worker_ids(tokenizer_path)
        end = array("I", [END_ID]).tobytes()

        def each(batch):
            out: dict[str, list] = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")}
            for doc_id, packed in zip(batch.column("doc_id").to_pylist(), ids.encode(byte_texts(batch.column("text")))):
                packed += end
                tokens = len(packed) // 4
                for at in range(0, tokens, width):
                    n = min(width, tokens - at)
                    row = (doc_id, at, n, zlib.crc32(packed[4 * at : 4 * (at + n)]), tokens)
                    for column, x in zip(out.values(), row):
                        column.append(x)
            yield out

        return each

    return map_batches(docs.select("doc_id", "text"), PIECES, start)


def pack_documents(docs: DataFrame, tokenizer_path: str, width: int = WIDTH) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset for each piece."""
    order = ["length", "doc_id", "start", "ids_crc32"]
    cut = materialize(pieces(docs, tokenizer_path, width), "pieces").repartitionByRange(*order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id()  # the partition above 33 bits, the place in it below
    cut = materialize(cut.withColumn("at", at).withColumns({"part": F.shiftright("at", 33), "nth": F.col("at").bitwiseAND((1 << 33) - 1)}).drop("at"), "sorted")
    counts = materialize(cut.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"), F.min("nth").alias("first")), "lengths")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most width rows
    steps = best_fit_plan(histogram, width)
    by_length = {}
    for s in steps:
        by_length.setdefault(s[0], []).append(s[1:])
    plan = {k: np.asarray(v, np.int64).T for k, v in by_length.items()}
    before = counts.select("length", "part", (F.sum("n").over(W.partitionBy("length").orderBy("part")) - F.col("n") - F.col("first")).alias("before"))
    ranked = cut.join(before, ["length", "part"]).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("nth") + F.col("before")).alias("rank"))
    shared = docs.sparkSession.sparkContext.broadcast(plan)

    def place(frames):
        for f in frames:
            rank, sequence, offset = f["rank"].to_numpy(), np.empty(len(f), np.int64), np.empty(len(f), np.int64)
            for length, at in f.groupby("length").indices.items():
                first, _, window, each, base = shared.value[length]
                step = np.searchsorted(first, rank[at], "right") - 1
                nth = rank[at] - first[step]
                sequence[at] = window[step] + nth // each[step]
                offset[at] = base[step] + nth % each[step] * length
            yield pd.DataFrame({**{c: f[c] for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")}, "sequence_id": sequence, "offset": offset})

    return ranked.mapInPandas(place, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
