"""Alignment of two tokenizers: which tokens of one cover the same bytes as which tokens of the other.

Both tokenizers split at spaces and line breaks behind a visible character, so that the tokens of a text are those of its segments in a
row.  The relational work is done once for each distinct segment of the corpus: tokens of both sides are exploded with their positions,
a window sums their byte lengths (from the vocabularies) to ends, equal ends of the two sides are joined by segment and end (as one
grouping of both sides, which needs no second shuffle), a running count of the cuts (ends of both sides) numbers the groups, and every
end of either side names one link, for the byte before it lies in exactly one token of each side: the range join of the two sides is a
running fill over the joined ends, linear in them however long a group is.  All of it runs on segments dealt once into buckets.
Links weigh as often as their segment occurs; their sums are the counts of id pairs.  Documents then take the results of their segments
in order: those of the HEAVY most frequent segments travel to the workers (a documented bound), the others are joined to their documents.

If the second vocabulary could join across such places, or changes texts, whole texts are the segments.

Defined cases: null and empty texts, and texts that the tokenizers do not give back byte for byte (a literal U+2581), have no tokens:
zeros and no groups; a text without spaces is one segment; repeated rows and rows of one doc_id each get their result; an empty table
gives an empty result; other columns than doc_id and text are ignored.
"""

from __future__ import annotations

import functools
import itertools
import os
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marlstone.llm.common import CHUNK_BYTES, bounded_batches, byte_slices, byte_texts, materialize, str_texts
from marlstone.work import bucketed

#: Segments whose results travel to the workers at most, id pairs whose counts do, and segments that a task counts before it hands them on.
HEAVY, HEAVY_PAIRS, HELD = 350_000, 100_000, 200_000
#: Bytes of texts that a worker lays out at once: their segments stand beside the results that have travelled to it.
SLICE_BYTES = CHUNK_BYTES // 2
#: Segments of a bucket, and slots dealt to a bucket.
BUCKET_ROWS, SLOTS = 100_000, 16
NUMBERS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
RESULT = "doc_id long, " + ", ".join(f"{c} long" for c in NUMBERS) + ", groups string"

_TWO_GAPS = ("  ", " \n", "\n ", "\n\n")
_VISIBLE_THEN_GAP = re.compile(r"(?<=[\w!-~])(?=[ \n])")


def byte_level() -> dict[str, int]:
    """Byte of each character that byte-level vocabularies write for it: printable bytes stand for themselves, the others follow 255."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class TokenizerPair:
    """A byte-level tokenizer (a) of space + text, and a piece tokenizer (b) of text, which adds that space itself."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as model
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        byte_of = byte_level()
        tokens = [self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size())]
        self.a_bytes = [bytes(map(byte_of.__getitem__, t)) if byte_of.keys() >= set(t) else t.encode() for t in tokens]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        spec = model.ModelProto()
        with open(b_path, "rb") as f:
            spec.ParseFromString(f.read())
        plain = spec.normalizer_spec.name == "identity" and not spec.normalizer_spec.remove_extra_whitespaces and spec.normalizer_spec.add_dummy_prefix
        self.cuts = plain and not any("▁" in p.lstrip("▁") or "\n" in p for p in pieces) and len(self.b.encode("\n")) == 2
        self.known: dict[str, bool] = {}

    def _same(self, c: str) -> bool:
        """Whether the piece tokenizer gives this character back; it changes characters one by one where texts are cut."""
        found = self.known[c] = b"".join(self.b_bytes[i] for i in self.b.encode("\n" + c)[2:]) == c.encode()
        return found

    def segments(self, text: str | None) -> list[str]:
        """Segments of space + text, each without its leading space where a character that is no gap follows; none without tokens."""
        if not text:
            return []
        if not self.cuts:
            return [" " + text]
        known, tab = self.known, False
        for c in set(text):
            if not (known[c] if c in known else self._same(c)):
                return []
            tab = tab or (c.isspace() and c not in " \n")
        text = " " + text
        if not tab and not any(pair in text for pair in _TWO_GAPS):  # each gap parts two words: a plain split
            return text.replace("\n", " \n").split(" ")[1:]
        return [s if s[0] == "\n" or s[1:2] in (" ", "\n") else s[1:] for s in _VISIBLE_THEN_GAP.split(text)]

    @staticmethod
    def whole(segment: str) -> str:
        """The segment with its leading space."""
        return segment if segment[:1] in (" ", "\n") else " " + segment

    def encode(self, segments: list[str]) -> Iterator[tuple[list[int], list[int]]]:
        """Ids of both sides of each segment; two empty lists where the bytes differ."""
        segments = list(map(self.whole, segments))
        first = [e.ids for e in self.a.encode_batch(segments, add_special_tokens=False)]
        if self.cuts:  # a line break takes the added space, and no piece holds it
            second = [ids[2:] for ids in self.b.encode(["\n" + s for s in segments], num_threads=1)]
        else:
            second = self.b.encode([s[1:] for s in segments], num_threads=1)
        for s, a, b in zip(segments, first, second):
            want = s.encode()
            same = b"".join(map(self.a_bytes.__getitem__, a)) == want and b"".join(map(self.b_bytes.__getitem__, b)) == want
            yield (a, b) if same else ([], [])


@functools.lru_cache(maxsize=1)
def tokenizer_pair(a_path: str, b_path: str) -> TokenizerPair:
    """One pair serves all tasks of a Python worker."""
    return TokenizerPair(a_path, b_path)


def _text_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from (s for s in byte_slices(batch, "text", SLICE_BYTES) if s.num_rows)
    freed()


def freed() -> None:
    """Hand back what Arrow keeps of a task's batches, for the worker stays and the next stage's memory is the JVM's."""
    pa.default_memory_pool().release_unused()


def segment_counts(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """segment, n: how often each segment occurs in texts that both tokenizers give back."""
    bounded_batches(docs.sparkSession)
    schema = pa.schema([("segment", pa.string()), ("n", pa.int64())])

    def handed(held: Counter) -> Iterator[pa.RecordBatch]:
        keys, counts = list(held), list(held.values())
        for i in range(0, len(keys), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + 50_000], pa.string()), pa.array(counts[i : i + 50_000], pa.int64())], schema=schema)

    def run(batches):
        pair, held = tokenizer_pair(a_path, b_path), Counter()
        for batch in _text_slices(batches):
            for text in str_texts(batch.column("text")):
                held.update(pair.segments(text))
            if len(held) > HELD:
                yield from handed(held)
                held = Counter()
        yield from handed(held)

    return docs.select("text").mapInArrow(run, "segment string, n long").groupBy("segment").agg(F.sum("n").alias("n"))


def encoded(segments: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """slot, uid, segment, n, a, b of segments (slot, uid, segment, n): the ids of both sides."""
    held = [("slot", pa.int32()), ("uid", pa.int64()), ("segment", pa.string()), ("n", pa.int64())]
    schema = pa.schema([*held, ("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))])

    def run(batches):
        pair = tokenizer_pair(a_path, b_path)
        for batch in batches:
            for part in byte_slices(batch, "segment", CHUNK_BYTES):
                if part.num_rows:
                    ids = zip(*pair.encode(part.column("segment").to_pylist()))
                    yield pa.RecordBatch.from_arrays([*(part.column(c) for c, _ in held), *(pa.array(x, pa.list_(pa.int32())) for x in ids)], schema=schema)
        freed()

    return segments.select(*(c for c, _ in held)).mapInArrow(run, "slot int, uid long, segment string, n long, a array<int>, b array<int>")


def token_sizes(spark: SparkSession, a_path: str, b_path: str) -> DataFrame:
    """side (0 or 1), id, size in bytes of every token; as many rows as the two vocabularies have."""
    pair = tokenizer_pair(a_path, b_path)
    return spark.createDataFrame([(side, i, len(b)) for side, found in enumerate((pair.a_bytes, pair.b_bytes)) for i, b in enumerate(found)], "side int, id int, size int")


def _joined(items: str, value: str, separator: str) -> Column:
    """The values of an array of structs as one string."""
    return F.array_join(F.transform(F.array_sort(items), lambda x: x[value].cast("string")), separator)


def align(segments: DataFrame, sizes: DataFrame) -> DataFrame:
    """For segments (slot, uid, a, b): slot, uid, n_a, n_b, n_groups, n_links, groups, links (structs of ids a, b).  Every step is by slot
    and uid, so that segments in buckets of slots are not shuffled; sizes has a row for each id of the vocabularies, which bounds its
    broadcast."""
    own = ["slot", "uid"]
    sides = F.array(*(F.struct(F.lit(k).alias("side"), F.col(c).alias("ids")) for k, c in enumerate("ab")))
    tokens = segments.select(*own, F.explode(sides).alias("x")).select(*own, "x.side", F.posexplode("x.ids").alias("pos", "id"))
    tokens = tokens.join(F.broadcast(sizes), ["side", "id"]).select(*own, "side", "id", F.sum("size").over(W.partitionBy(*own, "side").orderBy("pos")).alias("end"))
    ends = tokens.groupBy(*own, "end").agg(*(F.max(F.when(F.col("side") == k, F.col("id"))).alias(c) for k, c in enumerate("ab")))
    from_the_end = W.partitionBy(*own).orderBy(F.desc("end")).rowsBetween(W.unboundedPreceding, 0)
    cut = (F.col("a").isNotNull() & F.col("b").isNotNull()).cast("int")
    over = ends.select(*own, "end", "a", "b", F.sum(cut).over(from_the_end).alias("later"), *(F.last(c, ignorenulls=True).over(from_the_end).alias(f"over_{c}") for c in "ab"))
    ids = [F.collect_list(F.when(F.col(c).isNotNull(), F.struct("end", c))).alias(f"{c}s") for c in "ab"]
    groups = over.groupBy(*own, "later").agg(*ids, F.collect_list(F.struct(F.col("over_a").alias("a"), F.col("over_b").alias("b"))).alias("links"))
    text = F.concat_ws("|", _joined("as", "a", ","), _joined("bs", "b", ","))
    groups = groups.select(*own, F.size("as").alias("n_a"), F.size("bs").alias("n_b"), "links", F.struct((-F.col("later")).alias("at"), text.alias("ids")).alias("group"))
    whole = groups.groupBy(*own).agg(F.sum("n_a").alias("n_a"), F.sum("n_b").alias("n_b"), F.collect_list("group").alias("groups"), F.flatten(F.collect_list("links")).alias("links"))
    return whole.select(*own, "n_a", "n_b", F.size("groups").cast("long").alias("n_groups"), F.size("links").cast("long").alias("n_links"), _joined("groups", "ids", ";").alias("groups"), "links")


def pair_counts(links: DataFrame) -> DataFrame:
    """a, b, count, best (whether no a has a higher count with this b) of links (a, b, n)."""
    counts = materialize(links.groupBy("a", "b").agg(F.sum("n").alias("count")), "pairs")
    highest = counts.groupBy("b").agg(F.max("count").alias("highest"))
    return materialize(counts.join(highest, "b").select("a", "b", "count", (F.col("count") == F.col("highest")).cast("long").alias("best")), "pairs")


def heaviest(rows: DataFrame, by: str, most: int) -> DataFrame:
    """The rows with the highest values of by, at most `most`: whole classes of values, a quarter of a power of two wide."""
    size_class = F.floor(4 * F.log2(by))
    sizes = sorted(((r["c"], r["k"]) for r in rows.groupBy(size_class.alias("c")).agg(F.count(F.lit(1)).alias("k")).collect()), reverse=True)  # some 250 at most
    least, room = None, most
    for c, k in sizes:
        if k > room:
            break
        least, room = c, room - k
    return rows.filter(size_class >= least) if least is not None else rows.limit(0)


def slot_of(segment: str, parts: int) -> Column:
    return F.pmod(F.xxhash64(segment), F.lit(parts * SLOTS)).cast("int")


def aligned_segments(counted: DataFrame, parts: int, keep, a_path: str, b_path: str) -> DataFrame:
    """slot, segment, n, NUMBERS and groups of every segment with tokens, from counted (segment, n).  Segments are dealt into buckets of
    slots once, as strings; all that is worked out of them is written where it lies, so that the last joins need no shuffle either."""
    spark = counted.sparkSession
    dealt = counted.select(slot_of("segment", parts).alias("slot"), F.monotonically_increasing_id().alias("uid"), "segment", "n").repartition(parts, "slot")
    segments = keep(encoded(dealt, a_path, b_path).filter(F.size("a") > 0), "slot", dealt=True)
    found = keep(align(segments, token_sizes(spark, a_path, b_path)), "slot", dealt=True)
    own = ["slot", "uid"]
    links = found.select(*own, F.explode("links").alias("link")).select(*own, "link.a", "link.b")
    pairs = pair_counts(links.join(segments.select(*own, "n"), own))
    frequent = F.broadcast(heaviest(pairs, "count", HEAVY_PAIRS))
    near = links.join(frequent, ["a", "b"]).groupBy(*own).agg(F.sum("best").alias("best"), F.sum("count").alias("count"))
    far = links.join(frequent, ["a", "b"], "left_anti").join(pairs, ["a", "b"]).groupBy(*own).agg(F.sum("best").alias("far_best"), F.sum("count").alias("far_count"))
    joined = segments.select(*own, "segment", "n").join(found.drop("links"), own).join(near, own, "left").join(keep(far, "slot"), own, "left")
    sums = {name: F.coalesce(c, F.lit(0)) + F.coalesce(f"far_{c}", F.lit(0)) for name, c in (("n_best", "best"), ("count_sum", "count"))}
    return joined.withColumns(sums).select("slot", "segment", "n", *NUMBERS, "groups")


class Laid:
    """Results of segments as Arrow columns, found for many segments at once."""

    def __init__(self, rows: pa.Table):
        self.rows = pa.Table.from_arrays(rows.combine_chunks().columns, names=rows.column_names)  # no field is marked as never null

    def places(self, segments: pa.Array) -> pa.Array:
        """The row of each segment, or null."""
        return pc.index_in(segments, value_set=self.rows.column("segment"))

    def with_rows(self, more: pa.Table) -> Laid:
        """These results with more, in which a segment may stand several times."""
        return Laid(pa.concat_tables([self.rows, more])) if more.num_rows else self

    def sums_and_groups(self, found: list[list[str]]) -> tuple[np.ndarray, pa.Array]:
        """NUMBERS summed over the segments of each text, and their groups joined."""
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        at = self.places(pa.array(itertools.chain.from_iterable(found), pa.string()))
        some = np.flatnonzero(sizes)
        sums = np.zeros((len(found), len(NUMBERS)), np.int64)
        if len(some):
            for k, c in enumerate(NUMBERS):
                sums[some, k] = np.add.reduceat(pc.take(self.rows.column(c), at).to_numpy(), offsets[some])
        texts = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pc.take(self.rows.column("groups"), at).combine_chunks())
        return sums, pc.if_else(pa.array(sizes > 0), pc.binary_join(texts, ";"), pa.scalar(None, pa.string()))


def align_documents(docs: DataFrame, a_path: str, b_path: str, heavy: int = HEAVY) -> DataFrame:
    """doc_id, NUMBERS and groups (`a1,a2|b1;a3|b2,b3`, null without tokens) of each document."""
    spark = docs.sparkSession
    bounded_batches(spark)
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")  # joins by slot and uid then stay in the buckets of slots
    counted = materialize(segment_counts(docs, a_path, b_path), "counted")
    parts = max(4, -(-counted.count() // BUCKET_ROWS))
    with bucketed(spark, parts) as keep:
        return _laid_out(docs.select("doc_id", "text"), aligned_segments(counted, parts, keep, a_path, b_path), parts, keep, a_path, b_path, heavy)


def _laid_out(docs: DataFrame, results: DataFrame, parts: int, keep, a_path: str, b_path: str, heavy: int) -> DataFrame:
    """The documents with the results of their segments in order."""
    columns = ["segment", *NUMBERS, "groups"]
    shared = docs.sparkSession.sparkContext.broadcast(Laid(heaviest(results, "n", heavy).select(columns).toArrow()))
    row_type = pa.struct([("segment", pa.string()), *((c, pa.int64()) for c in NUMBERS), ("groups", pa.string())])
    key = [F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64("text", "doc_id", F.lit("second")).alias("k2")]
    rare_schema = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("segment", pa.string())])

    def rare_of(batches):
        pair = tokenizer_pair(a_path, b_path)
        for batch in _text_slices(batches):
            found = [pair.segments(text) for text in str_texts(batch.column("text"))]
            segments = pa.array(itertools.chain.from_iterable(found), pa.string())
            row = np.repeat(np.arange(len(found)), [len(f) for f in found])
            missing = pc.is_null(shared.value.places(segments))
            own = pa.table({"row": pa.array(row).filter(missing), "segment": segments.filter(missing)}).group_by(["row", "segment"]).aggregate([]).combine_chunks()
            at = own.column("row")
            yield from pa.Table.from_arrays([batch.column("k1").take(at), batch.column("k2").take(at), own.column("segment")], schema=rare_schema).to_batches()

    rare = docs.select("text", *key).mapInArrow(rare_of, "k1 long, k2 long, segment string")
    rare = keep(rare.withColumn("slot", slot_of("segment", parts)), "slot")
    rare = rare.join(results.select("slot", "segment", F.struct(*columns).alias("found")), ["slot", "segment"])
    rare = rare.groupBy("k1", "k2").agg(F.collect_set("found").alias("rare"))
    out_schema = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in NUMBERS), ("groups", pa.string())])
    packed_schema = pa.schema([("doc_id", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("size", pa.int64()), ("packed", pa.binary())])

    def packed(batches):  # texts are shuffled once, at about half of what the shuffle's own compression leaves
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for batch in _text_slices(batches):
            texts = byte_texts(batch.column("text"))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "k1", "k2")), pa.array(map(len, texts), pa.int64()), pa.array(map(squeeze, texts), pa.binary())], schema=packed_schema)

    def laid_out(batches):
        pair, unsqueeze = tokenizer_pair(a_path, b_path), zstandard.ZstdDecompressor().decompress
        for batch in batches:
            sizes = batch.column("size").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(sizes) // SLICE_BYTES)) + 1).tolist(), batch.num_rows]
            for first, last in itertools.pairwise(cuts):
                part = batch.slice(first, last - first)
                laid = shared.value.with_rows(pa.Table.from_struct_array(part.column("rare").flatten().cast(row_type)))
                sums, groups = laid.sums_and_groups([pair.segments(unsqueeze(p).decode()) for p in part.column("packed").to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(sums[:, i]) for i in range(len(NUMBERS))), groups], schema=out_schema)
        freed()

    texts = docs.select("doc_id", "text", *key).mapInArrow(packed, "doc_id long, k1 long, k2 long, size long, packed binary")
    return texts.join(rare, ["k1", "k2"], "left").select("doc_id", "size", "packed", "rare").mapInArrow(laid_out, RESULT)
