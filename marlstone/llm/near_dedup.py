"""Near-duplicates by HyperMinHash: compressed registers, banding, corrected estimates, then exact Jaccard.

A document's set holds its distinct shingles of SHINGLE lower-cased words, or its whole word sequence if it has
fewer.  A shingle's hash picks one of REGISTERS buckets; each bucket keeps the smallest hash as its count of
leading zeros (6 bits) and the MANTISSA bits after them.  Buckets that stay empty are filled in further rounds with
other hashes, and after ROUNDS rounds with a hash of their own, so that the registers of short texts are as independent
as those of long ones.

1. Equal word sequences collapse to their smallest doc_id; only these representatives go on.
2. Bands of registers, as many in a band as MISS allows, give keys.  Two documents at the threshold share no key with a
   chance of MISS at most, at any size of their sets.
3. Stars, in STAR_ROUNDS rounds: each key has a head in the largest component of its documents (at first each document is
   a component), and each document outside of it is compared with the head that it shares most keys with.  A star goes
   out in blocks of STAR_DOCS documents with the head in each, so that a round sends every text once at most; the
   confirmed links give new components.  Keys whose documents all lie in one component are done.
4. The keys that are left tie components into families, in which documents of different components are compared, block
   with block: pairs whose registers, corrected for chance collisions, estimate a Jaccard near the threshold are confirmed
   first, the likeliest before others, and then what is still untied is counted out on full sets, so that no link hangs on an
   estimate.  The largest component of a family is not compared with itself.
5. Components of all confirmed links are the result.

Defined cases: null and empty texts have an empty set, are linked with nothing and stay; rows without doc_id are linked
with nothing, have no component_id and stay; rows of one doc_id are one document, linked with whatever any of its texts
is like, each row with the set size of its own text; ties go to the smaller doc_id; very long texts are compared whole;
extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import bounded_batches, byte_texts, map_batches, materialize
from marlstone.llm.components import connected_components

SHINGLE, THRESHOLD_PERCENT = 3, 85
REGISTERS, MANTISSA = 320, 10
#: Chance that documents at the threshold share no band, at most.
MISS = 5e-6
#: Rounds of hashing before empty buckets get hashes of their own.
ROUNDS = 24
#: Standard deviations by which an estimate may miss before a pair is put off.
SLACK = 6.0
#: Rounds of stars; documents in a block of a star, documents and shingles in a block of a family.
STAR_ROUNDS = 1
STAR_DOCS, BLOCK_DOCS, BLOCK_SHINGLES = 32, 128, 500_000

_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingle_sets(docs: list[list[bytes]], shingle: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the word shingles of each document; all documents' words are mixed at once."""
    import xxhash

    sizes = np.fromiter(map(len, docs), np.int64, len(docs))
    total = int(sizes.sum())
    h = np.fromiter((xxhash.xxh3_64_intdigest(w) for d in docs for w in d), np.uint64, total)
    acc = np.zeros(max(0, total - shingle + 1), np.uint64)
    for k in range(shingle):
        acc = _mix(acc + h[k : len(acc) + k] * _U(0x9E3779B97F4A7C15 + 2 * k))
    out, at = [], 0
    for words, n in zip(docs, sizes.tolist()):
        if n >= shingle:
            own = np.sort(acc[at : at + n - shingle + 1])
            out.append(own[np.r_[True, own[1:] != own[:-1]]])
        elif n:
            out.append(np.asarray([xxhash.xxh3_64_intdigest(b" ".join(words), seed=7)], np.uint64))
        else:
            out.append(np.empty(0, np.uint64))
        at += n
    return out


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """REGISTERS values of 16 bits (leading zeros, mantissa) for each set; the sets must not be empty."""
    out = [np.empty((0, REGISTERS), np.uint16)]
    held, size = [], 0
    for x in sets:  # some sets at a time
        held.append(x)
        size += max(len(x), REGISTERS)
        if size > 1 << 18:
            out.append(_registers(held))
            held, size = [], 0
    if held:
        out.append(_registers(held))
    return np.concatenate(out)


def _registers(sets: list[np.ndarray]) -> np.ndarray:
    sizes = np.asarray([len(x) for x in sets])
    hashes = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    low = np.full(len(sets) * REGISTERS, _U(0xFFFFFFFFFFFFFFFF), np.uint64)
    empty = np.ones(len(low), bool)
    for nth in range(ROUNDS):
        h = _mix(hashes ^ _U(0xA0761D6478BD642F * (nth + 1) & 0xFFFFFFFFFFFFFFFF))
        at = owner * REGISTERS + ((h >> _U(32)) * _U(REGISTERS) >> _U(32)).astype(np.int64)
        new = empty[at]
        at = at[new]
        np.minimum.at(low, at, _mix(h[new]))
        empty[at] = False
        wanting = empty.reshape(len(sets), REGISTERS).any(axis=1)
        if not wanting.any():
            break
        if not wanting.all():
            rest = wanting[owner]
            hashes, owner = hashes[rest], owner[rest]
    doc, bucket = np.nonzero(empty.reshape(len(sets), REGISTERS))
    if len(doc):  # every element of the document against each of its empty buckets
        n = sizes[doc]
        first = np.concatenate([[0], np.cumsum(sizes)[:-1]])[doc]
        ends = np.cumsum(n)
        which = np.repeat(first - (ends - n), n) + np.arange(int(ends[-1]))
        h = _mix(np.concatenate(sets)[which] ^ _mix(np.repeat(bucket, n).astype(np.uint64) + _U(0x9E3779B97F4A7C15)))
        low[doc * REGISTERS + bucket] = np.minimum.reduceat(_mix(h), ends - n)
    exponent = np.frexp(np.maximum(low >> _U(11), _U(1)).astype(np.float64))[1]  # 53 bits: exact as a double
    zeros = (53 - exponent).astype(np.uint64)
    mantissa = (low << (zeros + _U(1))) >> _U(64 - MANTISSA)
    return ((zeros << _U(MANTISSA)) | mantissa).astype(np.uint16).reshape(len(sets), REGISTERS)


def band_rows(percent: int) -> int:
    """Registers in a band: the most that keep the chance to miss a pair at the threshold within MISS."""
    return max(r for r in range(1, 33) if r == 1 or (1 - (percent / 100) ** r) ** (REGISTERS // r) <= MISS)


def band_keys(signatures: np.ndarray, rows: int) -> np.ndarray:
    """One 63-bit key a band, for each row of registers."""
    bands = REGISTERS // rows
    acc = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(signatures), bands))
    for k in range(rows):
        acc = _mix(acc * _U(0x9E3779B97F4A7C15) + signatures[:, k : bands * rows : rows])
    return (acc >> _U(1)).astype(np.int64)


def estimates(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard estimates between rows of a and of b: equal registers less the share that collides by chance."""
    equal = np.empty((len(a), len(b)), np.float32)
    for i in range(0, len(a), 16):
        equal[i : i + 16] = (a[i : i + 16, None, :] == b[None, :, :]).mean(axis=2, dtype=np.float32)
    levels = lambda s: np.stack([np.bincount(r >> MANTISSA, minlength=64) for r in s]) / REGISTERS
    chance = levels(a) @ levels(b).T / (1 << MANTISSA)
    return (equal - chance) / (1 - chance)


def sketch(docs: DataFrame, shingle: int = SHINGLE, percent: int = THRESHOLD_PERCENT) -> DataFrame:
    """doc_id, key (of the word sequence; null if empty), n_shingles and the band keys of each document."""

    rows = band_rows(percent)

    def start():
        import xxhash

        def each(batch):
            words = [t.lower().split() for t in byte_texts(batch.column("text"))]
            sets = shingle_sets(words, shingle)
            full = [i for i, x in enumerate(sets) if len(x)]
            bands: list = [None] * len(sets)
            for i, keys in zip(full, band_keys(registers([sets[i] for i in full]), rows)):
                bands[i] = keys
            yield {
                "doc_id": batch.column("doc_id"),
                "key": [xxhash.xxh3_128_digest(b" ".join(w)) if w else None for w in words],
                "n_shingles": [len(s) for s in sets],
                "bands": bands,
            }

        return each

    return map_batches(docs.select("doc_id", "text"), "doc_id long, key binary, n_shingles long, bands array<long>", start)


def common_counts(left: list[np.ndarray], right: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Sizes of the intersections of all left sets with all right sets, as products of incidence matrices."""
    out = np.zeros((len(left), len(right)), np.int64)
    a, b = np.concatenate(left), np.concatenate(right)
    own_a, own_b = np.repeat(np.arange(len(left)), [len(x) for x in left]), np.repeat(np.arange(len(right)), [len(x) for x in right])
    shared = np.intersect1d(a, b)
    for first in range(0, len(shared), columns):
        part = shared[first : first + columns]

        def incidence(values: np.ndarray, own: np.ndarray, rows: int) -> np.ndarray:
            at = np.minimum(np.searchsorted(part, values), len(part) - 1)  # noqa: B023
            hit = part[at] == values  # noqa: B023
            x = np.zeros((rows, len(part)), np.float32)  # noqa: B023
            x[own[hit], at[hit]] = 1
            return x

        out += (incidence(a, own_a, len(left)) @ incidence(b, own_b, len(right)).T).astype(np.int64)
    return out


def _links_of_groups(rows: DataFrame, keys: list[str], order: list[str], shingle: int, percent: int, confirm) -> DataFrame:
    """a, b: what confirm(key, [(row, set)], percent) says of each group of rows (with doc_id, text)."""
    rows = rows.repartition(*keys).sortWithinPartitions(*keys, *order)
    bounded_batches(rows.sparkSession)
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        from marlstone.llm.common import sorted_groups

        found: list[tuple[int, int]] = []
        for key, members in sorted_groups(batches, keys):
            held = [(r, (r.pop("text") or "").encode().lower().split()) for r in members]
            sets = shingle_sets([w for _, w in held], shingle)
            found += confirm(key, [(r, s) for (r, _), s in zip(held, sets) if len(s)], percent)
            if len(found) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], schema=schema)
                found = []
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], schema=schema)

    return rows.mapInArrow(run, "a long, b long")


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    small, large = sorted((len(a), len(b)))
    if 100 * small < percent * large:
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (small + large - common)


def star_links(key: tuple, held: list[tuple[dict, np.ndarray]], percent: int = THRESHOLD_PERCENT) -> list[tuple[int, int]]:
    """Links of a head, key's first, with the documents of its block."""
    heads = [s for r, s in held if r["doc_id"] == key[0]]
    return [(key[0], r["doc_id"]) for r, s in held if r["doc_id"] != key[0] and any(similar(h, s, percent) for h in heads)]


def family_links(key: tuple, held: list[tuple[dict, np.ndarray]], percent: int = THRESHOLD_PERCENT) -> list[tuple[int, int]]:
    """Links that tie the documents (doc_id, own block, component) as all links between blocks x and y of a family do; key: family, x, y."""
    x, y = key[1:]
    left = [i for i, (r, _) in enumerate(held) if r["own"] == x]
    right = [i for i, (r, _) in enumerate(held) if r["own"] == y]
    if not left or not right:
        return []
    docs, sets = [r["doc_id"] for r, _ in held], [s for _, s in held]
    first: dict[int, int] = {}
    root = [first.setdefault(r["component"], i) for i, (r, _) in enumerate(held)]

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    links = []

    def tie(a: int, b: int) -> None:
        p, q = find(a), find(b)
        if p != q:
            root[max(p, q)] = min(p, q)
            links.append((docs[a], docs[b]))

    sizes = np.asarray([len(s) for s in sets])
    n, m = sizes[left][:, None], sizes[right][None, :]
    fits = 100 * np.minimum(n, m) >= percent * np.maximum(n, m)
    roots = np.asarray([find(i) for i in range(len(held))])
    fits &= roots[left][:, None] != roots[right][None, :]
    if not fits.any():
        return links
    signs = registers(sets)
    guess, j = estimates(signs[left], signs[right]), percent / 100
    rows, columns = np.nonzero(fits & (guess >= j - SLACK * (j * (1 - j) / REGISTERS) ** 0.5))
    for k in np.argsort(-guess[rows, columns], kind="stable").tolist():
        a, b = left[rows[k]], right[columns[k]]
        if find(a) != find(b) and similar(sets[a], sets[b], percent):
            tie(a, b)
    roots = np.asarray([find(i) for i in range(len(held))])
    fits &= roots[left][:, None] != roots[right][None, :]
    rows, columns = np.flatnonzero(fits.any(axis=1)), np.flatnonzero(fits.any(axis=0))
    if len(rows):
        common = np.zeros(fits.shape, np.int64)
        common[np.ix_(rows, columns)] = common_counts([sets[left[i]] for i in rows], [sets[right[i]] for i in columns])
        for a, b in zip(*np.nonzero(fits & (100 * common >= percent * (n + m - common)))):
            tie(left[a], right[b])
    return links


def blocks_needed(size: int):
    return F.greatest(F.ceil(F.count(F.lit(1)) / size), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).cast("long")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = THRESHOLD_PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs."""
    sketches = materialize(sketch(docs, shingle, percent), "sketch")
    nodes = sketches.filter("key is not null and doc_id is not null")
    classes = materialize(nodes.groupBy("key").agg(F.min("doc_id").alias("rep")), "classes")
    own = nodes.join(classes.select(F.col("key").alias("rep_key"), "rep"), (F.col("key") == F.col("rep_key")) & (F.col("doc_id") == F.col("rep")), "left_semi")
    bands = materialize(own.select("doc_id", F.explode("bands").alias("band_key")), "bands")
    several = bands.groupBy("band_key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("band_key")
    # small sides are written, so that their size is known before the keys are shuffled
    held = materialize(bands.join(materialize(several, "several"), "band_key").withColumn("component", F.col("doc_id")), "held")  # keys of several components
    sizes = sketches.groupBy("doc_id").agg(F.max("n_shingles").alias("n_shingles"))
    texts = docs.select(F.col("doc_id").alias("text_id"), "text")

    def with_texts(ids: DataFrame) -> DataFrame:
        """ids (a written row a document and group) with each of the document's texts once; where ids are small, they go to the texts."""
        return ids.join(texts.join(ids.select(F.col("doc_id").alias("text_id")), "text_id", "left_semi").distinct(), F.col("doc_id") == F.col("text_id")).drop("text_id")

    # stars: each document outside of its keys' largest components with the head of such a one that it shares most keys with
    links = None
    for nth in range(STAR_ROUNDS):
        if held.isEmpty():
            break
        parts = held.groupBy("band_key", "component").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.xxhash64("doc_id", F.lit(nth)).alias("order"), "doc_id"))["doc_id"].alias("head"))
        heads = parts.groupBy("band_key").agg(F.max(F.struct("n", (-F.col("component")).alias("order"), "component", "head")).alias("top")).select("band_key", F.col("top.component").alias("top"), F.col("top.head").alias("head"))
        met = held.join(materialize(heads, "heads"), "band_key").filter("component <> top").groupBy("doc_id", "head").agg(F.count(F.lit(1)).alias("n"))
        stars = met.groupBy("doc_id").agg(F.max(F.struct("n", (-F.col("head")).alias("order"), "head"))["head"].alias("head"))
        stars = materialize(stars.join(sizes, "doc_id"), "stars")
        spread = materialize(stars.groupBy("head").agg(blocks_needed(STAR_DOCS).alias("blocks")), "spread")
        members = stars.join(spread, "head").select("head", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).alias("block"), "doc_id")
        every = spread.select("head", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("head").alias("doc_id"))
        found = _links_of_groups(with_texts(materialize(members.unionByName(every), "members")), ["head", "block"], ["doc_id"], shingle, percent, star_links)
        found = materialize(found, "links")
        links = found if links is None else links.unionByName(found)
        component = connected_components(links).select(F.col("node").alias("doc_id"), "component")
        now = held.select("band_key", "doc_id").join(component, "doc_id", "left").select("band_key", "doc_id", F.coalesce("component", "doc_id").alias("component"))
        now = materialize(now, "now")
        among = now.groupBy("band_key").agg((F.min("component") != F.max("component")).alias("several")).filter("several").select("band_key")
        held = materialize(now.join(materialize(among, "among"), "band_key"), "held")

    # families: what these keys tie together
    least = held.groupBy("band_key").agg(F.min("doc_id").alias("head"))
    left = materialize(held.join(materialize(least, "least"), "band_key"), "open")
    family = connected_components(left.filter("doc_id <> head").select(F.col("head").alias("a"), F.col("doc_id").alias("b")))
    known = left.select("doc_id", "component").distinct().join(family.select(F.col("node").alias("doc_id"), F.col("component").alias("family")), "doc_id").join(sizes, "doc_id")
    known = materialize(known, "families")
    parts = known.groupBy("family", "component").agg(F.count(F.lit(1)).alias("n"))
    largest = parts.groupBy("family").agg(F.max(F.struct("n", "component")).alias("top")).select("family", F.col("top.component").alias("top"))
    known = materialize(known.join(largest, "family").withColumn("is_top", F.col("component") == F.col("top")), "known")
    shape = known.groupBy("family", "is_top").agg(blocks_needed(BLOCK_DOCS).alias("blocks")).groupBy("family").agg(
        F.sum(F.when(~F.col("is_top"), F.col("blocks"))).alias("others"), F.sum(F.when(F.col("is_top"), F.col("blocks"))).alias("tops")
    )
    placed = known.join(materialize(shape, "shape"), "family").withColumn("hash", F.xxhash64("doc_id"))
    placed = placed.withColumn("own", F.when(F.col("is_top"), F.col("others") + F.pmod("hash", F.col("tops"))).otherwise(F.pmod("hash", F.col("others"))))
    # blocks of the largest component meet those of the others, which meet all
    last = F.when(F.col("is_top"), F.col("others")).otherwise(F.col("others") + F.col("tops"))
    ids = placed.select("family", "doc_id", "component", "own", F.explode(F.sequence(F.lit(0), last - 1)).alias("other"))
    ids = ids.select("family", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "doc_id", "component")
    second = _links_of_groups(with_texts(materialize(ids, "members")), ["family", "x", "y"], ["own", "doc_id"], shingle, percent, family_links)

    # rows of one doc_id with several texts
    double = nodes.groupBy("doc_id").agg((F.min("key") != F.max("key")).alias("several")).filter("several").select("doc_id")
    same = nodes.join(double, "doc_id", "left_semi").join(classes, "key").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    groups = connected_components(reduce(DataFrame.unionByName, [x for x in (links, second, same) if x is not None]))
    named = materialize(classes.join(groups, classes["rep"] == groups["node"], "left").select("key", F.coalesce("component", "rep").alias("component_id")), "named")
    slim = sketches.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("key", F.concat(F.lit("id"), F.col("doc_id").cast("string")).cast("binary"))).alias("key"))
    return (
        slim.join(named, "key", "left")
        .select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )


def keep_one(docs: DataFrame, shingle: int = SHINGLE, percent: int = THRESHOLD_PERCENT) -> DataFrame:
    """The rows of docs whose doc_id is the smallest of its group of near-duplicates, with the columns of docs.

    Null and empty texts and rows without doc_id stay; repeated rows of a doc_id share its fate; an empty table stays empty;
    columns of any name are kept as they are."""
    dropped = near_duplicates(docs, shingle, percent).filter(~F.col("kept")).select(F.col("doc_id").alias("dropped_id")).distinct()
    return docs.join(dropped, docs["doc_id"] == dropped["dropped_id"], "left_anti")
