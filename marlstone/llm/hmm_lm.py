"""Language-model scoring by a hidden Markov model over word classes.

Tokens are words (runs of other than ASCII white space, A-Z lower-cased) and one end token a text.  The WORDS most
frequent tokens are classes of their own; every other token, known or not, belongs to one of SUFFIXES classes by its
last three bytes.  The model's probability of a text is that of its class sequence under a hidden Markov model of
STATES states, by the scaled forward recursion over the whole sequence, times each token's share of its class, by
the add-half counts that the base score uses too.  Each class keeps half a count for tokens never seen.

Training: counts of all tokens of all training rows are aggregated by token.  Baum-Welch starts from parameters
fitted to INIT_PARTS parts of training texts (all texts are cut into parts of INIT_TOKENS tokens; the parts with the
smallest hashes serve) and then takes ROUNDS rounds over all training rows, whole: each partition sums its expected
counts, and these are added up by class.

Counts of the most frequent tokens, HEAVY at most, go to all workers; the rest, without bound, meets its tokens in a join.

Memory: texts are encoded some MB at a time and sequences worked on in blocks of BLOCK_TOKENS.  A sequence over
LONG tokens is cut into segments.  A segment is a matrix over states; chaining these gives the exact forward and
backward vectors at its ends, and the segments then pass through the blocks as sequences of their own.

Defined cases: null and empty texts are the end token alone; very long texts are scored and train whole; rows without
doc_id train and are not held out; repeated rows, and different texts of one doc_id, count and are scored each; without
training rows all counts are zero and the model has one class distribution; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import bounded_batches, byte_texts, crc32_of_id, hash_sample, map_batches, materialize

STATES, WORDS, SUFFIXES, HEAVY = 12, 8_000, 2_048, 200_000
INIT_PARTS, INIT_TOKENS, INIT_ROUNDS, ROUNDS = 3_000, 1_000, 12, 3
#: Weight, in counts, of the class distribution mixed into each state's emissions, and of even transitions.
EMISSION_PRIOR, TRANSITION_PRIOR = 20.0, 1.0
#: Tokens of one flush of the count map, and of one block of sequences.
FLUSH_TOKENS, BLOCK_TOKENS = 200_000, 500_000
#: Tokens from which a sequence is cut, and tokens of a segment.
LONG, SEGMENT = 2_000, 500
END = ""


def suffix_class(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % SUFFIXES


def token_counts(docs: DataFrame) -> DataFrame:
    """token, c over all rows of docs; the end token is the empty string."""
    bounded_batches(docs.sparkSession)
    schema = pa.schema([("token", pa.string()), ("c", pa.int64())])

    def run(batches):
        counts: Counter = Counter()

        def flush():
            keys = [k.decode() for k in counts]
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(list(counts.values()), pa.int64())], schema=schema)

        for batch in batches:
            for t in byte_texts(batch.column("text")):
                counts.update(t.lower().split())
            counts[b""] += batch.num_rows
            if len(counts) > FLUSH_TOKENS:
                yield flush()
                counts.clear()
        if counts:
            yield flush()

    return docs.select("text").mapInArrow(run, "token string, c long").groupBy("token").agg(F.sum("c").alias("c"))


def size_class():
    """Sixteenths of powers of two of a token's count; classes are heavy or light as a whole."""
    return F.floor(F.log2("c") * 16).cast("int")


class Vocabulary:
    """Counts and classes of the HEAVY tokens, masses of the classes; class 0 is the end token."""

    def __init__(self, heavy: list[tuple[str, int]], end: int, suffix_mass: dict[int, float], total: int, types: int, least: int | None = None):
        tokens = [(b"", end)] + [(t.encode(), c) for t, c in heavy if t != END]
        self.index = {t: i for i, (t, _) in enumerate(tokens)}
        self.log_c = np.log10(np.asarray([c for _, c in tokens]) + 0.5)
        self.known = np.asarray([c > 0 for _, c in tokens])
        self.words = min(len(tokens), WORDS)
        self.classes = self.words + SUFFIXES
        self.class_of = np.asarray([i if i < self.words else self.words + suffix_class(t) for i, (t, _) in enumerate(tokens)], np.uint16)
        mass = np.full(self.classes, 0.5)
        mass[: self.words] = [c + 0.5 for _, c in tokens[: self.words]]
        for k, m in suffix_mass.items():
            mass[self.words + k] += m
        for t, c in tokens[1 : self.words]:
            mass[self.words + suffix_class(t)] -= c + 0.5  # counted with their suffixes, but classes of their own
        mass[self.words :] = np.maximum(mass[self.words :], 0.5)
        self.mass, self.total, self.types, self.least = mass, total, types, least  # least: the smallest size class of heavy tokens

    def encode(self, docs: list[list[bytes]]) -> dict[str, list]:
        """For each text its classes, sums over its heavy tokens, and its other tokens."""
        get = self.index.get
        sizes = np.fromiter((len(d) + 1 for d in docs), np.int64, len(docs))
        flat = np.fromiter((i for d in docs for i in (*map(get, d, [-1] * len(d)), 0)), np.int32, int(sizes.sum()))
        owner = np.repeat(np.arange(len(docs)), sizes)
        classes = self.class_of[flat]
        starts = np.concatenate([[0], np.cumsum(sizes)])
        rare: list[list[bytes]] = [[] for _ in docs]
        for at in np.flatnonzero(flat < 0).tolist():
            d = int(owner[at])
            word = docs[d][at - int(starts[d])]
            classes[at] = self.words + suffix_class(word)
            rare[d].append(word)
        heavy, of_suffix = flat >= 0, classes >= self.words
        log_c = np.where(heavy, self.log_c[flat], 0.0)
        share = np.where(of_suffix, log_c - np.log10(self.mass[classes]), 0.0)
        total = lambda x: np.bincount(owner, weights=x, minlength=len(docs))
        return {
            "n_tokens": sizes,
            "n_heavy": total(heavy & self.known[flat]).astype(np.int64),
            "log_c": total(log_c),
            "share": total(share),
            "classes": [classes[a:b].tobytes() for a, b in zip(starts[:-1], starts[1:])],
            "rare": [[w.decode() for w in r] for r in rare],
        }


class Model:
    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        """start: states; move: states by states; emit: classes by states."""
        self.start, self.move, self.emit = start.astype(np.float32), move.astype(np.float32), emit.astype(np.float32)

    @classmethod
    def initial(cls, mass: np.ndarray, states: int = STATES) -> Model:
        """Sticky transitions and the class distribution, bent at random for each state."""
        noise = np.random.RandomState(5).gamma(1.0, size=(len(mass), states)) + 0.2
        emit = mass[:, None] * noise
        move = np.full((states, states), 0.1 / max(1, states - 1))
        np.fill_diagonal(move, 0.9 if states > 1 else 1.0)
        return cls(np.full(states, 1 / states), move, emit / emit.sum(0))

    @classmethod
    def of_counts(cls, start: np.ndarray, move: np.ndarray, emit: np.ndarray, mass: np.ndarray) -> Model:
        """The M step, with the priors."""
        k = len(start)
        start, move = start + TRANSITION_PRIOR / k, move + TRANSITION_PRIOR / k
        emit = emit + EMISSION_PRIOR * (mass / mass.sum())[:, None]
        return cls(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))

    @staticmethod
    def _pack(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sequences by falling length, laid out step by step: (order, active sequences at each step, classes)."""
        sizes = np.asarray([len(s) for s in sequences])
        order = np.argsort(-sizes, kind="stable")
        active = np.searchsorted(-sizes[order], -np.arange(1, sizes.max() + 1), "right")
        flat = np.concatenate([sequences[i] for i in order])
        own = np.repeat(np.arange(len(order)), sizes[order])
        step = np.arange(len(flat)) - np.repeat(np.cumsum(sizes[order]) - sizes[order], sizes[order])
        packed = np.empty_like(flat)
        packed[(np.cumsum(active) - active)[step] + own] = flat
        return order, active, packed

    def forward(self, sequences: list[np.ndarray]) -> np.ndarray:
        """Natural logarithm of the likelihood of each sequence."""
        out = np.empty(len(sequences))
        for picked, run in (([i for i, s in enumerate(sequences) if len(s) < LONG], self._forward), ([i for i, s in enumerate(sequences) if len(s) >= LONG], lambda x: self._ends(x)[3])):
            if picked:
                out[picked] = run([sequences[i] for i in picked])
        return out

    def _forward(self, sequences: list[np.ndarray]) -> np.ndarray:
        order, active, packed = self._pack(sequences)
        alpha, at, logs = None, 0, np.zeros(len(order))
        for a in active.tolist():
            came = np.broadcast_to(self.start, (a, len(self.start))) if alpha is None else alpha[:a] @ self.move
            alpha = came * self.emit[packed[at : at + a]]
            scale = alpha.sum(1)
            alpha /= scale[:, None]
            logs[:a] += np.log(scale)
            at += a
        out = np.empty(len(order))
        out[order] = logs
        return out

    def _ends(self, sequences: list[np.ndarray], backward: bool = False) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
        """The segments of sequences, one sequence after another; for each segment the forward vector (adding up to 1) at the end of
        the segment before it, all zero for a first one, and the backward vector at its own end; and the logarithm of each
        sequence's likelihood."""
        segments = [s[at : at + SEGMENT] for s in sequences for at in range(0, len(s), SEGMENT)]
        k, n = len(self.start), len(segments)
        moved = np.empty((n, k, k), np.float32)  # from the vector that comes in to the one at the end, and its scale
        logs = np.zeros(n)
        for first in range(0, n, 2048):
            order, active, packed = self._pack(segments[first : first + 2048])
            m, scales, at = np.repeat(np.eye(k, dtype=np.float32)[None], len(order), 0), np.zeros(len(order)), 0
            for t, a in enumerate(active.tolist()):
                came = (m[:a].reshape(-1, k) @ self.move).reshape(-1, k, k) if t else m
                came = came * self.emit[packed[at : at + a]][:, None, :]
                scale = came.reshape(a, -1).sum(1)
                m[:a] = came / scale[:, None, None]
                scales[:a] += np.log(scale)
                at += a
            moved[first + order], logs[first + order] = m, scales
        before, after, likelihood = np.zeros((n, k), np.float32), np.ones((n, k), np.float32), np.zeros(len(sequences))
        j = 0
        for i, s in enumerate(sequences):
            begin, came = j, self.start.astype(np.float64)
            for j in range(begin, begin - (-len(s) // SEGMENT)):
                alpha = came @ moved[j]
                scale = alpha.sum()
                likelihood[i] += np.log(scale) + logs[j]
                alpha /= scale
                came = alpha @ self.move
                if SEGMENT * (j + 1 - begin) < len(s):
                    before[j + 1] = alpha
            if backward:
                beta = np.ones(k)
                for last in range(j, begin, -1):
                    beta = self.move @ (moved[last] @ beta)
                    beta /= beta @ before[last]
                    after[last - 1] = beta
            j += 1
        return segments, before, after, likelihood

    def expected(self, sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Expected counts (start, move, emit) and the log likelihood: the E step, forward and backward."""
        parts = []
        short, long = [s for s in sequences if len(s) < LONG], [s for s in sequences if len(s) >= LONG]
        if long:
            segments, before, after, _ = self._ends(long, backward=True)
            each = BLOCK_TOKENS // SEGMENT
            for at in range(0, len(segments), each):
                parts.append(self._expected(segments[at : at + each], before[at : at + each], after[at : at + each]))
        if short:
            parts.append(self._expected(short))
        return tuple(sum(x) for x in zip(*parts))

    def _expected(self, sequences: list[np.ndarray], before: np.ndarray | None = None, after: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """The same for a block of sequences, or of segments with the vectors around them."""
        order, active, packed = self._pack(sequences)
        k, steps = len(self.start), active.tolist()
        came, began = np.broadcast_to(self.start, (len(order), k)), np.ones(len(order), bool)
        if before is not None:
            before = before[order]
            began = ~before.any(axis=1)
            came = np.where(began[:, None], self.start, before @ self.move)
        alphas, scales = np.empty((len(packed), k), np.float32), np.empty(len(packed), np.float32)
        at, alpha = 0, None
        for a in steps:
            if alpha is not None:
                came = alpha[:a] @ self.move
            alpha = alphas[at : at + a]
            np.multiply(came, self.emit[packed[at : at + a]], out=alpha)
            s = scales[at : at + a] = alpha.sum(1)
            alpha /= s[:, None]
            at += a
        move = np.zeros((k, k))
        back = np.ones((steps[0], k), np.float32)  # of sequences that end at a later step this is read only once they are active
        if after is not None:  # their scale: a segment's last forward vector and its backward vector give 1
            back = after[order].astype(np.float32)
            sizes = np.asarray([len(s) for s in sequences])[order]
            ends = alphas[(np.cumsum(active) - active)[sizes - 1] + np.arange(len(order))]
            back /= (ends * back).sum(1, keepdims=True)
        following = 0
        transposed = np.ascontiguousarray(self.move.T)
        for t in range(len(steps) - 1, -1, -1):
            a = steps[t]
            at -= a
            here = alphas[at : at + a]
            if following:
                ahead = self.emit[packed[at + a : at + a + following]] * back[:following] / scales[at + a : at + a + following, None]
                move += here[:following].T @ ahead
                back[:following] = ahead @ transposed
            here *= back[:a]
            following = a
        if before is not None:  # steps into segments
            ahead = self.emit[packed[: steps[0]]] * back / scales[: steps[0], None]
            move += before.T @ ahead
        emit = np.stack([np.bincount(packed, weights=alphas[:, j], minlength=len(self.emit)) for j in range(k)], axis=1)
        return alphas[: steps[0]][began].sum(0, dtype=np.float64), move * self.move, emit, float(np.log(scales, dtype=np.float64).sum())


def blocks_of(sequences, most: int = BLOCK_TOKENS):
    """Lists of sequences of at most about most tokens."""
    held, size = [], 0
    for s in sequences:
        held.append(s)
        size += len(s)
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def baum_welch_round(encoded: DataFrame, model: Model, mass: np.ndarray) -> Model:
    """One round over the class sequences of encoded; what comes to the driver has the model's size."""
    spark, k = encoded.sparkSession, len(model.start)
    shared = spark.sparkContext.broadcast(model)
    names = [f"s{j}" for j in range(k)]
    schema = pa.schema([("row", pa.int32()), *((n, pa.float64()) for n in names)])
    n_classes = len(mass)

    def run(batches):
        model, sums = shared.value, None
        sequences = (np.frombuffer(s, np.uint16) for batch in batches for s in batch.column("classes").to_pylist())
        for held in blocks_of(sequences):
            start, move, emit, _ = model.expected(held)
            part = np.concatenate([emit, start[None], move])
            sums = part if sums is None else sums + part
        if sums is not None:
            rows = np.flatnonzero(sums.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(rows.astype(np.int32)), *(pa.array(sums[rows, j]) for j in range(k))], schema=schema)

    bounded_batches(spark)
    parts = encoded.select("classes").mapInArrow(run, ", ".join(["row int", *(f"{n} double" for n in names)]))
    rows = parts.groupBy("row").agg(*(F.sum(n).alias(n) for n in names)).toPandas()
    shared.destroy()
    sums = np.zeros((n_classes + 1 + k, k))
    sums[rows["row"].to_numpy()] = rows[names].to_numpy()
    return Model.of_counts(sums[n_classes], sums[n_classes + 1 :], sums[:n_classes], mass)


def fit_vocabulary(counts: DataFrame) -> Vocabulary:
    """counts: token, c of the training rows."""
    totals = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v"), F.sum(F.when(F.col("token") == END, F.col("c"))).alias("end")).first()
    words = counts.filter(F.col("token") != END).withColumn("size", size_class())
    sizes = words.groupBy("size").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("size")).collect()  # a few hundred rows
    least, held = None, 0
    for r in sizes:
        held += r["n"]
        if held > HEAVY:
            break
        least = r["size"]
    heavy = [] if least is None else sorted(((r["token"], r["c"]) for r in words.filter(F.col("size") >= least).select("token", "c").collect()), key=lambda t: (-t[1], t[0]))  # at most HEAVY rows
    suffix = F.crc32(F.substring(F.col("token").cast("binary"), -3, 3)) % SUFFIXES
    mass = counts.filter(F.col("token") != END).groupBy(suffix.cast("int").alias("k")).agg(F.sum(F.col("c") + 0.5).alias("m")).collect()  # at most SUFFIXES rows
    return Vocabulary(heavy, totals["end"] or 0, {r["k"]: r["m"] for r in mass}, totals["n"] or 0, totals["v"] or 0, least)


def fit(training: DataFrame, vocabulary: Vocabulary) -> Model:
    """training: encoded training rows (doc_id, n_tokens, classes)."""
    model = Model.initial(vocabulary.mass)
    size = 2 * INIT_TOKENS  # two bytes a token
    parts = training.select("doc_id", F.posexplode(F.expr(f"transform(sequence(0, cast((length(classes) - 1) div {size} as int)), i -> substring(classes, 1 + {size} * i, {size}))")).alias("nth", "classes"))
    parts = parts.select(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "nth").alias("part"), "classes")
    first = hash_sample(parts, "part", INIT_PARTS, "classes").collect()  # bounded rows of bounded length
    if not first:  # no training rows
        return model
    held = [np.frombuffer(r["classes"], np.uint16) for r in first]
    for _ in range(INIT_ROUNDS):
        sums = [model.expected(block)[:3] for block in blocks_of(held)]
        model = Model.of_counts(*(sum(x) for x in zip(*sums)), vocabulary.mass)
    for _ in range(ROUNDS):
        model = baum_welch_round(training, model, vocabulary.mass)
    return model


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of docs."""
    spark = docs.sparkSession
    held_out = F.coalesce(crc32_of_id() % 5 == 1, F.lit(False))
    rows = docs.select("doc_id", held_out.alias("held_out"), "text")
    counts = materialize(token_counts(rows.filter(~F.col("held_out"))), "counts")
    vocabulary = fit_vocabulary(counts)
    shared = spark.sparkContext.broadcast(vocabulary)  # HEAVY tokens at most

    def encode():
        def each(batch):
            yield {"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), **shared.value.encode([t.lower().split() for t in byte_texts(batch.column("text"))])}

        return each

    encoded = map_batches(rows, "doc_id long, held_out boolean, n_tokens long, n_heavy long, log_c double, share double, classes binary, rare array<string>", encode)
    encoded = materialize(encoded.withColumn("row", F.monotonically_increasing_id()), "encoded")
    model = fit(encoded.filter(~F.col("held_out")), vocabulary)
    shared_model = spark.sparkContext.broadcast(model)

    light = counts.withColumnRenamed("token", "word")
    if vocabulary.least is not None:
        light = light.filter(size_class() < vocabulary.least)
    words = encoded.select("row", F.explode("rare").alias("word"))
    looked_up = words.join(light, "word", "left").select("row", F.coalesce("c", F.lit(0)).alias("c"))
    sums = looked_up.groupBy("row").agg(F.sum(F.log10(F.col("c") + 0.5)).alias("rare_log_c"), F.sum((F.col("c") > 0).cast("long")).alias("rare_known"))

    def run(batches):
        for batch in batches:
            sequences = (np.frombuffer(s, np.uint16) for s in batch.column("classes").to_pylist())
            logs = np.concatenate([np.empty(0), *(shared_model.value.forward(block) for block in blocks_of(sequences))]) / np.log(10)
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + [pa.array(logs)], names=[*names, "log_likelihood"])

    names = ["row", "doc_id", "held_out", "n_tokens", "n_heavy", "log_c", "share"]
    bounded_batches(spark)
    scored = encoded.select(*names, "classes").mapInArrow(run, "row long, doc_id long, held_out boolean, n_tokens long, n_heavy long, log_c double, share double, log_likelihood double")
    scored = scored.join(sums, "row", "left")
    rare = F.coalesce("rare_log_c", F.lit(0.0))
    n, v = vocabulary.total, vocabulary.types
    return scored.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_heavy") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("log_c") + rare - F.col("n_tokens") * F.lit(float(np.log10(n + 0.5 * (v + 1))))).alias("base_score"),
        (F.col("log_likelihood") + F.col("share") + rare).alias("score"),
    )
