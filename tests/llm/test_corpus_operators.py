"""Operators that gather from the whole corpus, against brute force and on odd rows."""

import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from marlstone.llm import components, exact_topk, hmm_lm, near_dedup, toxicity
from marlstone.llm.common import table
from marlstone.llm.queries import op3_exact_topk, op4_minhash_dedup, op7_hmm_lm, op9_toxicity
from tests.llm.test_text_operators import odd_documents


def shingles(text, n=3):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def brute_components(docs, n=3, percent=85):
    sets = {i: shingles(t, n) for i, t in docs.items()}
    root = {i: i for i in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(docs), 2):
        s, t = sets[a], sets[b]
        if s and t and min(len(s), len(t)) * 100 >= percent * max(len(s), len(t)) and 100 * len(s & t) >= percent * len(s | t):
            p, q = find(a), find(b)
            root[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in docs}


def test_near_duplicates(spark, sf_dir):
    docs = {d["doc_id"]: d["text"] for d in table(spark, sf_dir, "documents").collect()}
    want = brute_components(docs)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in op4_minhash_dedup(spark, sf_dir).collect()}
    assert got == want and any(i != c for i, (_, c) in want.items())


@pytest.mark.parametrize(("n", "percent"), [(3, 85), (5, 80)])
def test_near_duplicate_families(spark, n, percent, monkeypatch):
    """A large family of graded copies, in several blocks, with chains of links."""
    monkeypatch.setattr(near_dedup, "BLOCK_DOCS", 40)
    monkeypatch.setattr(near_dedup, "STAR_DOCS", 7)
    rng = random.Random(5)
    base = [f"w{rng.randint(0, 300)}" for _ in range(120)]
    docs = {}
    for i in range(150):
        words = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 2, 3, 4, 6, 9])):
            words[rng.randrange(len(words))] = f"v{rng.randint(0, 10**6)}"
        docs[i] = " ".join(words)
    for i in range(150, 170):
        docs[i] = " ".join(f"u{rng.randint(0, 10**6)}" for _ in range(rng.choice([1, 2, 5, 8])))
    docs |= {200: "A b  C", 201: "a B\tc", 202: "a b", 203: "A B", 204: None, 205: "", 206: None}
    frame = spark.createDataFrame([(i, t, "x", "y") for i, t in docs.items()], "doc_id long, text string, family string, key string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(frame, n, percent).collect()}
    assert got == brute_components(docs, n, percent)
    kept = near_dedup.keep_one(frame, n, percent)
    assert kept.columns == frame.columns
    assert {r["doc_id"] for r in kept.collect()} == {c for _, c in got.values()}


def test_near_duplicates_odd_rows(spark):
    docs = odd_documents(spark)
    rows = near_dedup.near_duplicates(docs).collect()
    assert len(rows) == docs.count()
    assert {r["component_id"] for r in rows if r["doc_id"] == 5} == {5}
    assert near_dedup.near_duplicates(docs.limit(0)).count() == 0
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    near = b + " end"
    frame = spark.createDataFrame([(5, a), (5, b), (5, b), (3, a), (9, near), (12, c), (None, a), (None, None), (14, ""), (14, c), (20, "c0 c1"), (20, a)], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(frame).collect()), key=str)
    want = [(5, 38, 3, False), (5, 38, 3, False), (5, 38, 3, False), (3, 38, 3, True), (9, 39, 3, False), (12, 38, 12, True), (None, 38, None, True), (None, 0, None, True)]
    want += [(14, 0, 14, True), (14, 38, 12, False), (20, 1, 3, False), (20, 38, 3, False)]
    assert got == sorted(want, key=str)
    assert sorted((r["doc_id"], r["text"]) for r in near_dedup.keep_one(frame).collect() if r["doc_id"]) == [(3, a), (12, c)]


def test_bands_miss_no_pair_at_the_threshold():
    """Small sets too: their registers are no copies of each other."""
    rng = np.random.RandomState(3)
    rows = near_dedup.band_rows(85)
    for union in (20, 100, 300, 900):
        sets = []
        for _ in range(600):
            x = rng.randint(0, 2**62, union).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)
            own = union * 15 // 100
            sets += [np.sort(x[: union - own // 2]), np.sort(np.r_[x[: union - own], x[union - own // 2 :]])]
        signs = near_dedup.registers(sets)
        keys = near_dedup.band_keys(signs, rows)
        assert (keys[::2] == keys[1::2]).any(axis=1).all()
        share = (signs[::2] == signs[1::2]).mean(axis=1)
        spread = (0.85 * 0.15 / near_dedup.REGISTERS) ** 0.5
        assert abs(share.mean() - (union - own) / union) < 0.01 and share.std() < 1.2 * spread


def test_common_counts():
    rng = np.random.RandomState(4)
    sets = [np.unique(rng.randint(0, 300, rng.randint(1, 200)).astype(np.uint64)) for _ in range(30)]
    got = near_dedup.common_counts(sets[:12], sets[12:], 37)
    assert got.tolist() == [[len(np.intersect1d(a, b)) for b in sets[12:]] for a in sets[:12]]


def test_sketches():
    rng = np.random.RandomState(1)
    for size in (5, 60, 2000):
        errors = []
        for _ in range(40):
            x = rng.randint(0, 2**62, size * 2).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            a, b = np.unique(x[: size + size // 2]), np.unique(x[size // 2 :])
            truth = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            r = near_dedup.registers([a, b])
            errors.append(near_dedup.estimates(r[:1], r[1:])[0, 0] - truth)
        assert abs(np.mean(errors)) < 0.03
    assert near_dedup.registers([a])[0].tolist() == near_dedup.registers([b, a])[1].tolist()


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 60)] + [(rng.randint(100, 200), rng.randint(100, 200)) for _ in range(60)] + [(7, 7), (None, 3)]
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in edges:
        if a is not None and a != b:
            p, q = find(a), find(b)
            root[max(p, q)] = min(p, q)
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in list(root)}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_search(rows, asked, k, scale=64):
    out = {}
    ints = [(i, [math.floor(scale * float(x)) for x in v]) for i, v in rows]
    for q, x in asked:
        qi = [math.floor(scale * float(c)) for c in x]
        scored = sorted((-sum(a * b for a, b in zip(qi, v)), i) for i, v in ints if i != q)
        out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def test_topk(spark, sf_dir):
    rows = [(r["vec_id"], r["embedding"]) for r in table(spark, sf_dir, "embeddings").collect()]
    got = {}
    for r in op3_exact_topk(spark, sf_dir).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert got == brute_search(rows, [r for r in rows if r[0] % 20 == 0], 20)


def test_topk_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(exact_topk, "CANDIDATE_BLOCK", 3)
    monkeypatch.setattr(exact_topk, "GROUP_BYTES", 60)
    vectors = [(0, [1.0, 0.5]), (1, [1.0, 0.5]), (2, [1.0]), (3, None), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [-1.0, 3.0, 9.0]), (7, [-1.0, 3.0, 9.0]), (20, [1e9, -1e9]), (40, []), (None, [1.0, 1.0])]
    frame = spark.createDataFrame([(i, v, 1) for i, v in vectors], "vec_id long, embedding array<float>, score long")
    from pyspark.sql import functions as F

    got = {}
    for r in exact_topk.search(frame, F.col("vec_id") % 20 == 0, k=4).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    usable = [(i, [float(np.float32(x)) for x in v]) for i, v in vectors if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    assert got == brute_search(usable, [v for v in usable if v[0] % 20 == 0], 4)
    assert exact_topk.search(frame.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    sparse = [(i, [random.Random(f"{i} {j}").choice([0.0] * 9 + [1.5, -0.7]) for j in range(30)]) for i in range(60)]
    frame = spark.createDataFrame(sparse, "vec_id long, embedding array<double>")
    got = {}
    for r in exact_topk.search(frame, F.col("vec_id") % 20 == 0, k=7).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert got == brute_search(sparse, [v for v in sparse if v[0] % 20 == 0], 7)
    huge = spark.createDataFrame([(0, [1e30]), (1, [1e30]), (2, [2.0])], "vec_id long, embedding array<double>")
    assert [r["vec_id"] for r in exact_topk.search(huge, F.col("vec_id") == 0).orderBy("rank").collect()] == [1, 2]


def test_scaled_recursions_are_exact():
    """Likelihoods and expected counts against sums over all state paths."""
    rng = np.random.RandomState(0)
    k, c = 3, 5
    model = hmm_lm.Model(rng.dirichlet(np.ones(k)), rng.dirichlet(np.ones(k), size=k), rng.dirichlet(np.ones(c), size=k).T)
    sequences = [rng.randint(0, c, n).astype(np.uint16) for n in (1, 4, 2, 5)]
    logs, start, move, emit = [], np.zeros(k), np.zeros((k, k)), np.zeros((c, k))
    for s in sequences:
        total, parts = 0.0, []
        for path in itertools.product(range(k), repeat=len(s)):
            p = model.start[path[0]] * np.prod([model.move[a, b] for a, b in zip(path, path[1:])]) * np.prod([model.emit[x, a] for x, a in zip(s, path)])
            total += p
            parts.append((path, p))
        logs.append(math.log(total))
        for path, p in parts:
            start[path[0]] += p / total
            for a, b in zip(path, path[1:]):
                move[a, b] += p / total
            for x, a in zip(s, path):
                emit[x, a] += p / total
    assert model.forward(sequences) == pytest.approx(logs, rel=1e-4)
    got = model.expected(sequences)
    assert got[0] == pytest.approx(start, rel=1e-3) and got[1] == pytest.approx(move, rel=1e-3) and got[2] == pytest.approx(emit, rel=1e-3, abs=1e-6)
    assert got[3] == pytest.approx(sum(logs), rel=1e-4)


def test_cut_sequences_give_the_same(monkeypatch):
    """Segments chained by their matrices against the recursion over whole sequences."""
    rng = np.random.RandomState(1)
    model = hmm_lm.Model.initial(rng.gamma(1, 1, 50) + 0.1, 5)
    sequences = [rng.randint(0, 50, n).astype(np.uint16) for n in (3, 700, 1, 2500, 999, 1000, 1001)]
    logs, want = model.forward(sequences), model.expected(sequences)
    monkeypatch.setattr(hmm_lm, "LONG", 500)
    monkeypatch.setattr(hmm_lm, "SEGMENT", 100)
    for block in (150, 10_000):
        monkeypatch.setattr(hmm_lm, "BLOCK_TOKENS", block)
        assert model.forward(sequences) == pytest.approx(logs, rel=1e-5)
        for a, b in zip(model.expected(sequences), want):
            assert a == pytest.approx(b, rel=1e-3, abs=1e-3)


def check_language_scores(rows, docs):
    tokens = {i: [*(t or "").encode().lower().split(), None] for i, t in docs}
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    counts = Counter(w for i, t in docs if not held(i) for w in [*(t or "").encode().lower().split(), None])
    n, v = sum(counts.values()), len(counts)
    for r in rows:
        words = tokens[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["train_tokens"]) == (held(r["doc_id"]), len(words), n)
        assert r["n_known"] == sum(counts[w] > 0 for w in words)
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words)
        assert r["base_score"] == pytest.approx(base, rel=1e-9, abs=1e-9)
        assert math.isfinite(r["score"]) and r["score"] < 0


@pytest.mark.parametrize("heavy", [200_000, 300])
def test_language_scores(spark, sf_dir, heavy, monkeypatch):
    monkeypatch.setattr(hmm_lm, "HEAVY", heavy)
    monkeypatch.setattr(hmm_lm, "WORDS", min(heavy, 2000))
    rows = op7_hmm_lm(spark, sf_dir).collect()
    docs = [(d["doc_id"], d["text"]) for d in table(spark, sf_dir, "documents").collect()]
    assert len(rows) == len(docs)
    check_language_scores(rows, docs)
    out = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def test_language_odd_rows(spark):
    docs = odd_documents(spark)
    rows = hmm_lm.score_documents(docs).collect()
    assert len(rows) == docs.count()
    check_language_scores(rows, [(d["doc_id"], d["text"]) for d in docs.collect()])
    assert hmm_lm.score_documents(docs.limit(0)).count() == 0
    only = spark.createDataFrame([(i, "a b") for i in range(200) if zlib.crc32(str(i).encode()) % 5 == 1], "doc_id long, text string")
    assert all(r["train_tokens"] == 0 and math.isfinite(r["score"]) for r in hmm_lm.score_documents(only).collect())


def test_language_trains_on_long_texts(spark, monkeypatch):
    """Every text is cut for the start, and the rounds over all rows change the model too."""
    monkeypatch.setattr(hmm_lm, "INIT_TOKENS", 10)
    monkeypatch.setattr(hmm_lm, "LONG", 40)
    monkeypatch.setattr(hmm_lm, "SEGMENT", 16)
    end, red, blue = 0, 1, 2
    sequences = [np.asarray([red, blue] * n + [end], np.uint16) for n in range(20, 60)]
    of_suffix = {hmm_lm.suffix_class(t): 1600.5 for t in (b"red", b"blue")}
    vocabulary = hmm_lm.Vocabulary([("red", 1580), ("blue", 1580)], 40, of_suffix, 3200, 3, 0)
    training = spark.createDataFrame([(i, len(s), s.tobytes()) for i, s in enumerate(sequences)], "doc_id long, n_tokens long, classes binary")
    untrained, trained = hmm_lm.Model.initial(vocabulary.mass), hmm_lm.fit(training, vocabulary)
    tokens = sum(map(len, sequences))
    assert trained.forward(sequences).sum() > untrained.forward(sequences).sum() + 0.1 * tokens
    assert hmm_lm.fit(training.limit(0), vocabulary).emit.tolist() == untrained.emit.tolist()
    monkeypatch.setattr(hmm_lm, "ROUNDS", 0)
    assert hmm_lm.fit(training, vocabulary).emit.tolist() != trained.emit.tolist()


def test_language_scores_texts_over_4000_tokens(spark, monkeypatch):
    rounds = []
    once = hmm_lm.baum_welch_round
    monkeypatch.setattr(hmm_lm, "baum_welch_round", lambda *a: rounds.append(1) or once(*a))
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * j) % 50}" for j in range(4100 + i))) for i in range(12)], "doc_id long, text string")
    rows = hmm_lm.score_documents(docs).collect()
    check_language_scores(rows, [(d["doc_id"], d["text"]) for d in docs.collect()])
    assert len(rounds) == hmm_lm.ROUNDS and sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)


def test_toxicity_held_out(spark):
    sf_dir = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["toxic"] for r in table(spark, sf_dir, "labels").collect()}
    rows = op9_toxicity(spark, sf_dir).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    out = [(labels[r["doc_id"]], r["predicted"]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert np.mean([a == b for a, b in out]) > 0.95


def test_toxicity_folds_and_exceptions(spark):
    assert toxicity.fold("ÏD1ΟT, 1d!0t​  $cum 2024") == " idiot idiot scum "
    assert toxicity.fold("") == "  " or toxicity.fold("").strip() == ""
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("aeioubdklmnrst") for _ in range(6))
    rows, labels = [], []
    for i in range(400):
        words = [word() for _ in range(40)]
        kind = i % 4
        if kind == 0:
            words[rng.randrange(1, 39)] = rng.choice(["blarghit", "bl4rghit", "blarghens"])
        if kind == 1 and i % 8 == 1:
            at = rng.randrange(1, 38)
            words[at : at + 2] = ["blarghit", "museum"]
        rows.append((i, " ".join(words), "x"))
        labels.append((i, 1, int(kind == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score_documents(docs, marks).collect()}
    assert np.mean([got[i] == t for i, _, t in labels]) > 0.97
    kept = toxicity.keep_clean(docs, marks)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, p in got.items() if not p}


def naive_weight(lexicon, text):
    """Words one by one, by substring comparison alone."""
    words, total = toxicity.fold(text).split(), 0.0
    for i, w in enumerate(words):
        weight = max((x for e, x in lexicon.weights.items() if f" {w} ".startswith(e)), default=0.0)
        left = i and (f" {words[i - 1]} {w} ", len(words[i - 1]) + 1) in lexicon.exceptions
        right = i + 1 < len(words) and (f" {w} {words[i + 1]} ", 0) in lexicon.exceptions
        total += 0.0 if left or right else weight
    return total, len(words)


def test_toxicity_matches_as_substring_search_does(spark):
    lexicon = toxicity.Lexicon({" idio": 2.0, " idiot ": 3.0, " moron ": 1.5, " sav": 0.5}, {(" village idiot ", 8), (" idiot savant ", 0)}, (0.0, 0.0, 0.0))
    assert naive_weight(lexicon, "village idiot savant moron") == (2.0, 4)
    rng = random.Random(6)
    texts = ["village idiot savant moron", "", "idiot", "savant idiot village", "idiot savant idiot"]
    texts += [" ".join(rng.choice(["village", "idiot", "idiots", "savant", "moron", "m0r0n", "x"]) for _ in range(rng.randint(0, 12))) for _ in range(500)]
    for (a, b), text in zip(lexicon.features(texts, lexicon.matcher()), texts):
        total, n = naive_weight(lexicon, text)
        assert a == pytest.approx(math.log1p(total)) and b == pytest.approx(math.log1p(100 * total / (11 + n)) if total else 0.0)
    sf_dir = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    lexicon = toxicity.fit(docs, labels)
    assert lexicon.weights
    texts = [d["text"] or "" for d in docs.limit(150).collect()]
    for (a, _), text in zip(lexicon.features(texts, lexicon.matcher()), texts):
        assert a == pytest.approx(math.log1p(naive_weight(lexicon, text)[0]))


def test_toxicity_sample_is_bounded(spark):
    docs = spark.createDataFrame([(i % 20, f"text {i % 20}") for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i % 20, 1, i % 2) for i in range(60)], "doc_id long, quality int, toxic int")
    rows = toxicity.labelled_sample(docs, labels, 10).collect()
    assert 0 < len(rows) == len({r["label_id"] for r in rows}) <= 10
    assert toxicity.score_documents(docs, labels).count() == 200


def test_toxicity_odd_rows(spark, sf_dir):
    docs, labels = odd_documents(spark), table(spark, sf_dir, "labels")
    assert toxicity.score_documents(docs, labels).count() == docs.count()
    assert all(0 <= r["score"] <= 1 for r in toxicity.score_documents(docs, labels.limit(0)).collect())
    assert toxicity.score_documents(docs.limit(0), labels).count() == 0
    kept = toxicity.keep_clean(docs, labels.limit(0))
    key = lambda d: str(list(d))
    assert kept.columns == docs.columns and sorted(kept.collect(), key=key) == sorted(docs.collect(), key=key)
    assert toxicity.keep_clean(docs.limit(0), labels).count() == 0


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = table(spark, sf_dir, "documents")
    names = docs.columns
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, sf_dir)
        assert out.columns == names
        docs = spark.createDataFrame(out.collect(), docs.schema)
        assert docs.count() > 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    rows = packed.collect()
    whole = corpus_pipeline.run(spark, sf_dir).collect()
    key = lambda r: (r["doc_id"], r["start"], r["length"], r["ids_crc32"])
    assert sorted(map(key, rows)) == sorted(map(key, whole))
    assert {r["doc_id"] for r in rows} == {d["doc_id"] for d in docs.collect()}
    from marlstone.llm.secret_scan import find_secrets

    assert not any(find_secrets(d["text"])[1] for d in docs.collect())
    sets = {d["doc_id"]: shingles(d["text"], 5) for d in docs.collect()}
    assert not any(100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) for a, b in itertools.combinations(sets, 2) if sets[a])


def test_pipeline_stages_on_odd_rows(spark, sf_dir, tmp_path):
    import corpus_pipeline

    docs = odd_documents(spark)
    clean = " ".join(f"word{i}" for i in range(60))
    more = spark.createDataFrame([(90, clean, "en", None, 9, "k", 1, "r"), (91, clean + " end", "en", "a", 9, "k", 1, "r"), (92, clean + " password=hunter22 more", None, "a", None, None, None, None), (92, clean + " password=hunter22 more", None, "a", None, None, None, None), (None, clean, "en", "a", 1, "k", 1, "r")], docs.schema)
    docs = docs.unionByName(more)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.schema.names == docs.schema.names and stage(spark, docs.limit(0), sf_dir).count() == 0
        got = out.collect()
        ids = [r["doc_id"] for r in got]
        if name == "quality rules":
            assert {90, 91, 92, None} <= set(ids) and ids.count(92) == 2 and ids.count(None) == 1 and not {1, 2, 3} & set(ids)
        elif name == "toxicity":
            assert len(got) == docs.count()
        elif name == "MinHash near-dedup":
            assert 90 in ids and not {91, 92} & set(ids) and {1, 2, 3, None} <= set(ids) and ids.count(5) == 2 and 5 in ids
        else:
            assert len(got) == docs.count() and all("hunter22" not in (r["text"] or "") for r in got)
            assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in got)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in docs.collect()}
    assert all(r["doc_tokens"] == 1 for r in packed if r["doc_id"] in (1, 2)) and sum(r["doc_id"] == 92 for r in packed) == 2
    folder = str(tmp_path)
    docs.write.parquet(f"{folder}/documents.parquet")
    table(spark, sf_dir, "labels").limit(0).write.parquet(f"{folder}/labels.parquet")
    whole = corpus_pipeline.run(spark, f"file://{folder}").collect()
    assert {r["doc_id"] for r in whole} >= {90, None} and not {1, 2, 3, 91, 92} & {r["doc_id"] for r in whole}
    docs.limit(0).write.parquet(f"{folder}/none/documents.parquet")
    table(spark, sf_dir, "labels").write.parquet(f"{folder}/none/labels.parquet")
    assert corpus_pipeline.run(spark, f"file://{folder}/none").count() == 0
