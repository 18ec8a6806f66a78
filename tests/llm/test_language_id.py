"""op13 by held-out accuracy, and its parts by hand."""

import zlib

import numpy as np
import pytest

from marlstone.llm import language_id, queries


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in queries.op13_language_id(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert got.keys() == {d.doc_id for d in docs}
    assert all(got[d.doc_id].held_out == (zlib.crc32(str(d.doc_id).encode()) % 4 == 2) and 0 <= got[d.doc_id].score <= 1 for d in docs)
    held = [d for d in docs if got[d.doc_id].held_out]
    assert sum(got[d.doc_id].lang_pred == d.lang for d in held) >= 0.98 * len(held)


def test_held_out_rows_and_other_columns_change_nothing(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    changed = docs.selectExpr("doc_id", "text", "if(crc32(cast(cast(doc_id as string) as binary)) % 4 = 2, 'xx', lang) as lang", "'s' as source", "1 as label", "'h' as h")
    a, b = ({r.doc_id: (r.lang_pred, r.score) for r in language_id.predict_documents(d, 150).collect()} for d in (docs, changed))
    assert a == b


def test_odd_rows(spark):
    known = [(i, "the cat sat on that mat with others" if i % 2 else "der hund und die katze schlafen nicht", "en" if i % 2 else "de") for i in range(60)]
    odd = [(100, None, "en"), (101, "", None), (102, "12 34 !?", "en"), (103, "́", None), (104, "日本語", None), (None, "the the", None), (106, "der und " * 50_000, None), (106, "that with", None)]
    rows = spark.createDataFrame(known + odd, "doc_id long, text string, lang string")
    got = [(r.doc_id, r.lang_pred, r.score) for r in language_id.predict_documents(rows).collect()]
    by = dict((i, (p, s)) for i, p, s in got if i in (100, 101, 102, 103, 104))
    assert len(got) == len(known) + len(odd)
    assert all(by[i] == ("und", 0.0) for i in (100, 101, 102, 103)) and by[104][0] in ("de", "en")
    assert sorted(p for i, p, _ in got if i == 106) == ["de", "en"] and [p for i, p, _ in got if i is None] == ["en"]
    one = rows.filter("lang = 'en'")
    assert {r.lang_pred for r in language_id.predict_documents(one).filter("doc_id < 100").collect()} == {"en"}
    assert {(r.lang_pred, r.score) for r in language_id.predict_documents(rows.selectExpr("doc_id", "text", "cast(null as string) as lang")).collect()} == {("und", 0.0)}
    assert language_id.predict_documents(rows.limit(0)).collect() == []


def test_ngrams_are_those_of_each_text():
    texts = ["Ab  c", None, "", "é-é", "x" * 10, "ΑΒ"]
    together = list(language_id.text_features(texts))
    for t, (columns, has) in zip(texts, together):
        (alone, letter), = language_id.text_features([t])
        assert np.array_equal(np.sort(columns), np.sort(alone)) and has == letter
    sums, numbers, has = language_id.text_scores(texts, np.arange(language_id.FEATURES, dtype=float)[:, None])
    for (columns, _), s, n in zip(together, sums[:, 0], numbers):
        assert len(columns) == n and s == pytest.approx(columns.sum())
    assert list(has) == [True, False, False, True, True, True]


def test_leader_step_is_the_proximal_minimum():
    rng = np.random.default_rng(3)
    z, n = rng.normal(size=50), rng.random(50) * 4
    w = language_id.Leader.weights_of(z, n)
    curve = (language_id.BETA + np.sqrt(n)) / language_id.ALPHA + language_id.L2
    cost = lambda v: z * v + curve * v * v / 2 + language_id.L1 * abs(v)
    for step in (1e-4, -1e-4, 0.1, -0.1):
        assert (cost(w) <= cost(w + step) + 1e-12).all()
    assert (w[abs(z) <= language_id.L1] == 0).all()


def test_temperature_finds_the_scale(spark):
    rng = np.random.default_rng(4)
    weights = np.zeros((language_id.FEATURES + 1, 2))
    weights[0] = 8, -8
    p = 1 / (1 + np.exp(-2 * 1.0))  # logits of +-8 that should be +-1
    rows = [(int(rng.random() >= p), [0], [1]) for _ in range(4000)]
    idf = np.full(language_id.FEATURES, 1 / language_id.SHARE)
    heat = language_id.temperature(spark.createDataFrame(rows, "label int, columns array<int>, counts array<int>"), idf, weights)
    assert 6 < heat < 10.5
