"""The stored index against BM25 over the texts: fields, deltas, prefixes, skipped blocks and pruned scans."""

import random

import pytest
from pyspark.sql import functions as F

from marlstone.operators import fulltext
from marlstone.operators.textindex import TextIndex, bucket_of, bucket_of_word

FIELDS = {"id": 0.0, "name": 10.0, "doc": 1.0}


def texts(n, seed=0):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["rare", "alpha", "alphabet"]
    weights = [1 / (i + 1) for i in range(60)] + [0.004, 0.02, 0.02]
    return [(f"d{i}", f"d{i}", " ".join(rng.choices(vocabulary, weights, k=rng.randrange(3))), " ".join(rng.choices(vocabulary, weights, k=rng.randrange(1, 60)))) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "key string, id string, name string, doc string")


def over_texts(df, terms, limit, prefix=False):
    rows = [(r.doc, round(r.score, 9), r.matched) for r in fulltext.bm25(df, "key", FIELDS, terms, None, prefix).collect()]
    return sorted(rows, key=lambda r: (-r[1], r[0]))[:limit]


def found(index, terms, limit, prefix=False):
    return [(r.doc, round(r.score, 9), r.matched) for r in index.search(terms, limit, prefix).collect()]


@pytest.fixture(scope="module")
def rows():
    return texts(3000)


@pytest.fixture(scope="module")
def index(spark, rows, tmp_path_factory):
    return TextIndex(spark, str(tmp_path_factory.mktemp("index")), FIELDS).build(frame(spark, rows), "key")


@pytest.mark.parametrize("terms", [["rare"], ["rare", "w0"], ["w3", "w50", "alpha"], ["none"], ["none", "W7"]])
def test_equals_scores_over_texts(spark, index, rows, terms):
    for limit in (5, 40):
        assert found(index, terms, limit) == over_texts(frame(spark, rows), terms, limit)


def test_prefixes(spark, index, rows):
    for terms in (["alpha"], ["w5", "rar"]):
        assert found(index, terms, 30, True) == over_texts(frame(spark, rows), terms, 30, True)


def test_blocks_are_skipped_and_scans_pruned(spark, rows, index, tmp_path, capsys):
    plain = TextIndex(spark, str(tmp_path), {"doc": 1.0}, 16).build(frame(spark, rows), "key")
    best, scored, of = plain.search_read(["rare", "w45"], 10)
    assert of > 100 and scored < 0.7 * of, (scored, of)
    assert [r.doc for r in best.collect()] == [r.doc for r in fulltext.bm25(frame(spark, rows), "key", {"doc": 1.0}, ["rare", "w45"], 10).collect()]
    index._of_terms("postings", ["rare"], False).select("term", "slice", "max_tf").explain("formatted")
    plan = capsys.readouterr().out
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1].splitlines()[0]
    assert "docs" not in plan.split("ReadSchema")[1].splitlines()[0]


def test_delta_equals_rebuild(spark, rows, tmp_path):
    index = TextIndex(spark, f"{tmp_path}/a", FIELDS).build(frame(spark, rows[:400]), "key")
    held = {r[0]: r for r in rows[:400]}
    for step, (changed, removed) in enumerate([(texts(60, 7)[:50] + [("new", "new", "rare", "w0")], [f"d{i}" for i in range(300, 330)]), ([("d3", "d3", "", "rare rare"), ("d310", "d310", "alpha", "back")], ["new", "unknown"]), ([], ["d1"])]):
        index.apply(frame(spark, changed), spark.createDataFrame([(k,) for k in removed], "key string"), "key")
        for k in removed:
            held.pop(k, None)
        held |= {r[0]: r for r in changed}
        rebuilt = TextIndex(spark, f"{tmp_path}/b{step}", FIELDS).build(frame(spark, list(held.values())), "key")
        for terms in (["rare", "w0"], ["w2", "alpha", "back"]):
            want = over_texts(frame(spark, list(held.values())), terms, 25)
            assert found(index, terms, 25) == want == found(rebuilt, terms, 25)
        assert {r.doc for r in index.live().collect()} == held.keys()


def test_empty_and_null(spark, tmp_path):
    index = TextIndex(spark, f"{tmp_path}/e", FIELDS).build(frame(spark, []), "key")
    assert found(index, ["a"], 5) == []
    index.apply(frame(spark, [("a", "a", None, None), ("b", "b", "", "x")]), spark.createDataFrame([], "key string"), "key")
    assert [d for d, _, _ in found(index, ["x", "a"], 5)] == ["b", "a"]


def test_buckets_agree(spark):
    words = ["the", "größe", "ab", "a", "été"]
    got = {r.w: r.b for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", bucket_of(F.col("w")).alias("b")).collect()}
    assert got == {w: bucket_of_word(w) for w in words}


def test_build_shuffles_no_single_postings(spark, tmp_path):
    """Counts leave a document as one row, and blocks are made of whole documents: no step of a build explodes words (F23)."""
    from marlstone.operators import textindex

    docs = spark.createDataFrame([(i, "a b a" if i % 2 else None, f"b c{i} É") for i in range(300)], "id long, t string, u string")
    rows = {r["doc"]: r for r in textindex._counted(docs, "id", {"t": 10.0, "u": 1.0}).collect()}
    assert dict(zip(rows["7"]["terms"], rows["7"]["tfs"])) == {"a": 20.0, "b": 11.0, "c7": 1.0, "é": 1.0} and rows["7"]["dl"] == 6
    assert dict(zip(rows["8"]["terms"], rows["8"]["tfs"])) == {"b": 1.0, "c8": 1.0, "é": 1.0} and rows["8"]["dl"] == 3
    index = textindex.TextIndex(spark, f"file://{tmp_path}/index", {"t": 10.0, "u": 1.0}).build(docs, "id")
    blocks = index.table("postings").filter("term = 'b'").collect()
    assert sum(b["n"] for b in blocks) == 300 and all(b["n"] == len(b["docs"]) <= textindex.SLICE and b["docs"] == sorted(b["docs"]) for b in blocks)
    assert all(b["max_tf"] == max(b["tfs"]) and b["min_dl"] == min(b["dls"]) for b in blocks)
    assert {r["term"]: r["df"] for r in index.table("frequencies").filter("term in ('a', 'b', 'c9')").collect()} == {"a": 150, "b": 300, "c9": 1}
