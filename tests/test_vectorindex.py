"""The stored vector index against all vectors: recall, rows read, deltas, hot lists and odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.operators import vectorindex
from marlstone.operators.vectorindex import VectorIndex


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>")


def grouped(n, seed=0, dims=32, centres=60):
    """Vectors about many centres, as texts of a code base are."""
    rng = np.random.default_rng(seed)
    middle = rng.standard_normal((centres, dims))
    return [(i, (middle[i % centres] + 0.35 * rng.standard_normal(dims)).tolist()) for i in range(n)]


def exact(rows, asked, k):
    ids = np.array([i for i, _ in rows])
    m = np.array([v for _, v in rows])
    m = m / np.linalg.norm(m, axis=1, keepdims=True)
    out = {}
    for q in asked:
        s = np.round(m @ m[list(ids).index(q)], 12)
        order = [i for i in np.lexsort((ids, -s)) if ids[i] != q]
        out[q] = [int(ids[i]) for i in order[:k]]
    return out


def answers(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append(r.vec_id)
    return out


@pytest.fixture(scope="module")
def rows():
    return grouped(1500)


@pytest.fixture(scope="module")
def index(spark, rows, tmp_path_factory):
    return VectorIndex(spark, str(tmp_path_factory.mktemp("vectors"))).build(frame(spark, rows))


def test_recall_and_rows_read(spark, rows, index, capsys):
    asked = list(range(0, 1500, 75))
    top, read = index.search_read(frame(spark, [rows[i] for i in asked]), 10)
    got, want = answers(top), exact(rows, asked, 10)
    assert sum(len(set(got[q]) & set(want[q])) for q in asked) >= 0.9 * 10 * len(asked)
    assert read.agg(F.avg("read")).first()[0] < 0.1 * len(rows)
    index.stored().filter("list = 3").explain("formatted")
    assert "PartitionFilters: [isnotnull(list" in capsys.readouterr().out
    whole = index.search(frame(spark, [rows[i] for i in asked]), 10, len(index.centres()))
    assert answers(whole) == want


def test_delta_equals_rebuild(spark, rows, tmp_path):
    index = VectorIndex(spark, str(tmp_path)).build(frame(spark, rows[:600]), centroids=20)
    moved, new = [(i, rows[i + 1][1]) for i in range(0, 100, 3)], [(5000 + i, v) for i, v in rows[600:650]]
    index.apply(frame(spark, moved + new), spark.createDataFrame([(i,) for i in range(200, 260)] + [(99999,)], "vec_id long"))
    index.apply(frame(spark, [(200, rows[7][1])]), spark.createDataFrame([(5601,)], "vec_id long"))
    held = {i: v for i, v in rows[:600] if not 200 <= i < 260} | dict(moved) | dict(new) | {200: rows[7][1]}
    held.pop(5601)
    assert sorted(r.key for r in index.stored().collect()) == sorted(held)
    asked = [0, 3, 200, 5600, 599]
    again = index.search(frame(spark, [(i, held[i]) for i in asked]), 10, 20)
    assert answers(again) == exact(sorted(held.items()), asked, 10)
    lists = {r.key: r.list for r in index.stored().collect()}
    rebuilt = {r.key: r.near for r in index.nearest(vectorindex.directions(frame(spark, sorted(held.items())), "vec_id", "embedding"), 1).collect()}
    assert lists == rebuilt


def test_hot_lists_are_split(spark, rows, tmp_path, monkeypatch):
    monkeypatch.setattr(vectorindex, "PART_ROWS", 40)
    same = [(i, rows[0][1]) for i in range(400)] + rows[400:700]
    index = VectorIndex(spark, str(tmp_path)).build(frame(spark, same), centroids=12)
    assert answers(index.search(frame(spark, [same[5], same[650]]), 10, 12)) == exact(same, [5, 650], 10)


def test_odd_rows(spark, rows, tmp_path):
    odd = [(900, None), (901, []), (902, [0.0] * 32), (903, [float("nan")] * 32), (904, [float("inf")] * 32)]
    index = VectorIndex(spark, f"{tmp_path}/a").build(frame(spark, rows[:30] + odd))
    assert {r.key for r in index.stored().collect()} == set(range(30))
    none = VectorIndex(spark, f"{tmp_path}/b").build(frame(spark, []))
    assert none.search(frame(spark, rows[:2]), 5).collect() == []


def test_all_lists_are_probed_as_one(spark, tmp_path, monkeypatch):
    """A query of all lists is written once, not once a list, and its answer is the exact one (F34)."""
    import numpy as np

    from marlstone.operators import vectorindex

    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(400, 8))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    index = vectorindex.VectorIndex(spark, f"file://{tmp_path}/index").build(rows, 12)
    counts, kept = {}, vectorindex.materialize

    def counted(df, tag):
        out = kept(df, tag)
        counts[tag] = out.count()
        return out

    monkeypatch.setattr(vectorindex, "materialize", counted)
    top, read = index.search_read(rows.filter("vec_id % 50 = 0"), 5, len(index.centres()))
    assert counts["asked"] == 8 and {r["read"] for r in read.collect()} == {400}
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    for q in range(0, 400, 50):
        score = unit @ unit[q]
        score[q] = -2
        assert [r["vec_id"] for r in top.filter(f"query_id = {q}").orderBy("rank").collect()] == np.argsort(-score)[:5].tolist()
