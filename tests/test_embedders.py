"""Embedders by name: two spaces in one table, the guard, fields and syncs."""

import math

import pytest
from pyspark.sql import functions as F

from marlstone.operators import embedders as E


@pytest.fixture(autouse=True)
def letters():
    counts = lambda t: F.array(*(F.length(t) - F.length(F.replace(t, F.lit(c), F.lit(""))) for c in "abcd"))
    found = E.by_column("letters", 4, counts, least=0.9)
    E.REGISTERED.register(found)
    yield found
    E.REGISTERED.pop("letters", None)


def rows(spark):
    return spark.createDataFrame([(1, "aab", "c"), (2, "aab", ""), (3, None, " "), (4, "dd", "d"), (5, "aabb", None)], "id long, title string, body string")


FIELDS = {"title": 2.0, "body": 1.0}


def test_fields_are_weighted_and_of_length_one(spark):
    got = {r.id: r.vector for r in E.stored(rows(spark), "id", FIELDS, "letters").collect()}
    n = math.sqrt(16 + 4 + 1)
    assert got[1] == pytest.approx([4 / n, 2 / n, 1 / n, 0]) and got[3] == [1.0, 0.0, 0.0, 0.0] and got[4] == pytest.approx([0, 0, 0, 1])


def test_two_spaces_in_one_table(spark):
    table = E.stored(rows(spark), "id", FIELDS, "letters").unionByName(E.stored(rows(spark), "id", FIELDS, "hashed-v1"))
    got = {(r.query_id, r.id) for r in E.nearest(table, table, "letters", 3, "id").collect()}
    assert (2, 5) in got and (4, 1) not in got and all(a != b for a, b in got)
    assert {r.dim for r in E.space(table, "hashed-v1").select("dim").collect()} == {128}
    one = E.stored(rows(spark), "id", FIELDS, "letters")
    with pytest.raises(ValueError, match="letters/4, the search asks for hashed-v1/128"):
        E.nearest(one, table, "hashed-v1", 3, "id")
    with pytest.raises(ValueError, match="letters/5"):
        E.space(one.withColumn("dim", F.lit(5)), "letters")
    with pytest.raises(ValueError, match="no embedder other"):
        E.stored(rows(spark), "id", FIELDS, "other")
    with pytest.raises(ValueError, match="dimension 4"):
        E.REGISTERED.register(E.Embedder("letters", 7, None))


def test_sync_embeds_what_changed(spark):
    first = E.sync(spark.createDataFrame([], "id long, embedder string, dim int, vector array<double>, content string"), rows(spark), "id", FIELDS, "letters")
    marked = spark.createDataFrame([tuple(r)[:3] + ([9.0, 9.0, 9.0, 9.0], r.content) for r in first.collect()], first.schema)
    now = rows(spark).filter("id <> 5").withColumn("title", F.when(F.col("id") == 1, "dddd").otherwise(F.col("title")))
    got = {r.id: r.vector[0] for r in E.sync(marked, now, "id", FIELDS, "letters").collect()}
    assert got.keys() == {1, 2, 3, 4} and got[1] == 0.0 and got[2] == got[3] == got[4] == 9.0
    other = E.sync(marked, now, "id", FIELDS, "hashed-v1").collect()
    assert {r.embedder for r in other} == {"hashed-v1"} and all(len(r.vector) == 128 for r in other) and len(other) == 4
