"""Replays of streams, pages bound to order and filter, baselines of hubs, and the strength of evidence."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from marlstone.operators import baselines, ranking, scope
from marlstone.streaming import timeline


def test_refresh_keeps_what_a_replayed_batch_wrote(spark, tmp_path):
    inbox, cache, check = tmp_path / "in", f"{tmp_path}/cache", tmp_path / "check"
    schema = "path string, content string"
    extract = lambda rows: rows.select("path", "hash", F.length("content").alias("n"))
    seen = lambda: sorted(map(tuple, spark.read.parquet(cache).select("path", "n").collect()))

    def run():
        timeline.refresh(spark.readStream.schema(schema).json(str(inbox)), cache, extract, str(check))

    def replay():
        last = max(glob.glob(f"{check}/commits/[0-9]*"), key=lambda p: int(os.path.basename(p)))
        for path in (last, f"{os.path.dirname(last)}/.{os.path.basename(last)}.crc"):
            if os.path.exists(path):
                os.remove(path)
        run()

    spark.createDataFrame([("a", "1"), ("b", "22")], schema).coalesce(1).write.json(str(inbox))
    run()
    replay()
    assert seen() == [("a", 1), ("b", 2)]
    spark.createDataFrame([("a", "1"), ("b", "333"), ("c", "4")], schema).coalesce(1).write.mode("append").json(str(inbox))
    run()
    replay()
    assert seen() == [("a", 1), ("b", 2), ("b", 3), ("c", 1)]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(i, i * 7 % 9 // 3, f"n{i}") for i in range(9)], "id long, g long, name string")


def test_cursor_is_bound_to_order_and_filter(spark, rows):
    first, cursor = ranking.cursor_page(rows, ["id"], ["id", "name"], 4)
    assert [r.id for r in first.collect()] == [0, 1, 2, 3]
    with pytest.raises(ranking.StaleCursor):
        ranking.cursor_page(rows, ["g", "id"], ["id", "name"], 4, cursor)
    with pytest.raises(ranking.StaleCursor):
        ranking.cursor_page(rows, [F.desc("id")], ["id", "name"], 4, cursor)
    with pytest.raises(ranking.StaleCursor):
        ranking.cursor_page(rows, ["id"], ["id", "name"], 4, cursor, filter_key="g < 9")
    with pytest.raises(ranking.StaleCursor):
        ranking.cursor_page(rows, ["id"], ["id", "name"], 4, cursor.replace("c1_4_", "c1_40_"))
    for order in (["id"], ["g", "id"], ["g"], [F.desc("g"), "name"]):
        got, cursor, pages = [], None, 0
        while pages == 0 or cursor:
            part, cursor = ranking.cursor_page(rows, order, ["id", "name"], 4, cursor)
            got += [r.id for r in part.collect()]
            pages += 1
        assert pages == 3 and got == [r.id for r in rows.orderBy(*order, "id").collect()]


def test_digest_does_not_depend_on_partitions(spark, rows):
    digest = lambda df, order=("id",), run=2: ranking.list_digest(df, list(order), ["id", "name"], run=run).first()["digest"]
    assert digest(rows) == digest(rows.repartition(5)) == digest(rows.coalesce(1).orderBy(F.rand(3)))
    assert len({digest(rows), digest(rows, ("g", "id")), digest(rows.filter("id <> 4")), digest(rows.limit(0)), digest(rows, run=4)}) == 5


def test_numbers_are_places_in_the_order(spark):
    rows = spark.range(1000).select("id", (F.col("id") * 37 % 101).alias("x")).repartition(7)
    got = {r.id: r.place for r in ranking.numbered(rows, [F.desc("x"), "id"], "place").collect()}
    want = sorted(range(1000), key=lambda i: (-(i * 37 % 101), i))
    assert [got[i] for i in want] == list(range(1000))


def test_capture_keeps_all_callers_and_callees(spark):
    nodes = spark.createDataFrame([("hub", "r", "body", None)], "id string, ref string, body string, body_hash string")
    edges = [(f"c{i:03}", "hub", "calls") for i in range(150)] + [("hub", "out", "calls"), ("hub", "hub", "calls"), ("hub", "part", "contains")]
    got = baselines.capture(spark.createDataFrame([("d", "r")], "doc string, ref string"), nodes, spark.createDataFrame(edges, "source string, target string, kind string")).first()
    assert got.neighbours == sorted([f"c{i:03}" for i in range(150)] + ["out"])


def test_strength(spark):
    files = [("exact", True, []), ("three", False, ["a", "b"]), ("three", False, ["c", "c"]), ("some", None, ["a", "x"]), ("files", False, None), ("files", False, ["x"])]
    asked = spark.createDataFrame([(t,) for t in ("exact", "three", "some", "files", "nothing")], "task string")
    made = spark.createDataFrame(files, "task string, exact boolean, terms array<string>")
    got = {r.task: (r.strength, r.covered) for r in scope.strength(asked, made, ["a", "b", "c", "d"]).collect()}
    assert got == {"exact": ("strong", 0), "three": ("strong", 3), "some": ("moderate", 1), "files": ("weak", 0), "nothing": ("none", 0)}
    assert {r.strength for r in scope.strength(asked, made, ["a"]).filter("task in ('three', 'some')").collect()} == {"strong"}


def _forget_last(check):
    last = max(glob.glob(f"{check}/commits/[0-9]*"), key=lambda p: int(os.path.basename(p)))
    for path in (last, f"{os.path.dirname(last)}/.{os.path.basename(last)}.crc"):
        if os.path.exists(path):
            os.remove(path)


def test_claims_reach_events_of_earlier_batches(spark, tmp_path):
    from marlstone.sources.logs import superseded

    schema = "id string, kind string, supersedes string, superseded_by string"
    batches = [
        [("e1", "a", None, None), ("e2", "a", None, None), ("e3", "b", "later", None), ("e4", "b", "e1", None)],
        [("later", "c", None, None), ("e5", "c", "e2", None), ("e6", "c", None, "marked"), ("e7", "c", "e6", None)],
        [("e0", "d", "e1", None), ("e9", "d", "e2", None), ("ea", "d", "nothing", None)],
    ]
    changes, seen = f"{tmp_path}/changes", []
    for n, rows in enumerate(batches):
        seen += rows
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
        for replay in (False, True):
            if replay:
                _forget_last(f"{tmp_path}/check")
            timeline.supersede(spark.readStream.schema(schema).json(f"{tmp_path}/in"), changes, f"{tmp_path}/check")
            got = {r.id: (r.kind, r.superseded_by) for r in timeline.current(spark, changes, "id string, kind string, supersedes string").collect()}
            want = {r.id: (r.kind, r.superseded_by) for r in superseded(spark.createDataFrame(seen, schema)).collect()}
            assert got == want
    sizes = {r.batch: r.n for r in spark.read.parquet(changes).groupBy("batch").agg(F.count("id").alias("n")).collect()}
    assert sizes[2] == 4  # three new records and the one that the least claim changes; nothing else is written again
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider")
