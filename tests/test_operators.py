"""Operators on small inputs: equivalences, refusals, recall, determinism."""

import datetime

import pytest
from pyspark.sql import functions as F

from marlstone.functions import text as T
from marlstone.operators import deltas, graph, ranking, scope, sketches, vectors
from marlstone.plans import datalog, registry
from marlstone.plans.views import Views
from marlstone.sources import extract, logs


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_delta_equals_rebuild(spark, sf_dir):
    v = Views(spark, sf_dir)
    delta = deltas.keyed_delta(v.snap_old, v.snap_new, ["id"])
    assert sorted(map(tuple, deltas.apply_delta(v.snap_old, delta, ["id"]).collect())) == sorted(map(tuple, v.snap_new.collect()))
    assert {r["op"] for r in delta.collect()} == {"D", "I", "U"}
    assert deltas.keyed_delta(v.snap_old, v.snap_old, ["id"]).count() == 0
    assert deltas.keyed_delta(v.snap_old, v.snap_new, ["id"], ignore=("size", "price")).filter("op = 'U'").count() == 0


def test_cursor_is_bound_to_the_list(spark):
    rows = spark.createDataFrame([(i, f"n{i}") for i in range(10)], "id long, name string")
    page, cursor = ranking.cursor_page(rows, ["id"], ["id", "name"], 4)
    assert [r["id"] for r in page.collect()] == [0, 1, 2, 3] and cursor.startswith("c1_4_")
    page, cursor = ranking.cursor_page(rows, ["id"], ["id", "name"], 4, cursor)
    assert [r["id"] for r in page.collect()] == [4, 5, 6, 7]
    with pytest.raises(ranking.StaleCursor):
        ranking.cursor_page(rows.filter("id <> 9"), ["id"], ["id", "name"], 4, cursor)
    last, none = ranking.cursor_page(rows, ["id"], ["id", "name"], 4, cursor)
    assert last.count() == 2 and none is None


def test_capped_pairs_go_over_the_whole_list(spark):
    import random

    draw = random.Random(4)
    pairs = {(1, 0, i): 9000 - i for i in range(1, 2101)}  # a hot item's pairs fill the top
    pairs |= {(1, draw.randrange(3000, 3040), draw.randrange(3000, 3080)): draw.randrange(5) for _ in range(600)}
    pairs |= {(2, draw.randrange(12), draw.randrange(12)): draw.randrange(4) for _ in range(90)}
    rows = spark.createDataFrame([(*k, s) for k, s in pairs.items()], "grp long, a long, b long, score long")
    for per_item, most in ((2, 2000), (3, 7)):
        want = []
        for grp in (1, 2):
            used, kept = {}, []
            for (_, a, b), s in sorted((x for x in pairs.items() if x[0][0] == grp), key=lambda x: (-x[1], x[0])):
                if len(kept) < most and used.get(a, 0) < per_item and used.get(b, 0) < per_item:
                    used[a] = used.get(a, 0) + 1
                    used[b] = used.get(b, 0) + 1
                    kept.append((grp, a, b, s))
            want += kept
        assert sorted(map(tuple, ranking.capped_pairs(rows, "score", per_item, "grp", most).collect())) == sorted(want)
    assert ranking.capped_pairs(rows.limit(0), "score", 2, "grp").count() == 0


def test_relation_query_reports_contradictions(spark):
    from types import SimpleNamespace

    relations = spark.createDataFrame([(1, 2, "supersedes"), (2, 1, "supersedes"), (3, 1, "supersedes")], "source_id long, target_id long, type string")
    entities = spark.createDataFrame([(i, "active") for i in (1, 2, 3)], "position long, status string")
    registry.queries()
    rows = registry._FOUND["wk_8_relations"][0](SimpleNamespace(relations=relations, entities=entities)).collect()
    assert [(r["entity"], r["message"]) for r in rows if r["code"] == "relation-contradiction"] == [("1", "and 2")]


def test_skip_to_fit(spark):
    rows = spark.createDataFrame([("g", i, c) for i, c in enumerate([5, 9, 3, 1, 4])], "g string, id int, cost int")
    assert [r["id"] for r in ranking.skip_to_fit(rows, "cost", 10, ["id"], "g").collect()] == [0, 2, 3]
    assert [r["id"] for r in ranking.within_budget(rows, F.col("cost"), 10, ["id"], ["g"]).collect()] == [0]


def test_datalog(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 5)], "a long, b long")
    run = lambda p, **k: sorted(map(tuple, datalog.run(p, {"edges": edges}, k).collect()))
    assert run("r(x, y) :- edges(x, y). r(x, z) :- r(x, y), edges(y, z). ?(x, y) :- r(x, y), x = 4.") == [(4, 5)]
    assert run("?(count(x)) :- edges(a: x).") == [(4,)]
    assert run("?(x) :- edges(a: x, b: $to).", to=3) == [(2,)]
    assert run("s(x) :- edges(_, x). ?(x) :- edges(x, y), not s(x).") == [(4,)]
    ranks = dict(run("e(x, y) :- edges(x, y). ?(n, r) <~ PageRank(e)."))
    assert sum(ranks.values()) == pytest.approx(1) and ranks[5] > ranks[4]
    for bad in ("?(x) :- edges(a: x), y > 3.", "?(x) :- nothing(x).", "r(x) :- edges(x, y).", "p(x) :- edges(x, y), not p(y). ?(x) :- p(x).", "?(x) :- edges(a: x), edges(c: y)."):
        with pytest.raises(datalog.DatalogError):
            datalog.run(bad, {"edges": edges}).collect()


def test_shortest_path_and_components(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "x"), ("x", "c"), ("c", "d"), ("p", "q")], "src string, dst string")
    assert [r["id"] for r in graph.shortest_path(links, "a", "d").orderBy("step").collect()] == ["a", "b", "c", "d"]
    assert graph.shortest_path(links, "a", "q").count() == 0
    assert {(r["id"], r["component"]) for r in graph.components(links).collect()} == {(x, "a") for x in "abcdx"} | {("p", "p"), ("q", "p")}


def test_recall_of_approximate_search(spark):
    row = registry.queries()["vec_10_recall"](spark, "/root/testdata/sf0.01").first()
    assert row["recall"] >= 0.9 and row["n"] == 100


def test_embedding_space_guard_and_sync(spark, sf_dir):
    with pytest.raises(ValueError):
        vectors.require_same_space(("hashed", 128), ("hashed", 256))
    rows = registry.queries()["vec_7_incremental_sync"](spark, sf_dir).collect()
    assert rows and all(r["whole"] and r["as_rebuilt"] for r in rows)
    empty = vectors.embed(spark.createDataFrame([(1, ""), (2, None)], "id int, t string"), "id", {"t": 1.0}).collect()
    assert all(r["vector"][0] == 1.0 and sum(r["vector"]) == 1.0 for r in empty)


def test_erased_tokens_and_sketches(spark):
    a = "fn area(w: f64) -> f64 { // wide\n let x = w * 2.5; return \"s\" }"
    b = a.replace("area", "size").replace("x", "total").replace("2.5", "7")
    assert sketches.erased_tokens(a) == sketches.erased_tokens(b)
    assert sketches.erased_tokens("let a = 'q\\'' + 0x1f; /* c */ # d\nif b") == ["let", "ID", "=", "STR", "+", "NUM", ";", "if", "ID"]
    assert (sketches.minhash(["a", "b"]) == 0xFFFFFFFF).all()


def test_relocation(spark):
    body = "fn work(a: u8) -> u8 { let b = a + 1; if b > 3 { return b } else { loop { b = other(b, a) } } match a { 1 => x(1), _ => y(2) } }"
    other = "struct S { a: u8, b: u8, c: [u8; 3] } impl S { pub fn get(&self) -> u8 { self.a * self.b - self.c[0] / 2 } } // tail"
    rows = [("old", body, "h0", ["p", "q"]), ("new", body.replace("work", "job"), "h1", ["p", "q"]), ("far", other, "h2", ["z"])]
    s = spark.createDataFrame(rows, "id string, body string, body_hash string, neighbours array<string>")
    full = sketches.sketches(s, "id", "body").join(s.drop("body"), "id")
    got = sketches.relocate(full.filter("id = 'old'"), full.filter("id <> 'old'")).collect()
    assert [(r["lost"], r["verdict"], r["held"]) for r in got] == [("old", "moved", "new")]
    gone = sketches.relocate(full.filter("id = 'old'"), full.filter("id = 'far'")).collect()
    assert gone[0]["verdict"] == "gone"


def test_text_functions(spark):
    assert one(spark, T.identifier_components(F.lit("fetchUserByID_HTTPServer2"))) == ["fetch", "user", "by", "id", "http", "server2"]
    assert one(spark, T.stems(F.lit("queries"))) == ["queries", "query", "queri", "querie"]
    assert one(spark, T.slug(F.lit("  Hello, World! "))) == "hello-world"
    assert one(spark, T.since("2024-01-05", F.current_timestamp())) == datetime.datetime(2024, 1, 5)
    assert one(spark, T.is_test_path(F.lit("src/tests/a.py"))) and not one(spark, T.is_test_path(F.lit("src/contest/a.py")))
    import re

    assert re.match(T.glob_to_regex("src/**/*.py"), "src/a/b/c.py") and not re.match(T.glob_to_regex("src/*.py"), "src/a/b.py")


def test_plan_query():
    plan = scope.plan_query("How does HTTPServer parse_requests in tests when queries are running")
    assert plan.identifiers == ["HTTPServer", "parse_requests"]
    assert plan.tests and plan.terms["http"] == 1.15 and plan.terms["query"] == 0.55 and "when" not in plan.terms


def test_extractors_tolerate_odd_files(spark):
    odd = [("a.py", None), ("b.rs", "fn ("), ("c.ts", "}}}} function x() {"), ("d.md", "---\nid: x"), ("e.md", "﻿---\r\nid: y\r\n---\r\n# T\r\n")]
    files = spark.createDataFrame(odd, "path string, content string")
    assert extract.extract(files).count() >= 1
    assert [r["id"] for r in extract.markdown_entities(files).collect()] == ["y"]


def test_event_kinds_are_closed(spark, tmp_path):
    bad = spark.createDataFrame([("a", "party", ["f"])], "id string, kind string, files array<string>")
    with pytest.raises(ValueError):
        logs.append_event(spark, str(tmp_path / "log"), bad)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_flows():
    from marlstone.operators import flows as FL

    def known(edges, **more):
        nodes = {x for e in edges for x in (e.source, e.target)}
        out = FL.Known({n: n[0] for n in nodes}, set(), {n for n in nodes if n.startswith("_")}, set(), set(), dict.fromkeys(nodes, 0.0), {n: frozenset([n]) for n in nodes})
        for e in edges:
            out.out.setdefault(e.source, []).append(e)
        for k, v in more.items():
            setattr(out, k, v)
        return out

    call = lambda a, b, rank=None, weight=0.0, kind="calls": FL.Step(a, b, kind, 1, rank, weight)
    chain = known([call(a, b) for a, b in zip("abcdefghi", "bcdefghij")] + [call("c", "a")])
    found = FL.paths(chain, ["a"])
    assert [len(p) for p in found] == [1, 2, 3, 4, 5, 6, 7] and all(p[0].source == "a" for p in found)
    assert len(FL.paths(chain, ["a"], work=4)) == 2  # open a, take b, open b, take c
    assert {p[0].source for p in FL.paths(known([call("a", x) for x in "bcdefgh"] + [call("z", "y")]), ["a", "z"], work=5)} == {"a"}  # a unit was kept for z, whose branch it does not pay
    assert [len(p) for p in FL.paths(known([call("a", "_x"), call("_x", "_y"), call("_x", "b")]), ["a"])] == [1, 2]
    best = FL.admit(chain, sorted(found, key=lambda p: FL.ranking(chain, p)), [], {}, 8)
    assert [len(p) for p in best] == [7]  # the shorter ones lie inside
    two = known([call("a", "b", 1, 0.5), call("a", "c", 2, 0.9), call("b", "d"), call("c", "d")], relevance={"d": 1.0})
    ranked = sorted(FL.paths(two, ["a"]), key=lambda p: FL.ranking(two, p))
    assert ranked[0][0].target == "c"  # the heavier call site
    chosen = FL.admit(two, ranked, [], {}, 4)
    assert [[s.target for s in p] for p in chosen] == [["b"], ["c"], ["c", "d"]]  # call sites first, then the best; the other no longer fits
    handed = known([call("a", "b"), call("b", "_f", kind="contains"), call("_f", "g")])
    assert [s.target for s in FL.completion(handed, [("a", "b")])] == ["b", "_f", "g"]
    owned = known([call("o", "_f", kind="contains"), call("_f", "g", 3)])
    assert [s.source for s in FL.representatives(owned, FL.paths(owned, ["_f"]), 2)[0]] == ["o", "_f"]


def test_capped_pairs_are_the_greedy_choice(spark):
    import random

    from pyspark.sql import functions as F

    rng = random.Random(4)
    pairs = {(rng.randint(0, 25), rng.randint(0, 25)): rng.randint(0, 40) for _ in range(260)}
    rows = [(g, a, b, s) for g in (1, 2) for (a, b), s in pairs.items()]
    frame = spark.createDataFrame(rows, "grp int, a long, b long, score long")
    for most in (30, 2000):
        got = {tuple(r) for r in ranking.capped_pairs(frame, "score", 2, "grp", most).collect()}
        want = set()
        for g in (1, 2):
            used, kept = {}, 0
            for (a, b), s in sorted(pairs.items(), key=lambda p: (-p[1], *p[0])):
                items = {a, b}
                if kept < most and all(used.get(i, 0) < 2 for i in items):
                    kept += 1
                    want.add((g, a, b, s))
                    for i in items:
                        used[i] = used.get(i, 0) + (2 if a == b else 1)
        assert got == want
    assert ranking.capped_pairs(frame.filter(F.lit(False)), "score", 2, "grp").count() == 0


def test_timeline_takes_what_fits(spark, sf_dir):
    from marlstone.operators import timeline as L
    from marlstone.plans.views import Views

    rows = L.newest(L.matching(Views(spark, sf_dir).timeline, kinds=("error",)), 200).collect()
    from pyspark.sql import functions as F

    sizes = {r["event_id"]: r["n"] for r in L.newest(L.matching(Views(spark, sf_dir).timeline, kinds=("error",)), 200).select("event_id", F.octet_length(F.to_json(F.struct("*"))).alias("n")).collect()}
    left, want = 10_000, []
    for r in sorted(rows, key=lambda r: (r["ts"], r["event_id"]), reverse=True):
        if sizes[r["event_id"]] <= left:
            left -= sizes[r["event_id"]]
            want.append(r["event_id"])
    got = [r["event_id"] for r in registry.queries()["x_19_timeline_bytes"](spark, sf_dir).collect()]
    assert sorted(got) == sorted(want) and len(got) < len(rows)


def test_scope_scores_and_admission_by_hand(spark, sf_dir):
    from marlstone.functions import text as T
    from marlstone.operators import scope as S
    from marlstone.plans.scope_queries import TASK
    from marlstone.plans.views import Views

    nodes = Views(spark, sf_dir).g_nodes
    plan = S.plan_query(TASK)
    low = {r["id"]: (r["file_path"], r["low"]) for r in nodes.select("id", "file_path", T.is_low_value_path(nodes["file_path"]).alias("low")).collect()}
    score, exact = {}, set()
    for r in S.evidence(nodes, plan).collect():
        score[r["id"]] = score.get(r["id"], 0.0) + r["weight"] / (60 + r["rank"])
        exact |= {r["id"]} if r["channel"] == "exact" else set()
    files = {}
    for i, s in score.items():
        files.setdefault(low[i][0], []).append((-round(s, 12), i))
    want = {}
    for f, held in files.items():
        held.sort()
        total = sum(w * -s for w, (s, _) in zip((1.0, 0.45, 0.2), held)) * (0.55 if low[held[0][1]][1] else 1.0)
        want[f] = (total, any(i in exact for _, i in held))
    got = {r["file_path"]: (r["score"], r["exact"]) for r in registry.queries()["sc_13_file_scores"](spark, sf_dir).collect()}
    assert set(got) == set(want) and all(abs(got[f][0] - want[f][0]) < 1e-5 and got[f][1] == want[f][1] for f in want)
    admitted = registry.queries()["sc_15_admission"](spark, sf_dir).collect()
    top = sorted(want, key=lambda f: (not want[f][1], -round(want[f][0], 9), f))[:6]
    assert {r["file_path"] for r in admitted} <= set(top) and len(admitted) <= 24
    assert all(sum(r["file_path"] == f for r in admitted) == min(4, len(files[f])) for f in top)
    assert [r["place"] for r in sorted(admitted, key=lambda r: r["place"])] == list(range(1, len(admitted) + 1))


def test_stream_lifecycles(spark, tmp_path):
    import time

    from marlstone.streaming import jobs

    log = jobs.JobLog(4)
    spark.streams.addListener(log)
    try:
        spark.range(5).write.parquet(f"{tmp_path}/in")
        seen = []
        query = spark.readStream.schema("id long").parquet(f"{tmp_path}/in").writeStream.trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c").foreachBatch(lambda df, n: seen.append(df.count())).start()
        query.awaitTermination()
        end = time.time() + 20
        while time.time() < end and not any(e[2] == "finished" for e in log.since(0, 1.0)[0]):
            pass
        events, following, missed = log.since(0)
        assert seen == [5] and {e[2] for e in events} >= {"progress", "finished"} and following >= 3 and missed == max(0, following - 4)
        assert sum(e[3] or 0 for e in events) == 5 and log.since(following)[0] == []
        beats = []
        beat = jobs.heartbeat(spark, lambda df, n: beats.append(n), 0.2)
        end = time.time() + 20
        while time.time() < end and len(beats) < 2:
            time.sleep(0.1)
        beat.stop()
        assert len(beats) >= 2
    finally:
        spark.streams.removeListener(log)


def test_cursors_and_json():
    from marlstone.operators import lookup as L

    one = L.Request("list", ("a", 1), "r1")
    assert one.offset(None) == one.offset("") == 0 and one.offset(one.cursor(40)) == 40
    for other in (L.Request("search", ("a", 1), "r1"), L.Request("list", ("b", 1), "r1"), L.Request("list", ("a", 1), "r2")):
        with pytest.raises(L.BadCursor):
            other.offset(one.cursor(40))
    for bad in ("?", "e30", "x" * 5000, one.cursor(-1), one.cursor(10**9)):
        with pytest.raises(L.BadCursor):
            one.offset(bad)
    assert L.canonical_json({"b": [1, None], "a": "é"}) == '{"a":"é","b":[1,null]}'
    import json

    assert json.loads(L.without_comments('{"a": "x // no", /* c */ "b": [1, 2,], // d\n "e": "/*,]*/",}')) == {"a": "x // no", "b": [1, 2], "e": "/*,]*/"}


def test_relations_and_writes(spark, tmp_path):
    from marlstone.plans import datalog
    from marlstone.sources.relations import RelationError, Relations, upsert_stream

    store = Relations(spark, f"file://{tmp_path}/rel")
    assert store.names() == [] and store.create("pairs", "a long, b long") and not store.create("pairs", "a long, b long")
    with pytest.raises(RelationError):
        store.create("pairs", "a long", tolerant=False)
    with pytest.raises(RelationError):
        store.table("none")
    store.put("pairs", spark.createDataFrame([(1, 1), (1, 5), (2, 2)], "a long, b long"), ["a"])
    before = store.table("pairs")
    with pytest.raises(datalog.DatalogError):
        datalog.run("?(a, b) :- pairs(a, b). :put pairs a", {"pairs": before})
    datalog.run_mutable("?(a, b) :- pairs(a: a), b = 9, a > 1. :put pairs a", store)
    assert sorted(map(tuple, store.table("pairs").collect())) == [(1, 5), (2, 9)] and sorted(map(tuple, before.collect())) == [(1, 5), (2, 2)]
    upsert_stream(store, "pairs", ["a"])(spark.createDataFrame([(3, 3)], "a long, b long"), 0)
    store.remove("pairs", spark.createDataFrame([(1,)], "a long"), ["a"])
    assert sorted(map(tuple, store.table("pairs").collect())) == [(2, 9), (3, 3)]
    assert store.columns("pairs") == {"a": "bigint", "b": "bigint"} and store.drop("pairs") and store.names() == []


def test_ignore_rules():
    import re

    from marlstone.functions.text import ignore_rule

    match = lambda line, path: bool(re.match(ignore_rule(line)[0], path))
    assert ignore_rule("# c") is None and ignore_rule("  ") is None and ignore_rule("!a")[1]
    assert match("build/", "x/build/y") and not match("build/", "x/build") and match("build", "x/build") and match("build", "build/a/b")
    assert match("/a", "a/b") and not match("/a", "x/a") and match("a/b", "a/b/c") and not match("a/b", "x/a/b")
    assert match("*.js", "x/y.js") and not match("*.js", "x/y.jsx") and match("**/z", "p/q/z") and match("\\#a", "#a")
