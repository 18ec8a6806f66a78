"""Steps whose work must not be the square of what shares a key: inputs on which the pairs alone would not fit, with known answers."""

import random
import time
from contextlib import contextmanager

from pyspark.sql import functions as F

from marlstone.functions import text as T
from marlstone.operators import baselines as B
from marlstone.operators import drift as D
from marlstone.operators import graph as G
from marlstone.operators import knowledge as W
from marlstone.operators import lookup as L
from marlstone.operators import resolution as N
from marlstone.operators import selectors
from marlstone.operators import sketches as K
from marlstone.operators import structural as S
from marlstone.operators import vectors as V
from marlstone.operators.vectorindex import VectorIndex
from marlstone.plans import registry


@contextmanager
def within(seconds):
    """What runs in it must not take longer; the square of the input would take many times as long."""
    start = time.monotonic()
    yield
    assert time.monotonic() - start < seconds


def test_references_of_a_hot_file(spark):
    """40,000 references into one file of 40,000 nodes: 1.6e9 pairs share the path."""
    n = 40_000
    nodes = spark.range(n).select(F.col("id").cast("string").alias("id"), F.lit("f").alias("file_path"), F.when(F.col("id") % 2 == 0, "class").otherwise("fn").alias("kind"), F.concat(F.lit("n"), F.floor(F.col("id") / 4)).alias("name"), F.concat(F.lit("q"), "id").alias("qualified_name"))
    refs = spark.range(n).select(F.col("id").alias("ref_id"), F.when(F.col("id") % 3 == 0, "struct").otherwise("trait").alias("ref_kind"), F.lit("f").alias("ref_path"), F.when(F.col("id") % 5 == 0, F.concat(F.lit("q"), "id")).when(F.col("id") % 5 == 1, "gone").otherwise(F.concat(F.lit("n"), F.floor(F.col("id") / 4))).alias("ref_name"))
    with within(60):
        got = {r["state"]: r["n"] for r in S.resolve_refs(refs, nodes).groupBy("state").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == {"Resolved": n // 5, "Missing": n // 5, "Ambiguous": n // 5 * 3}


def test_exact_search_of_many_pairs(spark):
    """20 million pairs of 64 numbers; rows without a vector come last, equal ones by key."""
    at = F.sequence(F.lit(1), F.lit(64))
    vectors = spark.range(40_000).select(F.col("id").alias("vec_id"), F.when(F.col("id") == 7, None).otherwise(F.transform(at, lambda i: F.sin((F.col("id") % 20_000 + 1) * i))).alias("embedding"))
    with within(60):
        rows = V.exact_knn(vectors, vectors.filter("vec_id % 80 = 0"), 3).collect()
    assert len(rows) == 1500 and not any(r["query_id"] == r["vec_id"] for r in rows)
    first = {r["query_id"]: r for r in rows if r["rank"] == 1}
    assert all(first[q]["vec_id"] == (q + 20_000) % 40_000 and abs(first[q]["similarity"] - 1) < 1e-9 for q in range(0, 40_000, 80))
    few = V.exact_knn(vectors.filter("vec_id in (7, 8, 9)"), vectors.filter("vec_id = 8"), 3).orderBy("rank").collect()
    assert [r["vec_id"] for r in few] == [9, 7] and few[1]["similarity"] is None


def test_list_files(spark, tmp_path):
    """A list is one file unless it is large, so that the files do not outnumber the lists."""
    vectors = spark.range(3_000).select(F.col("id").alias("vec_id"), F.array(F.sin("id"), F.cos("id"), F.lit(1.0)).alias("embedding"))
    VectorIndex(spark, f"file://{tmp_path}/index").build(vectors, 20)
    lists = list((tmp_path / "index" / "lists" / "gen=0").glob("list=*"))
    assert lists and all(len(list(p.glob("*.parquet"))) == 1 for p in lists)


def test_one_split_is_worked_on_by_all_cores(spark, tmp_path):
    spark.range(100).select("id", F.lit("a text").alias("t")).coalesce(1).write.parquet(f"{tmp_path}/one")
    assert V.embed(spark.read.parquet(f"{tmp_path}/one"), "id", {"t": 1.0}).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_equal_calls_and_overloads(spark):
    """30,000 equal calls of 30,000 equal overloads, and one that its file settles."""
    n = 30_000
    none = F.lit(None).cast("string")
    decls = spark.range(n).select(F.col("id").cast("string").alias("id"), F.lit("Sources/M/a.swift").alias("file"), F.lit("m").alias("name"), F.lit("method").alias("kind"), F.lit("T").alias("container"), F.array(F.lit("to")).alias("labels"), F.lit(True).alias("exported"))
    decls = decls.unionByName(decls.limit(1).withColumns({"id": F.lit("own"), "file": F.lit("Sources/M/b.swift")}))
    calls = spark.range(n + 1).select(F.col("id").alias("call_id"), F.when(F.col("id") == n, "Sources/M/b.swift").otherwise("Sources/M/c.swift").alias("file"), F.lit("m(to:)").alias("target"), F.lit("self").alias("receiver"), F.lit(True).alias("is_method"), none.alias("receiver_type"), F.lit("T").alias("container"))
    imports = spark.createDataFrame([], "file string, module string, testable boolean")
    with within(60):
        got = {(r["target_id"], r["candidates"]): r["count"] for r in selectors.resolve_calls(calls, decls, imports).groupBy("target_id", "candidates").count().collect()}
    assert got == {(None, n + 1): n, ("own", 1): 1}


def test_relocation_among_equal_bodies(spark):
    """40,000 lost symbols and 40,000 nodes of one body; every name but one stands twice."""
    n = 40_000
    lost = spark.range(n).select(F.col("id").alias("ref_id"), F.lit("function").alias("kind"), F.concat(F.lit("f"), F.floor(F.col("id") / 2)).alias("name"), F.lit("h").alias("recorded_hash"))
    nodes = spark.range(n - 1).select("id", F.lit("method").alias("kind"), F.concat(F.lit("f"), F.floor(F.col("id") / 2)).alias("name"), F.lit("h").alias("body_hash"))
    with within(60):
        got = D.relocation_ladder(lost, nodes, spark.createDataFrame([], "ref_id long, target long, score double")).groupBy("state", "confidence").count().collect()
    assert {(r["state"], r["confidence"]): r["count"] for r in got} == {("ambiguous", None): n - 2, ("found", 0.8): 2}


def test_equal_spans(spark):
    """40,000 equal spans of one file: each encloses, overlaps and holds all others."""
    n = 40_000
    spans = spark.range(n).select((F.col("id") + 100_000).cast("string").alias("id"), F.lit("fn").alias("kind"), F.lit("f").alias("file_path"), F.lit(3).cast("long").alias("start_line"), F.lit(9).cast("long").alias("end_line"))
    points = spark.range(n).select(F.col("id").alias("point_id"), F.lit("f").alias("file_path"), F.lit(5).cast("long").alias("at"))
    chunks = spark.range(n).select(F.col("id").alias("chunk_id"), F.lit("f").alias("file_path"), F.lit(1).cast("long").alias("first"), F.lit(80).cast("long").alias("last"))
    with within(90):
        assert S.enclosing(points, spans).groupBy("id").count().collect() == [("100000", n)]
        assert S.lexical_parents(spans).groupBy("parent").count().collect() == [("100000", n - 1)]
        near = S.overlapping(chunks, spans).groupBy("id", "rank", "overlap").count().orderBy("rank").collect()
    assert [tuple(r) for r in near] == [(str(100_000 + i), i + 1, 7, n) for i in range(8)]


def test_counted_calls(spark):
    """20,000 calls of a name that 20,000 methods bear; on few rows the counts are those of the lists."""
    schema = "call_id string, file string, container string, qualifier string, name string"
    n, none = 20_000, F.lit(None).cast("string")
    calls = spark.range(n).select(F.col("id").cast("string").alias("call_id"), F.lit("f").alias("file"), none.alias("container"), F.lit("x").alias("qualifier"), F.lit("m").alias("name"))
    symbols = spark.range(n).select(F.concat(F.lit("s"), "id").alias("id"), F.lit("m").alias("name"), F.lit("method").alias("kind"), F.concat(F.lit("T"), "id").alias("container"), F.lit("g").alias("file"))
    imports = spark.createDataFrame([("f", "a", "g", None), ("f", "b", "g", "m"), ("f", "b", "h", "m"), ("g", "u", "h", None)], "file string, local string, target_file string, symbol string")
    with within(60):
        assert [tuple(r) for r in N.count_calls(calls, symbols, imports).groupBy("state", "n").count().collect()] == [("ambiguous", n, n)]
    few = [(f"{f}|{c}|{q}|{w}", f, c, q, w) for f in "fgh" for c in (None, "T") for q in (None, "self", "T", "U", "x") for w in ("a", "b", "m", "u", "T")]
    held = [("1", "m", "method", "T", "f"), ("2", "m", "function", None, "h"), ("3", "T", "class", None, "h"), ("4", "a", "method", "U", "g"), ("5", "u", "function", None, "g"), ("6", "b", "function", None, "g"), ("7", "b", "function", None, "h"), ("8", "m", "method", "T", "g"), ("9", "m", "class", None, "g")]
    small = [spark.createDataFrame(few, schema), spark.createDataFrame(held, "id string, name string, kind string, container string, file string"), imports]
    for traits in ((), ("T", "U")):
        lists, counts = N.resolve_calls(*small, traits), N.count_calls(*small, traits)
        rows = lambda df, n: sorted(map(tuple, df.select("call_id", "state", "target", n.cast("long"), "kind", "confidence", "method").collect()), key=repr)
        assert rows(lists, F.size("candidates")) == rows(counts, F.col("n"))


def test_markers_beside_other_letters(spark):
    """As in its SQL, words are of ASCII letters, digits and underscores."""
    docs = spark.createDataFrame([(1, "éTODO a\nTODOé b\nTODO\u0301 c\nxTODO d\nTODO_ e\n1TODO f\nTODO"), (2, None)], "id long, text string")
    assert sorted((r["file"], r["line"], r["message"]) for r in D.markers(docs, "id", "text").collect()) == [("1", n, "TODO") for n in (1, 2, 3, 7)]


def test_vectors_are_not_broadcast(spark):
    rows = spark.range(50).select("id", F.concat(F.lit("word "), "id").alias("t"))
    old = rows.join(V.embed(rows, "id", {"t": 1.0}).hint("merge"), "id")
    plan = V.sync(old, rows, "id", {"t": 1.0}, ["t"])._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_references_into_a_hot_fresh_file(spark):
    """20,000 references to a name that 20,000 fresh symbols of a file bear, and to a qualified one of them."""
    n = 20_000
    refs = spark.range(n).select(F.col("id").alias("ref_id"), F.lit("function").alias("kind"), F.lit("f").alias("path"), F.when(F.col("id") == 0, "T.m7").otherwise("m").alias("name"))
    symbols = spark.range(n).select(F.lit("f").alias("path"), F.lit("method").alias("kind"), F.lit("m").alias("name"), F.concat(F.lit("T::m"), F.when(F.col("id") == 7, "7").otherwise("x")).alias("qualified_name"), F.lit("T").alias("container"), F.lit("body").alias("body"))
    with within(60):
        got = B.resolve_in_symbols(refs, symbols).groupBy("n", F.col("body_hash").isNull().alias("none")).count().collect()
    assert {tuple(r) for r in got} == {(1, False, 1), (n, True, n - 1)}


def test_a_list_of_values_is_broadcast(spark, sf_dir):
    plan = registry.queries()["flt_8_list_membership"](spark, sf_dir)._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_equal_texts_are_embedded_once(spark):
    """200,000 rows of two texts and nulls; cells of 600 dimensions a row would be 240 million."""
    docs = spark.range(200_000).select("id", F.when(F.col("id") % 4 == 0, "coldWidget").when(F.col("id") % 4 == 1, "widget").when(F.col("id") % 4 == 2, "none").alias("t"))
    matrix = spark.createDataFrame([("cold", [3.0] + [0.0] * 599), ("widget", [0.0, 4.0] + [0.0] * 598)], "token string, vector array<double>")
    with within(60):
        got = V.static_embed(docs, "id", "t", matrix).select(F.round(F.col("vector")[0], 4).alias("a"), F.round(F.col("vector")[1], 4).alias("b")).groupBy("a", "b").count().collect()
    assert {(r["a"] and round(r["a"], 4), r["b"] and round(r["b"], 4), r["count"]) for r in got} == {(0.6, 0.8, 50_000), (0.0, 1.0, 50_000), (None, None, 100_000)}


def test_rounds_of_doubling_broadcast_nothing(spark, monkeypatch):
    """Each round's table would pass through the driver."""
    plans, keep = [], G.materialize

    def seen(df, tag):
        if tag in ("pointers", "walk"):
            plans.append(df._jdf.queryExecution().sparkPlan().toString())
        return keep(df, tag)

    monkeypatch.setattr(G, "materialize", seen)
    chain = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1), (5, None), (6, 5)], "id long, next long")
    assert sorted(map(tuple, G.functional_cycles(chain).collect())) == [(1, 1, 3), (2, 1, 3), (3, 1, 3)]
    assert sorted(map(tuple, G.chain_ordinals(chain).collect())) == [(5, 5, 0, False), (6, 5, 1, True)]
    assert sum("SortMergeJoin" in p for p in plans) >= 6 and not any("Broadcast" in p for p in plans)


def _sketched(spark, rows):
    return spark.createDataFrame(rows, "id long, sketch array<long>, token_count long, body_hash string, neighbours array<string>")


def _few_sketches(spark, n):
    """n rows that share most of their buckets, all sketches of few values; nulls and repeats among hashes and neighbours."""
    draw = random.Random(5)
    rows = [(i, [draw.randrange(2) if p % 2 else draw.choice([0, 0, 0, 1, 2, i]) for p in range(64)], draw.choice([5, 50]), draw.choice(["a", "b", None, f"u{i}"]), draw.choice([["p", "q"], ["p"], ["p", "p"], [None, "q"], [], None])) for i in range(n)]
    rows += [(n + 1 + i, r[1], r[2], r[3], r[4]) for i, r in enumerate(rows[: n // 4])]
    return rows


def _banded(x, y):
    return any(x[i : i + 2] == y[i : i + 2] for i in range(0, 64, 2))


def test_links_of_equal_sketches(spark):
    """60,000 rows of two sketches, 9e8 pairs, are counted as classes; on few rows the counts are those of the pairs."""
    n = 60_000
    hot = spark.range(n).select("id", F.transform(F.sequence(F.lit(1), F.lit(64)), lambda p: p + F.when(F.col("id") % 3 == 0, 1).otherwise(0)).alias("sketch"))
    with within(60):
        got = K.links(hot.filter("id % 2 = 0"), hot.filter("id % 2 = 1"), "id").groupBy("lost", "class", "links").count().collect()
    assert {tuple(r) for r in got} == {(side, c, m // 2, m // 2) for side in (True, False) for c, m in ((0, n // 3), (1, n // 3 * 2))}
    rows = _few_sketches(spark, 60)
    few = _sketched(spark, rows)
    for size in (7, 65_536):
        have = {(r["id"], r["lost"]): (r["class"], r["links"]) for r in K.links(few.filter("id % 3 = 0"), few.filter("id % 3 > 0"), "id", size).collect()}
        assert have == {(r[0], r[0] % 3 == 0): (min(q[0] for q in rows if q[1] == r[1]), sum(_banded(r[1], q[1]) for q in rows if (q[0] % 3 == 0) != (r[0] % 3 == 0))) for r in rows}


def _relocated(row, held):
    """A verdict pair by pair."""
    i, s, tokens, h, near = row
    scored = []
    for j, s2, _, h2, near2 in held:
        u = None if near is None or near2 is None else set(near) | set(near2)
        jaccard = None if u is None else len(set(near) & set(near2)) / len(u) if u else 1.0
        share = sum(x == y for x, y in zip(s, s2)) / 64
        equal = sum(x == y and x is not None for x in near or () for y in near2 or ())
        if tokens >= K.SMALL and _banded(s, s2):
            scored.append((None if jaccard is None else 0.7 * share + 0.3 * jaccard, h, h2, j))
        elif tokens < K.SMALL and near is not None and equal and (equal >= 2 or equal == len(near)):
            scored.append((1.0 if share == 1 else 0.9 * jaccard, h, h2, j))
    if not scored:
        return i, "gone", None, 0.0
    rank = lambda p, q: 2 if p is None or q is None else int(p != q)
    score, _, _, j, r = min(((-1 if v is None else v, p, q, j, rank(p, q)) for v, p, q, j in scored), key=lambda c: (-c[0], c[4], c[3]))
    if score < 0:
        return i, "ambiguous", None, 0.0
    near_best, same = sum(c[0] is not None and score - c[0] < K.MARGIN for c in scored), sum(rank(c[1], c[2]) == 0 for c in scored)
    moved = score >= K.MOVED and (near_best == 1 or (same == 1 and r == 0))
    return i, "moved" if moved else "gone" if score < K.GONE else "ambiguous", j if moved else None, score


def test_relocation_among_alike_bodies(spark):
    """30,000 lost rows and 30,000 held ones that are all candidates of each other; on few rows the verdicts are those of the pairs."""
    n = 60_000
    hot = spark.range(n).select("id", F.transform(F.sequence(F.lit(1), F.lit(64)), lambda p: p.cast("long")).alias("sketch"), F.lit(50).cast("long").alias("token_count"), F.when(F.col("id") < 2, "one").otherwise(F.concat(F.lit("h"), F.col("id") % 50)).alias("body_hash"), F.array(F.lit("p"), F.lit("q")).alias("neighbours"))
    with within(60):
        got = K.relocate(hot.filter("id % 2 = 0"), hot.filter("id % 2 = 1")).groupBy("verdict", "held", "score").count().collect()
    assert {tuple(r) for r in got} == {("moved", 1, 1.0, 1), ("ambiguous", None, 1.0, n // 2 - 1)}
    rows = _few_sketches(spark, 120)
    few = _sketched(spark, rows)
    for size in (11, 65_536):
        have = sorted(map(tuple, K.relocate(few.filter("id % 3 = 0"), few.filter("id % 3 > 0"), part_rows=size).collect()))
        want = [_relocated(r, [q for q in rows if q[0] % 3]) for r in rows if r[0] % 3 == 0]
        assert have == want and len({r[1] for r in have}) == 3


def test_relations_of_a_hot_node(spark):
    """F8: 40,000 entities on one node, 8e8 pairs, stand as memberships; pairs that share another node, or are linked, count it too."""
    n = 40_000
    grounded = spark.range(n).select(F.lit("hot").alias("node"), F.col("id").alias("entity"))
    grounded = grounded.unionByName(spark.createDataFrame([("x", 1), ("x", 2), ("x", 2), ("y", 3), ("z", -1)], "node string, entity long"))
    edges = spark.createDataFrame([("x", "y", 0.3), ("z", "x", 0.3), ("y", "x", 0.9)], "source string, target string, weight double")
    with within(60):
        got = W.relation_candidates(edges, grounded).collect()
    hot = [r for r in got if r["node"] is not None]
    assert sorted(r["a"] for r in hot) == list(range(n)) and {(r["b"], r["score"], r["shared"], r["node"]) for r in hot} == {(None, 0.2, None, "hot")}
    assert sorted((r["a"], r["b"], round(r["score"], 6), r["shared"]) for r in got if r["node"] is None) == [(-1, 1, 0.3, 0), (-1, 2, 0.3, 0), (1, 2, 0.4, 2), (1, 3, 1.2, 1), (2, 3, 1.2, 1)]


def test_words_are_split_outside_of_java(spark):
    """Java's pattern took most of the time of searches; the words are the same."""
    rows = [(None,), ("",), (" ,",), ("a",), ("  Ab,c  ÀÉß÷ÿ x\u0130y \u1e9e\U0001f600z1_2 naïve\u0301-é\n\x00q",), ("end ",)]
    docs = spark.createDataFrame(rows * 30, "text string")
    java = F.filter(F.split(F.lower("text"), r"[^a-z0-9à-ÿ]+"), lambda w: w != "")
    both = docs.select(T.words(F.col("text")).alias("w"), java.alias("j"))
    assert all(r["w"] == r["j"] for r in both.collect()) and "ArrowEvalPython" in both._jdf.queryExecution().executedPlan().toString()


def test_integrity_splits_texts_once(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, "b c"), (3, None), (4, "d")], "id long, t string")
    stored = spark.createDataFrame([(1, "a"), (1, "b"), (1, "b"), (2, "c"), (3, "x"), (4, "d"), (5, "y")], "doc long, term string")
    got = L.posting_integrity(docs, "id", "t", stored)
    assert sorted(map(tuple, got.collect())) == [(2, "lost"), (3, "extra"), (5, "extra")]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("_split_words") == 1


def test_searches_split_texts_once(spark, sf_dir):
    """the matches are written, so that no later use of them splits the texts again."""
    for name in ("fts_2_term_lists", "fts_4_hybrid"):
        assert "_split_words" not in registry.queries()[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()


def test_overrides_of_a_frequent_name(spark):
    """F16: 40,000 members of one name in a class and as many in the one it extends, 1.6e9 pairs, are counted as classes."""
    n = 40_000
    members = spark.range(2 * n).select((F.col("id") % 2).cast("int").alias("owner"), F.lit("m").alias("name"), "id").unionByName(spark.createDataFrame([(1, "own", -5), (0, None, -6), (1, None, -7)], "owner int, name string, id long"))
    extends = spark.createDataFrame([(1, 0), (2, 1)], "sub int, base int")
    with within(60):
        got = G.override_classes(extends, members).groupBy("class_id", "base_id", "links").count().collect()
    assert {tuple(r) for r in got} == {(0, None, 0, n), (1, 0, n, n), (-5, None, 0, 1), (-6, None, 0, 1), (-7, None, 0, 1)}


def shuffled_rows(spark, run):
    """Rows that the tasks of run's jobs wrote to shuffles."""
    sc, group = spark.sparkContext, f"rows-{time.monotonic()}"
    sc.setJobGroup(group, group)
    try:
        run()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    store = sc._jsc.sc().statusStore()
    jobs = [store.job(j) for j in sc.statusTracker().getJobIdsForGroup(group)]
    stages = {s for j in jobs for s in (j.stageIds().apply(i) for i in range(j.stageIds().size()))}
    return sum(store.lastStageAttempt(s).shuffleWriteRecords() for s in stages)


def test_ranks_without_rounds_over_sources(spark):
    """30,000 nodes to which nothing links: they take part in the first of the rounds alone, and the ranks are those of the plain rounds."""
    n = 30_000
    links = spark.range(n).select(F.concat(F.lit("s"), "id").alias("src"), F.concat(F.lit("t"), F.col("id") % 900).alias("dst"))
    links = links.unionByName(spark.range(900).select(F.concat(F.lit("t"), "id").alias("src"), F.lit("end").alias("dst")).limit(890))
    got = {}
    moved = shuffled_rows(spark, lambda: got.update({r["id"]: r["rank"] for r in G.pagerank(links).collect()}))
    assert moved < 14 * n
    out, nodes = {}, n + 901
    for i in range(n):
        out.setdefault(f"s{i}", []).append(f"t{i % 900}")
    ends = [r["src"] for r in links.filter("dst = 'end'").collect()]
    out |= {s: ["end"] for s in ends}
    rank = dict.fromkeys(got, 1 / nodes)
    for _ in range(20):
        loose = sum(r for i, r in rank.items() if i not in out)
        fresh = dict.fromkeys(got, 0.15 / nodes + 0.85 * loose / nodes)
        for s, ts in out.items():
            for t in ts:
                fresh[t] += 0.85 * rank[s] / len(ts)
        rank = fresh
    assert len(got) == nodes and all(abs(got[i] - rank[i]) < 1e-12 for i in rank)


def test_ranks_of_a_cycle(spark):
    """Walks on a cycle never end, so that all rounds run."""
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "src string, dst string")
    got = {r["id"]: r["rank"] for r in G.pagerank(links).collect()}
    rank, out = dict.fromkeys("abcd", 0.25), {"a": "b", "b": "c", "c": "ad"}
    for _ in range(20):
        rank = {i: 0.15 / 4 + 0.85 * rank["d"] / 4 + 0.85 * sum(rank[s] / len(t) for s, t in out.items() if i in t) for i in "abcd"}
    assert all(abs(got[i] - rank[i]) < 1e-12 for i in rank)


def test_remembered_words_are_small():
    """A task remembers many words, and so does each of an executor's workers."""
    import tracemalloc

    hasher = V._Hasher()
    tracemalloc.start()
    for i in range(20_000):
        hasher.word(f"word{i}")
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held < 20_000 * 300


def test_flows_rank_opened_nodes_alone(spark):
    """40,000 edges of nodes that the search never opens are not shuffled."""
    from marlstone.operators import flows as FL

    n = 40_000
    edge = lambda a, b: [a.alias("source"), b.alias("target"), F.lit("calls").alias("kind"), F.lit(1.0).alias("confidence"), F.lit(1).cast("long").alias("line"), F.lit(1).cast("long").alias("rank"), F.lit(1.0).alias("weight")]
    edges = spark.range(n).select(*edge(F.concat(F.lit("x"), "id"), F.concat(F.lit("y"), F.col("id") % 7)))
    edges = edges.unionByName(spark.range(2).select(*edge(F.concat(F.lit("a"), "id"), F.concat(F.lit("a"), F.col("id") + 1))))
    nodes = edges.select(F.col("source").alias("id")).unionByName(spark.createDataFrame([("a2",), *((f"y{i}",) for i in range(7))], "id string"))
    nodes = nodes.select("id", F.lit("f").alias("file_path"), F.col("id").alias("name"), F.lit(True).alias("exported"), F.lit(1.0).alias("relevance"), F.lit(False).alias("selected"), F.array("id").alias("terms"))
    got = []
    moved = shuffled_rows(spark, lambda: got.extend(FL.flows(edges, nodes, spark.createDataFrame([("a0", 0)], "id string, place long")).collect()))
    assert moved < n and {(r["source"], r["target"]) for r in got} == {("a0", "a1"), ("a1", "a2")}


def test_similar_titles_of_frequent_words(spark):
    """30,000 titles of ten words out of 200: some 100,000,000 pairs share a word among their rarest (F22)."""
    n, rng = 30_000, random.Random(5)
    rows = [(i, "t", " ".join(f"w{w}" for w in rng.sample(range(200), 10))) for i in range(n)]
    rows += [(n + i, "t", " ".join([*rows[i][2].split()[:9], "new"])) for i in range(50)]
    with within(100):
        got = {(r["a"], r["b"]): r["score"] for r in W.similar_pairs(spark.createDataFrame(rows, "id long, type string, title string"), 0.6).collect()}
    assert all(got[(i, n + i)] == 9 / 11 for i in range(50))


def test_similar_titles_are_those_of_all_pairs(spark, monkeypatch):
    """Short and long titles, copies and frequent pairs of words in parts, at several thresholds."""
    monkeypatch.setattr(W, "PART_TITLES", 8)
    rng = random.Random(11)
    rows = [(i, "uv"[i % 2], " ".join(f"w{min(int(rng.expovariate(0.2)), 30)}" for _ in range(rng.randint(0, 9)))) for i in range(260)]
    sets = [(i, kind, set(title.split())) for i, kind, title in rows]
    titles = spark.createDataFrame(rows, "id long, type string, title string")
    for least in (0.3, 0.6, 1.0):
        want = {(a, b, len(x & y) / len(x | y)) for a, s, x in sets for b, t, y in sets if a < b and s == t and x | y and len(x & y) / len(x | y) >= least}
        got = W.similar_pairs(titles, least).collect()
        assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_approximate_search_lists_no_pairs(spark):
    """60,000 vectors and 1,200 queries, which look at some 10,000,000 of them (F1)."""
    at = F.sequence(F.lit(1), F.lit(16))
    vectors = spark.range(60_000).select(F.col("id").alias("vec_id"), F.transform(at, lambda i: F.sin((F.col("id") + 1) * i)).alias("embedding"))
    with within(60):
        rows = V.approximate_knn(vectors, vectors.filter("vec_id % 50 = 0"), 3, 16).collect()
    assert len(rows) == 3600 and not any(r["query_id"] == r["vec_id"] for r in rows)


def test_approximate_search_looks_at_near_codes(spark):
    """All codes near: the exact answer; rows without a cosine come last."""
    rng = random.Random(5)
    rows = [(i, [float(rng.randint(-2, 2)) for _ in range(3)]) for i in range(60)] + [(60, None), (61, [1.0]), (62, [float("nan")] * 3)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = vectors.filter("vec_id % 7 = 0")
    top, read = V.approximate_knn_read(vectors, asked, 61, 3, share=1.0, part_rows=20, block_rows=4)
    assert {(r["query_id"], r["looked"]) for r in read.collect()} == {(i, 62) for i in range(0, 63, 7)}
    assert sorted(map(repr, top.collect())) == sorted(map(repr, V.exact_knn(vectors, asked, 61).collect()))


def test_exact_search_among_copies(spark):
    """400,000 rows of 35 distinct vectors, of which 8,000 are asked: 3.2e9 pairs of rows (F4)."""
    n = 400_000
    vectors = spark.range(n).select(F.col("id").alias("vec_id"), F.array(F.col("id") % 7 + 1.0, F.col("id") % 5 + 1.0).alias("embedding"))
    with within(60):
        rows = V.exact_knn(vectors, vectors.filter("vec_id % 50 = 0"), 5).collect()
    assert len(rows) == n // 50 * 5 and all(r["similarity"] == 1.0 and r["query_id"] != r["vec_id"] for r in rows)


def test_exact_search_keeps_the_order_of_rows(spark):
    """Copies and vectors of one direction: ties go to the smaller key, whatever its class."""
    rng = random.Random(9)
    rows = [(i, [float(rng.randint(0, 2)) * (1 + i % 3) for _ in range(2)]) for i in range(120)] + [(120, None), (121, None), (122, [1.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in V.exact_knn(vectors, vectors.filter("vec_id % 8 = 0"), 6, part_rows=7, block_rows=3).orderBy("rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])

    def score(a, b):
        if a is None or b is None or len(a) != len(b):
            return -2.0
        norm = sum(x * x for x in a) ** 0.5 * sum(x * x for x in b) ** 0.5
        return round(sum(x * y for x, y in zip(a, b)) / norm, 12) if norm else 0.0

    assert got == {q: [i for _, i in sorted((-score(v, w), i) for i, w in rows if i != q)[:6]] for q, v in rows if q % 8 == 0}


def test_index_of_copies(spark, tmp_path, monkeypatch):
    """60,000 rows of 60 distinct vectors, of which 6,000 are asked: what the parts of lists meet are distinct vectors (F3)."""
    from marlstone.operators import vectorindex

    n, counts, kept = 60_000, {}, vectorindex.materialize

    def counted(df, tag):
        out = kept(df, tag)
        counts[tag] = out.count()
        return out

    vectors = spark.range(n).select(F.col("id").alias("vec_id"), F.array(F.sin(F.col("id") % 60), F.cos(F.col("id") % 60), F.lit(0.5)).alias("embedding"))
    index = VectorIndex(spark, f"file://{tmp_path}/index").build(vectors, 20)
    monkeypatch.setattr(vectorindex, "materialize", counted)
    top, read = index.search_read(vectors.filter("vec_id % 10 = 0"), 4, 2)
    got = top.collect()
    assert counts["asked"] == 12 and counts["held"] <= 60 and read.count() == n // 10 and index.stored().count() == n
    assert len(got) == n // 10 * 4 and all(r["query_id"] != r["vec_id"] and (r["query_id"] - r["vec_id"]) % 60 == 0 for r in got)
    assert {r["vec_id"] for r in got if r["query_id"] == 120} == {0, 60, 180, 240}


def test_links_of_many_classes():
    """10,000 classes with 40,000: 400 million pairs, whose bands were compared one by one (F6)."""
    import numpy as np

    rng = np.random.default_rng(4)
    x, y = (rng.integers(0, 3, (n, 64)).astype(np.uint32) * rng.integers(1, 4, (n, 1)).astype(np.uint32) for n in (10_000, 40_000))
    x[:50, :] += rng.integers(0, 900, (50, 64)).astype(np.uint32)
    weight = rng.integers(1, 5, len(y))
    with within(20):
        got = K._linked(K._buckets(x), K._buckets(y), weight)
    for i in range(0, 10_000, 250):
        same = x[i] == y
        assert got[i] == weight[(same[:, ::2] & same[:, 1::2]).any(axis=1)].sum()
