"""Contexts of clusters against plain loops."""

import json

from marlstone.operators import cluster_context as C


def test_context_by_hand(spark):
    nodes = [
        ("f1", "function", "m.f1", None, "a", 2, 3, False), ("f2", "method", "m.f2", "x", "a", 5, 5, True), ("v", "variable", "m.v", None, "a", 1, 1, None), ("s", "method", "m.s", "x", "b", 4, 9, False), ("gone", "class", "m.gone", None, "none", 1, 2, False), ("zero", "class", "m.zero", None, "a", 0, 2, False),
    ]
    edges = [(f"c{i}", "f1", "calls") for i in range(8)] + [("s", "f1", "calls"), ("f1", "f2", "calls"), ("f1", "f1", "calls"), ("f1", "x", "contains"), ("c0", "s", "calls")]
    n = spark.createDataFrame(nodes, "id string, kind string, qualified_name string, container_id string, file_path string, start_line long, end_line long, is_exported boolean")
    members = spark.createDataFrame([("k", i[0]) for i in nodes] + [("k", "f1"), ("k", "unknown")], "cluster string, id string")
    context = C.context_nodes(members, n, spark.createDataFrame(edges, "source string, target string, kind string"), 5)
    got = {r.id: r for r in context.collect()}
    assert [i for i in sorted(got, key=lambda i: got[i].place)] == ["zero", "f1", "f2", "gone", "v"] and got["v"].total == 6 and not got["v"].primary
    assert got["f1"].callers == ["c0", "c1", "c2", "c3", "c4"] and got["f1"].callees == ["m.f2"] and got["f2"].callers == ["m.f1"] and got["v"].callers == []
    files = {"a": "\n".join(f"line {i}" for i in range(1, 8)) + "\n", "b": "\n \n"}
    blocks = C.context_blocks(context, spark.createDataFrame(sorted(files.items()), "path string, content string"))
    assert {r.id: (r.first, r.last) for r in blocks.collect()} == {"f1": (1, 6), "f2": (2, 7), "v": (1, 1)}
    assert next(r.content for r in blocks.collect() if r.id == "v") == "line 1"


def by_loop(context, blocks, budget):
    out = {}
    for cluster in {r.cluster for r in context}:
        nodes = [r for r in context if r.cluster == cluster]
        said = (json.dumps({k: r[k] for k in ("id", "kind", "name", "file_path", "primary", "callers", "callees")}, separators=(",", ":"), ensure_ascii=False) for r in nodes)
        used = sum(-(-len(s.encode()) // 4) for s in said)
        own = sorted((r for r in blocks if r.cluster == cluster), key=lambda r: (not r.primary, r.place))
        kept = []
        for r in own:
            cost = -(-len(r.content.encode()) // 4) + C.BLOCK_TOKENS
            if used + cost <= budget:
                used += cost
                kept.append(r.id)
        for i in kept:
            out[cluster, i] = (len(own) - len(kept), len(kept) < len(own) or nodes[0].total > len(nodes))
    return out


def test_budget(spark, sf_dir):
    from marlstone.plans.retrieval_queries import _clusters
    from marlstone.plans.views import Views

    _, context, blocks = _clusters(Views(spark, sf_dir))
    held, source = context.collect(), blocks.collect()
    for budget in (700, 3000):
        got = {(r.cluster, r.id): (r.dropped, r.truncated) for r in C.fit_context(context, blocks, budget).collect()}
        assert got == by_loop(held, source, budget)
    assert any(d for d, _ in got.values()) or budget == 3000
