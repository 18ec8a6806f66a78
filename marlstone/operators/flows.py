"""Directed flows: a few trusted paths from seeds that show how a task runs through the code.

The part of the graph that a bounded search can reach is cut out by joins, a hop at a time, each node with its best branches
alone.  What follows is one ordered choice over at most some thousand edges, so it runs as one grouped function: paths in
the order of a queue within a budget of work, their ranking, representatives of each call site, and the admission."""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marlstone.functions import text as T
from marlstone.operators.structural import CALL_KINDS
from marlstone.work import materialize

# Steps of a path, branches of a node, work of a search, least confidence and least relevance that counts.
HOPS, BRANCHES, WORK, TRUST, STRONG = 7, 8, 256, 0.8, 0.5
_NEVER = 1 << 30


def branches(edges: DataFrame, nodes: DataFrame, most: int = BRANCHES) -> DataFrame:
    """edges with the place of each among its source's trusted ones, at most `most` of a source.

    nodes: id, file_path, name, exported, relevance, selected.  Edges known from a call site (rank) come first, then by weight, rank,
    chosen, exported and relevant targets.  Where there are too many, the best of each call site and target file go first."""
    t = nodes.select(F.col("id").alias("target"), F.col("file_path").alias("to_file"), F.col("name").alias("to_name"), "exported", "relevance", "selected")
    x = edges.filter(F.col("confidence") >= TRUST).join(t, "target")
    x = x.filter((F.col("kind") != "contains") | (F.coalesce("to_name", F.lit("")) == ""))
    by = [F.col("rank").isNull(), F.desc("weight"), F.col("rank").asc_nulls_last(), F.desc("selected"), F.desc("exported"), F.desc("relevance"), F.desc("confidence"), "target", F.col("line").asc_nulls_last()]
    x = x.withColumn("plain", F.row_number().over(W.partitionBy("source").orderBy(*by))).withColumn("n", F.count(F.lit(1)).over(W.partitionBy("source")))
    calls = F.col("kind").isin(*CALL_KINDS)
    first = F.row_number().over(W.partitionBy("source", "rank", "to_file").orderBy(F.desc(calls), F.col("line").desc_nulls_last(), "plain")) == 1
    x = x.withColumn("stands", F.col("rank").isNotNull() & first & (F.col("n") > most))
    place = F.row_number().over(W.partitionBy("source").orderBy(F.desc("stands"), F.when(F.col("stands"), F.col("rank")).asc_nulls_last(), "plain"))
    return x.withColumn("place", place).filter(F.col("place") <= most).select("source", "target", "kind", "line", "rank", "weight", "place")


def reachable(edges: DataFrame, nodes: DataFrame, seeds: DataFrame, hops: int = HOPS, most: int = WORK) -> DataFrame:
    """The branches that a search from seeds(id, place) can use: at most `most` nodes are opened at each hop, in their order.  A hop reads
    the edges of the nodes it opens alone, and ranks no others."""
    frontier = materialize(seeds.select("id", F.col("place").cast("long").alias("at")).orderBy("place").limit(most), "frontier")
    opened, out = frontier.select("id"), None
    for _ in range(hops):
        open_now = [r["id"] for r in frontier.select("id").distinct().collect()]  # at most `most` rows
        own = materialize(edges.filter(F.col("source").isin(open_now)), "own")
        step = materialize(branches(own, nodes).join(frontier.select(F.col("id").alias("source"), "at"), "source"), "step")
        part = step.drop("at")
        out = part if out is None else out.unionByName(part)
        near = step.groupBy(F.col("target").alias("id")).agg(F.min(F.struct("at", "place")).alias("came"))
        near = near.join(opened, "id", "left_anti").orderBy("came", "id").limit(most)
        frontier = materialize(near.select("id", F.row_number().over(W.orderBy("came", "id")).cast("long").alias("at")), "frontier")  # at most `most` rows
        if frontier.isEmpty():
            break
        opened = opened.unionByName(frontier.select("id"))
    return out


@dataclass(frozen=True)
class Step:
    source: str
    target: str
    kind: str
    line: int | None
    rank: int | None
    weight: float

    @property
    def is_call(self) -> bool:
        return self.kind in CALL_KINDS


@dataclass
class Known:
    """What is known of the nodes of a search."""

    file: dict[str, str]
    low: set[str]
    unnamed: set[str]
    exported: set[str]
    selected: set[str]
    relevance: dict[str, float]
    terms: dict[str, frozenset[str]]
    out: dict[str, list[Step]] = field(default_factory=dict)


def paths(known: Known, seeds: list[str], hops: int = HOPS, work: int = WORK) -> list[tuple[Step, ...]]:
    """Paths that end in a call or reference, in the order of a queue.  Opening a node and taking a branch cost one unit each; a unit is
    kept for every seed that still waits.  A path meets no node twice and one unnamed node at most."""
    waiting, found = len(seeds), []
    queue = deque((s, ()) for s in seeds)
    while queue and work > 0:
        node, path = queue.popleft()
        if len(path) >= hops:
            continue
        waiting -= not path
        work -= 1
        met = {path[0].source, *(s.target for s in path)} if path else {node}
        for step in known.out.get(node, ()):
            if work <= waiting:
                break
            if step.target in met or len({*met, step.target} & known.unnamed) > 1:
                continue
            work -= 1
            longer = (*path, step)
            queue.append((step.target, longer))
            if step.kind != "contains" and any(s.is_call or s.kind == "references" for s in longer):
                found.append(longer)
    return found


def ranking(known: Known, path: tuple[Step, ...]) -> tuple:
    """A path's place among the candidates, least first: production code, calls, call sites of the query by weight and rank, public
    ends, relevant ends and nodes, files, chosen nodes, and short ones."""
    first, last = path[0].source, path[-1].target
    ends = list(dict.fromkeys([first, *(s.target for s in path)]))
    worth = known.relevance.get
    sites = [s.rank for s in path if s.rank is not None]
    return (
        first in known.low,
        -(2 if any(s.is_call for s in path) else 1),
        not sites,
        -max(s.weight for s in path),
        min(sites, default=_NEVER),
        last not in known.exported,
        -len(sites),
        -sum(worth(e, 0.0) >= STRONG for e in (first, last)),
        -sum(worth(e, 0.0) for e in ends if worth(e, 0.0) >= STRONG),
        -(worth(first, 0.0) + worth(last, 0.0)),
        -worth(last, 0.0),
        known.file.get(first) == known.file.get(last),
        first not in known.selected,
        -sum(e in known.selected for e in ends),
        -worth(first, 0.0),
        len(path),
        key_of(path),
    )


def key_of(path: tuple[Step, ...]) -> tuple:
    return tuple((s.source, s.target, s.kind, -1 if s.line is None else s.line) for s in path)


def representatives(known: Known, ranked: list[tuple[Step, ...]], most: int) -> list[tuple[Step, ...]]:
    """For each call site of the query its best direct step, and a second one to another strong target; at most `most` of them.  A step
    out of an unnamed node begins at the named one that contains it."""
    owners = {s.target: s for steps in known.out.values() for s in steps if s.kind == "contains" and s.source not in known.unnamed}
    sites: dict[int, list[tuple[Step, ...]]] = {}
    for p in ranked:
        if len(p) == 1 and p[0].rank is not None:
            sites.setdefault(p[0].rank, []).append(p)
    picked: list[tuple[Step, ...]] = []
    for rank in sorted(sites):
        at = [p for p in sites[rank] if p[0].is_call] or sites[rank]
        second = next((p for p in at[1:] if p[0].target != at[0][0].target and (known.relevance.get(p[0].target, 0.0) >= STRONG or {p[0].source, p[0].target} <= known.selected)), None)
        for p in (at[0], second):
            if p is not None:
                owner = owners.get(p[0].source) if p[0].source in known.unnamed else None
                whole = (owner, *p) if owner is not None and owner.source != p[0].target else p
                if key_of(whole) not in map(key_of, picked):
                    picked.append(whole)
    return picked[:most]


def completion(known: Known, pairs: list[tuple[str, str]]) -> tuple[Step, ...] | None:
    """The first call pair of the query whose callee hands on through one unnamed function: call, containment, call."""
    for a, b in pairs:
        call = next((s for s in known.out.get(a, ()) if s.target == b and s.is_call), None)
        if call is None or a == b:
            continue
        for inner in known.out.get(b, ()):
            if inner.kind == "contains" and inner.target in known.unnamed:
                last = next((s for s in known.out.get(inner.target, ()) if s.is_call and s.target not in (a, b)), None)
                if last is not None:
                    return call, inner, last
    return None


def admit(known: Known, ranked: list[tuple[Step, ...]], pairs: list[tuple[str, str]], weights: dict[str, float], steps: int) -> list[tuple[Step, ...]]:
    """The flows to show, of `steps` steps in all: what completes a call pair, representatives up to half of the steps, the best path,
    then those that add most new terms; one that shares an edge with a chosen flow waits for the others.  A path inside a longer
    one is left out, and so is what shows nothing new."""
    keys = [key_of(p) for p in ranked]
    inner = {k[i:j] for k in keys for i in range(len(k)) for j in range(i + 1, len(k) + 1) if j - i < len(k)}
    chosen: list[tuple[Step, ...]] = []
    used: set[tuple] = set()
    covered: set[str] = set()

    def take(path: tuple[Step, ...]) -> None:
        key = key_of(path)
        if len(path) <= steps - sum(map(len, chosen)) and not set(key) <= used:
            chosen.append(path)
            used.update(key)
            covered.update(*(known.terms.get(e, frozenset()) for s in path for e in (s.source, s.target)))

    if (done := completion(known, pairs)) is not None:
        take(done)
    stand = representatives(known, ranked, max(1, -(-steps // 2)))
    for p in stand:
        take(p)
    held = {key_of(p) for p in stand}
    rest = [p for p, k in zip(ranked, keys) if k not in held and k not in inner]
    for p in rest[:1]:
        take(p)
    new = lambda p: sum(weights.get(t, 0.0) for t in set().union(*(known.terms.get(e, frozenset()) for s in p for e in (s.source, s.target))) - covered)
    gains = [(p[0].source not in known.selected, -new(p), i) for i, p in enumerate(rest[1:], 1)]
    waiting = []
    for _, _, i in sorted(gains):
        (waiting.append if set(key_of(rest[i])) & used else take)(rest[i])
    for p in waiting:
        take(p)
    return chosen


def flows(edges: DataFrame, nodes: DataFrame, seeds: DataFrame, pairs: list[tuple[str, str]] = (), weights: dict[str, float] | None = None, steps: int = 8) -> DataFrame:
    """flow, step, source, target, kind, line.  edges: source, target, kind, confidence, line, rank, weight; nodes: id, file_path, name,
    exported, relevance, selected, terms; seeds: id, place; pairs: calls between hits of the whole query; weights of terms."""
    hops = min(HOPS, steps)
    near = materialize(reachable(edges, nodes, seeds, hops).distinct(), "near")
    ends = materialize(near.select(F.col("source").alias("id")).union(near.select("target")).union(seeds.select("id")).distinct(), "ends")  # some thousand rows
    info = nodes.join(ends, "id", "left_semi").select("id", "file_path", "name", "exported", "relevance", "selected", "terms", T.is_low_value_path(F.col("file_path")).alias("low"))
    rows = near.select(F.lit("edge").alias("what"), F.col("place").cast("long"), "source", "target", "kind", "line", "rank", "weight")
    rows = rows.unionByName(info.select(F.lit("node").alias("what"), "*"), allowMissingColumns=True)
    first = seeds.orderBy("place").limit(32).select(F.lit("seed").alias("what"), F.col("place").cast("long"), F.col("id").alias("source"))
    flat = rows.unionByName(first, allowMissingColumns=True).withColumn("all", F.lit(1))  # some thousand rows
    pairs, weights = list(pairs), dict(weights or {})

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        none = lambda x: None if pd.isna(x) else int(x)
        n = pdf[pdf["what"] == "node"]
        known = Known(
            dict(zip(n["id"], n["file_path"])), set(n["id"][n["low"] == True]), set(n["id"][n["name"].fillna("") == ""]), set(n["id"][n["exported"] == True]), set(n["id"][n["selected"] == True]),  # noqa: E712
            dict(zip(n["id"], n["relevance"].fillna(0.0).astype(float))), {i: frozenset(() if t is None else t) for i, t in zip(n["id"], n["terms"])},
        )
        for r in pdf[pdf["what"] == "edge"].sort_values(["source", "place"]).itertuples():
            known.out.setdefault(r.source, []).append(Step(r.source, r.target, r.kind, none(r.line), none(r.rank), float(r.weight or 0.0)))
        starts = list(pdf[pdf["what"] == "seed"].sort_values("place")["source"])
        ranked = sorted(set(paths(known, starts, hops)), key=lambda p: ranking(known, p))
        out = admit(known, ranked, pairs, weights, steps)
        return pd.DataFrame([(i, j, s.source, s.target, s.kind, s.line) for i, p in enumerate(out) for j, s in enumerate(p)], columns=["flow", "step", "source", "target", "kind", "line"]).astype({"flow": "int64", "step": "int64", "line": "Int64"})

    return flat.groupBy("all").applyInPandas(choose, "flow long, step long, source string, target string, kind string, line long")
