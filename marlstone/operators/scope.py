"""Ranked retrieval: a query plan, channels of ranked evidence, fusion, scores of files, admission under caps.

Channels are relational and give one long table of evidence (channel, id, rank, weight, reason).  Admission is greedy over a
few hundred ranked rows, so it runs as one grouped function after a top-k."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marlstone.functions import text as T
from marlstone.operators import fulltext as X
from marlstone.operators.ranking import RRF, ranked
from marlstone.operators.structural import CONTAINERS

# Words that ask for nothing, and words that say little about code.
STOP = frozenset(
    """a an and are as at be been but by can could did do does each every for from give had has have how i if in into is it its just may me might more my need no not
    of on only or our out should show so some such tell than that the their them then there these they this those to up us used using want was we what when where
    which who why will with would you work works your""".split()
)
LOW_SIGNAL = frozenset("agent called class code declaration declarations file files function graph method node nodes object search source symbol symbols task".split())
_TOKEN = re.compile(r"[#A-Za-z_$][#\w$.:/\\-]*", re.A)
MAX_TOKENS, MAX_TERMS, MAX_IDENTIFIERS = 40, 32, 16


@dataclass
class Plan:
    """terms: weight by term; concepts: terms by the token they came from; identifiers as typed; whether tests are asked for."""

    terms: dict[str, float] = field(default_factory=dict)
    concepts: dict[str, list[str]] = field(default_factory=dict)
    identifiers: list[str] = field(default_factory=list)
    tests: bool = False


def is_identifier(token: str) -> bool:
    """Whether a token looks typed as an identifier: paths, qualified names, marks or digits inside, capitals."""
    return bool(re.search(r"[/\\_$0-9]", token) or re.match(r"#[A-Za-z_$]", token) or re.search(r"[\w$](?:\.|::|#)[\w$]", token) or re.fullmatch(r"[A-Z][A-Za-z0-9]*", token) or re.search(r".[A-Z]", token))


def components(token: str) -> list[str]:
    spaced = re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1 \2", re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", token))
    return list(dict.fromkeys(p for p in re.split(r"[^a-z0-9]+", spaced.lower()) if len(p) >= 2))


def stem_variants(term: str) -> list[str]:
    """Shorter forms of a word: without plural, participle and noun endings."""
    out: list[str] = []
    n = len(term)
    rules = [
        (term.endswith("ing") and n > 5, lambda: [term[:-3], term[:-3] + "e"] + ([term[:-4]] if term[-4] == term[-5] else [])),
        (re.search(r"[ts]ion$", term) and n >= 9, lambda: [term[:5]]),
        (term.endswith("ment") and n > 6, lambda: [term[:-4]]),
        (term.endswith("ies") and n > 4, lambda: [term[:-3] + "y"]),
        (not term.endswith("ies") and re.search(r"(sses|xes|zes|ches|shes|oes)$", term) and n > 4, lambda: [term[:-2]]),
        (term.endswith("s") and not re.search(r"(ss|ies|sses|xes|zes|ches|shes|oes)$", term) and n > 4, lambda: [term[:-1]]),
        (term.endswith("ed") and n > 4, lambda: [term[:-1], term[:-2]]),
    ]
    for applies, forms in rules:
        if applies:
            out += forms()
    return list(dict.fromkeys(v for v in out if len(v) >= 3 and v != term))


def plan_query(text: str) -> Plan:
    """A task in words as weighted terms: identifiers count double, their parts and plain words less, stems and words of low
    signal least."""
    plan = Plan(tests=bool(re.search(r"\b(tests?|specs?|coverage)\b", text, re.I)))
    for token in _TOKEN.findall(text)[:MAX_TOKENS]:
        token = token.rstrip(".:/-")
        lower = token.lower()
        if not token or lower in STOP:
            continue
        shaped = is_identifier(token)
        if shaped and token not in plan.identifiers and len(plan.identifiers) < MAX_IDENTIFIERS:
            plan.identifiers.append(token)
        weight = 2.0 if shaped else 0.35 if lower in LOW_SIGNAL else 1.0
        found = [(lower, weight)] if re.fullmatch(r"[a-z0-9]+", lower) else []
        if shaped:
            found += [(p, 1.15 if p not in STOP and p not in LOW_SIGNAL else 0.15) for p in components(token) if p != lower]
        else:
            found += [(s, 0.55 if lower not in LOW_SIGNAL else 0.2) for s in stem_variants(lower)]
        for term, w in found:
            if term in plan.terms or len(plan.terms) < MAX_TERMS:
                plan.terms[term] = max(w, plan.terms.get(term, 0.0))
                plan.concepts.setdefault(lower, []).append(term)
    return plan


def query_plans(tasks: DataFrame) -> DataFrame:
    """task, concept, term, weight of tasks (task long, text): each planned by itself, a null text as an empty one."""

    def run(frames):
        for f in frames:
            rows = [(t, c, term, float(plan.terms[term])) for t, text in zip(f["task"], f["text"]) for plan in (plan_query(text or ""),) for c, terms in plan.concepts.items() for term in terms]
            yield pd.DataFrame(rows, columns=["task", "concept", "term", "weight"])

    return tasks.select("task", "text").mapInPandas(run, "task long, concept string, term string, weight double")


FIELDS = {"name": 10.0, "qualified_name": 4.0}


def _channel(rows: DataFrame, name: str, weight: float, order: list, reason: str, most: int) -> DataFrame:
    top = rows.orderBy(*order).limit(most).withColumn("channel", F.lit(name))
    return ranked(top, order, ["channel"]).select("channel", "id", "rank", F.lit(weight).alias("weight"), F.lit(reason).alias("reason"))


def exact_channel(nodes: DataFrame, plan: Plan) -> DataFrame:
    """Declarations whose name or qualified name was typed, whatever the case of a capitalised word."""
    wanted = [i.lower() for i in plan.identifiers] or [""]
    hit = nodes.filter((F.lower("name").isin(*wanted) | F.lower("qualified_name").isin(*wanted)) & ~F.col("kind").isin(*CONTAINERS))
    return _channel(hit, "exact", 3.0, ["file_path", "start_line", "id"], "exact identifier", 60)


def text_channel(nodes: DataFrame, plan: Plan) -> DataFrame:
    """The whole task by BM25 over names."""
    found = X.bm25(nodes.filter(~F.col("kind").isin(*CONTAINERS)), "id", FIELDS, list(plan.terms) or [""]).select(F.col("doc").alias("id"), F.round("score", 9).alias("score"))
    return _channel(found, "text", 1.0, [F.desc("score"), "id"], "matches the task", 80)


def concept_channels(nodes: DataFrame, plan: Plan) -> DataFrame | None:
    """A list for each of at most 16 concepts, weighted by its best term.  All concepts read the postings once."""
    concepts = list(plan.concepts.items())[:16]
    if not concepts:
        return None
    p = X.postings_of(X.matches(nodes.filter(~F.col("kind").isin(*CONTAINERS)), "id", FIELDS, [t for _, terms in concepts for t in terms]))
    of = F.lit(None).cast("string")
    for name, terms in concepts:
        of = F.when(F.col("term").isin(*terms), name).otherwise(of)
    weight = F.lit(0.0)
    for name, terms in concepts:
        weight = F.when(F.col("concept") == name, max(plan.terms[t] for t in terms)).otherwise(weight)
    hits = p.withColumn("concept", of).filter("concept is not null").groupBy("concept", F.col("doc").alias("id")).agg(F.sum("tf").alias("tf"), F.first("dl").alias("dl"))
    best = ranked(hits, [F.desc("tf"), "dl", "id"], ["concept"], 30)
    return best.select(F.concat(F.lit("concept:"), "concept").alias("channel"), "id", "rank", (weight * 0.5).alias("weight"), F.concat(F.lit("about "), "concept").alias("reason"))


def path_channel(nodes: DataFrame, plan: Plan) -> DataFrame:
    """Declarations in files whose path shares terms with the task."""
    terms = F.array(*map(F.lit, list(plan.terms) or [""]))
    shared = F.size(F.array_intersect(T.identifier_components(F.col("file_path")), terms))
    return _channel(nodes.filter(~F.col("kind").isin(*CONTAINERS)).withColumn("shared", shared).filter("shared > 0"), "path", 0.4, [F.desc("shared"), "file_path", "id"], "path matches", 40)


def vector_channel(vectors: DataFrame, query: list[float], k: int = 40) -> DataFrame:
    """Nearest vectors (id, vector): half the weight of a text list, and a share of the similarity that fades with rank."""
    q = F.array(*(F.lit(float(x)) for x in query))
    near = vectors.select("id", F.round(T.cosine(F.col("vector"), q), 9).alias("score")).orderBy(F.desc("score"), "id").limit(k)
    return _channel(near, "vector", 0.5, [F.desc("score"), "id"], "similar meaning", k)


def evidence(nodes: DataFrame, plan: Plan, *more: DataFrame) -> DataFrame:
    """All channels as one table."""
    out = exact_channel(nodes, plan).unionByName(text_channel(nodes, plan)).unionByName(path_channel(nodes, plan))
    if (concepts := concept_channels(nodes, plan)) is not None:
        out = out.unionByName(concepts)
    for m in more:
        out = out.unionByName(m)
    return out


def node_scores(found: DataFrame) -> DataFrame:
    """id, score, exact, reasons."""
    return found.groupBy("id").agg(F.sum(F.col("weight") / (RRF + F.col("rank"))).alias("score"), F.bool_or(F.col("channel") == "exact").alias("exact"), F.array_sort(F.collect_set("reason")).alias("reasons"))


def file_scores(scored: DataFrame, nodes: DataFrame, plan: Plan) -> DataFrame:
    """file_path, score, exact: the best three declarations at 1, 0.45 and 0.2, times 0.55 in tests and the like unless asked for."""
    files = scored.join(nodes.select("id", "file_path"), "id")
    best = ranked(files, [F.desc("score"), "id"], ["file_path"], 3)
    share = F.when(F.col("rank") == 1, 1.0).when(F.col("rank") == 2, 0.45).otherwise(0.2)
    out = best.groupBy("file_path").agg(F.sum(share * F.col("score")).alias("score"), F.bool_or("exact").alias("exact"))
    fade = F.when(T.is_low_value_path(F.col("file_path")) & F.lit(not plan.tests), 0.55).otherwise(1.0)
    return out.withColumn("score", F.col("score") * fade)


def admit(scored: DataFrame, files: DataFrame, nodes: DataFrame, max_files: int = 6, max_nodes: int = 24, per_file: int = 4) -> DataFrame:
    """id, file_path, place, why: files with an exact hit first, then by score; in each its best declarations, in turns, so that
    no file takes all places."""
    top = files.orderBy(F.desc("exact"), F.desc("score"), "file_path").limit(max_files).select("file_path", F.col("score").alias("file_score"), F.col("exact").alias("file_exact"))
    rows = ranked(scored.join(nodes.select("id", "file_path"), "id").join(F.broadcast(top), "file_path"), [F.desc("exact"), F.desc("score"), "id"], ["file_path"], per_file)  # top: max_files rows
    rows = rows.withColumn("all", F.lit(1)).select("all", "id", "file_path", "rank", "file_score", "file_exact", F.array_join("reasons", "; ").alias("why"))

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["rank", "file_exact", "file_score", "file_path", "id"], ascending=[True, False, False, True, True]).head(max_nodes)
        return pd.DataFrame({"id": pdf["id"], "file_path": pdf["file_path"], "place": range(1, len(pdf) + 1), "why": pdf["why"]})

    return rows.groupBy("all").applyInPandas(choose, "id string, file_path string, place long, why string")


def strength(asked: DataFrame, files: DataFrame, path_terms: list[str]) -> DataFrame:
    """asked(task) with strength and covered: strong where a chosen file of files(task, exact, terms) is exact, or where they cover three
    of the task's path terms (all, if those are fewer); moderate where they cover any; weak with files alone; none without."""
    wanted = F.array(*map(F.lit, dict.fromkeys(path_terms))).cast("array<string>")
    held = files.select("task", "exact", F.array_intersect(F.coalesce("terms", F.array().cast("array<string>")), wanted).alias("terms"))
    terms = held.select("task", F.explode("terms").alias("term")).distinct().groupBy("task").agg(F.count(F.lit(1)).alias("covered"))
    found = held.groupBy("task").agg(F.coalesce(F.bool_or("exact"), F.lit(False)).alias("exact"))
    rows = asked.select("task").join(found, "task", "left").join(terms, "task", "left").withColumn("covered", F.coalesce("covered", F.lit(0).cast("long")))
    enough = F.col("covered") >= min(3, len(set(path_terms)))
    level = F.when(F.col("exact").isNull(), "none").when(F.col("exact") | enough, "strong").when(F.col("covered") > 0, "moderate").otherwise("weak")
    return rows.select("task", level.alias("strength"), "covered")


def scope(nodes: DataFrame, text: str, *more: DataFrame) -> DataFrame:
    """The declarations to read for a task."""
    plan = plan_query(text)
    scored = node_scores(evidence(nodes, plan, *more))
    return admit(scored, file_scores(scored, nodes, plan), nodes)


def source_windows(nodes: DataFrame, hits: DataFrame, whole: int = 200, most: int = 160, around: int = 12, gap: int = 10) -> DataFrame:
    """file_path, first, last of source lines to show: a declaration of at most `most` lines as a whole, a longer one by its
    first six lines and windows around its hits (id, line); windows near one another merge.  nodes: id, file_path,
    start_line, end_line."""
    from marlstone.operators.ranking import gaps_and_islands

    span = F.col("end_line") - F.col("start_line") + 1
    short = nodes.filter(span <= most).select("file_path", F.col("start_line").alias("first"), F.col("end_line").alias("last"))
    head = nodes.filter(span > most).select("file_path", F.col("start_line").alias("first"), (F.col("start_line") + 5).alias("last"))
    near = ranked(hits.join(nodes.filter(span > most), "id").filter("line between start_line and end_line"), ["line"], ["id"], 2)
    windows = near.select("file_path", F.greatest("start_line", F.col("line") - around).alias("first"), F.least("end_line", F.col("line") + around).alias("last"))
    return gaps_and_islands(short.unionByName(head).unionByName(windows), "file_path", gap)


def co_called(edges: DataFrame, hits: DataFrame) -> DataFrame:
    """source, target of calls between two of the hits(id)."""
    ids = hits.select("id").distinct()
    return edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi").select("source", "target").distinct()


def test_neighbours(nodes: DataFrame, edges: DataFrame, chosen: DataFrame, most: int = 3) -> DataFrame:
    """Tests that call the chosen(id) declarations."""
    calls = edges.join(chosen.select(F.col("id").alias("target")), "target", "left_semi").select(F.col("source").alias("id")).distinct()
    return nodes.join(calls, "id").filter(T.is_test_path(F.col("file_path"))).orderBy("file_path", "id").limit(most)


def bridges(edges: DataFrame, nodes: DataFrame, left: DataFrame, right: DataFrame, per_file: int = 2) -> DataFrame:
    """id, file_path of nodes that trusted edges tie to hits of both halves of a phrase, in other files; at most per_file each."""
    trusted = edges.filter("confidence >= 0.8")
    both = trusted.select(F.col("source").alias("id"), F.col("target").alias("near")).union(trusted.select("target", "source")).distinct()
    a = both.join(left.select(F.col("id").alias("near")), "near", "left_semi").select("id").distinct()
    b = both.join(right.select(F.col("id").alias("near")), "near", "left_semi").select("id").distinct()
    found = nodes.join(a.join(b, "id"), "id")
    return found.withColumn("nth", F.row_number().over(W.partitionBy("file_path").orderBy("id"))).filter(F.col("nth") <= per_file).select("id", "file_path")
