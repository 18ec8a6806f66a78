"""What follows ranked evidence: regions of source, seeds, admission of files and declarations, promotion by flows, budgets.

Each choice is a rank within tiers, so it is a window function over bounded lists; only budgets that skip what does not fit
run in order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marlstone.operators.source_ranges import admit_ranges
from marlstone.operators.ranking import RRF, skip_to_fit

# Weights of a region's evidence for a declaration, and the most it can reach.
CONCEPT_SHARE, NAME_SHARE, STARTS_INSIDE, ENCLOSES, RANK_SHARE, RANK_MOST, PLACE_SHARE, MOST = 0.18, 0.32, 0.08, 0.04, 2.0, 0.1, 20.0, 1.2
# Seeds after preferred ones, after one a file, and in all.
SEEDS_PREFERRED, SEEDS_FILES, SEEDS = 12, 18, 24
# Token budgets of an answer by files of the corpus, and the share that sources may take.
BUDGETS, SOURCE_SHARE = ((200, 3500), (2000, 4500), (None, 6000)), 0.75


def _place(order: list, *within: str):
    return F.row_number().over(W.partitionBy(*(within or (F.lit(1),))).orderBy(*order))


def _top(rows: DataFrame, order: list, most: int) -> DataFrame:
    """The first `most` rows of the order with their place: each task gives its first ones, so that one task numbers `most` rows alone."""
    return rows.orderBy(*order).limit(most).withColumn("place", _place(order))


def region_alignment(hits: DataFrame, overlaps: DataFrame) -> DataFrame:
    """id, score, hit: each declaration's best alignment with a source hit.  hits: hit (its place from 0), file_path, first, last, rank
    (negative is better), n_concepts (of the query, in the hit).  overlaps: hit, id, place (from 0, of the declaration in the hit),
    start_line, end_line, n_name (concepts its name shares)."""
    x = overlaps.join(hits, "hit")
    inside = F.col("start_line").between(F.col("first"), F.col("last"))
    around = (F.col("start_line") <= F.col("first")) & (F.col("end_line") >= F.col("last"))
    score = (
        F.greatest(F.col("n_concepts") - 1, F.lit(0)) * CONCEPT_SHARE + F.col("n_name") * NAME_SHARE + F.when(inside, STARTS_INSIDE).when(around, ENCLOSES).otherwise(0.0)
        + F.least(F.abs("rank") * RANK_SHARE, F.lit(RANK_MOST)) + PLACE_SHARE / (RRF + F.col("hit") + F.col("place") + 1)
    )
    best = x.withColumn("score", F.least(F.lit(MOST), score)).groupBy("id").agg(F.max(F.struct("score", (-F.col("hit")).alias("order"))).alias("top"))
    return best.select("id", F.col("top.score").alias("score"), (-F.col("top.order")).alias("hit"))


def choose_seeds(preferred: DataFrame, pool: DataFrame) -> DataFrame:
    """id, place: preferred(id, file_path, tier, rank) by tier and rank, then the best of pool(id, file_path, rank) in each file not yet
    seen, then the best of what is left, up to the three caps."""
    first = preferred.groupBy("id").agg(F.min(F.struct("tier", "rank")).alias("at"), F.min("file_path").alias("file_path"))
    first = _top(first, ["at.tier", "at.rank", "id"], SEEDS_PREFERRED)
    n_first = first.agg(F.count(F.lit(1)).alias("n"))  # one row
    rest = pool.join(first.select("id"), "id", "left_anti")
    new = rest.join(first.select("file_path").distinct(), "file_path", "left_anti").withColumn("nth", _place(["rank", "id"], "file_path")).filter("nth = 1")
    new = _top(new, ["rank", "id"], SEEDS_FILES).join(F.broadcast(n_first)).filter(F.col("place") + F.col("n") <= SEEDS_FILES)
    two = first.select("id", F.lit(0).alias("step"), "place").unionByName(new.select("id", F.lit(1).alias("step"), "place"))
    n_two = two.agg(F.count(F.lit(1)).alias("n"))  # one row
    last = _top(rest.join(new.select("id"), "id", "left_anti"), ["rank", "id"], SEEDS).join(F.broadcast(n_two)).filter(F.col("place") + F.col("n") <= SEEDS)
    every = two.unionByName(last.select("id", F.lit(2).alias("step"), "place"))
    return every.select("id", _place(["step", "place"]).cast("long").alias("place"))


def admit_files(files: DataFrame, most: int = 6, floor: int = 3) -> DataFrame:
    """file_path, tier, place of files(file_path, pinned, bridge, strong, source_rank, score): pinned files, those of a bridge, strong
    ones, up to `floor` of the best source hits, then by score."""
    hit = files.filter("source_rank is not null").orderBy("source_rank", "file_path").limit(floor).select("file_path", F.lit(True).alias("hit"))
    tier = F.when(F.col("pinned"), 0).when(F.col("bridge"), 1).when(F.col("strong"), 2).when(F.col("hit"), 3).otherwise(4)
    rows = files.join(F.broadcast(hit), "file_path", "left").withColumn("tier", tier)  # hit: floor rows
    order = ["tier", F.when(F.col("tier") == 3, F.col("source_rank")).asc_nulls_last(), F.desc("score"), "file_path"]
    return _top(rows, order, most).select("file_path", "tier", F.col("place").cast("long").alias("place"))


def admit_declarations(found: DataFrame, facets: DataFrame, most: int = 24, per_file: int = 4) -> DataFrame:
    """id, place, reserved of found(id, file_path, score): the best declaration of each facet (facets: facet, id, weight), by the facet's
    weight, and of each file are reserved; the others follow by score, at most per_file of a file."""
    best = facets.join(found, "id").withColumn("nth", _place([F.desc("score"), "id"], "facet")).filter("nth = 1").groupBy("id").agg(F.max("weight").alias("facet_weight"))
    rows = found.join(best, "id", "left").withColumn("in_file", _place([F.desc("score"), "id"], "file_path"))
    tier = F.when(F.col("facet_weight").isNotNull(), 0).when(F.col("in_file") == 1, 1).otherwise(2)
    rows = rows.withColumn("tier", tier).filter((F.col("tier") == 0) | (F.col("in_file") <= per_file))
    order = ["tier", F.col("facet_weight").desc_nulls_last(), F.desc("score"), "id"]
    return _top(rows, order, most).select("id", F.col("place").cast("long").alias("place"), (F.col("tier") < 2).alias("reserved"))


def promote(admitted: DataFrame, spine: DataFrame) -> DataFrame:
    """file_path, promoted: admitted(file_path, score, protected) after the files of a flow's spine(file_path, step) that lack have
    each taken the place of the weakest file that nothing protects; files of the spine are protected."""
    on = spine.groupBy("file_path").agg(F.min("step").alias("step"))
    kept = admitted.join(on.select("file_path", F.lit(True).alias("on_spine")), "file_path", "left")
    lacking = on.join(admitted.select("file_path"), "file_path", "left_anti")
    n = lacking.count()  # a flow's files
    lacking = _top(lacking, ["step", "file_path"], n)
    weak = _top(kept.filter(~F.col("protected") & F.col("on_spine").isNull()), ["score", F.desc("file_path")], n)
    swaps = lacking.join(weak.select("place", F.col("file_path").alias("out")), "place")
    stay = admitted.join(swaps.select(F.col("out").alias("file_path")), "file_path", "left_anti")
    return stay.select("file_path", F.lit(False).alias("promoted")).unionByName(swaps.select("file_path", F.lit(True).alias("promoted")))


def default_budget(files: int) -> int:
    """Tokens for an answer over a corpus of this many files."""
    return next(tokens for most, tokens in BUDGETS if most is None or files <= most)


def ledger(records: DataFrame, budget: int, order: list[str]) -> DataFrame:
    """records within the budget as one JSON line each, with place, cost (a quarter of its characters) and what is spent so far; the
    first that does not fit ends the answer."""
    line = F.to_json(F.struct(*records.columns))
    rows = records.withColumn("line", line).withColumn("cost", F.ceil(F.length("line") / 4).cast("long"))
    w = W.partitionBy(F.lit(1)).orderBy(*order)
    rows = rows.orderBy(*order).limit(budget).withColumn("spent", F.sum("cost").over(w.rowsBetween(W.unboundedPreceding, 0)))  # a record costs a token at least
    return rows.withColumn("place", F.row_number().over(w).cast("long")).filter(F.col("spent") <= budget).select("place", "line", "cost", "spent")


def admit_sources(sources: DataFrame, budget: int) -> DataFrame:
    """The pieces of sources (task, id, file_path, first, costs of its lines, atomic, centred, exact, flow_target, answer, score) that
    each task shows within the source share of its budget: exact ones, the first target of a flow, the best answer by meaning, then files
    in turns.  A line is shown once, and only what is shown hides anything."""
    tier = F.when(F.col("exact"), 0).when(F.col("flow_target"), 1).when(F.col("answer"), 2).otherwise(3)
    rows = sources.withColumn("tier", tier).withColumn("turn", _place(["tier", F.desc("score"), "id"], "task", "file_path"))
    order = ["tier", F.when(F.col("tier") == 3, F.col("turn")).asc_nulls_first(), F.desc("score"), "id"]
    return admit_ranges(rows, int(budget * SOURCE_SHARE), order)


def cluster_context(members: DataFrame, edges: DataFrame, most: int = 12) -> DataFrame:
    """cluster, id, role (member, neighbour), n: each cluster's members (cluster, id) with most edges inside it, and the nodes outside
    that most of its edges reach; at most `most` of either."""
    both = edges.select(F.col("source").alias("id"), F.col("target").alias("near")).union(edges.select("target", "source")).filter("id <> near").distinct()
    near = members.join(both, "id").select("cluster", "id", "near").join(members.select(F.col("cluster").alias("near_cluster"), F.col("id").alias("near")), "near", "left")
    inside = F.col("near_cluster").eqNullSafe(F.col("cluster"))
    held = members.join(near.filter(inside).groupBy("cluster", "id").agg(F.count(F.lit(1)).alias("n")), ["cluster", "id"], "left").select("cluster", "id", F.lit("member").alias("role"), F.coalesce("n", F.lit(0)).alias("n"))
    beyond = near.filter(~inside).groupBy("cluster", F.col("near").alias("id")).agg(F.count(F.lit(1)).alias("n")).select("cluster", "id", F.lit("neighbour").alias("role"), "n")
    return held.unionByName(beyond).withColumn("place", _place([F.desc("n"), "id"], "cluster", "role").cast("long")).filter(F.col("place") <= most)


def allowed_relations(pairs: DataFrame, types: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """a, b, type, shared of pairs(a, b, shared) whose entity types a rule (type of a, relation, type of b) allows, in either direction."""
    allowed = pairs.sparkSession.createDataFrame(rules, "type_a string, type string, type_b string")  # a short list
    both = pairs.select("a", "b", "shared").union(pairs.select("b", "a", "shared"))
    t = types.select("id", "kind")
    typed = both.join(t.select(F.col("id").alias("a"), F.col("kind").alias("type_a")), "a").join(t.select(F.col("id").alias("b"), F.col("kind").alias("type_b")), "b")
    return typed.join(F.broadcast(allowed), ["type_a", "type_b"]).select("a", "b", "type", "shared").distinct()


def entity_panel(entity: DataFrame, parts: dict[str, DataFrame]) -> DataFrame:
    """entity_id, part, n, worst of several tables about entities (entity_id, rank): rows without any keep a count of 0."""
    out = [
        entity.select("entity_id").join(rows.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n"), F.max("rank").alias("worst")), "entity_id", "left").select("entity_id", F.lit(name).alias("part"), F.coalesce("n", F.lit(0)).alias("n"), "worst")
        for name, rows in parts.items()
    ]
    return reduce(DataFrame.unionByName, out)
