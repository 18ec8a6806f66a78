"""Ranking, budgets and pages.

Ranks are window functions over a key with a unique last sort column.  Budgets whose outcome depends on the order of
admission (skip what does not fit) are bounded, ordered lists by nature: they run as one grouped Arrow function over at
most a few hundred rows a group, after a ranked limit.  Caps on both sides of a pair go in rounds over all pairs.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marlstone.work import materialize

#: The constant of reciprocal-rank fusion.
RRF = 60


def first_claims(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """rows with `shadowed`: another row claimed the key earlier."""
    return rows.withColumn("shadowed", F.row_number().over(W.partitionBy(key).orderBy(*order)) > 1)


def ranked(rows: DataFrame, by: list, within: list[str], most: int | None = None) -> DataFrame:
    """rows with their 1-based rank (long) within a group, at most `most` of each; Spark prunes ranks before it shuffles."""
    out = rows.withColumn("rank", F.row_number().over(W.partitionBy(*within).orderBy(*by)).cast("long"))
    return out if most is None else out.filter(F.col("rank") <= most)


def fuse(channels: DataFrame) -> DataFrame:
    """Reciprocal-rank fusion of channels (channel, id, rank, weight): id, score, channels; best first."""
    return channels.groupBy("id").agg(F.sum(F.col("weight") / (RRF + F.col("rank"))).alias("score"), F.array_sort(F.collect_set("channel")).alias("channels")).orderBy(F.desc("score"), "id")


def near_ties(rows: DataFrame, group: str, score: str, margin: float) -> DataFrame:
    """rows within margin of their group's best, with the runner-up's distance."""
    w = W.partitionBy(group)
    by = w.orderBy(F.desc(score), "id")
    out = rows.withColumns({"best": F.max(score).over(w), "next": F.lead(score).over(by), "place": F.row_number().over(by)})
    gap = F.max(F.when(F.col("place") == 1, F.col(score) - F.col("next"))).over(w)
    return out.withColumn("runner_up_gap", gap).filter(F.col("best") - F.col(score) < margin).drop("best", "next", "place")


def within_budget(rows: DataFrame, cost: Column, budget: int, order: list, within: list[str]) -> DataFrame:
    """The longest prefix of each group, in order, whose running cost stays within the budget."""
    w = W.partitionBy(*within).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn("running_cost", F.sum(cost).over(w)).filter(F.col("running_cost") <= budget)


def skip_to_fit(rows: DataFrame, cost: str, budget: int, order: list[str], group: str, most: int = 200) -> DataFrame:
    """In order, rows that still fit the budget; one that does not is skipped and later ones may fit.  A group takes
    part with its first `most` rows, as the feature asks."""
    top = rows.withColumn("place", F.row_number().over(W.partitionBy(group).orderBy(*order))).filter(F.col("place") <= most)
    names = top.columns

    def admit(pdf: pd.DataFrame) -> pd.DataFrame:
        left, kept = budget, []
        for i, c in pdf.sort_values("place")[cost].items():
            if c <= left:
                left -= c
                kept.append(i)
        return pdf.loc[kept, names]

    return top.groupBy(group).applyInPandas(admit, top.schema)


def capped_pairs(pairs: DataFrame, score: str, per_item: int, group: str, most: int = 2_000) -> DataFrame:
    """Greedily, best score first, pairs (a, b) whose two items have fewer than per_item pairs so far, over all pairs of a
    group; its first `most` admitted ones are kept, as the feature bounds it.  The pairs of a group are distinct.

    In rounds: a pair is admitted where, for both items, fewer than what is left of per_item would be used up even if all
    better pairs of the item were admitted; pairs of used-up items go.  The best pair is always admitted, so rounds end."""
    key = [group, "a", "b"]
    best = [F.desc(score), "a", "b"]
    uses = F.when(F.col("a") == F.col("b"), 2).otherwise(1)  # a pair of an item with itself counts twice
    open_pairs, admitted, used = materialize(pairs, "pairs"), [], None
    while not open_pairs.isEmpty():
        items = open_pairs.select(*key, score, uses.alias("uses"), F.explode(F.array_distinct(F.array("a", "b"))).alias("item"))
        top = ranked(items, best, [group, "item"], per_item)
        w = W.partitionBy(group, "item").orderBy(*best).rowsBetween(W.unboundedPreceding, -1)
        top = top.withColumn("before", F.coalesce(F.sum("uses").over(w), F.lit(0)))
        if used is not None:
            top = top.join(used, [group, "item"], "left").withColumn("before", F.col("before") + F.coalesce("used", F.lit(0)))
        sides = F.when(F.col("a") == F.col("b"), 1).otherwise(2)
        chosen = top.filter(F.col("before") < per_item).groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == sides).select(*key)
        chosen = materialize(chosen, "chosen")
        admitted.append(chosen)
        now = chosen.select(group, uses.alias("used"), F.explode(F.array_distinct(F.array("a", "b"))).alias("item"))
        now = now if used is None else now.unionByName(used)
        used = materialize(now.groupBy(group, "item").agg(F.sum("used").alias("used")), "used")
        full = used.filter(F.col("used") >= per_item).select(group, "item")
        rest = open_pairs.join(chosen, key, "left_anti")
        for side in ("a", "b"):
            rest = rest.join(full.withColumnRenamed("item", side), [group, side], "left_anti")
        open_pairs = materialize(rest.select(*pairs.columns), "pairs")
    if not admitted:
        return open_pairs
    kept = pairs.join(reduce(DataFrame.unionByName, admitted), key, "left_semi")
    return ranked(kept, best, [group], most).select(*pairs.columns)


def clamp(value: int, low: int, high: int) -> int:
    return max(low, min(high, value))


def page(rows: DataFrame, order: list, offset: int, size: int) -> DataFrame:
    """A page of rows with total, truncated and next_offset on each row; OFFSET and LIMIT go to the plan."""
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    part = rows.orderBy(*order).offset(offset).limit(size).join(F.broadcast(total))  # one row
    more = F.col("total") > offset + size
    return part.withColumn("truncated", more).withColumn("next_offset", F.when(more, F.lit(offset + size).cast("long")))


def numbered(rows: DataFrame, order: list, name: str) -> DataFrame:
    """rows with their place in the order (from 0, long) as `name`: dealt by ranges of the order and numbered within each, so that no
    task holds all; the order must be total."""
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    held = materialize(dealt.withColumns({"_part": F.shiftright("_at", 33), "_nth": F.col("_at").bitwiseAND((1 << 33) - 1)}).drop("_at"), "numbered")
    counts = held.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))  # a row a partition
    before = counts.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_before"))
    return held.join(F.broadcast(before), "_part").withColumn(name, F.col("_nth") + F.col("_before")).drop("_part", "_nth", "_before")


def list_digest(rows: DataFrame, order: list, keys: list[str], filter_key: str = "", run: int = 4096) -> DataFrame:
    """One row with a digest of the filter and of the keys in their order: SHA-256 over runs of `run` places, then over runs of those
    digests until one is left, so that no task holds more than a run.  It does not depend on partitions; ties of the order are broken by
    the keys."""
    line = F.concat_ws("\x1f", *(F.coalesce(F.col(k).cast("string"), F.lit("\x00")) for k in keys))
    held = numbered(rows.select("*", line.alias("_line")), [*order, *keys], "_place").select(F.col("_place").alias("place"), F.sha2("_line", 256).alias("d"))
    count = held.count()
    while True:
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "d"))), lambda s: s["d"]), "")
        held = held.groupBy(F.floor(F.col("place") / run).alias("place")).agg(F.sha2(joined, 256).alias("d"))
        count = -(-count // run)
        if count <= 1:
            break
        held = materialize(held, "digests")
    return held.agg(F.sha2(F.concat_ws("\n", F.lit(filter_key), F.max("d")), 256).alias("digest"))


class StaleCursor(ValueError):
    """The list has changed since the cursor was given."""


def read_cursor(cursor: str | None, revision: str) -> int:
    """The offset of a cursor `c1_<offset>_<revision>`; refuses one of another revision."""
    if cursor is None:
        return 0
    version, offset, of = cursor.split("_", 2)
    if version != "c1" or not offset.isdigit():
        raise ValueError(f"not a cursor: {cursor}")
    if of != revision:
        raise StaleCursor(cursor)
    return int(offset)


def cursor_page(rows: DataFrame, order: list, keys: list[str], size: int, cursor: str | None = None, filter_key: str = "") -> tuple[DataFrame, str | None]:
    """(page, next cursor): the page is bound to the list's keys in their order and to the filter that made it (in words of the caller):
    a cursor of a re-sorted, re-filtered or changed list is refused, and so is one past its end."""
    order = [*order, *keys]
    revision = list_digest(rows, order, keys, filter_key).first()["digest"][:16]
    offset = read_cursor(cursor, revision)
    if offset and rows.orderBy(*order).offset(offset - 1).limit(1).isEmpty():
        raise StaleCursor(cursor)
    found = page(rows, order, offset, size)
    after = rows.orderBy(*order).offset(offset + size).limit(1).isEmpty()
    return found, None if after else f"c1_{offset + size}_{revision}"


def gaps_and_islands(ranges: DataFrame, group: str, gap: int) -> DataFrame:
    """Ranges (first, last) of a group merged where they overlap or lie at most gap apart; contained ones fold in."""
    w = W.partitionBy(group).orderBy("first", F.desc("last"))
    before = F.max("last").over(w.rowsBetween(W.unboundedPreceding, -1))
    marked = ranges.withColumn("new", (before.isNull() | (F.col("first") > before + gap)).cast("long"))
    islands = marked.withColumn("island", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return islands.groupBy(group, "island").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.count(F.lit(1)).alias("merged"))
