"""Source lines of an answer, each shown at most once.

A LineSet holds the lines of a file that are shown as sorted, disjoint intervals.  Admission goes through the ranges of a task in their
order, with one such set a file: a range loses the lines that are shown already and costs the rest alone; what does not fit is shown up
to the last line that does (or around its middle, for windows about a hit), unless it is to be shown as a whole or not at all.  Only
lines that are shown hide others.  Tasks are dealt to partitions and sorted, so that a task's ranges stream past sets that hold no more
lines than its budget has tokens."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


class LineSet:
    """Lines as disjoint intervals in order, adjacent ones joined."""

    def __init__(self, intervals: Iterable[tuple[int, int]] = ()):
        self.firsts: list[int] = []
        self.lasts: list[int] = []
        for first, last in intervals:
            self.add(first, last)

    def __iter__(self) -> Iterator[tuple[int, int]]:
        return zip(self.firsts, self.lasts)

    def add(self, first: int, last: int) -> None:
        if last < first:
            return
        i, j = bisect_left(self.lasts, first - 1), bisect_right(self.firsts, last + 1)
        if i < j:
            first, last = min(first, self.firsts[i]), max(last, self.lasts[j - 1])
        self.firsts[i:j], self.lasts[i:j] = [first], [last]

    def missing(self, first: int, last: int) -> list[tuple[int, int]]:
        """The parts of first..last that are not in the set."""
        out, at = [], first
        i = bisect_left(self.lasts, first)
        while at <= last and i < len(self.firsts) and self.firsts[i] <= last:
            if at < self.firsts[i]:
                out.append((at, self.firsts[i] - 1))
            at, i = max(at, self.lasts[i] + 1), i + 1
        if at <= last:
            out.append((at, last))
        return out

    def covers(self, first: int, last: int) -> bool:
        i = bisect_left(self.lasts, first)
        return last < first or (i < len(self.firsts) and self.firsts[i] <= first and last <= self.lasts[i])


def merge_in_phase(ranges: DataFrame) -> DataFrame:
    """ranges (task, file_path, phase, id, first, last, place, atomic) with those of a file and phase that overlap merged into one: it
    takes the id and place of its first member by place and is atomic if all are."""
    w = W.partitionBy("task", "file_path", "phase").orderBy("first", F.desc("last"), "place")
    before = F.max("last").over(w.rowsBetween(W.unboundedPreceding, -1))
    marked = ranges.withColumn("_new", (before.isNull() | (F.col("first") > before)).cast("long"))
    islands = marked.withColumn("_island", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    top = F.min(F.struct("place", "id")).alias("top")
    found = islands.groupBy("task", "file_path", "phase", "_island").agg(top, F.min("first").alias("first"), F.max("last").alias("last"), F.bool_and("atomic").alias("atomic"))
    return found.select("task", "file_path", "phase", "top.id", "first", "last", "top.place", "atomic")


def longest_fit(costs: list[int], room: int, centred: bool) -> tuple[int, int]:
    """(offset, number) of the most lines that cost no more than room: from the first line on, or around the middle."""
    sums = [0]
    for c in costs:
        sums.append(sums[-1] + c)
    low, high = 0, len(costs)
    while low < high:  # costs are not negative: fewer lines around the same middle cost no more
        n = (low + high + 1) // 2
        offset = (len(costs) - n) // 2 if centred else 0
        low, high = (n, high) if sums[offset + n] - sums[offset] <= room else (low, n - 1)
    return ((len(costs) - low) // 2 if centred else 0), low


class Admission:
    """What one task has shown and what it may still cost."""

    def __init__(self, budget: int):
        self.room, self.shown = budget, {}

    def take(self, file: str, first: int, costs: list[int], atomic: bool, centred: bool) -> Iterator[tuple[int, int, int]]:
        """(first, last, cost) of the pieces of a range that are shown now."""
        lines = self.shown.setdefault(file, LineSet())
        missing = lines.missing(first, first + len(costs) - 1)
        cost_of = lambda s, e: sum(costs[s - first : e - first + 1])
        if atomic and sum(cost_of(s, e) for s, e in missing) > self.room:
            return
        for s, e in missing:
            whole = cost_of(s, e)
            if whole > self.room:
                offset, n = longest_fit(costs[s - first : e - first + 1], self.room, centred)
                s, e = s + offset, s + offset + n - 1
            if s <= e:
                cost = cost_of(s, e)
                self.room -= cost
                lines.add(s, e)
                yield s, e, cost
            if whole > self.room + cost_of(s, e):
                return


SHOWN = "task string, id string, file_path string, first long, last long, cost long, spent long"


def admit_ranges(ranges: DataFrame, budget: int, order: list[Column | str]) -> DataFrame:
    """SHOWN: the pieces of ranges (task, id, file_path, first, costs (tokens of each line), atomic, centred) that each task shows within
    its budget, in the order given, which must be total; spent is what the task has spent then."""
    columns = ["task", "id", "file_path", "first", "costs", "atomic", "centred"]
    dealt = ranges.repartition("task").sortWithinPartitions("task", *order).select(*columns)
    schema = pa.schema([*((c, pa.string()) for c in ("task", "id", "file_path")), *((c, pa.int64()) for c in ("first", "last", "cost", "spent"))])

    def run(batches):
        task, held = None, None
        for batch in batches:
            out: list[tuple] = []
            for r in batch.to_pylist():
                if held is None or r["task"] != task:
                    task, held = r["task"], Admission(budget)
                if held.room > 0:
                    for s, e, cost in held.take(r["file_path"], r["first"], r["costs"], r["atomic"], r["centred"]):
                        out.append((task, r["id"], r["file_path"], s, e, cost, budget - held.room))
            columns = zip(*out) if out else [[]] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return dealt.mapInArrow(run, SHOWN)
