"""The context of a cluster of declarations: its nodes with callers and callees, and blocks of their source within a budget of tokens.

Primary nodes are exported ones and those at the top that are no variables; the others support them.  A cluster gives its first NODES
nodes, primary ones first, then by file and line.  A primary node's block has PAD lines around it and PRIMARY_LINES at most, a supporting
one's its own lines, SUPPORTING_LINES at most.  Blocks that do not fit what the nodes leave of the budget are left out, supporting ones
first, and counted."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

NODES, NEAR, TOKENS, PAD, PRIMARY_LINES, SUPPORTING_LINES, BLOCK_TOKENS = 60, 5, 4000, 3, 400, 120, 20
CALLERS = ("function", "method")


def context_nodes(members: DataFrame, nodes: DataFrame, edges: DataFrame, most: int = NODES, near: int = NEAR) -> DataFrame:
    """cluster, place, id, kind, name, file_path, start_line, end_line, primary, callers, callees, total for members (cluster, id);
    nodes: id, kind, qualified_name, container_id, file_path, start_line, end_line, is_exported.  Callers and callees are the names of a
    primary function's first `near` by id."""
    loose = F.col("container_id").isNull() & ~F.col("kind").isin("variable", "field", "property")
    primary = F.coalesce(F.col("is_exported"), F.lit(False)) | loose
    rows = members.select("cluster", "id").distinct().join(nodes.withColumn("primary", primary), "id")
    w = W.partitionBy("cluster")
    place = F.row_number().over(w.orderBy(F.desc("primary"), "file_path", "start_line", "id"))
    total = members.select("cluster", "id").distinct().join(nodes.select("id"), "id").groupBy("cluster").agg(F.count(F.lit(1)).alias("total"))
    kept = rows.withColumn("place", place).filter(F.col("place") <= most)
    asked = kept.filter(F.col("primary") & F.col("kind").isin(*CALLERS)).select("id").distinct()
    calls = edges.filter("kind = 'calls' and source <> target").select("source", "target").distinct()
    names = nodes.select(F.col("id").alias("other"), "qualified_name")

    def ends(own: str, other: str, name: str) -> DataFrame:
        found = calls.select(F.col(own).alias("id"), F.col(other).alias("other")).join(asked, "id", "left_semi")
        found = found.withColumn("nth", F.row_number().over(W.partitionBy("id").orderBy("other"))).filter(F.col("nth") <= near)
        found = found.join(names, "other", "left").withColumn("name", F.coalesce("qualified_name", "other"))
        return found.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "name"))), lambda x: x["name"]).alias(name))

    out = kept.join(ends("target", "source", "callers"), "id", "left").join(ends("source", "target", "callees"), "id", "left").join(total, "cluster")
    none = F.array().cast("array<string>")
    return out.select("cluster", "place", "id", "kind", F.col("qualified_name").alias("name"), "file_path", "start_line", "end_line", "primary", *(F.coalesce(c, none).alias(c) for c in ("callers", "callees")), "total")


def context_blocks(context: DataFrame, files: DataFrame) -> DataFrame:
    """cluster, place, id, primary, file_path, first, last, content: the source of the context's nodes from files (path, content)."""
    lines = files.select(F.col("path").alias("file_path"), F.split(F.regexp_replace("content", "\n$", ""), "\n").alias("lines"))
    rows = context.filter("start_line >= 1").join(lines, "file_path")
    pad, cap = F.when(F.col("primary"), PAD).otherwise(0), F.when(F.col("primary"), PRIMARY_LINES).otherwise(SUPPORTING_LINES)
    first = F.greatest(F.col("start_line") - pad, F.lit(1)).cast("long")
    rows = rows.withColumn("first", first)
    last = F.least(F.greatest("end_line", "start_line") + pad, F.size("lines"), F.col("first") + cap - 1).cast("long")
    rows = rows.withColumn("last", last).filter("first <= last")
    content = F.array_join(F.slice("lines", F.col("first").cast("int"), (F.col("last") - F.col("first") + 1).cast("int")), "\n")
    return rows.select("cluster", "place", "id", "primary", "file_path", "first", "last", content.alias("content")).filter(F.trim(F.regexp_replace("content", r"\s+", " ")) != "")


def fit_context(context: DataFrame, blocks: DataFrame, budget: int = TOKENS) -> DataFrame:
    """The blocks that fit, with cost, and dropped and truncated of their cluster: primary blocks in their order, then supporting ones;
    one that does not fit is left out and later ones may fit.  A cluster has NODES blocks at most."""
    said = F.to_json(F.struct("id", "kind", "name", "file_path", "primary", "callers", "callees"))
    fixed = context.groupBy("cluster").agg(F.sum(F.ceil(F.octet_length(said) / 4)).alias("fixed"), F.max("total").alias("total"), F.count(F.lit(1)).alias("held"))
    rows = blocks.withColumn("cost", (F.ceil(F.octet_length("content") / 4) + BLOCK_TOKENS).cast("long")).join(fixed, "cluster")
    schema = "cluster string, place int, id string, primary boolean, file_path string, first long, last long, content string, cost long, dropped long, truncated boolean"

    def admit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["primary", "place"], ascending=[False, True])
        left, kept = budget - int(pdf["fixed"].iloc[0]), []
        for i, cost in pdf["cost"].items():
            if cost <= left:
                left -= cost
                kept.append(i)
        dropped = len(pdf) - len(kept)
        out = pdf.loc[kept].copy()
        out["dropped"], out["truncated"] = dropped, dropped > 0 or bool((pdf["total"] > pdf["held"]).iloc[0])
        return out[["cluster", "place", "id", "primary", "file_path", "first", "last", "content", "cost", "dropped", "truncated"]]

    return rows.groupBy("cluster").applyInPandas(admit, schema)
