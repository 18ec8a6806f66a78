"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.operators import graph


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) for each node of an edge; edges: a long, b long.  Edges need no order; loops,
    repeats and nulls are dropped."""
    found = graph.components(edges.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    return found.select(F.col("id").alias("node"), "component")
