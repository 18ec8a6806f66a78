"""Embedders by name: each has a name, a dimension and a way to embed weighted text fields; vectors of different embedders never meet.

An embedder is registered once; stored vectors carry its name and dimension beside them (columns embedder, dim, vector), so that one table
may hold several spaces.  A search asks for one embedder: it reads that one's rows and is refused where the table holds the name with
another dimension, or not at all.  A sync embeds what is new or changed, and everything where the embedder itself has changed."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.operators import vectors as V


@dataclass(frozen=True)
class Embedder:
    """embed(rows, key, fields): key and vector (of length one, or the first unit vector where there is nothing to embed) of each row;
    least: scores below it are no answer."""

    name: str
    dim: int
    embed: Callable[[DataFrame, str, dict[str, float]], DataFrame]
    least: float = 0.20


class Embedders(dict[str, Embedder]):
    def register(self, embedder: Embedder) -> Embedder:
        known = self.setdefault(embedder.name, embedder)
        if known.dim != embedder.dim:
            raise ValueError(f"{embedder.name} is registered with dimension {known.dim}")
        return known

    def __missing__(self, name: str) -> Embedder:
        raise ValueError(f"no embedder {name}; known are {', '.join(sorted(self))}")


REGISTERED = Embedders()
REGISTERED.register(Embedder("hashed-v1", V.DIM, V.embed))


def by_column(name: str, dim: int, vector: Callable[[Column], Column], least: float = 0.20) -> Embedder:
    """An embedder whose vector of one text is a Column expression: the fields' vectors are weighted, added and brought to length one."""

    def embed(rows: DataFrame, key: str, fields: dict[str, float]) -> DataFrame:
        unit = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: (i == 0).cast("double"))
        zero = F.array_repeat(F.lit(0.0), dim)
        total = zero
        for field, weight in fields.items():
            text = F.coalesce(F.col(field), F.lit(""))
            own = F.when(F.trim(text) != "", F.transform(vector(text), _times(weight)))
            total = F.zip_with(total, F.coalesce(own, zero), lambda a, b: a + b)
        norm = F.sqrt(F.aggregate("sum", F.lit(0.0), lambda s, x: s + x * x))
        held = rows.select(key, total.alias("sum")).withColumn("norm", norm)
        return held.select(key, F.when(F.col("norm") > 1e-9, F.transform("sum", lambda x: x / F.col("norm"))).otherwise(unit).alias("vector"))

    return Embedder(name, dim, embed, least)


def _times(weight: float):
    return lambda x: x.cast("double") * weight


def stored(rows: DataFrame, key: str, fields: dict[str, float], name: str) -> DataFrame:
    """key, embedder, dim, vector of rows under a registered embedder."""
    e = REGISTERED[name]
    found = e.embed(rows, key, fields)
    return found.select(key, F.lit(e.name).alias("embedder"), F.lit(e.dim).alias("dim"), F.transform("vector", lambda x: x.cast("double")).alias("vector"))


def space(table: DataFrame, name: str) -> DataFrame:
    """The rows of one embedder's space; refused where the table holds none, or holds them in another dimension."""
    e = REGISTERED[name]
    kinds = {(r["embedder"], r["dim"]) for r in table.select("embedder", "dim").distinct().collect()}  # a row an embedder
    found = [k for k in kinds if k[0] == name]
    if kinds and found != [(name, e.dim)]:
        V.require_same_space(sorted(found or kinds)[0], (name, e.dim))
    return table.filter(F.col("embedder") == name)


def nearest(table: DataFrame, asked: DataFrame, name: str, k: int, key: str) -> DataFrame:
    """query_id, key, similarity, rank: the k nearest of each row of asked in one space, those below the embedder's least left out."""
    own, other = space(table, name), space(asked, name)
    return V.exact_knn(own, other, k, key, "vector").filter(F.col("similarity") >= REGISTERED[name].least)


def sync(old: DataFrame, rows: DataFrame, key: str, fields: dict[str, float], name: str) -> DataFrame:
    """key, embedder, dim, vector, content for rows: those whose fields are as they were under the same embedder keep their vector."""
    e = REGISTERED[name]
    content = F.sha2(F.to_json(F.struct(*fields)), 256)
    now = rows.withColumn("content", content)
    kept = old.filter((F.col("embedder") == e.name) & (F.col("dim") == e.dim)).join(now.select(key, "content"), [key, "content"], "left_semi").select(key, "embedder", "dim", "vector", "content")
    fresh = now.join(kept.select(key), key, "left_anti")
    return kept.unionByName(stored(fresh, key, fields, name).join(fresh.select(key, "content"), key))
