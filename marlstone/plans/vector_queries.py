"""Vector search and hashed embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.operators import vectors as E
from marlstone.plans.registry import query
from marlstone.plans.views import Views
from marlstone.work import materialize

ASKED = "(SELECT embedding FROM embeddings WHERE vec_id = 7)::double[]"


def _asked(v: Views, vec_id: int = 7) -> list[float]:
    return list(v.embeddings.filter(F.col("vec_id") == vec_id).first()["embedding"])


@query("vec_1_exact_knn", f"SELECT vec_id, round(list_cosine_similarity(embedding::double[], {ASKED}), 6) AS similarity FROM embeddings ORDER BY list_cosine_similarity(embedding::double[], {ASKED}) DESC, vec_id LIMIT 20")
def _(v: Views):
    return E.knn(v.embeddings, _asked(v), 20).select("vec_id", F.round("similarity", 6).alias("similarity"))


@query("vec_3_search_policy", f"""SELECT vec_id, score, below_floor FROM (SELECT *, cast(count(*) FILTER (score < 0.2) OVER () AS bigint) AS below_floor FROM (SELECT vec_id, round(greatest(0, list_cosine_similarity(embedding::double[], {ASKED})), 6) AS score FROM embeddings WHERE label <> 3
    ORDER BY greatest(0, list_cosine_similarity(embedding::double[], {ASKED})) DESC, vec_id LIMIT 100)) WHERE score >= 0.2""")
def _(v: Views):
    rows = v.embeddings.withColumn("kind", F.when(F.col("label") == 3, "module").otherwise("function"))
    return E.search(rows, _asked(v), 100).select("vec_id", F.round("score", 6).alias("score"), "below_floor")


TOKENS = """w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9à-ÿ]+'), lambda x: x <> '') AS ws FROM documents),
    tok AS (SELECT doc_id, unnest(ws) AS t, 1.5 AS wt FROM w UNION ALL SELECT doc_id, substr(t, i, 3), 0.5 FROM (SELECT doc_id, t, unnest(range(1, length(t) - 1)) AS i FROM (SELECT doc_id, unnest(ws) AS t FROM w) WHERE length(t) >= 3)
    UNION ALL SELECT doc_id, ws[i] || '|' || ws[i + 1], 1.2 FROM (SELECT doc_id, ws, unnest(range(1, len(ws))) AS i FROM w WHERE len(ws) >= 2)),
    digest AS (SELECT doc_id, sha256(t) AS h, wt FROM tok)"""


@query("vec_4_hashed_buckets", f"""WITH {TOKENS} SELECT doc_id, ('0x' || substr(h, 1, 2))::int & 127 AS bucket, round(sum(CASE WHEN ('0x' || substr(h, 9, 2))::int & 1 = 0 THEN wt ELSE -wt END), 4) + 0.0 AS value FROM digest GROUP BY ALL""")
def _(v: Views):
    return E.buckets(v.documents, "doc_id", {"text": 1.0}).select("doc_id", "bucket", (F.round("value", 4) + 0.0).alias("value"))


@query("vec_4_embedding_length", "SELECT doc_id, 1.0::double AS length FROM documents")
def _(v: Views):
    vectors = E.embed(v.documents, "doc_id", {"text": 1.0})
    return vectors.select("doc_id", F.round(F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))), 4).alias("length"))


@query("vec_5_static", """SELECT p_partkey, round(x / sqrt(sum(x * x) OVER (PARTITION BY p_partkey)), 6) AS first FROM (SELECT p_partkey, dim, sum(x) AS x FROM (SELECT p_partkey, unnest(string_split(lower(p_name), ' ')) AS token FROM part) JOIN (SELECT 'w' || 0 AS none, * FROM (SELECT token, unnest(embedding)::double AS x, unnest(range(1, 65)) AS dim FROM (SELECT row_number() OVER (ORDER BY token) - 1 AS vec_id, token FROM (SELECT DISTINCT unnest(string_split(lower(p_name), ' ')) AS token FROM part) WHERE token <> 'widget') JOIN embeddings USING (vec_id))) USING (token) GROUP BY ALL) QUALIFY dim = 1""")
def _(v: Views):
    from pyspark.sql import Window as W

    tokens = v.part.select(F.explode(F.split(F.lower("p_name"), " ")).alias("token")).distinct().filter("token <> 'widget'")
    matrix = tokens.withColumn("vec_id", F.row_number().over(W.orderBy("token")) - 1).join(v.embeddings, "vec_id").select("token", F.col("embedding").alias("vector"))
    out = E.static_embed(v.part, "p_partkey", "p_name", matrix)
    return out.filter("vector is not null").select("p_partkey", F.round(F.col("vector")[0].cast("double"), 6).alias("first"))


@query("vec_8_entity_sync", """SELECT id, 'put' AS action FROM entities GROUP BY id UNION ALL SELECT 'gone' || p_partkey, 'remove' FROM part WHERE p_partkey <= 5""", ("entities",))
def _(v: Views):
    stored = v.entities.select("id").union(v.part.filter("p_partkey <= 5").select(F.concat(F.lit("gone"), "p_partkey")))
    put, remove = E.sync_entities(stored, v.entities, {"title": 3.0, "summary": 2.0, "body": 1.0})
    return put.filter(F.size("vector") == E.DIM).select("id", F.lit("put").alias("action")).unionByName(remove.select("id", F.lit("remove").alias("action")))


@query("vec_6_combined", """SELECT vec_id, round(x / sqrt(list_sum(list_transform(c, lambda y: y * y))), 6) AS first FROM (SELECT vec_id, c, c[1] AS x FROM (SELECT vec_id, [3 * a.embedding[i]::double + b.embedding[i]::double FOR i IN range(1, 65)] AS c FROM embeddings a JOIN (SELECT vec_id - 1 AS vec_id, embedding FROM embeddings) b USING (vec_id)))""")
def _(v: Views):
    b = v.embeddings.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    both = v.embeddings.join(b, "vec_id")
    return both.select("vec_id", F.round(F.element_at(E.combine([(F.col("embedding"), 3.0), (F.col("other"), 1.0)]), 1), 6).alias("first"))


@query("vec_7_incremental_sync")
def _(v: Views):
    old = v.part.filter("p_partkey % 17 <> 3")
    stored = old.join(E.embed(old, "p_partkey", {"p_name": 3.0, "p_type": 1.0}).hint("merge"), "p_partkey")
    now = v.part.filter("p_partkey % 17 <> 9").withColumn("p_name", F.when(F.col("p_partkey") % 17 == 5, F.concat("p_name", F.lit(" new"))).otherwise(F.col("p_name")))
    synced = E.sync(stored, now, "p_partkey", {"p_name": 3.0, "p_type": 1.0}, ["p_name", "p_type"])
    fresh = E.embed(now, "p_partkey", {"p_name": 3.0, "p_type": 1.0}).withColumnRenamed("vector", "rebuilt")
    return synced.join(fresh.hint("merge"), "p_partkey").select("p_partkey", (F.size("vector") == E.DIM).alias("whole"), F.forall(F.zip_with("vector", "rebuilt", lambda a, b: F.abs(a - b) < 1e-5), lambda x: x).alias("as_rebuilt"))


@query("vec_10_recall")
def _(v: Views):
    """Recall, and the share of the table that a query looks at."""
    asked = v.embeddings.filter("vec_id % 50 = 0")
    top, read = E.approximate_knn_read(v.embeddings, asked, 10, 64)
    looked = read.agg(F.coalesce(F.sum("looked"), F.lit(0)).alias("looked"))
    sizes = asked.agg(F.count(F.lit(1)).alias("asked")).join(v.embeddings.agg(F.count(F.lit(1)).alias("held")))
    share = looked.join(sizes).select(F.round(F.col("looked") / (F.col("asked") * F.col("held")), 6).alias("share"))  # single rows
    return E.recall(top, E.exact_knn(v.embeddings, asked, 10)).join(share)


@query("vec_9_named_spaces", """WITH v AS (SELECT p_partkey, p_size % 7 + 1.0::double AS a, p_size % 5 + 1.0::double AS b FROM part), s AS (SELECT q.p_partkey AS query_id, c.p_partkey, round((q.a * c.a + q.b * c.b) / (sqrt(q.a * q.a + q.b * q.b) * sqrt(c.a * c.a + c.b * c.b)), 9) AS similarity FROM v q JOIN v c ON q.p_partkey % 50 = 0 AND q.p_partkey <> c.p_partkey)
    SELECT query_id, similarity, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, p_partkey) AS rank FROM s) WHERE rank <= 5 GROUP BY query_id, similarity""")
def _(v: Views):
    """Two embedders in one table; the search stays in the space of the one it names."""
    from marlstone.operators import embedders

    sizes = embedders.REGISTERED.register(embedders.by_column("sizes", 2, lambda t: F.array(t.cast("int") % 7 + 1, t.cast("int") % 5 + 1), least=0.0))
    rows = v.part.select("p_partkey", F.col("p_size").cast("string").alias("size"), "p_name")
    table = embedders.stored(rows, "p_partkey", {"size": 1.0}, sizes.name).unionByName(embedders.stored(rows, "p_partkey", {"p_name": 1.0}, "hashed-v1"))
    table = materialize(table, "spaces")
    found = embedders.nearest(table, table.filter("p_partkey % 50 = 0"), sizes.name, 5, "p_partkey")
    return found.groupBy("query_id", F.round("similarity", 9).alias("similarity")).agg(F.count(F.lit(1)).alias("n"))
