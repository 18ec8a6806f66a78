"""Searches in stored indexes: built, maintained by delta, and read by buckets."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.operators import vectors as E
from marlstone.operators.textindex import NODE_FIELDS, TextIndex
from marlstone.operators.vectorindex import VectorIndex
from marlstone.plans.registry import query
from marlstone.plans.views import Views
from marlstone.work import materialize, shared_dir

WORDS = "list_filter(regexp_split_to_array(lower({}), '[^a-z0-9à-ÿ]+'), lambda w: w <> '')"


def _bm25(rows: str, fields: dict[str, float], terms: tuple[str, ...], limit: int) -> str:
    """SQL of BM25 over rows(doc, fields)."""
    words = ", ".join(f"{WORDS.format(f'coalesce({f}, chr(32))')} AS w{i}" for i, f in enumerate(fields))
    length = " + ".join(f"len(w{i})" for i in range(len(fields)))
    hits = " UNION ALL ".join(f"SELECT doc, unnest(w{i}) AS term, {w} AS w FROM words" for i, w in enumerate(fields.values()))
    asked = ", ".join(f"'{t}'" for t in terms)
    return f"""WITH words AS (SELECT doc, {words} FROM ({rows})), dl AS (SELECT doc, {length} AS dl FROM words), post AS (SELECT doc, term, sum(w) AS tf FROM ({hits}) WHERE term IN ({asked}) GROUP BY ALL),
    s AS (SELECT doc, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score, count(*) AS matched FROM post JOIN dl USING (doc) JOIN (SELECT term, count(*) AS df FROM post GROUP BY term) USING (term), (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl) GROUP BY doc)
    SELECT doc, round(score, 6) AS score, matched FROM s ORDER BY round(s.score, 9) DESC, doc LIMIT {limit}"""


def _index(v: Views, name: str, fields: dict[str, float]) -> TextIndex:
    import uuid

    return TextIndex(v._spark, f"{shared_dir(v._spark)}/{name}-{uuid.uuid4().hex}", fields)


PARTS = "SELECT 'part:' || p_partkey AS doc, 'part:' || p_partkey AS id, p_name AS name, p_brand || '.' || p_name AS qualified_name, p_type AS docstring, 'size ' || p_size || ' of ' || p_brand AS signature FROM part"
PART_TERMS = ("cold", "brand", "small", "7", "part")


def _parts(v: Views):
    return v._spark.sql(PARTS.replace("FROM part", "FROM {part}"), part=v.part)


@query("fts_1_stored_fields", _bm25(PARTS, NODE_FIELDS, PART_TERMS, 60))
def _(v: Views):
    return _index(v, "parts", NODE_FIELDS).build(_parts(v), "doc").search(list(PART_TERMS), 60).select("doc", F.round("score", 6).alias("score"), "matched")


TEXT_FIELDS, TEXT_TERMS = {"title": 10.0, "body": 1.0}, ("from", "with", "nicht", "license", "para")
#: The documents after a delta: one in ten has changed, one in seventeen is gone, as many new ones come.
CHANGED = "SELECT cast(doc_id AS varchar) AS doc, substr(text, 9, 40) AS title, substr(text, 9) AS body FROM documents WHERE doc_id % 10 = 3 UNION ALL SELECT 'n' || doc_id, source, text FROM documents WHERE doc_id % 17 = 5"
STAY = "SELECT cast(doc_id AS varchar) AS doc, substr(text, 1, 40) AS title, text AS body FROM documents"


@query("fts_1_stored_delta", _bm25(f"SELECT * FROM ({STAY} WHERE doc_id % 10 <> 3 AND doc_id % 17 <> 0) UNION ALL SELECT * FROM ({CHANGED}) WHERE doc NOT IN (SELECT cast(doc_id AS varchar) FROM documents WHERE doc_id % 170 = 153)", TEXT_FIELDS, TEXT_TERMS, 80))
def _(v: Views):
    spark = v._spark
    rows = lambda text: spark.sql(text.replace("varchar", "string").replace("FROM documents", "FROM {documents}"), documents=v.documents)
    index = _index(v, "documents", TEXT_FIELDS).build(rows(STAY), "doc")
    index.apply(rows(CHANGED).filter("doc like 'n%' or try_cast(doc as long) % 17 <> 0"), rows(STAY).filter("try_cast(doc as long) % 17 = 0"), "doc")
    return index.search(list(TEXT_TERMS), 80).select("doc", F.round("score", 6).alias("score"), "matched")


def _vector_index(v: Views, rows, key: str, column: str) -> VectorIndex:
    import uuid

    return VectorIndex(v._spark, f"{shared_dir(v._spark)}/vectors-{uuid.uuid4().hex}", key, column).build(rows)


@query("vec_2_indexed_recall")
def _(v: Views):
    """Every fiftieth part's name against all, in the index: recall at ten and the share of the table that a query reads."""
    rows = materialize(E.embed(v.part, "p_partkey", {"p_name": 3.0, "p_type": 1.0}).select("p_partkey", "vector"), "vectors")
    index, asked = _vector_index(v, rows, "p_partkey", "vector"), rows.filter("p_partkey % 50 = 0")
    top, read = index.search_read(asked, 10)
    found = E.recall(top, E.exact_knn(rows, asked, 10, "p_partkey", "vector"), "p_partkey")
    share = read.agg(F.avg("read").alias("read")).join(rows.agg(F.count(F.lit(1)).alias("held")))  # single rows
    return found.join(share.select(F.round(F.col("read") / F.col("held"), 6).alias("share")))


@query("vec_2_all_lists", """WITH d AS (SELECT vec_id, list_transform(embedding, lambda x: x::double) AS e FROM embeddings), s AS (SELECT q.vec_id AS query_id, c.vec_id, round(list_cosine_similarity(q.e, c.e), 9) AS similarity FROM d q JOIN d c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
    SELECT query_id, vec_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM s) WHERE rank <= 10""")
def _(v: Views):
    """All lists probed: the index gives the exact answer."""
    index = _vector_index(v, v.embeddings, "vec_id", "embedding")
    return index.search(v.embeddings.filter("vec_id % 50 = 0"), 10, len(index.centres())).select("query_id", "vec_id", "rank")
