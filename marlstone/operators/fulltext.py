"""Full text: source chunks, postings, BM25 with weighted fields, fused term lists, hybrid search.

A query keeps only its terms' words inside each document's row, so what a search shuffles is the size of its answer lists.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marlstone.functions import text as T
from marlstone.operators.ranking import RRF
from marlstone.work import materialize

K1, B = 1.2, 0.75


def chunks(files: DataFrame, path: str, content: str, window: int = 80, stride: int = 60) -> DataFrame:
    """path, start_line, end_line, text of overlapping windows of lines; the last window is the one that reaches the end."""
    lines = F.split(F.regexp_replace(F.col(content), "\n$", ""), "\n")
    rows = files.select(F.col(path).alias("path"), lines.alias("lines"))
    n = F.size("lines")
    last = F.greatest(F.lit(0), F.ceil((n - window) / stride)).cast("int")
    rows = rows.withColumn("offset", F.explode(F.transform(F.sequence(F.lit(0), last), lambda i: i * stride)))
    part = F.slice("lines", F.col("offset") + 1, window)
    return rows.select("path", (F.col("offset") + 1).cast("long").alias("start_line"), F.least(n, F.col("offset") + window).cast("long").alias("end_line"), F.array_join(part, "\n").alias("text"))


def matches(docs: DataFrame, key: str, fields: dict[str, float], terms: list[str], prefix: bool = False) -> DataFrame:
    """doc, dl (its words, unweighted), hits (an array of term, w): one row a document.  Texts are split once, and words that no term
    asks for are left out inside the array."""
    wanted = list(dict.fromkeys(t.lower() for t in terms))
    words = docs.select(F.col(key).alias("doc"), *(T.words(F.coalesce(F.col(f), F.lit(""))).alias(f"words_{i}") for i, f in enumerate(fields)))

    def asked(w):
        return reduce(lambda x, y: x | y, (w.startswith(t) for t in wanted), F.lit(False)) if prefix else w.isin(*wanted)

    def hits(i: int, weight: float):
        held = F.filter(F.col(f"words_{i}"), asked)
        if not prefix:
            return F.transform(held, lambda w: F.struct(w.alias("term"), F.lit(float(weight)).alias("w")))
        begun = F.flatten(F.transform(held, lambda w: F.filter(F.array(*map(F.lit, wanted)), lambda t: w.startswith(t))))
        return F.transform(begun, lambda t: F.struct(t.alias("term"), F.lit(float(weight)).alias("w")))

    length = reduce(lambda a, b: a + b, (F.size(f"words_{i}") for i in range(len(fields)))).cast("long")
    return words.select("doc", length.alias("dl"), F.flatten(F.array(*(hits(i, w) for i, w in enumerate(fields.values())))).alias("hits"))


def postings_of(matched: DataFrame) -> DataFrame:
    """doc, term, tf (weighted over fields), dl of rows of matches; a document's terms are added up in its row."""
    rows = matched.filter(F.size("hits") > 0).select("doc", "dl", "hits", F.explode(F.array_distinct(F.transform("hits", lambda h: h["term"]))).alias("term"))
    tf = F.aggregate(F.filter("hits", lambda h: h["term"] == F.col("term")), F.lit(0.0), lambda s, h: s + h["w"])
    return rows.select("doc", "term", tf.alias("tf"), "dl")


def bm25(docs: DataFrame, key: str, fields: dict[str, float], terms: list[str], limit: int | None = None, prefix: bool = False) -> DataFrame:
    """doc, score, matched of the documents that hold any of the terms (or words that begin with one); best first.

    One pass over the texts leaves a short row a document, from which come the counts of the corpus and of the terms too."""
    held = materialize(matches(docs, key, fields, terms, prefix), "matches")
    p = postings_of(held)
    df = p.groupBy("term").agg(F.count(F.lit(1)).alias("df"))  # a row for each asked term
    size = held.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))  # one row
    scored = p.join(F.broadcast(df), "term").join(F.broadcast(size))
    idf = F.log1p((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    out = scored.groupBy("doc").agg(F.sum(part).alias("score"), F.count(F.lit(1)).alias("matched")).orderBy(F.desc("score"), "doc")
    return out if limit is None else out.limit(limit)


def term_lists(docs: DataFrame, key: str, fields: dict[str, float], terms: dict[str, float], per_term: int) -> DataFrame:
    """doc, score: for each weighted term (32 at most) its best per_term documents by tf, fused by weight / (60 + rank)."""
    if len(terms) > 32:
        raise ValueError("at most 32 terms")
    p = postings_of(materialize(matches(docs, key, fields, list(terms)), "matches"))  # else each use of the hits splits the texts again
    weight = reduce(lambda c, t: c.when(F.col("term") == t, float(terms[t])), list(terms), F.when(F.lit(False), 0.0))
    rank = F.row_number().over(W.partitionBy("term").orderBy(F.desc("tf"), "dl", "doc"))
    best = p.withColumn("rank", rank).filter(F.col("rank") <= per_term)
    return best.groupBy("doc").agg(F.sum(weight / (RRF + F.col("rank"))).alias("score"), F.count(F.lit(1)).alias("terms")).orderBy(F.desc("score"), "doc")


def field_search(entities: DataFrame, terms: list[str], limit: int = 50) -> DataFrame:
    """Knowledge search over entities(id, title, summary, body): all terms in one field, by field (exact id, title, summary,
    body); only if no field matches them all, any term in any field."""
    wanted = F.array(*(F.lit(t.lower()) for t in terms))
    words = {f: T.words(F.coalesce(F.col(f), F.lit(""))) for f in ("title", "summary", "body")}
    every = lambda f: F.size(F.array_except(wanted, words[f])) == 0
    some = lambda f: F.arrays_overlap(wanted, words[f])
    ladder = lambda test: F.when(F.col("id").isin(*terms), 0).when(test("title"), 1).when(test("summary"), 2).when(test("body"), 3)
    ranked = entities.withColumns({"all_rank": ladder(every), "any_rank": ladder(some)})
    strict = ranked.agg(F.count(F.when(F.col("all_rank") > 0, 1)).alias("strict"))  # one row
    rank = F.when(F.col("strict") > 0, F.col("all_rank")).otherwise(F.col("any_rank"))
    out = ranked.join(F.broadcast(strict)).withColumn("field_rank", rank).filter(F.col("field_rank").isNotNull())
    return out.drop("all_rank", "any_rank", "strict").orderBy("field_rank", "title", "position").limit(limit)


def document_frequency(docs: DataFrame, key: str, column: str) -> DataFrame:
    """term, df, idf over all documents."""
    n = docs.agg(F.countDistinct(key).alias("n"))  # one row
    df = docs.select(F.col(key).alias("doc"), F.explode(F.array_distinct(T.words(F.col(column)))).alias("term")).groupBy("term").agg(F.countDistinct("doc").alias("df"))
    return df.join(F.broadcast(n)).select("term", "df", T.idf(F.col("n"), F.col("df")).alias("idf"))


def file_rollup(evidence: DataFrame) -> DataFrame:
    """file, score, exact, terms from evidence(file, id, score, chunk, exact, terms): the best three declarations at 1, 0.45 and
    0.2, the best two chunks at 1 and 0.35, exactness of any, and all matched terms."""
    rank = F.row_number().over(W.partitionBy("file", "chunk").orderBy(F.desc("score"), "id"))
    share = F.when(F.col("chunk"), F.when(F.col("rank") == 1, 1.0).when(F.col("rank") == 2, 0.35)).otherwise(F.when(F.col("rank") == 1, 1.0).when(F.col("rank") == 2, 0.45).when(F.col("rank") == 3, 0.2))
    return evidence.withColumn("rank", rank).groupBy("file").agg(F.sum(F.coalesce(share, F.lit(0.0)) * F.col("score")).alias("score"), F.bool_or("exact").alias("exact"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("terms")))).alias("terms"))
