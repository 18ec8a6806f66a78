"""Deltas between two snapshots of a table."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.operators import deltas as D
from marlstone.plans.registry import query
from marlstone.plans.views import Views

SNAPS = ("snap_old", "snap_new")
DELTA = """SELECT op, id, name, size, price FROM (SELECT coalesce(o.id, n.id) AS id, n.name, n.size, n.price, CASE WHEN n.id IS NULL THEN 'D' WHEN o.id IS NULL THEN 'I'
    WHEN o.name IS DISTINCT FROM n.name OR o.size IS DISTINCT FROM n.size OR o.price IS DISTINCT FROM n.price THEN 'U' END AS op FROM snap_old o FULL JOIN snap_new n ON o.id = n.id) WHERE op IS NOT NULL"""


@query("set_1_keyed_delta", DELTA, SNAPS)
def _(v: Views):
    return D.keyed_delta(v.snap_old, v.snap_new, ["id"])


@query("snk_4_applied_delta", "SELECT id, name, size, price FROM snap_new", SNAPS)
def _(v: Views):
    return D.apply_delta(v.snap_old, D.keyed_delta(v.snap_old, v.snap_new, ["id"]), ["id"])


@query("set_2_stale_and_missing", "SELECT 'D' AS op, id FROM snap_old WHERE id NOT IN (SELECT id FROM snap_new) UNION ALL SELECT 'I', id FROM snap_new WHERE id NOT IN (SELECT id FROM snap_old)", SNAPS)
def _(v: Views):
    return D.stale_and_missing(v.snap_old, v.snap_new, ["id"])


@query("set_3_set_delta", "SELECT 'D' AS op, * FROM (SELECT name, size FROM snap_old EXCEPT SELECT name, size FROM snap_new) UNION ALL SELECT 'I', * FROM (SELECT name, size FROM snap_new EXCEPT SELECT name, size FROM snap_old)", SNAPS)
def _(v: Views):
    return D.set_delta(v.snap_old.select("name", "size"), v.snap_new.select("name", "size"))


@query("set_4_invalidated", "SELECT DISTINCT id FROM ((SELECT id, size FROM snap_old EXCEPT SELECT id, size FROM snap_new) UNION ALL (SELECT id, size FROM snap_new EXCEPT SELECT id, size FROM snap_old))", SNAPS)
def _(v: Views):
    return D.invalidated(v.snap_old.select("id", "size"), v.snap_new.select("id", "size"), "id")


@query("set_5_delta_statistics", f"SELECT 'snap' AS \"table\", op, count(*) AS n FROM ({DELTA}) GROUP BY op", SNAPS)
def _(v: Views):
    return D.delta_statistics({"snap": D.keyed_delta(v.snap_old, v.snap_new, ["id"])})


@query("set_9_source_changes", "SELECT change, count(*) AS n FROM (SELECT CASE WHEN o.id IS NULL THEN 'added' WHEN n.id IS NULL THEN 'deleted' WHEN o.size <> n.size THEN 'modified' ELSE 'same' END AS change FROM snap_old o FULL JOIN snap_new n ON o.id = n.id) GROUP BY change", SNAPS)
def _(v: Views):
    return D.classify_sources(v.snap_old, v.snap_new, "id", "size").groupBy("change").agg(F.count(F.lit(1)).alias("n"))


@query("set_11_revision_marks", """SELECT coalesce(o.id, n.id) AS id, CASE WHEN n.size IS NOT NULL AND o.size IS DISTINCT FROM n.size THEN n.size ELSE o.size END AS revision, CASE WHEN n.size IS NOT NULL AND o.size IS DISTINCT FROM n.size THEN 2 ELSE CASE WHEN o.id IS NOT NULL THEN 1 END END AS "at"
    FROM snap_old o FULL JOIN snap_new n ON o.id = n.id""", SNAPS)
def _(v: Views):
    marks = v.snap_old.select("id", F.col("size").alias("revision"), F.lit(1).alias("at"))
    return D.upsert_revisions(marks, v.snap_new.select("id", F.col("size").alias("revision"), F.lit(2).alias("at")))


@query("snk_7_dump_diff", "SELECT 'old' AS side, count(*) AS n FROM (SELECT * FROM snap_old EXCEPT ALL SELECT * FROM snap_new) UNION ALL SELECT 'new', count(*) FROM (SELECT * FROM snap_new EXCEPT ALL SELECT * FROM snap_old)", SNAPS)
def _(v: Views):
    count = lambda df, side: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(side).alias("side"), "n")
    return count(v.snap_old.exceptAll(v.snap_new), "old").unionByName(count(v.snap_new.exceptAll(v.snap_old), "new"))


TREE = """SELECT lang || '/' || source || '/p' || (doc_id % 7) || CASE WHEN doc_id % 3 = 0 THEN '/deep' ELSE '' END || '/' || doc_id AS path, CASE WHEN doc_id % 97 = 5 THEN 'new' ELSE lang || n_chars END AS hash, doc_id FROM documents"""


@query("x_26_changed_folders", f"""WITH n AS ({TREE}), o AS (SELECT path, CASE WHEN hash = 'new' THEN 'old' ELSE hash END AS hash FROM n WHERE doc_id % 89 <> 3), m AS (SELECT path, hash FROM n WHERE doc_id % 83 <> 4),
    f AS (SELECT coalesce(o.path, m.path) AS path, o.hash AS was, m.hash AS now FROM o FULL JOIN m USING (path)),
    p AS (SELECT array_to_string(string_split(path, '/')[1:i], '/') AS path, i = len(string_split(path, '/')) AS is_file, was, now FROM f, unnest(range(0, len(string_split(path, '/')) + 1)) t(i))
    SELECT path, is_file, CASE WHEN count(was) = 0 THEN 'added' WHEN count(now) = 0 THEN 'removed' ELSE 'changed' END AS change FROM p GROUP BY path, is_file HAVING bool_or(was IS DISTINCT FROM now)""")
def _(v: Views):
    from marlstone.operators import digests
    from marlstone.work import shared_dir

    import uuid

    now = v._spark.sql(TREE.replace("FROM documents", "FROM {documents}"), documents=v.documents)
    at = f"{shared_dir(v._spark)}/trees-{uuid.uuid4().hex}"
    digests.store_tree(now.filter("doc_id % 89 <> 3").withColumn("hash", F.when(F.col("hash") == "new", "old").otherwise(F.col("hash"))), f"{at}/old")
    digests.store_tree(now.filter("doc_id % 83 <> 4"), f"{at}/new")
    return digests.changed(digests.stored_tree(v._spark, f"{at}/old"), digests.stored_tree(v._spark, f"{at}/new"))
