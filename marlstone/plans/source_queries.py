"""Extractors and readers on small fixtures and on the stand-in tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from marlstone.functions import text as T
from marlstone.plans.registry import query
from marlstone.plans.views import Views
from marlstone.sources import extract as E
from marlstone.sources import logs as L
from marlstone.work import shared_dir

FILES = {
    "src/shop.py": "import os\nfrom .cart import total as t\n\nclass Shop(Base):\n    def open(self):\n        return t(self.door())\n\n    def door(self):\n        return os.path.join('a')\n\ndef main():\n    Shop().open()\n",
    "src/cart.ts": "import { tax } from './tax';\nexport class Cart {\n  total(x: number): number {\n    return tax(x);\n  }\n}\nexport const sum = (a) => {\n  return a;\n};\n",
    "src/lib.rs": "use crate::io::{read, write};\npub struct Door { open: bool }\nimpl Door {\n    pub fn new() -> Self {\n        build()\n    }\n}\nfn build() -> Door { Door::new() }\n",
    "db/schema.sql": "CREATE TABLE IF NOT EXISTS orders (id int);\nCREATE UNIQUE INDEX o_id ON orders (id);\n-- done\nCREATE TRIGGER t1 AFTER INSERT ON orders BEGIN SELECT 1; END;",
    "api.json": '{"openapi": "3.0", "paths": {"/a": {"get": {"operationId": "listA"}, "post": {"summary": "make"}}, "/b": {"delete": {"operationId": "dropB"}}}}',
    "docs/adr/0007-use-parquet.md": "# 7. Use Parquet\n\n## Status\n\nAccepted\n",
    "web/server.js": "app.get('/users', auth, list);\nrouter.post(\"/users\", create);\n",
    "web/api.py": "@app.get('/items')\ndef items(): ...\n@bp.route('/old', methods=['POST'])\ndef old(): ...\n",
    "app/shop/route.ts": "export async function GET() {}\nexport const POST = 1;\n",
    "bad.py": "def (:\n",
    "wiki/page.md": "---\nid: spec-1\ntype: spec\ntitle: One\ntopics: [a, b]\n---\n# One\nSee function:src/lib.rs:build.\n```\n# not a heading\n<!-- entity: hidden -->\n```\n<!-- entity: req-2 type=requirement -->\n## Two\ntext\n",
}


def _files(v: Views):
    return v._spark.createDataFrame(list(FILES.items()), "path string, content string")


def _values(columns: str, *rows: tuple) -> str:
    show = lambda x: "NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x)
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(show, r)) + ')' for r in rows)}) t({columns})"


@query("src_1_corpus_scan", _values("path, bytes", ("a/x.py", 6), ("b.md", 4)))
def _(v: Views):
    root = f"{shared_dir(v._spark)}/corpus-{uuid.uuid4().hex}"
    for path, text in (("a/x.py", "x = 1\n"), ("b.md", "# b\n"), ("skip/y.py", "y\n"), ("bin.dat", "a\0b"), ("big.txt", "z" * 5000)):
        _write(v, f"{root}/{path}", text)
    return L.scan_corpus(v._spark, root, ("skip/**",), max_file_bytes=1000).select("path", "bytes")


def _write(v: Views, path: str, text: str) -> None:
    jvm = v._spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(v._spark._jsc.hadoopConfiguration()).create(target)
    out.write(bytearray(text.encode()))
    out.close()


@query("src_1_coverage", "SELECT extension, count(*) AS n FROM (SELECT lower(regexp_extract(url, '\\.([A-Za-z0-9_]+)$', 1)) AS extension FROM (SELECT regexp_replace(url, '[?#].*', '') || CASE page_id % 3 WHEN 0 THEN '.html' WHEN 1 THEN '.Md' ELSE '.py' END AS url FROM pages)) WHERE extension NOT IN ('', 'py') GROUP BY 1".replace("\\\\", "\\"))
def _(v: Views):
    ending = F.when(F.col("page_id") % 3 == 0, ".html").when(F.col("page_id") % 3 == 1, ".Md").otherwise(".py")
    return L.coverage(v.pages.select(F.concat(F.regexp_replace("url", "[?#].*", ""), ending).alias("path")), "path", ("py",))


IGNORE = ["# built", "build/", "*.min.js", "/vendor", "docs/**/draft*", "!docs/keep/draft7", "!a/build/src3", "lib/vendor/[0-4]*", "src1*"]


@query("src_1_ignore_file", r"""SELECT path, CASE WHEN path LIKE 'src1%' OR regexp_matches(path, '(^|/)src1[^/]*(/|$)') THEN true WHEN regexp_full_match(path, 'lib/vendor/[0-4].*') THEN true WHEN regexp_full_match(path, 'docs/keep/draft7(/.*)?') THEN false WHEN regexp_full_match(path, 'docs/(.*/)?draft[^/]*(/.*)?') THEN true WHEN regexp_full_match(path, 'vendor(/.*)?') THEN true WHEN regexp_matches(path, '(^|/)[^/]*\.min\.js(/|$)') THEN true WHEN regexp_matches(path, '(^|/)build/') THEN true ELSE false END AS ignored FROM (
    SELECT DISTINCT CASE doc_id % 7 WHEN 0 THEN 'a/build/' || source WHEN 1 THEN 'js/x' || doc_id || '.min.js' WHEN 2 THEN 'vendor/' || source WHEN 3 THEN 'docs/' || lang || '/draft' || doc_id WHEN 4 THEN 'docs/keep/draft' || (doc_id % 9) WHEN 5 THEN source || '/main.c' ELSE 'lib/vendor/' || doc_id END AS path FROM documents)""")
def _(v: Views):
    i = F.col("doc_id")
    path = (
        F.when(i % 7 == 0, F.concat(F.lit("a/build/"), "source")).when(i % 7 == 1, F.concat(F.lit("js/x"), i, F.lit(".min.js"))).when(i % 7 == 2, F.concat(F.lit("vendor/"), "source")).when(i % 7 == 3, F.concat(F.lit("docs/"), "lang", F.lit("/draft"), i))
        .when(i % 7 == 4, F.concat(F.lit("docs/keep/draft"), i % 9)).when(i % 7 == 5, F.concat("source", F.lit("/main.c"))).otherwise(F.concat(F.lit("lib/vendor/"), i))
    )
    return v.documents.select(path.alias("path")).distinct().select("path", T.ignored(F.col("path"), IGNORE).alias("ignored"))


@query("src_14_discovery", """SELECT path, bytes FROM (SELECT path, bytes, sum(bytes) OVER (ORDER BY path ROWS UNBOUNDED PRECEDING) AS running FROM (SELECT path, bytes FROM (SELECT CASE doc_id % 6 WHEN 0 THEN '.git/' WHEN 1 THEN 'local/' WHEN 2 THEN 'skip/' ELSE 'docs/' || lang || '/' END || doc_id || CASE WHEN doc_id % 5 = 0 THEN '.txt' ELSE '.md' END AS path, n_chars AS bytes FROM documents)
    WHERE path LIKE '%.md' AND path NOT LIKE '.git/%' AND path NOT LIKE 'local/%' AND path NOT LIKE 'skip/%' AND bytes <= 4000 ORDER BY path LIMIT 60)) WHERE running <= 60000""")
def _(v: Views):
    i = F.col("doc_id")
    folder = F.when(i % 6 == 0, ".git/").when(i % 6 == 1, "local/").when(i % 6 == 2, "skip/").otherwise(F.concat(F.lit("docs/"), "lang", F.lit("/")))
    files = v.documents.select(F.concat(folder, i.cast("string"), F.when(i % 5 == 0, ".txt").otherwise(".md")).alias("path"), F.col("n_chars").alias("bytes"))
    return L.discover(files, ("skip/**",), 60, 64, 4000, 60_000)[0]


@query("src_2_languages", _values("path, lang", *sorted({p: E.LANGUAGES.get(p.rsplit(".", 1)[-1]) for p in FILES}.items())))
def _(v: Views):
    return _files(v).select("path", E.language(F.col("path")).alias("lang"))


@query("src_4_symbols", _values("path, kind, qualified_name, start_line, end_line", ("src/shop.py", "class", "Shop", 4, 9), ("src/shop.py", "method", "Shop.open", 5, 6), ("src/shop.py", "method", "Shop.door", 8, 9), ("src/shop.py", "function", "main", 11, 12),
        ("src/cart.ts", "class", "Cart", 2, 6), ("src/cart.ts", "method", "Cart.total", 3, 5), ("src/cart.ts", "function", "sum", 7, 9), ("src/lib.rs", "struct", "Door", 2, 2), ("src/lib.rs", "impl", "Door", 3, 7), ("src/lib.rs", "method", "Door::new", 4, 6), ("src/lib.rs", "function", "build", 8, 8),
        ("web/api.py", "function", "items", 2, 2), ("web/api.py", "function", "old", 4, 4), ("app/shop/route.ts", "function", "GET", 1, 1)))
def _(v: Views):
    return E.extract(_files(v)).filter("row = 'symbol'").select("path", "kind", "qualified_name", "start_line", "end_line")


@query("src_3_calls_and_imports", _values("path, row, name, qualified_name, container", ("src/shop.py", "import", "os", "os", None), ("src/shop.py", "import", "t", ".cart", None), ("src/shop.py", "call", "t", "Shop.open", None), ("src/shop.py", "call", "door", "Shop.open", "self"), ("src/shop.py", "call", "join", "Shop.door", "os.path"), ("src/shop.py", "call", "Shop", "main", None),
        ("src/cart.ts", "import", "tax", "./tax", None), ("src/cart.ts", "call", "tax", "Cart.total", None), ("src/lib.rs", "import", "read", "crate::io", None), ("src/lib.rs", "import", "write", "crate::io", None), ("src/lib.rs", "call", "build", "Door::new", None), ("src/lib.rs", "call", "new", "build", "Door")))
def _(v: Views):
    return E.extract(_files(v)).filter("row in ('call', 'import') and path like 'src/%'").select("path", "row", "name", "qualified_name", "container")


@query("src_3_parse_errors", _values("path, name", ("bad.py", "SyntaxError")))
def _(v: Views):
    return E.extract(_files(v)).filter("row = 'error'").select("path", "name")


@query("src_5_ddl", 'SELECT * FROM (VALUES (\'table\', \'orders\', NULL, 1), (\'index\', \'o_id\', \'orders\', 2), (\'trigger\', \'t1\', \'orders\', 4)) t(kind, name, "on", line_number)')
def _(v: Views):
    return E.ddl(_files(v).filter("path like '%.sql'")).select("kind", "name", "on", "line_number")


@query("src_6_openapi", _values("method, route, operation", ("GET", "/a", "listA"), ("POST", "/a", "make"), ("DELETE", "/b", "dropB")))
def _(v: Views):
    return E.openapi(_files(v).filter("path = 'api.json'")).select("method", "route", "operation")


@query("src_7_decisions", _values("path, number, title, status", ("docs/adr/0007-use-parquet.md", "0007", "Use Parquet", "accepted")))
def _(v: Views):
    return E.decisions(_files(v))


@query("src_8_routes", _values("framework, method, route, handler", ("express", "GET", "/users", "list"), ("express", "POST", "/users", "create"), ("fastapi", "GET", "/items", None), ("flask", "POST", "/old", None), ("nextjs", "GET", "/shop", None), ("nextjs", "POST", "/shop", None)))
def _(v: Views):
    return E.routes(_files(v)).select("framework", "method", "route", "handler")


@query("src_8_hrefs", "SELECT page_id, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS href FROM pages) GROUP BY page_id")
def _(v: Views):
    links = v.pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href"))
    return links.groupBy("page_id").agg(F.count(F.lit(1)).alias("n"))


@query("src_13_markdown_entities", _values("id, type, title, start_line, refs", ("spec-1", "spec", "One", 7, "function:src/lib.rs:build"), ("req-2", "requirement", "Two", 13, "")))
def _(v: Views):
    return E.markdown_entities(_files(v)).filter("path like 'wiki/%'").select("id", "type", "title", "start_line", F.rtrim(F.array_join("refs", ","), F.lit(".")).alias("refs"))


@query("src_10_recent_log", "SELECT 'e' || event_id AS id, event_type AS kind FROM (SELECT * FROM events ORDER BY event_id DESC LIMIT 100)")
def _(v: Views):
    path = f"{shared_dir(v._spark)}/log-{uuid.uuid4().hex}"
    rows = v.events.orderBy("event_id").select(F.to_json(F.struct(F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("id"), F.col("event_type").alias("kind"))).alias("value"))
    rows.coalesce(1).write.text(path)
    return L.read_recent_events(v._spark, path, 100).select("id", "kind")


@query("src_11_whole_log", "SELECT event_type AS kind, count(*) AS n FROM events GROUP BY 1")
def _(v: Views):
    path = f"{shared_dir(v._spark)}/log-{uuid.uuid4().hex}"
    good = v.events.select(F.to_json(F.struct(F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("id"), F.col("event_type").alias("kind"))).alias("value"))
    good.union(v._spark.createDataFrame([('{"id": broken',), ("",)], "value string")).write.text(path)
    return L.read_events(v._spark, path).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("snk_1_supersession", _values("id, superseded_by", ("a", "b"), ("b", None), ("c", None)))
def _(v: Views):
    path = f"{shared_dir(v._spark)}/log-{uuid.uuid4().hex}"
    event = lambda i, of: v._spark.createDataFrame([(i, "note", ["./x\\y"], of, None)], "id string, kind string, files array<string>, supersedes string, superseded_by string")
    for i, of in (("a", None), ("b", "a"), ("c", None)):
        L.append_event(v._spark, path, event(i, of))
    return L.superseded(L.read_events(v._spark, path)).select("id", "superseded_by")


@query("snk_3_publication", "SELECT p_partkey AS id, p_name AS name FROM part WHERE p_partkey % 17 <> 9")
def _(v: Views):
    from marlstone.operators.deltas import Publication, keyed_delta

    held = Publication(v._spark, f"{shared_dir(v._spark)}/pub-{uuid.uuid4().hex}")
    held.publish(v.snap_old)
    pinned = held.read()
    held.publish_delta(keyed_delta(v.snap_old, v.snap_new, ["id"]), ["id"])
    assert pinned.count() == v.snap_old.count()  # the reader stays on its version
    return held.read().select("id", "name")


@query("snk_6_export", "SELECT cast(doc_id AS varchar) AS path FROM (SELECT doc_id, sum(strlen(text)) OVER (ORDER BY cast(doc_id AS varchar)) AS s FROM documents) WHERE s <= 100000")
def _(v: Views):
    pages = v.documents.select(F.col("doc_id").cast("string").alias("path"), "text")
    return L.export_bundle(pages, f"{shared_dir(v._spark)}/bundle-{uuid.uuid4().hex}", 200, 100_000).select("path")


RECORDS = """SELECT CASE doc_id % 5 WHEN 0 THEN 'docs/adr/' WHEN 1 THEN 'adr/' WHEN 2 THEN 'docs/adr/old/' WHEN 3 THEN 'doc/adrs/' ELSE 'notes/' END || doc_id || '.md' AS path, CASE WHEN doc_id % 2 = 0 THEN '# ' || lang || ' ' || doc_id || chr(10) ELSE '' END || text AS content, doc_id FROM documents"""


@query("src_15_decision_records", f"""WITH f AS ({RECORDS}), r AS (SELECT *, string_split(regexp_replace(content, '\n$', ''), chr(10)) AS lines FROM f WHERE doc_id % 5 IN (0, 1, 3) AND doc_id % 11 <> 4),
    h AS (SELECT *, list_filter(lines, lambda x: trim(x) LIKE '# %') AS heads FROM r) SELECT path, 'ADR: ' || CASE WHEN len(heads) > 0 THEN trim(regexp_replace(trim(heads[1]), '^#+', '')) ELSE cast(doc_id AS varchar) END AS summary, md5(array_to_string(lines[1:15], chr(10))) AS details FROM h""".replace("\\\\", "\\"))
def _(v: Views):
    from marlstone.sources import harvest

    files = v._spark.sql(RECORDS.replace("FROM documents", "FROM {documents}"), documents=v.documents)
    existing = files.filter("doc_id % 11 = 4").select(F.array(F.concat(F.lit("adr:"), "path")).alias("tags"))
    found = harvest.decision_records(files, existing)
    return found.select(F.col("files")[0].alias("path"), "summary", F.md5("details").alias("details"))
