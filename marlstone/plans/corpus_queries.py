"""Extractors over a corpus written from the tables: a few files for each part, whose contents SQL can foretell."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.operators import drift as D
from marlstone.operators import resolution as N
from marlstone.plans.registry import query
from marlstone.plans.views import Views
from marlstone.sources import extract as E
from marlstone.sources import logs as L

# {k}: the part's key, {s}: its size; the condition says which parts have the file.
CODE = "import os\nfrom .m{s} import f{k} as g\n\nclass C{k}:\n    def run(self):\n        return g(self.stop())\n\n    def stop(self):\n        return os.getcwd()\n\ndef main{k}():\n    C{k}().run()\n"
SCHEMA = "-- part {k}\nCREATE TABLE IF NOT EXISTS t{k} (id int);\nCREATE UNIQUE INDEX i{k} ON t{k} (id);\n"
RECORD = "# {k}. Use size {s}\n\n## Status\n\nAccepted\n"
API = '{"openapi": "3.0", "paths": {"/parts/{k}": {"get": {"operationId": "part{k}"}, "delete": {"summary": "drop{s}"}}}}'
WEB = "@app.get('/parts/{k}')\ndef part(): ...\n@bp.route('/old/{s}', methods=['POST'])\ndef old(): ...\n"
PAGE = "---\nid: page-{k}\ntype: spec\ntitle: Size {s}\n---\n# Head\nSee function:src/m{k}.py:main{k} here.\n<!-- entity: req-{k} type=requirement -->\n## Part {k}\ntext\n"
MEMO = "Run `npm run build{k}` and read `src/size{s}/x.ts`.\nIt requires left{k}; react@{s}.2 will do.\nNever call `make old{k}` again.\n"


def _corpus(v: Views, path: str, content: str, condition: str = "true"):
    fill = lambda text: F.replace(F.replace(F.lit(text), F.lit("{k}"), F.col("p_partkey").cast("string")), F.lit("{s}"), F.col("p_size").cast("string"))
    return v.part.filter(condition).select(fill(path).alias("path"), fill(content).alias("content"))


@query("src_2_corpus_languages", """SELECT path, CASE p_partkey % 6 WHEN 0 THEN 'python' WHEN 1 THEN 'typescript' WHEN 2 THEN 'rust' WHEN 3 THEN 'java' WHEN 4 THEN 'go' END AS lang FROM (SELECT p_partkey, 'src/p' || p_partkey || CASE p_partkey % 6 WHEN 0 THEN '.py' WHEN 1 THEN '.ts' WHEN 2 THEN '.rs' WHEN 3 THEN '.java' WHEN 4 THEN '.go' ELSE '.png' END AS path FROM part)""")
def _(v: Views):
    k = F.col("p_partkey") % 6
    ending = F.when(k == 0, ".py").when(k == 1, ".ts").when(k == 2, ".rs").when(k == 3, ".java").when(k == 4, ".go").otherwise(".png")
    path = F.concat(F.lit("src/p"), F.col("p_partkey").cast("string"), ending)
    return v.part.select(path.alias("path"), E.language(path).alias("lang"))


@query("src_4_corpus_symbols", """SELECT 'src/m' || k || '.py' AS path, kind, replace(name, '#', k) AS qualified_name, a AS start_line, b AS end_line FROM (SELECT cast(p_partkey AS varchar) AS k FROM part), (VALUES ('class', 'C#', 4, 9), ('method', 'C#.run', 5, 6), ('method', 'C#.stop', 8, 9), ('function', 'main#', 11, 12)) t(kind, name, a, b)""")
def _(v: Views):
    return E.extract(_corpus(v, "src/m{k}.py", CODE)).filter("row = 'symbol'").select("path", "kind", "qualified_name", "start_line", "end_line")


@query("src_3_corpus_calls", """SELECT 'src/m' || k || '.py' AS path, row_kind AS row, replace(name, '#', k) AS name, replace(replace(full_name, '#', k), '%', s) AS qualified_name, replace(container, '#', k) AS container FROM (SELECT cast(p_partkey AS varchar) AS k, cast(p_size AS varchar) AS s FROM part),
    (VALUES ('import', 'os', 'os', NULL), ('import', 'g', '.m%', NULL), ('call', 'g', 'C#.run', NULL), ('call', 'stop', 'C#.run', 'self'), ('call', 'getcwd', 'C#.stop', 'os'), ('call', 'C#', 'main#', NULL)) t(row_kind, name, full_name, container)""")
def _(v: Views):
    # the call on the result of another call has no name for a receiver
    return E.extract(_corpus(v, "src/m{k}.py", CODE)).filter("row in ('call', 'import') and name <> 'run'").select("path", "row", "name", "qualified_name", "container")


@query("src_5_corpus_ddl", """SELECT 'db/t' || k || '.sql' AS path, kind, letter || k AS name, CASE WHEN kind = 'index' THEN 't' || k END AS "on", line AS line_number FROM (SELECT cast(p_partkey AS varchar) AS k FROM part WHERE p_partkey % 5 = 0), (VALUES ('table', 't', 2), ('index', 'i', 3)) t(kind, letter, line)""")
def _(v: Views):
    return E.ddl(_corpus(v, "db/t{k}.sql", SCHEMA, "p_partkey % 5 = 0")).select("path", "kind", "name", "on", "line_number")


@query("src_6_corpus_openapi", """SELECT method, '/parts/' || p_partkey AS route, CASE method WHEN 'GET' THEN 'part' || p_partkey ELSE 'drop' || p_size END AS operation FROM part, (VALUES ('GET'), ('DELETE')) t(method) WHERE p_partkey % 3 = 0""")
def _(v: Views):
    return E.openapi(_corpus(v, "api/{k}.json", API, "p_partkey % 3 = 0")).select("method", "route", "operation")


@query("src_7_corpus_decisions", """SELECT 'docs/adr/' || p_partkey || '-size.md' AS path, cast(p_partkey AS varchar) AS number, 'Use size ' || p_size AS title, 'accepted' AS status FROM part WHERE p_partkey % 7 = 0""")
def _(v: Views):
    return E.decisions(_corpus(v, "docs/adr/{k}-size.md", RECORD, "p_partkey % 7 = 0"))


@query("src_8_corpus_routes", """SELECT framework, method, CASE framework WHEN 'fastapi' THEN '/parts/' || p_partkey ELSE '/old/' || p_size END AS route, line AS line_number, count(*) AS n FROM part, (VALUES ('fastapi', 'GET', 1), ('flask', 'POST', 3)) t(framework, method, line) GROUP BY ALL""")
def _(v: Views):
    return E.routes(_corpus(v, "web/r{k}.py", WEB)).groupBy("framework", "method", "route", "line_number").agg(F.count(F.lit(1)).alias("n"))


@query("src_13_corpus_entities", """SELECT CASE kind WHEN 'spec' THEN 'page-' ELSE 'req-' END || p_partkey AS id, kind AS type, CASE kind WHEN 'spec' THEN 'Size ' || p_size ELSE 'Part ' || p_partkey END AS title, CASE kind WHEN 'spec' THEN 6 ELSE 8 END AS start_line, CASE kind WHEN 'spec' THEN 'function:src/m' || p_partkey || '.py:main' || p_partkey ELSE '' END AS refs FROM part, (VALUES ('spec'), ('requirement')) t(kind) WHERE p_partkey % 4 = 0""")
def _(v: Views):
    return E.markdown_entities(_corpus(v, "wiki/p{k}.md", PAGE, "p_partkey % 4 = 0")).select("id", "type", "title", "start_line", F.array_join("refs", ",").alias("refs"))


@query("dr_1_corpus_claims", """SELECT 'memo' || k AS file, line, kind, replace(replace(value, '#', k), '%', s) AS value, negated FROM (SELECT cast(p_partkey AS varchar) AS k, cast(p_size AS varchar) AS s FROM part),
    (VALUES (1, 'command', 'npm run build#', false), (1, 'path', 'src/size%/x.ts', false), (2, 'dependency', 'left#', false), (2, 'version', 'react@%.2', false), (3, 'command', 'make old#', true)) t(line, kind, value, negated)""")
def _(v: Views):
    docs = _corpus(v, "memo{k}", MEMO).withColumnsRenamed({"path": "file", "content": "text"})
    return D.claims(docs, "file", "text").select("file", F.col("line").cast("int").alias("line"), "kind", "value", "negated")


@query("snk_1_log_supersession", "SELECT 'e' || e.event_id AS id, min('e' || s.event_id) AS superseded_by FROM events e LEFT JOIN events s ON s.event_id % 10 = 3 AND s.event_id - s.event_id % 7 = e.event_id GROUP BY e.event_id")
def _(v: Views):
    i = F.col("event_id")
    name = lambda c: F.concat(F.lit("e"), c.cast("string"))
    events = v.events.select(name(i).alias("id"), F.when(i % 10 == 3, name(i - i % 7)).alias("supersedes"), F.lit(None).cast("string").alias("superseded_by"))
    return L.superseded(events).select("id", "superseded_by")


@query("res_11_corpus_imports", """SELECT 'src/a' || p_size || '/x.ts' AS file, '../b/y' || p_partkey AS module, 'src/b/y' || p_partkey || CASE WHEN p_partkey % 3 = 0 THEN '.ts' ELSE '/index.js' END AS target_file FROM part WHERE p_partkey % 3 <> 2 OR p_partkey % 2 = 1""")
def _(v: Views):
    k = F.col("p_partkey")
    text = k.cast("string")
    imports = v.part.select(F.concat(F.lit("src/a"), F.col("p_size").cast("string"), F.lit("/x.ts")).alias("file"), F.concat(F.lit("../b/y"), text).alias("module"))
    files = v.part.filter(k % 3 == 0).select(F.concat(F.lit("src/b/y"), text, F.lit(".ts")).alias("path")).unionByName(v.part.filter((k % 3 == 1) | (k % 2 == 1)).filter(k % 3 != 0).select(F.concat(F.lit("src/b/y"), text, F.lit("/index.js")).alias("path")))
    return N.resolve_imports(imports.unionByName(v.part.select(F.lit("src/a1/x.ts").alias("file"), F.concat(F.lit("react"), text).alias("module"))), files)
