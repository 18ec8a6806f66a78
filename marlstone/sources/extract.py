"""Extractors: symbols, calls and imports of source files, routes, schemas, decision records, Markdown entities.

Python is parsed by its own grammar; other languages go by declaration patterns and matching brackets.  Files are read one
by one in Arrow batches, so an extractor sees a whole file and nothing else; what Spark's functions can express (DDL, routes,
decision records, OpenAPI) stays in the JVM."""

from __future__ import annotations

import ast
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Languages by extension.
LANGUAGES = {
    "py": "python", "rs": "rust", "ts": "typescript", "tsx": "tsx", "js": "javascript", "jsx": "jsx", "mjs": "javascript", "cjs": "javascript", "cs": "csharp", "swift": "swift",
    "sql": "sql", "json": "json", "yaml": "yaml", "yml": "yaml", "md": "markdown", "go": "go", "java": "java",
}
ROWS = "path string, row string, kind string, name string, qualified_name string, container string, start_line int, end_line int, detail string"


def language(path: Column) -> Column:
    """The language of a path by its extension; null for others."""
    pairs = [F.lit(x) for k, v in LANGUAGES.items() for x in (k, v)]
    return F.element_at(F.create_map(*pairs), F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)))


def _python(content: str) -> list[tuple]:
    """(row, kind, name, qualified, container, start, end, detail) of a Python file."""
    out: list[tuple] = []

    def dotted(node) -> str | None:
        if isinstance(node, ast.Name):
            return node.id
        if isinstance(node, ast.Attribute):
            left = dotted(node.value)
            return f"{left}.{node.attr}" if left else None
        return None

    def walk(node, path: list[str], inside_class: bool) -> None:
        for child in ast.iter_child_nodes(node):
            here, is_class = path, inside_class
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                kind = "class" if isinstance(child, ast.ClassDef) else "method" if inside_class else "function"
                here = [*path, child.name]
                is_class = isinstance(child, ast.ClassDef)
                out.append(("symbol", kind, child.name, ".".join(here), ".".join(path) or None, child.lineno, child.end_lineno, ast.get_docstring(child)))
                if isinstance(child, ast.ClassDef):
                    out.extend(("extends", "class", b, ".".join(here), None, child.lineno, child.lineno, None) for b in map(dotted, child.bases) if b)
                out.extend(("decorates", "reference", d, ".".join(here), None, child.lineno, child.lineno, None) for d in (dotted(x.func if isinstance(x, ast.Call) else x) for x in child.decorator_list) if d)
            elif isinstance(child, ast.Call) and (name := dotted(child.func)):
                left, _, last = name.rpartition(".")
                out.append(("call", "call", last, ".".join(path) or None, left or None, child.lineno, child.end_lineno, None))
            elif isinstance(child, ast.Import):
                out.extend(("import", "module", a.asname or a.name, a.name, None, child.lineno, child.lineno, None) for a in child.names)
            elif isinstance(child, ast.ImportFrom):
                module = "." * child.level + (child.module or "")
                out.extend(("import", "symbol", a.asname or a.name, module, None, child.lineno, child.lineno, a.name) for a in child.names)
            walk(child, here, is_class)

    walk(ast.parse(content), [], False)
    return out


_KINDS = {
    "rust": [("function", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+|unsafe\s+|const\s+)*fn\s+(\w+)"), ("struct", r"^\s*(?:pub(?:\([^)]*\))?\s+)?struct\s+(\w+)"), ("enum", r"^\s*(?:pub(?:\([^)]*\))?\s+)?enum\s+(\w+)"), ("trait", r"^\s*(?:pub(?:\([^)]*\))?\s+)?trait\s+(\w+)"), ("impl", r"^\s*impl(?:<[^>]*>)?\s+(?:[\w:<>, ]+\s+for\s+)?(\w+)")],
    "typescript": [("function", r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(\w+)"), ("class", r"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(\w+)"), ("interface", r"^\s*(?:export\s+)?interface\s+(\w+)"), ("type_alias", r"^\s*(?:export\s+)?type\s+(\w+)\s*="), ("enum", r"^\s*(?:export\s+)?(?:const\s+)?enum\s+(\w+)"), ("function", r"^\s*(?:export\s+)?(?:const|let)\s+(\w+)\s*(?::[^=]+)?=\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*(?::[^=]+)?=>"), ("method", r"^\s+(?:public\s+|private\s+|protected\s+|static\s+|async\s+|readonly\s+)*(?!if|for|while|switch|catch|return|function)(\w+)\s*\([^)]*\)\s*(?::\s*[^{]+)?\{")],
    "csharp": [("class", r"^\s*(?:(?:public|internal|private|protected|static|abstract|sealed|partial)\s+)*(?:class|record)\s+(\w+)"), ("interface", r"^\s*(?:(?:public|internal)\s+)*interface\s+(\w+)"), ("struct", r"^\s*(?:(?:public|internal|readonly)\s+)*struct\s+(\w+)"), ("enum", r"^\s*(?:(?:public|internal)\s+)*enum\s+(\w+)"), ("method", r"^\s*(?:(?:public|internal|private|protected|static|virtual|override|async|abstract)\s+)+[\w<>\[\],?. ]+\s+(\w+)\s*\([^;]*\)\s*(?:=>|\{|$)")],
    "swift": [("class", r"^\s*(?:(?:public|open|final|private|internal)\s+)*class\s+(\w+)"), ("struct", r"^\s*(?:(?:public|private|internal)\s+)*struct\s+(\w+)"), ("interface", r"^\s*(?:(?:public|private|internal)\s+)*protocol\s+(\w+)"), ("enum", r"^\s*(?:(?:public|private|internal|indirect)\s+)*enum\s+(\w+)"), ("function", r"^\s*(?:(?:public|open|private|internal|static|override|mutating|@\w+)\s+)*func\s+(\w+)")],
}
for _same in ("tsx", "javascript", "jsx"):
    _KINDS[_same] = _KINDS["typescript"]
_PATTERNS = {lang: [(k, re.compile(p)) for k, p in kinds] for lang, kinds in _KINDS.items()}
_CALL = re.compile(r"(?:([\w.:]+?)(?:\.|::))?([A-Za-z_]\w*)\s*\(")
_IMPORTS = {
    "rust": re.compile(r"^\s*(?:pub\s+)?use\s+([\w:]+?)(?:::\{([^}]*)\}|::(\w+))?\s*;"),
    "typescript": re.compile(r"""^\s*import\s+(?:type\s+)?(?:(\w+)\s*,?\s*)?(?:\{([^}]*)\}|\*\s+as\s+(\w+))?\s*(?:from\s+)?['"]([^'"]+)['"]"""),
    "csharp": re.compile(r"^\s*using\s+(?:static\s+)?([\w.]+)\s*;"),
    "swift": re.compile(r"^\s*import\s+(\w+)"),
}
_NO_CALL = frozenset("if for while switch match return catch fn function func class new sizeof typeof await async super".split())


def _braced(content: str, lang: str) -> list[tuple]:
    """Declarations of brace languages: a declaration's block ends where its bracket closes, and holds what lies inside."""
    out: list[tuple] = []
    clean = re.sub(r'"(?:\\.|[^"\\\n])*"', '""', content)
    lines = clean.split("\n")
    depth, stack = 0, []  # (depth at its opening line, index in out)
    in_comment = False
    base = "typescript" if lang in ("tsx", "javascript", "jsx") else lang
    raw = content.split("\n")
    for number, line in enumerate(lines, 1):
        if in_comment:
            if "*/" not in line:
                continue
            line, in_comment = line.split("*/", 1)[1], False
        line = re.sub(r"//.*|/\*.*?\*/", "", line)
        if "/*" in line:
            line, in_comment = line.split("/*", 1)[0], True
        m = _IMPORTS[base].match(raw[number - 1])
        if m and base == "typescript":
            out.extend(("import", "symbol", (x.split(" as ")[-1]).strip(), m[4], None, number, number, x.split(" as ")[0].strip()) for x in (m[2] or "").split(",") if x.strip())
            out.extend(("import", "module", x, m[4], None, number, number, None) for x in (m[1], m[3]) if x)
        elif m and base == "rust":
            names = [x.strip() for x in m[2].split(",")] if m[2] else [m[3] or m[1].split("::")[-1]]
            out.extend(("import", "symbol", n.split(" as ")[-1], m[1], None, number, number, n.split(" as ")[0]) for n in names if n)
        elif m:
            out.append(("import", "module", m[1].split(".")[-1], m[1], None, number, number, None))
        owner = out[stack[-1][1]][3] if stack else None
        declared = None
        for kind, pattern in _PATTERNS[lang]:
            if found := pattern.match(line):
                inside = stack and out[stack[-1][1]][1] in ("class", "struct", "interface", "trait", "impl", "enum")
                if kind == "method" and base == "typescript" and not inside:
                    continue
                kind = "method" if kind == "function" and inside else kind
                sep = "::" if lang == "rust" else "."
                declared = len(out)
                out.append(("symbol", kind, found[1], f"{owner}{sep}{found[1]}" if owner else found[1], owner, number, number, None))
                break
        if not m:
            for call in _CALL.finditer(line):
                if (call[1] or call[2] not in _NO_CALL) and not (declared is not None and call[2] == out[declared][2]):
                    caller = owner if declared is None else out[declared][3]
                    out.append(("call", "call", call[2], caller, call[1], number, number, None))
        opened = line.count("{") - line.count("}")
        if declared is not None and "{" in line and opened > 0:
            stack.append((depth, declared))
        depth += opened
        while stack and depth <= stack[-1][0]:
            _, i = stack.pop()
            out[i] = (*out[i][:6], number, *out[i][7:])
    return out


def extract_rows(path: str, content: str, lang: str | None) -> list[tuple]:
    """Rows of one file; a file that does not parse gives one row `error`."""
    if lang == "python":
        try:
            return _python(content)
        except (SyntaxError, ValueError, RecursionError) as error:
            return [("error", "parse", type(error).__name__, None, None, None, None, str(error)[:200])]
    return _braced(content, lang) if lang in _PATTERNS else []


def extract(files: DataFrame) -> DataFrame:
    """ROWS of files(path, content): symbols, calls (qualified_name: the caller, container: the receiver), imports (qualified_name:
    the module, detail: the name there), bases and decorators."""

    def run(frames):
        names = [c.split()[0] for c in ROWS.split(", ")]
        for f in frames:
            rows = [(p, *r) for p, c, lang in zip(f["path"], f["content"], f["lang"]) for r in extract_rows(p, c or "", lang)]
            out = pd.DataFrame(rows, columns=names)
            yield out.astype({"start_line": "Int32", "end_line": "Int32"})

    return files.select("path", "content", language(F.col("path")).alias("lang")).mapInPandas(run, ROWS)


def _lines(files: DataFrame) -> DataFrame:
    return files.select("path", F.posexplode(F.split("content", "\n")).alias("at", "line")).withColumn("line_number", F.col("at") + 1).drop("at")


def ddl(files: DataFrame) -> DataFrame:
    """path, kind (table, view, index, trigger), name, on, line_number of CREATE statements, in the JVM."""
    pattern = r"(?i)^\s*CREATE\s+(?:OR\s+REPLACE\s+)?(?:TEMP(?:ORARY)?\s+)?(?:UNIQUE\s+|VIRTUAL\s+|MATERIALIZED\s+)?(TABLE|VIEW|INDEX|TRIGGER)\s+(?:IF\s+NOT\s+EXISTS\s+)?[\"`\[]?([\w.]+)[\"`\]]?(?:.*?\bON\s+[\"`\[]?([\w.]+))?"
    hit = _lines(files).filter(F.col("line").rlike(pattern))
    group = lambda n: F.regexp_extract("line", pattern, n)
    return hit.select("path", F.lower(group(1)).alias("kind"), group(2).alias("name"), F.nullif(group(3), F.lit("")).alias("on"), "line_number")


def openapi(files: DataFrame) -> DataFrame:
    """path, method, route, operation of OpenAPI documents in JSON: two maps exploded."""
    paths = F.from_json(F.get_json_object("content", "$.paths"), "map<string, map<string, struct<operationId string, summary string>>>")
    rows = files.select("path", F.explode(paths).alias("route", "methods")).select("path", "route", F.explode("methods").alias("method", "body"))
    return rows.filter(F.col("method").isin("get", "put", "post", "delete", "patch", "head", "options")).select("path", F.upper("method").alias("method"), "route", F.coalesce("body.operationId", "body.summary").alias("operation"))


def decisions(files: DataFrame) -> DataFrame:
    """path, number, title, status of decision records in Markdown."""
    text = F.col("content")
    title = F.regexp_extract(text, r"(?m)^#\s+(?:ADR[- ]?)?(?:\d+[.:]?\s*)?(.+?)\s*$", 1)
    number = F.regexp_extract("path", r"(\d+)[^/]*\.md$", 1)
    status = F.lower(F.coalesce(F.nullif(F.regexp_extract(text, r"(?mi)^##\s+status\s*\n+\s*(\w+)", 1), F.lit("")), F.regexp_extract(text, r"(?mi)^\s*(?:\*\*)?status(?:\*\*)?:\s*(\w+)", 1)))
    return files.filter(F.col("path").rlike(r"(?i)(^|/)(adr|adrs|decisions)/.*\.md$")).select("path", F.nullif(number, F.lit("")).alias("number"), title.alias("title"), F.nullif(status, F.lit("")).alias("status"))


def routes(files: DataFrame) -> DataFrame:
    """path, framework, method, route, handler, line_number: Express, FastAPI and Flask, NestJS by patterns on lines, Next.js by
    file names and exported methods."""
    lines = _lines(files)

    def by(pattern: str, framework: str, method: int | str, route: int, handler: int | None, ends: tuple[str, ...]) -> DataFrame:
        get = lambda n: F.regexp_extract("line", pattern, n)
        hit = lines.filter(F.col("line").rlike(pattern) & F.col("path").rlike(rf"\.({'|'.join(ends)})$"))
        return hit.select("path", F.lit(framework).alias("framework"), F.upper(get(method) if isinstance(method, int) else F.lit(method)).alias("method"), get(route).alias("route"), F.nullif(get(handler) if handler else F.lit(""), F.lit("")).alias("handler"), "line_number")

    js = ("ts", "js", "tsx", "jsx", "mjs")
    found = by(r"""\b(?:app|router|server)\.(get|post|put|delete|patch|all)\(\s*['"]([^'"]+)['"]\s*(?:,\s*(?:[\w.]+\s*,\s*)*([\w.]+)\s*\))?""", "express", 1, 2, 3, js)
    found = found.unionByName(by(r"""^\s*@(?:app|router|api)\.(get|post|put|delete|patch)\(\s*['"]([^'"]+)['"]""", "fastapi", 1, 2, None, ("py",)))
    flask = by(r"""^\s*@\w+\.route\(\s*['"]([^'"]+)['"](?:.*methods\s*=\s*\[\s*['"](\w+))?""", "flask", 2, 1, None, ("py",))
    found = found.unionByName(flask.withColumn("method", F.coalesce(F.nullif("method", F.lit("")), F.lit("GET"))))
    found = found.unionByName(by(r"""^\s*@(Get|Post|Put|Delete|Patch)\(\s*(?:['"]([^'"]*)['"])?\s*\)""", "nestjs", 1, 2, None, ("ts",)))
    folder = F.regexp_extract("path", r"(?:^|/)app/(.*?)/?route\.(?:ts|js|tsx)$", 1)
    exported = r"^\s*export\s+(?:async\s+)?(?:function|const)\s+(GET|POST|PUT|DELETE|PATCH)\b"
    pages = lines.filter(F.col("path").rlike(r"(^|/)app/.*route\.(ts|js|tsx)$") & F.col("line").rlike(exported))
    pages = pages.select("path", F.lit("nextjs").alias("framework"), F.regexp_extract("line", exported, 1).alias("method"), F.concat(F.lit("/"), F.regexp_replace(folder, r"\([^)]*\)/", "")).alias("route"), F.lit(None).cast("string").alias("handler"), "line_number")
    return found.unionByName(pages)


ENTITY = "path string, id string, type string, title string, status string, topics array<string>, refs array<string>, body string, start_line int, end_line int"
_MARKER = re.compile(r"<!--\s*entity:\s*(\S+)(?:\s+type=(\S+))?(?:\s+status=(\S+))?\s*-->")
_REF = re.compile(r"\b(?:function|method|class|struct|enum|trait|interface|type|module):[\w./-]+:[\w.:]+")


def parse_markdown(path: str, content: str) -> list[tuple]:
    """Entities of a page: the page itself by its front matter, and a section for each inline marker; code fences hide headings
    and markers, a byte-order mark and CRLF line ends are tolerated."""
    text = content.removeprefix("﻿").replace("\r\n", "\n")
    lines = text.split("\n")
    meta: dict[str, str] = {}
    first = 0
    if lines and lines[0].strip() == "---" and "---" in (x.strip() for x in lines[1:]):
        end = next(i for i, x in enumerate(lines[1:], 1) if x.strip() == "---")
        for x in lines[1:end]:
            if m := re.match(r"(\w+):\s*(.*?)\s*$", x):
                meta[m[1]] = m[2].strip("\"'")
        first = end + 1
    marks: list[tuple[int, str, str, str]] = []
    headings: dict[int, tuple[int, str]] = {}
    fence = None
    for i in range(first, len(lines)):
        x = lines[i]
        if m := re.match(r"\s*(`{3,}|~{3,})", x):
            fence = None if fence and m[1].startswith(fence) else fence or m[1]
            continue
        if fence:
            continue
        if m := _MARKER.search(x):
            marks.append((i, m[1], m[2] or "note", m[3] or "active"))
        elif m := re.match(r"(#{1,6})\s+(.+?)\s*#*$", x):
            headings[i] = (len(m[1]), m[2])
    topics = [t.strip() for t in meta.get("topics", "").strip("[]").split(",") if t.strip()]
    title = meta.get("title") or next((h[1] for _, h in sorted(headings.items())), None)
    out = []
    if "id" in meta:
        body = "\n".join(lines[first:])
        out.append((path, meta["id"], meta.get("type", "note"), title, meta.get("status", "active"), topics, list(dict.fromkeys(_REF.findall(body))), body, first + 1, len(lines)))
    for n, (i, name, kind, status) in enumerate(marks):
        until = marks[n + 1][0] if n + 1 < len(marks) else len(lines)
        near = next((h[1] for j, h in sorted(headings.items()) if i < j < until), None) or next((headings[j][1] for j in sorted(headings, reverse=True) if j < i), title)
        body = "\n".join(lines[i + 1 : until])
        out.append((path, name, kind, near, status, topics, list(dict.fromkeys(_REF.findall(body))), body, i + 1, until))
    return out


def markdown_entities(files: DataFrame) -> DataFrame:
    """ENTITY rows of Markdown files(path, content)."""
    names = [c.split()[0] for c in re.split(r", (?=\w+ )", ENTITY)]

    def run(frames):
        for f in frames:
            yield pd.DataFrame([r for p, c in zip(f["path"], f["content"]) for r in parse_markdown(p, c or "")], columns=names)

    return files.filter(F.col("path").rlike(r"\.mdx?$")).select("path", "content").mapInPandas(run, ENTITY)
