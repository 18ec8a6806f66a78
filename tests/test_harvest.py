"""Harvested decisions and changelogs by hand."""

from marlstone.sources import harvest


def test_harvest(spark):
    files = spark.createDataFrame([
        ("docs/adr/1-use-x.md", "\n# Use X\n\nBecause.\n" + "more\n" * 20), ("adr/plain.md", "no heading"), ("docs/adr/deep/2.md", "# No"), ("docs/adr/3.txt", "# No"), ("doc/adr/known.md", "# Known"), ("adr/none.md", None),
        ("CHANGELOG.md", "# Log\nintro\n\n## 1.1 \n\n- one\n  - two\n### Fixed\n## 1.0\r\nfirst\n## 1.1\nagain\n"), ("CHANGES.md", "## 1.0\nother\n## 0.9"), ("docs/CHANGELOG.md", "## 7"),
    ], "path string, content string")
    existing = spark.createDataFrame([(["adr:doc/adr/known.md", "x"],), (["changelog:0.9"],), (None,)], "tags array<string>")
    got = {r.files[0]: r for r in harvest.decision_records(files, existing).collect()}
    assert {p: r.summary for p, r in got.items()} == {"docs/adr/1-use-x.md": "ADR: Use X", "adr/plain.md": "ADR: plain", "adr/none.md": "ADR: none"}
    one = got["docs/adr/1-use-x.md"]
    assert one.details.count("\n") == 14 and one.tags == ["adr", "harvested:doc", "adr:docs/adr/1-use-x.md"] and (one.kind, one.confidence, one.provenance) == ("decision", 1.0, "ADR file docs/adr/1-use-x.md")
    logs = {r.summary: (r.files, r.details, r.tags[-1]) for r in harvest.changelog_sections(files, existing).collect()}
    assert logs == {"Changelog: 1.1": (["CHANGELOG.md"], "- one\n- two\n### Fixed", "changelog:1.1"), "Changelog: 1.0": (["CHANGELOG.md"], "first", "changelog:1.0")}


def test_what_a_file_calls(spark):
    from marlstone.operators import structural

    nodes = spark.createDataFrame([("f", "file", "a.ts", "a.ts"), ("ax", "function", "x", "a.ts"), ("y", "function", "y", "b.ts"), ("z", "function", "x", "c.ts")], "id string, kind string, name string, file_path string").selectExpr("*", "name as qualified_name", "1L as start_line")
    edges = spark.createDataFrame([("f", "y", "calls", 3), ("ax", "f", "calls", 1), ("z", "y", "calls", 9), ("z", "ax", "contains", 2)], "source string, target string, kind string, line long")
    by = lambda name: [(r.id, r.by) for r in structural.what_calls(nodes, edges, name).collect()]
    assert by("a.ts") == [("y", "f")] and by("x") == [("f", "ax"), ("y", "z")] and by("none") == []
