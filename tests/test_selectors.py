"""Labels, module scope and rungs by hand."""

from pyspark.sql import functions as F

from marlstone.operators import selectors as S

DECLS = "id string, file string, name string, kind string, container string, labels array<string>, exported boolean"
CALLS = "call_id string, file string, target string, receiver string, is_method boolean, receiver_type string, container string"


def test_modules_and_selectors(spark):
    paths = {"Sources/Core/Models/User.swift": ("Sources/Core", "Core"), "pkg/Tests/CoreTests/UserTests.swift": ("pkg/Tests/CoreTests", "CoreTests"), "App/View.swift": ("App", "App"), "main.swift": ("", ""), "Sources/x.swift": ("Sources", "Sources")}
    got = spark.createDataFrame([(p,) for p in paths], "p string").select("p", S.module_root(F.col("p")).alias("r"), S.module_name(F.col("p")).alias("m")).collect()
    assert {r.p: (r.r, r.m) for r in got} == paths
    targets = {"move(to:by:)": ("move", ["to", "by"]), "load()": ("load", []), "load": ("load", None)}
    got = spark.createDataFrame([(t,) for t in targets], "t string").select("t", S.base_name(F.col("t")).alias("b"), S.labels_of(F.col("t")).alias("l")).collect()
    assert {r.t: (r.b, r.l) for r in got} == targets
    pairs = [(["_", "*"], ["_", "completion"], True), (["to"], ["to", "by"], False), ([], [], True), (["to"], ["by"], False), (["to"], None, False)]
    got = spark.createDataFrame(pairs, "c array<string>, d array<string>, w boolean").select(S.labels_match(F.col("c"), F.col("d")).alias("m"), "w").collect()
    assert all(r.m == r.w for r in got)


def test_rungs(spark):
    core, app, other = "Sources/Core/a.swift", "Sources/App/b.swift", "Sources/App/c.swift"
    decls = [
        ("move1", core, "move", "method", "Shape", ["to"], True), ("move2", core, "move", "method", "Shape", ["to", "by"], True), ("move3", app, "move", "method", "Shape", ["to", "by"], True), ("case", core, "ok", "enum_member", "Result", [], True),
        ("load1", core, "load", "function", None, [], True), ("load2", core, "load", "function", None, ["from"], False), ("load3", app, "load", "function", None, ["from"], False), ("Shape", core, "Shape", "class", None, None, True), ("hidden", core, "hidden", "function", None, [], False),
    ]
    calls = [
        ("own", other, "move(to:)", None, False, None, "Shape"), ("self", other, "move(to:by:)", "self", True, None, "Shape"), ("near", core, "move(to:by:)", "self", True, None, "Shape"), ("typed", other, "move(to:)", "s", True, "Shape", None), ("static", other, "move(to:)", "Shape", True, None, None),
        ("none fit", other, "move(at:)", "Shape", True, None, None), ("case", other, "ok()", "Result", True, None, None), ("inside", other, "load(from:)", None, False, None, None), ("beyond", "Sources/Ui/u.swift", "load()", None, False, None, None), ("unseen", "Sources/Ui/u.swift", "hidden()", None, False, None, None),
        ("test", "Tests/CoreTests/t.swift", "hidden()", None, False, None, None), ("init", "Sources/Ui/u.swift", "Shape", None, False, None, None), ("nothing", other, "unknown()", None, False, None, None),
    ]
    imports = [("Sources/Ui/u.swift", "Core", False), ("Tests/CoreTests/t.swift", "Core", True), ("Tests/CoreTests/t.swift", "Core", False)]
    got = S.resolve_calls(spark.createDataFrame(calls, CALLS), spark.createDataFrame(decls, DECLS), spark.createDataFrame(imports, "file string, module string, testable boolean"))
    assert {r.call_id: (r.target_id, r.method) for r in got.collect()} == {
        "own": ("move1", "same_container"), "self": (None, "same_container"), "near": ("move2", "same_container"), "typed": ("move1", "type_annotation"), "static": ("move1", "qualifier_type"), "none fit": (None, "qualifier_type"), "case": ("case", "enum_case"),
        "inside": ("load3", "swift-module"), "beyond": ("load1", "swift-module"), "test": ("hidden", "swift-module"), "init": ("Shape", "swift-module"),
    }
