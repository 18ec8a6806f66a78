"""The folder walk and the column form of ignore files against git's rules written out."""

import os

import pytest
from pyspark.sql import functions as F

from marlstone.functions import text as T
from marlstone.sources.walk import FolderWalk, Walker

FILES = [
    "a.py", "build/x.o", "build/keep.txt", "out/log1.txt", "out/log12.txt", "out/logx.txt", "src/a.gen.py", "src/keep.gen.py", "src/deep/b.gen.py", "src/deep/c.py", "src/deep/local.cfg", "src/local.cfg", "docs/x/draft1.md", "docs/draft2.md",
    "node_modules/m/i.js", ".hidden/h.py", "lib/.secret", "lib/tmp", "lib/sub/tmp/f.py", "lib/[x].py", "data/a1/z.csv", "data/b1/z.csv", "data/c1/z.csv",
]
RULES = {
    "": ["# comment", "", "build/", "!build/keep.txt", "out/log[0-9].txt", "*.gen.py", "/local.cfg", "docs/**/draft*", "data/[!ab]1"],
    "src": ["!keep.gen.py", "/local.cfg"], "src/deep": ["!*.gen.py"], "lib": ["tmp/", "\\[x].py"],
}
LEFT = {"a.py", "out/log12.txt", "out/logx.txt", "src/keep.gen.py", "src/deep/b.gen.py", "src/deep/c.py", "src/deep/local.cfg", "lib/tmp", "data/a1/z.csv", "data/b1/z.csv"}


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    top = tmp_path_factory.mktemp("tree")
    for path in FILES:
        os.makedirs(top / os.path.dirname(path), exist_ok=True)
        (top / path).write_text(path)
    for folder, lines in RULES.items():
        (top / folder / ".gitignore").write_text("\n".join(lines) + "\n")
    return str(top)


@pytest.mark.parametrize("partitions", [1, 3, 64])
@pytest.mark.parametrize("scheme", ["", "file://"])
def test_walk(spark, root, partitions, scheme):
    spark.dataSource.register(FolderWalk)
    got = spark.read.format("folder_walk").option("path", scheme + root).option("partitions", partitions).load().collect()
    assert sorted(r.path for r in got) == sorted(LEFT) and all(r.bytes == len(r.path) for r in got)


def test_left_out_folders_are_not_listed(root):
    walker = Walker(root, ".gitignore", ("node_modules",))
    assert {p for p, _, _ in walker.walk("", ())} == LEFT
    assert set(walker.listed) == {"", "data", "data/a1", "data/b1", "docs", "docs/x", "lib", "lib/sub", "out", "src", "src/deep"}


def test_column_form_agrees(spark):
    visible = [f for f in FILES if not f.startswith((".", "node_modules")) and "/." not in f]
    got = spark.createDataFrame([(f,) for f in visible], "p string").select("p", T.ignored(F.col("p"), RULES).alias("out")).collect()
    assert {r.p for r in got if not r.out} == LEFT
    one = spark.createDataFrame([("build/keep.txt",), ("a0.log",), ("a[0-9].log",)], "p string").select("p", T.ignored(F.col("p"), ["build/", "!build/keep.txt", "a[0-9].log"]).alias("out"))
    assert {r.p: r.out for r in one.collect()} == {"build/keep.txt": True, "a0.log": True, "a[0-9].log": False}
