"""Trees of digests against full comparisons."""

import random

from marlstone.operators import digests


def tree(spark, files):
    return digests.folder_tree(spark.createDataFrame(sorted(files.items()) or [], "path string, hash string")).repartition(3)


def by_comparison(old, new):
    out = {}
    for path in old.keys() | new.keys():
        if old.get(path) != new.get(path):
            out[path, True] = "added" if path not in old else "removed" if path not in new else "changed"
            parts = path.split("/")[:-1]
            for i in range(len(parts) + 1):
                out["/".join(parts[:i]), False] = None
    under = lambda files, folder: any(folder == "" or p.startswith(folder + "/") for p in files)
    return {k: v or ("added" if not under(old, k[0]) else "removed" if not under(new, k[0]) else "changed") for k, v in out.items()}


def test_changes_equal_a_full_comparison(spark):
    rng = random.Random(1)
    paths = ["/".join(rng.choice("abc") for _ in range(rng.randrange(1, 4))) + f"/f{i}" for i in range(120)] + ["top"]
    old = {p: str(rng.randrange(3)) for p in paths}
    new = dict(old)
    for p in rng.sample(paths, 8):
        new[p] = "other"
    for p in rng.sample(paths, 3):
        new.pop(p)
    new |= {"z/new/x": "1", "a/added": "2"}
    got = {(r.path, r.is_file): r.change for r in digests.changed(tree(spark, old), tree(spark, new)).collect()}
    assert got == by_comparison(old, new)
    assert digests.changed(tree(spark, old), tree(spark, old)).collect() == []
    assert digests.root_digest(tree(spark, old)) != digests.root_digest(tree(spark, new))


def test_names_and_moves_count(spark):
    a = digests.root_digest(tree(spark, {"x/a": "1", "y/b": "2"}))
    assert a == digests.root_digest(tree(spark, {"y/b": "2", "x/a": "1"}))
    assert len({a, *(digests.root_digest(tree(spark, f)) for f in ({"x/b": "1", "y/a": "2"}, {"x/a": "2", "y/b": "1"}, {"x/a/b": "1", "y/b": "2"}, {"y/b": "2"}))}) == 5
    assert digests.root_digest(tree(spark, {})) is None
