import random

import pytest
from pyspark.sql import functions as F

from docloom.operators import trees
from docloom.operators.maintenance import detect_changes

SCAN = "path string, mtime double, size_bytes long, content_hash string"
KNOWN = f"file_id long, {SCAN}, status string"


def listing(seed, n=400):
    rng = random.Random(seed)
    paths = {"/" + "/".join(f"d{rng.randint(0, 3)}" for _ in range(rng.randint(0, 5))) + f"/f{i}.md" for i in range(n)}
    paths |= {"rel/a.md", "rel/b/c.md", "top.md", "hdfs:///docs/x.md", "//odd/y.md"}
    return {p: (100.0 + i, 10, f"h{i}") for i, p in enumerate(sorted(paths))}


def frames(spark, scan, known):
    return (
        spark.createDataFrame([(p, *v) for p, v in scan.items()], SCAN).repartition(3),
        spark.createDataFrame([(i, p, *v) for i, (p, v) in enumerate(known.items())], KNOWN).repartition(4),
    )


def check(spark, scan, known, looked=None):
    new, old = frames(spark, scan, known)
    changes, gone = trees.detect_changes_tree(new, old, looked=looked)
    want = detect_changes(new, old).filter("state <> 'unchanged'")
    got = sorted(map(repr, changes.select("path", "file_id", "state").collect()))
    assert got == sorted(map(repr, want.select("path", "file_id", "state").collect()))
    assert sorted(r.path for r in gone.collect()) == sorted(set(known) - set(scan))
    return got


@pytest.mark.parametrize("seed", range(4))
def test_same_as_joining_everything(spark, seed):
    scan = listing(seed)
    rng = random.Random(100 + seed)
    known = {}
    for path, (mtime, size, digest) in scan.items():
        kind = rng.random()
        if kind < 0.05:
            continue  # new
        moved = 0.5 if kind < 0.1 else 3.0 if kind < 0.15 else 0.0
        known[path] = (mtime + moved, size, digest if kind < 0.9 else "other", "error" if 0.2 < kind < 0.24 else "indexed")
    known |= {f"/gone/{i}.md": (1.0, 1, "x", "indexed") for i in range(3)}
    check(spark, scan, known)


def test_equal_folders_are_not_looked_at(spark):
    scan = {f"/r/{a}/{b}/f{i}.md": (1.0, 1, f"h{a}{b}{i}") for a in range(12) for b in range(5) for i in range(4)}
    known = {p: (*v, "indexed") for p, v in scan.items()}
    looked = trees.Looked()
    assert check(spark, scan, known, looked) == [] and looked.files == 0 and looked.folders == 1
    known["/r/3/2/f1.md"] = (1.0, 1, "other", "indexed")
    looked = trees.Looked()
    assert len(check(spark, scan, known, looked)) == 1
    # Of 240 files on each side, those of the four folders on the way: one holds files.
    assert looked.files == 8 and looked.folders == 1 + 1 + 12 + 5 and looked.levels == 4


def test_kept_tree(spark):
    scan = listing(9)
    known = {p: (*v, "indexed") for p, v in scan.items() if p != "top.md"}
    new, old = frames(spark, scan, known)
    changes, _ = trees.detect_changes_tree(new, old, trees.folder_tree(old))
    assert [(r.path, r.state) for r in changes.collect()] == [("top.md", "new")]


def test_digests_do_not_cancel(spark):
    """Two equal entries, or entries exchanged between folders, are not nothing."""
    one = {"/a/x.md": (1.0, 1, "h")}
    new, _ = frames(spark, one, {"/q": (1.0, 1, "h", "indexed")})
    twice = new.unionByName(new)
    sums = {tuple(r)[3:] for t in (new, twice, twice.unionByName(twice)) for r in trees.folder_tree(t).filter("folder = '/a'").collect()}
    assert len(sums) == 3
    a = trees.folder_tree(frames(spark, {"/a/x": (1.0, 1, "h"), "/b/y": (1.0, 1, "i")}, {"/q": (1.0, 1, "h", "indexed")})[0])
    b = trees.folder_tree(frames(spark, {"/a/y": (1.0, 1, "i"), "/b/x": (1.0, 1, "h")}, {"/q": (1.0, 1, "h", "indexed")})[0])
    assert a.join(b, ["folder", "n", "x1", "x2", "s"]).count() == 0


def test_empty(spark):
    scan = {"/a/x.md": (1.0, 1, "h"), "/y.md": (1.0, 1, "h")}
    new, old = frames(spark, scan, {"/a/x.md": (1.0, 1, "h", "indexed")})
    changes, gone = trees.detect_changes_tree(new, old.limit(0))
    assert {r.state for r in changes.collect()} == {"new"} and gone.count() == 0
    changes, gone = trees.detect_changes_tree(new.limit(0), old)
    assert changes.count() == 0 and gone.count() == 1
    changes, gone = trees.detect_changes_tree(new.limit(0), old.limit(0))
    assert changes.count() == 0 and gone.count() == 0


def test_folders(spark):
    rows = spark.createDataFrame([(p,) for p in ("/a/b.md", "/a", "a", "", "a/b/c", "hdfs:///d/x")], "path string")
    folder = trees.folder_of(F.col("path"))
    got = {r.path: (r.f, r.d) for r in rows.select("path", folder.alias("f"), trees.depth_of(folder).alias("d")).collect()}
    assert got == {"/a/b.md": ("/a", 1), "/a": ("", 0), "a": ("", 0), "": (None, None), "a/b/c": ("a/b", 2), "hdfs:///d/x": ("hdfs:///d", 4)}
