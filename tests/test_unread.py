"""What cannot be read is a row of its own and is not taken for deleted."""

import errno
import os

import pytest

from conftest import manifest, rows_of, sha1
from treeledger.operators.compare import diff, diff_pruned, differing_dirs, in_dirs
from treeledger.operators.constrain import keep_unread
from treeledger.operators.rollup import dir_rollup
from treeledger.plans.manifest import Unread, build_manifest, settle_unread
from treeledger.plans.record import commit
from treeledger.sources import stores, tables, tree


class Broken:
    """A directory whose reading stops after some entries, as a failing disk has it."""

    def __init__(self, path, entries):
        self.path, self.entries = path, list(os.scandir(path))[:entries]

    def __enter__(self):
        return self

    def __exit__(self, *_):
        return False

    def __iter__(self):
        yield from self.entries
        raise OSError(errno.EIO, os.strerror(errno.EIO))


def test_a_directory_that_cannot_be_read_is_a_row(tmp_path, monkeypatch):
    for name in "abc":
        (tmp_path / name).write_text(name)
    broken = Broken(tmp_path, 2)
    monkeypatch.setattr(tree.os, "scandir", lambda path: broken)
    rows = list(tree._list_dir(str(tmp_path), "", (), ()))
    assert [r[1] for r in rows] == ["blob", "blob", "unread"] and rows[-1][0] == "" and rows[-1][4] == os.strerror(errno.EIO)

    def refuse(path):
        raise PermissionError(errno.EACCES, os.strerror(errno.EACCES))

    monkeypatch.setattr(tree.os, "scandir", refuse)
    assert [(r[0], r[1]) for r in tree._list_dir(str(tmp_path.parent), tmp_path.name, (), ())] == [(tmp_path.name, "unread")]
    monkeypatch.setattr(tree.os, "readlink", refuse)
    os.symlink("x", tmp_path / "ln")
    assert tree._entry(str(tmp_path), "ln")[1] == "unread"


def test_a_tree_that_is_not_mounted_is_not_an_empty_one(spark, tmp_path):
    root = tmp_path / "tree"
    (root / "x").mkdir(parents=True)
    (root / "x" / "a").write_text("a")
    base = str(tmp_path / "ledger")
    state = build_manifest(spark, str(root))
    assert state.unread.isEmpty()
    commit(spark, base, state.manifest.select("path", "kind", "digest"), "one", unread=state.unread)
    gone = build_manifest(spark, str(tmp_path / "nowhere"))
    assert gone.manifest.isEmpty() and rows_of(gone.unread, "path") == [("",)]
    staged = gone.manifest.select("path", "kind", "digest")
    with pytest.raises(Unread, match=r"not read: \. \(No such file or directory\)"):
        commit(spark, base, staged, "two", unread=gone.unread)
    assert tables.read_commits(spark, base).count() == 1
    # Told to, the commit takes what was not read for deleted, or keeps it: then nothing has changed.
    with pytest.raises(ValueError, match="no changes staged"):
        commit(spark, base, staged, "two", unread=gone.unread, mode="keep")
    commit(spark, base, staged, "two", unread=gone.unread, mode="drop")
    assert tables.read_manifest(spark, base, tables.read_commits(spark, base).where("seq = 1").first()["commit_id"]).isEmpty()
    given = build_manifest(spark, str(tmp_path / "nowhere"), paths=["x", "y/z"])
    assert rows_of(given.unread, "path") == [("x",), ("y/z",)]


def test_old_entries_stay_below_what_was_not_read(spark):
    old = manifest(spark, {"a/b/1": "1", "a/b/2": "2", "a/c": "3", "ln": "4", "bad/x": "5"})
    new = manifest(spark, {"a/b/2": "new", "a/c2": "3", "a/b/3": "6"})
    unread = spark.createDataFrame([("a/b", "EIO"), ("ln", "EACCES")], "path string, reason string")
    kept = keep_unread(old, new, unread)
    assert rows_of(kept, "path", "digest") == sorted((p, sha1(c)) for p, c in {"a/b/1": "1", "a/b/2": "new", "a/b/3": "6", "a/c2": "3", "ln": "4"}.items())
    assert rows_of(diff(old, kept), "status", "path") == [("A", "a/b/3"), ("D", "bad/x"), ("M", "a/b/2"), ("R", "a/c2")]
    assert settle_unread(new, unread, old, "drop") is new
    assert settle_unread(new, unread.where("false"), old) is new
    with pytest.raises(ValueError):
        settle_unread(new, unread, old, "guess")


def test_stores_and_ledgers_that_cannot_be_read(spark, tmp_path):
    for number, files in (("1", ["commits"]), ("2", ["commits"]), ("3", []), ("4", None)):
        ledger = tmp_path / "store" / number / ".treeledger"
        if files is None:
            ledger.parent.mkdir(parents=True)
            continue
        for name in files or [""]:
            (ledger / name).mkdir(parents=True)
    good = spark.createDataFrame([(f"c{n}", None, n, 0, 0, "") for n in range(3)], tables.COMMITS)
    good.repartition(2).write.mode("overwrite").parquet(str(tmp_path / "store" / "1" / ".treeledger" / "commits"))
    (tmp_path / "store" / "2" / ".treeledger" / "commits" / "part.parquet").write_text("this is no parquet")
    (tmp_path / "file").write_text("not a folder")
    listed = spark.createDataFrame(
        [("good", f"{tmp_path}/store/*", 0), ("lost", f"{tmp_path}/nowhere/*", 1), ("odd", f"{tmp_path}/file/*", 2), ("one", f"{tmp_path}/gone", 3)],
        "store string, url string, ordinal int",
    )
    copies = stores.read_copies(listed)
    assert rows_of(copies.found, "store", "snapshot_id") == [("good", "1"), ("good", "2"), ("good", "3"), ("one", None)]
    assert [r["store"] for r in copies.unread.orderBy("store").collect()] == ["lost", "odd"]
    heads = stores.read_base_commits(copies.found)
    assert rows_of(heads.found, "reference", "base_commit_id") == [("good/1", "c2")]
    assert sorted((r["store"], r["snapshot_id"] or "") for r in heads.unread.collect()) == [("good", "2"), ("one", "")]

    old = spark.createDataFrame(
        [("good", "1", "c0", "good/1"), ("good", "2", "c0", "good/2"), ("good", "9", "c0", "good/9"), ("lost", "5", "c1", "lost/5"), ("one", None, "c1", "one")],
        "store string, snapshot_id string, base_commit_id string, reference string",
    )
    unread = copies.unread.unionByName(heads.unread)
    fresh = stores.refresh_snapshots(old, heads.found, listed, unread=unread)
    assert rows_of(fresh, "reference", "base_commit_id") == [("good/1", "c2"), ("good/2", "c0"), ("lost/5", "c1"), ("one", "c1")]
    some = stores.refresh_snapshots(old, heads.found, listed, ["good"], unread)
    assert rows_of(some, "reference", "base_commit_id") == [("good/1", "c2"), ("good/2", "c0"), ("lost/5", "c1"), ("one", "c1")]


def test_equal_directories_are_not_compared(spark):
    old = spark.range(4000).selectExpr("concat('d', id % 8, '/e', id % 40, '/f', id) AS path", "'blob' AS kind", "sha1(CAST(id AS STRING)) AS digest")
    # A change, a file that moves to another directory, and a new one.
    new = old.selectExpr("CASE path WHEN 'd3/e3/f43' THEN 'd5/f43' ELSE path END AS path", "kind", "if(path = 'd1/e1/f1', sha1('x'), digest) AS digest")
    new = new.union(manifest(spark, {"new/sub/x": "x"}))
    rollups = dir_rollup(old), dir_rollup(new)
    dirs = differing_dirs(*rollups)
    assert rows_of(dirs, "dir") == sorted((d,) for d in ["", "d1", "d1/e1", "d3", "d3/e3", "d5", "new", "new/sub"])
    # Two directories of a hundred files each, of four thousand files.
    assert in_dirs(old, dirs).count() == 200
    found = diff_pruned(old, new, *rollups)
    assert rows_of(found) == rows_of(diff(old, new)) and rows_of(found, "status") == [("A",), ("M",), ("R",)]
    assert diff_pruned(old, old, rollups[0], rollups[0]).isEmpty()
    nothing = old.where("false")
    assert diff_pruned(nothing, old, dir_rollup(nothing), rollups[0]).count() == 4000
    with pytest.raises(ValueError):
        diff_pruned(old, new, *rollups, copies=True)
