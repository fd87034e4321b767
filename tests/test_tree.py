import os
import subprocess

import pytest
from pyspark.sql import functions as F

from conftest import rows_of, sha1
from treeledger.plans.manifest import build_manifest, verify
from treeledger.schema import ZERO_DIGEST
from treeledger.sources.content import digest_files, file_digest
from treeledger.sources.tree import scan_tree


def write(root, path, text=""):
    full = os.path.join(root, path)
    os.makedirs(os.path.dirname(full), exist_ok=True)
    with open(full, "w") as out:
        out.write(text)


@pytest.fixture
def tree(tmp_path):
    root = str(tmp_path / "tree")
    for path in (".dot", "_under", "a b [*]?/x", "line\nbreak", "naïve/é", "empty"):
        write(root, path, "" if path == "empty" else path)
    for path in ("g/.git/HEAD", "g/in", "s/.svn", "s/t/u", "o/.sodignore", "o/in", "n/.snapshots/1/f", "n/in", ".treeledger/t"):
        write(root, path, path)
    os.makedirs(f"{root}/void/of/files")
    os.symlink("a b [*]?/x", f"{root}/to-file")
    os.symlink("gone", f"{root}/dangling")
    os.symlink("a b [*]?", f"{root}/to-dir")
    os.mkfifo(f"{root}/fifo")
    with open(os.fsencode(root) + b"/raw-\xff\xfe", "w") as out:
        out.write("raw")
    return root


KEPT = {".dot", "_under", "a b [*]?/x", "line\nbreak", "naïve/é", "empty", "n/in", "to-file", "dangling", "to-dir", "raw-\U000f00ff\U000f00fe"}


def test_scan(spark, tree):
    listing = scan_tree(spark, tree)
    rows = {row["path"]: row for row in listing.collect()}
    assert set(rows) == KEPT
    assert {p for p, row in rows.items() if row["kind"] == "link"} == {"to-file", "dangling", "to-dir"}
    assert rows["dangling"]["link_target"] == "gone"
    assert rows["_under"]["size"] == 6
    assert rows["_under"]["mtime_ns"] == os.stat(f"{tree}/_under").st_mtime_ns


def test_scan_in_small_rounds_finds_the_same(spark, tree):
    assert rows_of(scan_tree(spark, tree, budget=1), "path") == rows_of(scan_tree(spark, tree), "path")


def test_a_flag_in_the_root_empties_the_scan(spark, tree):
    os.mkdir(f"{tree}/.git")
    assert scan_tree(spark, tree).isEmpty()
    assert scan_tree(spark, tree, ["_under"]).isEmpty()


def test_scan_of_paths(spark, tree):
    found = scan_tree(spark, tree, ["naïve", "_under", "to-dir", "missing", "fifo", "g/in", "g", "n/.snapshots/1", "naïve/é", ".treeledger/t"])
    assert {row["path"] for row in found.collect()} == {"naïve/é", "_under", "to-dir"}
    assert {row["path"] for row in scan_tree(spark, tree, ["."]).collect()} == KEPT


def test_digests(spark, tree):
    os.symlink("x", f"{tree}/l")
    rows = {row["path"]: row for row in digest_files(scan_tree(spark, tree), tree).collect()}
    assert rows["_under"]["digest"] == sha1("_under")
    assert rows["empty"]["digest"] == sha1("")
    assert rows["to-dir"]["digest"] == sha1("a b [*]?")
    assert rows["raw-\U000f00ff\U000f00fe"]["digest"] == sha1("raw")
    alone = digest_files(scan_tree(spark, tree), tree, task_bytes=5)
    assert rows_of(alone, "path", "digest") == sorted((p, r["digest"]) for p, r in rows.items())


def test_what_cannot_be_read_gets_zeros(spark, tree):
    listing = scan_tree(spark, tree)
    os.unlink(f"{tree}/_under")
    found = digest_files(listing, tree).where("path = '_under'").first()
    assert found["digest"] == ZERO_DIGEST
    assert file_digest(tree) == ZERO_DIGEST


def test_manifest_reads_only_what_the_cache_does_not_know(spark, tree, tmp_path):
    first = build_manifest(spark, tree)
    first.cache.write.parquet(f"{tmp_path}/cache")
    cache = spark.read.parquet(f"{tmp_path}/cache")
    assert cache.count() == len(KEPT) - 3

    kept_time = os.stat(f"{tree}/_under").st_mtime_ns
    write(tree, "_under", "!under")
    os.utime(f"{tree}/_under", ns=(kept_time, kept_time))
    write(tree, "empty", "no more")
    os.utime(f"{tree}/empty", ns=(kept_time, kept_time + 10**9))

    again = build_manifest(spark, tree, cache)
    digests = {row["path"]: row["digest"] for row in again.manifest.collect()}
    assert digests["_under"] == sha1("_under")
    assert digests["empty"] == sha1("no more")

    anew = build_manifest(spark, tree, cache, rehash=True)
    assert {row["path"]: row["digest"] for row in anew.manifest.collect()}["_under"] == sha1("!under")
    assert anew.cache.where(F.col("path") == "_under").first()["digest"] == sha1("!under")

    changes = verify(first.manifest, anew.manifest, cache)
    assert rows_of(changes, "path", "status", "suspect") == [("_under", "M", True), ("empty", "M", False)]


def test_unreadable_directories_leave_no_rows(spark, tmp_path):
    root = str(tmp_path / "t")
    write(root, "locked/x")
    write(root, "open/y")
    os.chmod(f"{root}/locked", 0)
    try:
        found = {row["path"] for row in scan_tree(spark, root).collect()}
    finally:
        os.chmod(f"{root}/locked", 0o755)
    assert "open/y" in found
    assert found <= {"open/y", "locked/x"}


def test_many_entries_in_one_directory(spark, tmp_path):
    root = str(tmp_path / "wide")
    os.mkdir(root)
    subprocess.run(["bash", "-c", "touch f{1..12000}"], cwd=root, check=True)
    assert scan_tree(spark, root).count() == 12000


def test_roots_must_be_mounted(spark):
    with pytest.raises(ValueError, match="file system"):
        scan_tree(spark, "s3a://bucket/tree")
