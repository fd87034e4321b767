"""Digests belong to files, generations are complete or do not count, names and requests are told apart."""

import os

import pytest

from conftest import rows_of, sha1
from treeledger.operators.compare import compare, diff
from treeledger.operators.history import resolve_refs, with_times
from treeledger.plans import manifest as trees
from treeledger.plans.manifest import build_manifest
from treeledger.schema import ZERO_DIGEST
from treeledger.sources import content, tables
from treeledger.sources.names import to_name, to_text


def put(path, text, when):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as out:
        out.write(text)
    os.utime(path, ns=(when, when))


def kept(spark, state, base):
    tables.write_cache(state.cache, base)
    return tables.read_cache(spark, base)


@pytest.fixture
def tree(spark, tmp_path):
    root = str(tmp_path / "tree")
    put(f"{root}/a", "content of a", 2_000_000_000)
    put(f"{root}/b", "content of b", 1_000_000_000)
    put(f"{root}/d/c", "content of c", 3_000_000_000)
    return root, kept(spark, build_manifest(spark, root), str(tmp_path / "ledger"))


def digests(state):
    return {row["path"]: row["digest"] for row in state.manifest.collect()}


def test_an_older_file_in_place_of_another_is_seen(spark, tree):
    root, cache = tree
    os.replace(f"{root}/b", f"{root}/a")
    assert digests(build_manifest(spark, root, cache)) == {"a": sha1("content of b"), "d/c": sha1("content of c")}


def test_a_copy_in_place_of_a_deleted_file_is_read(spark, tree):
    root, cache = tree
    os.unlink(f"{root}/a")
    put(f"{root}/a", "other text, older", 500_000_000)
    assert digests(build_manifest(spark, root, cache))["a"] == sha1("other text, older")


def test_a_moved_tree_opens_no_file(spark, tree, monkeypatch):
    root, cache = tree
    os.rename(f"{root}/d", f"{root}/e")
    os.rename(f"{root}/a", f"{root}/moved a")
    asked = []
    whole = content.digest_files

    def watched(listing, *args):
        asked.extend(row["path"] for row in listing.collect())
        return whole(listing, *args)

    monkeypatch.setattr(trees, "digest_files", watched)
    found = build_manifest(spark, root, cache)
    assert digests(found) == {"moved a": sha1("content of a"), "b": sha1("content of b"), "e/c": sha1("content of c")}
    assert asked == []
    # The cache has the new paths and not the old ones.
    assert {row["path"] for row in found.cache.collect()} == {"moved a", "b", "e/c"}


def test_vanished_paths_leave_the_cache_where_it_was_listed(spark, tree):
    root, cache = tree
    os.unlink(f"{root}/d/c")
    os.unlink(f"{root}/a")
    part = build_manifest(spark, root, cache, paths=["d", "b"])
    assert {row["path"] for row in part.cache.collect()} == {"a", "b"}
    assert {row["path"] for row in build_manifest(spark, root, cache).cache.collect()} == {"b"}


def test_what_could_not_be_read_is_tried_again(spark, tree, monkeypatch):
    root, _ = tree
    monkeypatch.setattr(content, "file_digest", lambda path: ZERO_DIGEST)
    listing = build_manifest(spark, root).listing
    zero = listing.selectExpr("*", f"'{ZERO_DIGEST}' AS digest")
    from treeledger.operators.cache import probe_cache, refresh_cache

    empty = spark.createDataFrame([], "path string, digest string")
    assert refresh_cache(empty, zero).isEmpty()
    stored = zero.selectExpr("path", "1 AS version", "mtime_ns", "'sha1' AS algorithm", "digest", "size", "dev", "inode", "ctime_ns")
    assert {row["cache_state"] for row in probe_cache(listing, stored).collect()} == {"unreadable"}


def test_hard_links_are_one_file(spark, tree, tmp_path):
    root, _ = tree
    os.link(f"{root}/a", f"{root}/a2")
    cache = kept(spark, build_manifest(spark, root), str(tmp_path / "second"))
    assert digests(build_manifest(spark, root, cache))["a2"] == sha1("content of a")


def test_an_empty_generation_counts(spark, tmp_path):
    base = str(tmp_path)
    schema = "store string, snapshot_id string, base_commit_id string, reference string"
    full = spark.createDataFrame([("s", "1", "c", "s/1")], schema)
    tables.write_snapshots(full, base)
    tables.write_snapshots(full.where("false"), base)
    assert tables.read_snapshots(spark, base).isEmpty()
    tables.write_snapshots(full, base)
    assert tables.read_snapshots(spark, base).count() == 1


def test_a_generation_that_was_not_finished_does_not_count(spark, tmp_path):
    base = str(tmp_path)
    schema = "store string, snapshot_id string, base_commit_id string, reference string"
    tables.write_snapshots(spark.createDataFrame([("s", "1", "c", "s/1")], schema), base)
    tables.write_snapshots(spark.createDataFrame([("t", "1", "c", "t/1")], schema), base)
    os.unlink(f"{base}/snapshots/generation=1/_SUCCESS")
    assert rows_of(tables.read_snapshots(spark, base), "store") == [("s",)]
    for store in ("u", "v"):
        tables.write_snapshots(spark.createDataFrame([(store, "1", "c", "x")], schema), base)
        assert rows_of(tables.read_snapshots(spark, base), "store") == [(store,)]


@pytest.mark.parametrize("name", ["plain", "\udcff\udcfe", "x\U000f0085y", "\U000f0080\udc80\U000f00ff", "é\udcc3"])
def test_names_come_back(name):
    text = to_text(name)
    assert to_name(text) == name and not any(0xD800 <= ord(c) < 0xE000 for c in text)


def test_unreadable_files_may_differ(spark):
    rows = [("a", "blob", ZERO_DIGEST), ("b", "blob", ZERO_DIGEST), ("c", "blob", sha1("c"))]
    old = spark.createDataFrame(rows, "path string, kind string, digest string")
    new = spark.createDataFrame([rows[0], ("n", "blob", ZERO_DIGEST), rows[2]], old.schema)
    assert rows_of(compare(old, new, match_unreadable=False), "status", "path") == [("A", "n"), ("D", "b"), ("M", "a")]
    assert rows_of(diff(old, new, copies=True, match_unreadable=False), "status", "path") == [("A", "n"), ("D", "b"), ("M", "a")]
    assert rows_of(diff(old, new), "status", "path") == [("R", "n")]


def test_steps_back_from_any_name(spark, history):
    ids, commits, _, snapshots, _ = history
    wanted = {
        "HEAD": 2, "@": 2, "master": 2, "HEAD^": 1, "HEAD^^": 0, "HEAD~2": 0, "HEAD~1^": 0, "@~1": 1, "HEAD^0": 2, "HEAD~0^1": 1,
        "aux1/3~2": 0, "aux1/2^": 0, f"{ids[2][:8]}^": 1, f"{ids[1].upper()}~1": 0, "HEAD~": 1,
        "HEAD^^^": None, "HEAD^2": None, "HEAD~99999999999999999999": None, f"{ids[0]}^": None, "~1": None, "HEADx": None,
    }
    refs = spark.createDataFrame([(name,) for name in wanted], "ref string")
    found = {row["ref"]: row for row in resolve_refs(refs, commits, snapshots).collect()}
    assert {name: row["seq"] for name, row in found.items()} == wanted
    assert all(row["commit_id"] == (None if row["seq"] is None else ids[row["seq"]]) for row in found.values())
    assert all((row["problem"] is None) == (row["seq"] is not None) for row in found.values())


def test_commit_times(spark):
    rows = [(0, 60), (-3600, -90), (1_700_000_000, 330)]
    found = with_times(spark.createDataFrame(rows, "commit_time long, tz_offset_min int")).collect()
    assert [row["local_time"] for row in found] == ["1970-01-01 01:00:00 +01:00", "1969-12-31 21:30:00 -01:30", "2023-11-15 03:43:20 +05:30"]
