import pytest

from conftest import manifest, rows_of, sha1
from treeledger.operators.cache import parse_entries, probe_cache, refresh_cache, split_cached
from treeledger.operators.compare import compare
from treeledger.operators.history import log
from treeledger.plans.record import NothingStaged, commit
from treeledger.sources import tables
from treeledger.sources.stores import refresh_snapshots


def test_commits_on_disk(spark, golden, tmp_path):
    base = str(tmp_path)
    trees = [manifest(spark, files) for files in golden.revisions]
    first = commit(spark, base, trees[0], "Initial", when=0).first()
    assert first["adds_new_content"] is True
    with pytest.raises(NothingStaged):
        commit(spark, base, trees[0], "again")
    second = commit(spark, base, trees[1], "Change 1", when=86400).first()
    commit(spark, base, trees[2], "Change 2", when=172800)

    commits = tables.read_commits(spark, base)
    assert rows_of(commits, "seq", "message", "commit_time") == [(0, "Initial", 0), (1, "Change 1", 86400), (2, "Change 2", 172800)]
    assert second["parent_id"] == first["commit_id"]
    assert len(second["commit_id"]) == 40
    assert rows_of(tables.read_manifest(spark, base, second["commit_id"])) == rows_of(trees[1])
    found = log(commits, tables.read_manifest(spark, base)).where("seq = 1")
    assert rows_of(found, "status", "path") == [("M", golden.a), ("M", golden.d), ("R", golden.B)]


def test_a_move_alone_asks_for_no_snapshot(spark, tmp_path):
    base = str(tmp_path)
    commit(spark, base, manifest(spark, {"a": "1", "b": "2"}), "one")
    assert commit(spark, base, manifest(spark, {"c": "1"}), "two").first()["adds_new_content"] is False


def test_reading_one_revision_reads_one_partition(spark, tmp_path):
    base = str(tmp_path)
    tables.write_manifest(manifest(spark, {"a": "1"}), base, "r1")
    tables.write_manifest(manifest(spark, {"b": "2"}), base, "r2")
    one = tables.read_manifest(spark, base, "r1")
    assert rows_of(one, "path") == [("a",)]
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(revision" in plan


def test_cache_generations(spark, tmp_path):
    base = str(tmp_path)
    assert tables.read_cache(spark, base).isEmpty()
    schema = "path string, version int, mtime_ns long, algorithm string, digest string"
    tables.write_cache(spark.createDataFrame([("a", 1, 1, "sha1", "x")], schema), base)
    cache = tables.read_cache(spark, base)
    tables.write_cache(cache.unionByName(spark.createDataFrame([("b", 1, 1, "sha1", "y")], schema), True), base)
    assert rows_of(tables.read_cache(spark, base), "path") == [("a",), ("b",)]


def test_snapshot_table_forgets_what_vanished(spark, tmp_path):
    base = str(tmp_path)
    schema = "store string, snapshot_id string, base_commit_id string, reference string"
    assert tables.read_snapshots(spark, base).isEmpty()
    tables.write_snapshots(spark.createDataFrame([("s", "1", "c", "s/1"), ("t", None, "c", "t")], schema), base)
    old = tables.read_snapshots(spark, base)
    stores = spark.createDataFrame([("s", "/s/*", 0), ("t", "/t", 1)], "store string, url string, ordinal int")
    tables.write_snapshots(refresh_snapshots(old, old.where("false"), stores, ["s"]), base)
    assert rows_of(tables.read_snapshots(spark, base)) == [("t", None, "c", "t")]


def test_link_targets_are_kept_once(spark, tmp_path):
    base = str(tmp_path)
    links = spark.createDataFrame([("d1", "x"), ("d1", "x"), ("d2", "y")], "digest string, link_target string")
    tables.append_links(links, base)
    tables.append_links(links.union(spark.createDataFrame([("d3", "z")], links.schema)), base)
    assert rows_of(tables.read_links(spark, base)) == [("d1", "x"), ("d2", "y"), ("d3", "z")]


def test_bucketed_revisions_compare_without_a_shuffle(spark, golden, tmp_path):
    spark.sql(f"CREATE DATABASE IF NOT EXISTS buckets LOCATION '{tmp_path}/db'")
    rows = manifest(spark, golden.r0).selectExpr("*", "'r0' AS revision").union(manifest(spark, golden.r1).selectExpr("*", "'r1' AS revision"))
    tables.save_bucketed(rows, "buckets.manifests", 4)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        stored = spark.table("buckets.manifests")
        delta = compare(stored.where("revision = 'r0'"), stored.where("revision = 'r1'"))
        assert "Exchange" not in delta._jdf.queryExecution().executedPlan().toString()
        assert rows_of(delta, "status", "path") == [("A", golden.B), ("D", golden.b), ("M", golden.a), ("M", golden.d)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        spark.sql("DROP DATABASE buckets CASCADE")


def test_cache_states(spark):
    listing = spark.createDataFrame([(p, "blob", 1, 100, None) for p in "abcdefg"], "path string, kind string, size long, mtime_ns long, link_target string")
    cache = spark.createDataFrame(
        [("a", 1, 100, "sha1", "x"), ("b", 1, 99, "sha1", "x"), ("c", 2, 99, "md5", "x"), ("d", 1, 1, "md5", "x"), ("e", 1, 100, "sha1", ""), ("f", None, 500, "sha1", "x"), ("z", 1, 1, "sha1", "z")],
        "path string, version int, mtime_ns long, algorithm string, digest string",
    )
    states = {row["path"]: row["cache_state"] for row in probe_cache(listing, cache).collect()}
    assert states == {"a": "hit", "b": "outdated", "c": "bad_version", "d": "bad_algorithm", "e": "empty", "f": "bad_version", "g": "absent"}
    hits, misses = split_cached(listing, cache)
    assert rows_of(hits, "path", "digest") == [("a", "x")]
    assert misses.count() == 6 and misses.columns == listing.columns
    assert split_cached(listing, cache, rehash=True)[0].isEmpty()
    fresh = refresh_cache(cache, listing.where("path = 'b'").selectExpr("*", f"'{sha1('b')}' AS digest"))
    assert rows_of(fresh.where("path IN ('b', 'z')"), "path", "version", "mtime_ns", "algorithm", "digest") == [("b", 1, 100, "sha1", sha1("b")), ("z", 1, 1, "sha1", "z")]


def test_cache_entries_as_text(spark):
    entries = spark.createDataFrame(
        [("a", "1:5:sha1:ff"), ("b", "x:5:sha1:ff"), ("c", "1:5:sha1"), ("d", "")], "path string, entry string"
    )
    assert rows_of(parse_entries(entries)) == [("a", 1, 5, "sha1", "ff"), ("b", None, 5, "sha1", "ff")]
