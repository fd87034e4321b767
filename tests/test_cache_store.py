"""The stored cache: buckets that a run changes are written, others stay; files are known by path first."""

import os

import pytest

from conftest import rows_of, sha1
from treeledger.operators.cache import cache_changes, probe_by_path_first, probe_cache, refresh_cache
from treeledger.plans.manifest import build_manifest
from treeledger.schema import CACHE_CHANGES, DIGEST_CACHE
from treeledger.sources import cache_store, ledger, tables

COLUMNS = "path string, kind string, size long, mtime_ns long, dev long, inode long, ctime_ns long"


def entries(spark, n, first=0):
    return spark.range(first, first + n).selectExpr(
        "concat('d', id % 7, '/', id) AS path", "1 AS version", "id AS mtime_ns", "'sha1' AS algorithm",
        "sha1(CAST(id AS STRING)) AS digest", "id AS size", "1L AS dev", "id AS inode", "id AS ctime_ns",
    )


def changes(spark, put=(), gone=()):
    rows = [(p, 1, 5, "sha1", sha1(p), 1, 1, 10**6, 5, False) for p in put]
    rows += [(p, *[None] * 8, True) for p in gone]
    return spark.createDataFrame(rows, CACHE_CHANGES)


def files(base):
    return {os.path.join(d, f) for d, _, names in os.walk(f"{base}/digest_cache/rows") for f in names if f.endswith(".parquet")}


def test_only_touched_buckets_are_written(spark, tmp_path):
    base = str(tmp_path)
    tables.write_cache(entries(spark, 2000), base, 32)
    before = files(base)
    assert len(before) == 32
    assert tables.update_cache(spark, base, changes(spark, put=["new"], gone=["d0/0"])) <= 2
    assert 1 <= len(files(base) - before) <= 2
    found = {row["path"]: row["digest"] for row in tables.read_cache(spark, base).collect()}
    wanted = {row["path"]: row["digest"] for row in entries(spark, 2000).collect()} | {"new": sha1("new")}
    del wanted["d0/0"]
    assert found == wanted
    # What was before is still there to read.
    assert cache_store.read(spark, base, 0).count() == 2000
    assert tables.update_cache(spark, base, changes(spark).limit(0)) == 0
    assert len(cache_store._heads(spark, base)) == 2


def test_a_bucket_may_lose_all_its_rows(spark, tmp_path):
    base = str(tmp_path)
    tables.write_cache(entries(spark, 3), base, 2)
    paths = [row["path"] for row in tables.read_cache(spark, base).collect()]
    tables.update_cache(spark, base, changes(spark, gone=paths))
    assert tables.read_cache(spark, base).isEmpty()
    tables.update_cache(spark, base, changes(spark, put=["x"]))
    assert rows_of(tables.read_cache(spark, base), "path") == [("x",)]


def test_a_cache_that_grew_gets_more_buckets(spark, tmp_path, monkeypatch):
    base = str(tmp_path)
    monkeypatch.setattr(cache_store, "BUCKET_ROWS", 10)
    tables.write_cache(entries(spark, 10), base)
    assert cache_store.buckets(spark, base).count() == 1
    for first, wanted in ((10, 6), (60, 6)):
        added = entries(spark, 50, first).selectExpr("*", "false AS gone")
        tables.update_cache(spark, base, added)
        assert cache_store.buckets(spark, base).count() == wanted
    assert rows_of(tables.read_cache(spark, base), "path") == rows_of(entries(spark, 110), "path")


def test_a_first_run_spreads_what_it_found(spark, tmp_path, monkeypatch):
    base = str(tmp_path)
    monkeypatch.setattr(cache_store, "BUCKET_ROWS", 10)
    tables.update_cache(spark, base, entries(spark, 100).selectExpr("*", "false AS gone"))
    assert cache_store.buckets(spark, base).count() == 10
    assert rows_of(tables.read_cache(spark, base), "path") == rows_of(entries(spark, 100), "path")


def test_of_two_writers_one_gets_the_version(spark, tmp_path):
    base = str(tmp_path)
    tables.write_cache(entries(spark, 10), base, 2)
    ledger.claim(spark, f"{base}/digest_cache", 1)
    with pytest.raises(ledger.Taken):
        tables.update_cache(spark, base, changes(spark, put=["x"]))
    assert tables.read_cache(spark, base).count() == 10
    ledger.release(spark, f"{base}/digest_cache", 1)
    tables.update_cache(spark, base, changes(spark, put=["x"]))
    assert tables.read_cache(spark, base).count() == 11


def test_an_unfinished_version_does_not_count(spark, tmp_path):
    base = str(tmp_path)
    tables.write_cache(entries(spark, 10), base, 2)
    tables.update_cache(spark, base, changes(spark, put=["x"]))
    os.unlink(f"{base}/digest_cache/heads/version=1/_SUCCESS")
    assert tables.read_cache(spark, base).count() == 10


def test_a_cache_of_whole_generations_becomes_buckets(spark, tmp_path):
    base = str(tmp_path)
    tables._write_generation(entries(spark, 20), base, "digest_cache", DIGEST_CACHE)
    assert tables.read_cache(spark, base).count() == 20
    tables.update_cache(spark, base, changes(spark, put=["x"]))
    assert tables.read_cache(spark, base).count() == 21


def test_changes_lead_to_the_refreshed_cache(spark, tmp_path):
    base = str(tmp_path)
    tables.write_cache(entries(spark, 100), base, 8)
    known = tables.read_cache(spark, base)
    hits = known.where("inode >= 10").selectExpr("if(inode = 50, 'moved', path) AS path", "digest", "mtime_ns", "size", "dev", "inode", "ctime_ns")
    read = spark.createDataFrame([("a", sha1("a"), 7), ("bad", "0" * 40, 7)], "path string, digest string, mtime_ns long")
    for args in ((hits,), (), (hits.where("path LIKE 'd1/%'"), ["d1"])):
        found = cache_changes(known, read, *args)
        wanted = refresh_cache(known, read, *args)
        kept = known.join(found, "path", "left_anti").unionByName(found.where("NOT gone").drop("gone"))
        assert rows_of(kept, *DIGEST_CACHE.names) == rows_of(wanted, *DIGEST_CACHE.names)
    # Ten that are gone, one that moved, one that was read.
    assert cache_changes(known, read, hits).count() == 13


def test_files_are_known_by_path_first(spark):
    """Moved, replaced, linked twice, without identity, changed: as with both lookups for all."""
    listing = spark.createDataFrame(
        [
            ("same", "blob", 1, 10, 1, 1, 10), ("to", "blob", 1, 10, 1, 2, 99), ("replaced", "blob", 1, 10, 1, 77, 99),
            ("second name", "blob", 1, 10, 1, 1, 10), ("plain", "blob", 1, 10, None, None, None), ("old entry", "blob", 1, 10, 1, 5, 10),
            ("edited", "blob", 1, 20, 1, 6, 20), ("new", "blob", 1, 10, 1, 8, 10), ("plain new", "blob", 1, 10, None, None, None),
            ("swapped", "blob", 1, 10, 1, 9, 99), ("was swapped", "blob", 1, 10, 1, 10, 99),
        ],
        COLUMNS,
    )
    cache = spark.createDataFrame(
        [
            (p, 1, 10, "sha1", sha1(p), 1, dev, inode, 10)
            for p, dev, inode in [
                ("same", 1, 1), ("from", 1, 2), ("replaced", 1, 3), ("plain", None, None), ("old entry", None, None),
                ("edited", 1, 6), ("swapped", 1, 10), ("was swapped", 1, 9),
            ]
        ],
        DIGEST_CACHE,
    )
    found = rows_of(probe_by_path_first(listing, cache), "path", "cache_state", "digest")
    assert found == rows_of(probe_cache(listing, cache), "path", "cache_state", "digest")
    states = {path: state for path, state, _ in found}
    assert [p for p, s in states.items() if s != "hit"] == ["edited", "new", "plain new", "replaced"]
    for part in (listing.limit(0), listing):
        assert {r["cache_state"] for r in probe_by_path_first(part, cache.limit(0)).collect()} <= {"absent"}


def test_a_run_stores_what_it_changed(spark, tmp_path):
    root, base = str(tmp_path / "tree"), str(tmp_path / "ledger")
    for n in range(40):
        os.makedirs(f"{root}/d{n % 3}", exist_ok=True)
        with open(f"{root}/d{n % 3}/f{n}", "w") as out:
            out.write(f"content {n}")
        os.utime(f"{root}/d{n % 3}/f{n}", ns=(10**9, 10**9))
    tables.write_cache(build_manifest(spark, root).cache, base, 16)
    os.unlink(f"{root}/d0/f0")
    os.rename(f"{root}/d1/f1", f"{root}/d1/moved")
    state = build_manifest(spark, root, cache=tables.read_cache(spark, base))
    assert rows_of(state.cache_changes, "path", "gone") == [("d0/f0", True), ("d1/f1", True), ("d1/moved", False)]
    assert tables.update_cache(spark, base, state.cache_changes) <= 3
    assert rows_of(tables.read_cache(spark, base)) == rows_of(state.cache)
    again = build_manifest(spark, root, cache=tables.read_cache(spark, base))
    assert again.cache_changes.isEmpty()
