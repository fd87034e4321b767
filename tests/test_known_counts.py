"""Counts that two engines agreed on before this code was written, at scale factor 0.01."""

import pytest

from conftest import TESTDATA, rows_of
from treeledger.operators.cache import probe_cache
from treeledger.operators.compare import diff
from treeledger.operators.history import log
from treeledger.operators.ignore import hits, ignored_dirs, prune_ignored
from treeledger.operators.locate import locate
from treeledger.operators.rollup import dir_rollup

DOCUMENTS = f"parquet.`{TESTDATA}/sf0.01/documents.parquet`"
PAGES = f"parquet.`{TESTDATA}/sf0.01/pages.parquet`"
PATH = "concat(source, '/', lang, '/d', cast(doc_id AS string), '.txt')"


def pair(spark, digest, edited):
    old = spark.sql(
        f"SELECT {PATH} AS path, 'blob' AS kind, {digest} AS digest FROM {DOCUMENTS} WHERE doc_id % 17 <> 0"
    )
    new = spark.sql(
        f"""SELECT if(doc_id % 7 = 0, concat('moved/', {PATH}), {PATH}) AS path, 'blob' AS kind,
                   if(doc_id % 11 = 0, {edited}, {digest}) AS digest
            FROM {DOCUMENTS} WHERE doc_id % 13 <> 0"""
    )
    return old, new


@pytest.mark.parametrize(
    ("content", "counts"),
    [("text", {"R": 113, "D": 83, "M": 67, "A": 65}), ("source", {"R": 161, "M": 67, "D": 35, "A": 17})],
)
def test_pair(spark, content, counts):
    delta = diff(*pair(spark, f"sha1({content})", f"sha1(concat({content}, '!'))"))
    assert {row["status"]: row["count"] for row in delta.groupBy("status").count().collect()} == counts


@pytest.fixture(scope="module")
def revisions(spark):
    manifests = spark.sql(
        f"""SELECT sha1(concat('c', cast(rev AS string))) AS revision,
                   if(doc_id % 7 = 2 AND rev >= 2, concat('moved/', {PATH}), {PATH}) AS path, 'blob' AS kind,
                   sha1(concat(text, '#', cast(if(doc_id % 9 = 1, rev, 0) AS string))) AS digest
            FROM (SELECT *, explode(sequence(0, 4)) AS rev FROM {DOCUMENTS})
            WHERE doc_id % 5 <= rev AND NOT (doc_id % 23 = 3 AND rev >= 3)"""
    )
    commits = spark.sql(
        """SELECT sha1(concat('c', cast(rev AS string))) AS commit_id,
                  if(rev > 0, sha1(concat('c', cast(rev - 1 AS string))), NULL) AS parent_id,
                  cast(rev AS bigint) AS seq FROM (SELECT explode(sequence(0, 4)) AS rev)"""
    )
    return commits, manifests


def test_log(spark, revisions):
    found = log(*revisions).groupBy("seq", "status").count()
    assert rows_of(found) == [
        (0, "A", 200), (1, "A", 200), (1, "M", 22), (2, "A", 206), (2, "D", 6), (2, "M", 39), (2, "R", 51),
        (3, "A", 189), (3, "D", 24), (3, "M", 64), (3, "R", 2), (4, "A", 191), (4, "M", 85),
    ]


def test_locate(spark, revisions):
    commits, manifests = revisions
    snapshots = spark.sql(
        """SELECT store, snapshot_id, sha1(base) AS base_commit_id, concat(store, '/', snapshot_id) AS reference
           FROM VALUES ('aux1', '1', 'c0'), ('aux1', '2', 'c1'), ('aux1', '3', 'c2'), ('aux2', '1', 'c0'),
                       ('aux2', '2', 'c2') AS t(store, snapshot_id, base)"""
    )
    stores = spark.sql("SELECT * FROM VALUES ('aux1', 0), ('aux2', 1) AS t(store, ordinal)")
    wanted = manifests.where("revision IN (sha1('c1'), sha1('c2'), sha1('c4'))").selectExpr("path", "revision AS ref")
    found = locate(wanted, commits, manifests, snapshots, stores)
    named = found.join(commits.selectExpr("commit_id AS ref", "seq AS rev"), "ref")
    assert rows_of(named.groupBy("rev", "same_path").count()) == [
        (1, False, 4), (1, True, 756), (2, False, 130), (2, True, 1810), (4, False, 219), (4, True, 1605),
    ]
    latest = wanted.where("ref = sha1('c4')").join(found, ["path", "ref"], "left_anti")
    assert latest.count() == 420


def test_cache(spark):
    listing = spark.sql(f"SELECT {PATH} AS path, 1000000 * doc_id AS mtime_ns, doc_id FROM {DOCUMENTS}")
    cache = spark.sql(
        f"""SELECT {PATH} AS path, if(doc_id % 15 = 0, 2, 1) AS version,
                   1000000 * doc_id - if(doc_id % 3 = 1, 1, 0) AS mtime_ns,
                   if(doc_id % 10 = 0, 'md5', 'sha1') AS algorithm, sha1(text) AS digest
            FROM {DOCUMENTS} WHERE doc_id % 3 <> 2"""
    )
    found = probe_cache(listing, cache).groupBy("cache_state").count()
    counts = {row["cache_state"]: row["count"] for row in found.collect()}
    assert counts == {"hit": 267, "outdated": 300, "absent": 333, "bad_version": 67, "bad_algorithm": 33}


def test_ignores_and_rollup(spark):
    path = "regexp_replace(regexp_replace(url, '^https?://', ''), '/$', '')"
    pages = spark.sql(f"SELECT page_id, {path} AS path, sha1(html) AS digest FROM {PAGES}")
    marked = pages.selectExpr(
        "concat(substring_index(path, '/', size(split(path, '/')) - 1), '/', CASE page_id % 50"
        " WHEN 0 THEN '.git/HEAD' WHEN 1 THEN '.sodignore' WHEN 2 THEN '.snapshots/1/f' END) AS path",
    ).where("path IS NOT NULL").distinct()
    listing = pages.select("path").union(marked)
    assert prune_ignored(listing).count() == 215
    # Thirteen directories say they are left out; one of them lies inside another.
    assert hits(listing).count() == 13
    assert ignored_dirs(listing).count() == 12
    rows = pages.selectExpr("path", "'blob' AS kind", "digest").union(
        marked.selectExpr("path", "'blob' AS kind", "sha1('') AS digest")
    )
    assert dir_rollup(rows).count() == 197
