import os
import shutil

import pytest

from conftest import Golden, manifest, rows_of, sha1
from treeledger.plans.manifest import build_manifest
from treeledger.plans.record import commit
from treeledger.plans.recover import restore
from treeledger.schema import LEDGER_DIR
from treeledger.sinks.restore import restore_links
from treeledger.sources import stores as sources
from treeledger.sources import tables


@pytest.fixture(scope="module")
def backups(spark, tmp_path_factory):
    """A tracked tree of three commits and two stores with copies of it."""
    top = tmp_path_factory.mktemp("backups")
    tree, ledger = f"{top}/tree", f"{top}/tree/{LEDGER_DIR}"
    taken = {0: [("aux1", 1), ("aux2", 1)], 1: [("aux1", 2)], 2: [("aux1", 3), ("aux2", 2)]}
    for number, files in enumerate(Golden.revisions):
        for name in os.listdir(tree) if os.path.exists(tree) else []:
            if name != LEDGER_DIR:
                full = f"{tree}/{name}"
                shutil.rmtree(full) if os.path.isdir(full) else os.unlink(full)
        for path, content in files.items():
            os.makedirs(os.path.dirname(f"{tree}/{path}"), exist_ok=True)
            with open(f"{tree}/{path}", "w") as out:
                out.write(content)
        commit(spark, ledger, build_manifest(spark, tree).manifest, f"Change {number}", when=86400 * number)
        for store, copy in taken[number]:
            shutil.copytree(tree, f"{top}/{store}/{copy}/snapshot")
    os.makedirs(f"{top}/aux1/9/snapshot")
    shutil.copytree(f"{top}/aux1/1", f"{top}/aux1/.hidden")
    urls = [("aux1", f"file://{top}/aux1/*/snapshot", 0), ("aux2", f"{top}/aux2/*/snapshot", 1), ("far", "ssh://host/x", 2)]
    stores = spark.createDataFrame(urls, "store string, url string, ordinal int")
    copies = sources.base_commits(sources.discover_snapshots(stores))
    snapshots = sources.refresh_snapshots(copies.select("store", "snapshot_id", "base_commit_id", "reference").where("false"), copies, stores)
    return ledger, stores, copies, snapshots


def test_discovery(spark, backups):
    ledger, _, _, snapshots = backups
    ids = {row["seq"]: row["commit_id"] for row in tables.read_commits(spark, ledger).collect()}
    assert rows_of(snapshots, "reference", "base_commit_id") == sorted(
        [("aux1/1", ids[0]), ("aux1/2", ids[1]), ("aux1/3", ids[2]), ("aux2/1", ids[0]), ("aux2/2", ids[2])]
    )


def test_a_store_without_star_is_one_snapshot(spark, backups, tmp_path):
    ledger = backups[0]
    stores = spark.createDataFrame([("one", os.path.dirname(ledger), 0)], "store string, url string, ordinal int")
    found = sources.base_commits(sources.discover_snapshots(stores)).collect()
    assert [(row["snapshot_id"], row["reference"]) for row in found] == [(None, "one")]


def test_star_inside_a_name(spark, backups, tmp_path):
    for name in ("s-1-x", "s-2-x", "s-x", "t-3-x"):
        os.makedirs(f"{tmp_path}/{name}/{LEDGER_DIR}")
    stores = spark.createDataFrame([("s", f"{tmp_path}/s-*-x", 0)], "store string, url string, ordinal int")
    assert rows_of(sources.discover_snapshots(stores), "snapshot_id") == [("1",), ("2",)]


def test_refresh_of_some_stores(spark, backups):
    _, stores, copies, snapshots = backups
    old = snapshots.unionByName(
        spark.createDataFrame([("aux1", "7", "c", "aux1/7"), ("aux2", "8", "c", "aux2/8")], "store string, snapshot_id string, base_commit_id string, reference string")
    )
    found = sources.refresh_snapshots(old, copies, stores, ["aux1"])
    assert rows_of(found, "reference") == [("aux1/1",), ("aux1/2",), ("aux1/3",), ("aux2/1",), ("aux2/2",), ("aux2/8",)]
    with pytest.raises(ValueError, match="no such store: aux9"):
        sources.refresh_snapshots(old, copies, stores, ["aux1", "aux9"])


def run_restore(spark, backups, target, requests, **options):
    ledger, stores, copies, snapshots = backups
    commits, manifests = tables.read_commits(spark, ledger), tables.read_manifest(spark, ledger)
    frame = spark.createDataFrame(requests, "path string, ref string")
    outcome = restore(frame, str(target), commits, manifests, snapshots, stores, copies, **options)
    return rows_of(outcome, "path", "ref", "outcome", "reference")


def test_restore(spark, backups, tmp_path):
    g = Golden
    assert run_restore(spark, backups, tmp_path, [(g.a, "aux1/2"), (g.d, "HEAD"), (g.b, "HEAD~2"), ("x", "HEAD"), ("no", "HEAD")]) == sorted([
        (g.a, "aux1/2", "restored", "aux1/2"), (g.d, "HEAD", "restored", "aux1/3"),
        (g.b, "HEAD~2", "restored", "aux1/1"), ("x", "HEAD", "directory", None), ("no", "HEAD", "unknown_path", None),
    ])
    assert (tmp_path / g.a).read_text() == "a changed content"
    assert (tmp_path / g.b).read_text() == "b content"
    assert (tmp_path / g.d).read_text() == "d changed content"
    assert not [name for name in os.listdir(tmp_path) if name.endswith(".part")]


def test_restore_from_one_store(spark, backups, tmp_path):
    g = Golden
    assert run_restore(spark, backups, tmp_path, [(g.a, "aux1/2"), (g.c, "HEAD")], store="aux2") == [
        (g.a, "aux1/2", "excluded_only", None), (g.c, "HEAD", "restored", "aux2/2"),
    ]


def test_nothing_is_overwritten(spark, backups, tmp_path):
    g = Golden
    (tmp_path / g.a).write_text("mine")
    existing = spark.createDataFrame([(g.c,)], "path string")
    assert run_restore(spark, backups, tmp_path, [(g.a, "HEAD"), (g.c, "HEAD")], existing=existing) == [
        (g.a, "HEAD", "exists", None), (g.c, "HEAD", "exists", None),
    ]
    assert (tmp_path / g.a).read_text() == "mine"


def test_a_bad_copy_is_passed_over(spark, backups, tmp_path):
    g = Golden
    copy = os.path.join(os.path.dirname(os.path.dirname(backups[0])), "aux1/3/snapshot", g.c)
    good = open(copy).read()
    try:
        with open(copy, "w") as out:
            out.write("rotten")
        assert run_restore(spark, backups, tmp_path, [(g.c, "HEAD")]) == [(g.c, "HEAD", "restored", "aux2/2")]
    finally:
        with open(copy, "w") as out:
            out.write(good)
    assert (tmp_path / g.c).read_text() == "c content"


def test_links_are_made_anew(spark, tmp_path):
    (tmp_path / "taken").write_text("")
    requests = spark.createDataFrame([("d/l", "HEAD", "../x"), ("taken", "HEAD", "y")], "path string, ref string, link_target string")
    assert rows_of(restore_links(requests, str(tmp_path)), "path", "outcome") == [("d/l", "restored"), ("taken", "exists")]
    assert os.readlink(tmp_path / "d/l") == "../x"
    assert rows_of(restore_links(requests, str(tmp_path)), "path", "outcome") == [("d/l", "restored"), ("taken", "exists")]


@pytest.mark.parametrize(
    ("url", "error"),
    [
        ("file:///a/*/b", None), ("/a/b", None), ("ssh://h/a*", None), ("a/b", None), ("FILE:///a", None),
        ("file://host/a", "host must be empty"), ("//host/a", "host must be empty"), ("ssh:///a", "host must not be empty"),
        ("http://h/a", "unknown scheme"), ("file:///a?q", "query must be empty"), ("file:///a#f", "fragment must be empty"),
        ("file:///a;p", "parameters must be empty"), ("ssh://h*/a", "host must not contain *"), ("/a/*/*", "more than one *"),
        ("file://", "no path"), ("", "no path"),
    ],
)
def test_store_addresses(spark, url, error):
    stores = spark.createDataFrame([("s", url, 0)], "store string, url string, ordinal int")
    assert sources.check_stores(stores).first()["store_error"] == error


def test_restore_brings_links_back_by_their_target(spark, history, tmp_path):
    ids, commits, manifests, snapshots, stores = history
    link = spark.createDataFrame([("d/l", "link", sha1("../x"), ids[2]), ("m", "link", sha1("lost"), ids[2])], manifests.schema)
    links = spark.createDataFrame([(sha1("../x"), "../x")], "digest string, link_target string")
    copies = snapshots.selectExpr("reference", "'/nowhere' AS root")
    requests = spark.createDataFrame([("d/l", "HEAD"), ("m", "HEAD"), (Golden.c, "HEAD")], "path string, ref string")
    outcome = restore(requests, str(tmp_path), commits, manifests.union(link), snapshots, stores, copies, links=links)
    assert rows_of(outcome) == [
        (Golden.c, "HEAD", "failed", None), ("d/l", "HEAD", "restored", None), ("m", "HEAD", "link", None),
    ]
    assert os.readlink(tmp_path / "d/l") == "../x"


def test_digest_of_golden_text():
    assert sha1("a content") == "112c74d3c737c3d2facb0b8da36e1ffab710aea1"


def test_manifest_helper(spark):
    assert manifest(spark, {"a": "a content"}).first()["digest"].startswith("112c74d3c7")
