"""History as change sets and intervals: against plain versions, on disk, and for locating."""

import os
import random

import pytest

from conftest import manifest, rows_of, sha1
from treeledger.catalog import queries as catalog
from treeledger.operators import intervals as iv
from treeledger.operators import spread
from treeledger.operators.compare import delta_of_sides, detect_renames, diff
from treeledger.operators.history import log, log_of_changes
from treeledger.operators.locate import bind_requests, classify_requests, locate, locate_first, rank_candidates
from treeledger.operators.rollup import changed_root, dir_rollup, root_rollup, update_rollup
from treeledger.plans.record import NothingStaged, commit
from treeledger.plans.recover import restore
from treeledger.plans.status import diff_refs, diff_refs_of_changes
from treeledger.schema import MANIFEST
from treeledger.session import stored
from treeledger.sources import ledger, tables


def random_history(seed: int, commits: int = 9, paths: int = 14) -> list[dict[str, tuple[str, str]]]:
    """Trees in which entries come, go, come back, move, turn into links, and stay."""
    rng, tree, found = random.Random(seed), {}, []
    for n in range(commits):
        for _ in range(rng.randrange(4) if n else 8):
            path = f"d{rng.randrange(3)}/f{rng.randrange(paths)}"
            what = rng.random()
            if what < 0.3:
                tree.pop(path, None)
            elif what < 0.5 and tree:
                tree[path] = tree.pop(rng.choice(sorted(tree)))
            else:
                tree[path] = (rng.choice(["blob", "blob", "blob", "link"]), sha1(str(rng.randrange(5))))
        found.append(dict(tree))
    return found


def frames(spark, trees, gap=1):
    ids = [sha1(f"commit {n}") for n in range(len(trees))]
    commits = spark.createDataFrame(
        [(ids[n], ids[n - 1] if n else None, gap * n, 0, 0, "") for n in range(len(trees))],
        "commit_id string, parent_id string, seq long, commit_time long, tz_offset_min int, message string",
    )
    rows = [(p, k, d, ids[n]) for n, tree in enumerate(trees) for p, (k, d) in tree.items()]
    return ids, commits, spark.createDataFrame(rows, "path string, kind string, digest string, revision string")


def plain_changes(trees, gap=1):
    found, before = set(), {}
    for n, tree in enumerate(trees):
        for path in before.keys() | tree.keys():
            old, new = before.get(path, (None, None)), tree.get(path, (None, None))
            if old != new:
                found.add((gap * n, path, *old, *new))
        before = tree
    return found


def plain_intervals(trees):
    found, since = set(), {}
    for n, tree in enumerate([*trees, {}]):
        for path in list(since):
            start, entry = since[path]
            if tree.get(path) != entry or n == len(trees):
                found.add((path, *entry, start, None if n == len(trees) else n))
                del since[path]
        for path, entry in tree.items():
            since.setdefault(path, (n, entry))
    return found


def as_set(df, *columns):
    rows = df.select(*columns).collect()
    assert len(rows) == len(set(rows))
    return {tuple(r) for r in rows}


CHANGE = ("seq", "path", "old_kind", "old_digest", "kind", "digest")
INTERVAL = ("path", "kind", "digest", "from_seq", "to_seq")


@pytest.mark.parametrize("seed", range(3))
def test_changes_and_intervals(spark, seed):
    trees = random_history(seed)
    _, commits, manifests = frames(spark, trees)
    changes = iv.changes_of_manifests(commits, manifests)
    assert as_set(changes, *CHANGE) == plain_changes(trees)
    found = iv.intervals_of_changes(changes)
    assert as_set(found, *INTERVAL) == plain_intervals(trees)
    assert as_set(iv.changes_of_intervals(found), *CHANGE) == plain_changes(trees)
    for n in (0, 4, 8):
        assert as_set(iv.state_at(found, n), *MANIFEST.names) == {(p, *e) for p, e in trees[n].items()}
    # Cut anywhere and put together again: what ends and begins at once with equal content is no change.
    cut = found.selectExpr("path", "kind", "digest", "explode(sequence(from_seq, coalesce(to_seq - 1, 8L))) AS from_seq").selectExpr("*", "if(from_seq = 8, NULL, from_seq + 1) AS to_seq")
    assert as_set(iv.changes_of_intervals(cut), *CHANGE) == plain_changes(trees)
    assert as_set(iv.manifests_of(found, commits), "path", "kind", "digest", "revision") == as_set(manifests, "path", "kind", "digest", "revision")


def test_places_may_have_gaps(spark):
    trees = random_history(7)
    _, commits, manifests = frames(spark, trees, gap=5)
    assert as_set(iv.changes_of_manifests(commits, manifests), *CHANGE) == plain_changes(trees, gap=5)
    assert iv.changes_of_manifests(commits, manifests.where("false")).isEmpty()


def test_log_equals_one_diff_per_commit(spark):
    trees = random_history(11, commits=6)
    ids, commits, manifests = frames(spark, trees)
    columns = ("status", "old_path", "new_path", "old_digest", "new_digest", "similarity")
    for found in (log(commits, manifests), log_of_changes(commits, iv.changes_of_manifests(commits, manifests))):
        by_commit = {}
        for row in found.collect():
            by_commit.setdefault(row["seq"], []).append(tuple(row[c] for c in columns))
            assert row["commit_id"] == ids[row["seq"]]
        for n in range(6):
            sides = [manifests.where(f"revision = '{ids[m]}'") if m >= 0 else manifests.where("false") for m in (n - 1, n)]
            wanted = [tuple(r[c] for c in columns) for r in diff(*sides).collect()]
            assert sorted(by_commit.get(n, []), key=str) == sorted(wanted, key=str)


def test_differences_between_places(spark):
    trees = random_history(5)
    ids, commits, manifests = frames(spark, trees)
    changes = iv.changes_of_manifests(commits, manifests)
    for old, new in ((1, 7), (7, 1), (3, 3)):
        wanted = diff_refs(commits, manifests, ids[old], ids[new])
        assert rows_of(diff_refs_of_changes(commits, changes, ids[old], ids[new])) == rows_of(wanted.select(*diff_refs_of_changes(commits, changes, ids[old], ids[new]).columns))


def test_rollups_follow_changes(spark):
    trees = random_history(2, commits=4)
    old, new = (spark.createDataFrame([(p, *e) for p, e in t.items()], MANIFEST) for t in (trees[0], trees[3]))
    changes = iv.change_set(old, new)
    assert rows_of(update_rollup(dir_rollup(old), changes), "dir", "n_files", "h1", "h2") == rows_of(dir_rollup(new), "dir", "n_files", "h1", "h2")
    before, step, after = (f.first() for f in (root_rollup(old), changed_root(changes), root_rollup(new)))
    assert all(before[c] + step[c] == after[c] for c in ("n_files", "h1", "h2"))
    gone = update_rollup(dir_rollup(old), iv.change_set(old, old.where("false")))
    assert gone.isEmpty()


def folder_bytes(path):
    return {
        os.path.join(d, f): os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(path) for f in files if f.endswith(".parquet")
    }


def test_history_on_disk(spark, tmp_path, monkeypatch):
    """Many commits; small packs, and states when enough has changed."""
    monkeypatch.setattr(ledger, "PACK", 3)
    base, trees, ids = str(tmp_path), [], []
    for tree in random_history(21, commits=12):
        staged = spark.createDataFrame([(p, *e) for p, e in tree.items()], MANIFEST)
        if trees and tree == trees[-1]:
            with pytest.raises(NothingStaged):
                commit(spark, base, staged, "again")
            continue
        ids.append(commit(spark, base, staged, f"Change {len(ids)}", when=len(ids)).first()["commit_id"])
        trees.append(tree)
    assert os.listdir(f"{base}/history/states") and len(os.listdir(f"{base}/history/packed")) >= 2
    head = len(trees) - 1
    assert as_set(tables.read_history(spark, base), *CHANGE) == plain_changes(trees)
    for n in range(len(trees)):
        assert as_set(tables.read_manifest(spark, base, ids[n]), *MANIFEST.names) == {(p, *e) for p, e in trees[n].items()}
    assert as_set(ledger.read_intervals(spark, base, head), *INTERVAL) == plain_intervals(trees)
    assert as_set(ledger.read_intervals(spark, base, 4), *INTERVAL) == plain_intervals(trees[:5])
    assert tables.read_manifest(spark, base).count() == sum(map(len, trees))
    # The rollup that is kept with a commit is that of its tree.
    kept = tables.read_root(spark, base, ids[-1])
    whole = root_rollup(tables.read_manifest(spark, base, ids[-1])).first()
    assert kept == {"commit_id": ids[-1], **whole.asDict()}


def test_bytes_of_a_commit_follow_its_changes(spark, tmp_path):
    base = str(tmp_path)
    tree = spark.range(40_000).selectExpr("concat('d', id % 100, '/f', id) AS path", "'blob' AS kind", "sha1(CAST(id AS STRING)) AS digest")
    commit(spark, base, tree, "all")
    first = folder_bytes(base)
    commit(spark, base, tree.selectExpr("path", "kind", "if(path = 'd7/f7', sha1('x'), digest) AS digest"), "one")
    second = {k: v for k, v in folder_bytes(base).items() if k not in first}
    assert sum(first.values()) > 1_000_000 and sum(second.values()) < 10_000
    assert rows_of(tables.read_history(spark, base).where("seq = 1"), "path", "digest") == [("d7/f7", sha1("x"))]


def test_a_ledger_of_full_copies_goes_on_as_history(spark, tmp_path):
    base, trees = str(tmp_path), [manifest(spark, t) for t in ({"a": "1"}, {"a": "1", "b": "2"}, {"b": "2"})]
    rows = [("c0", None, 0, 0, 0, ""), ("c1", "c0", 1, 0, 0, "")]
    for row, tree in zip(rows, trees):
        tables.write_manifest(tree, base, row[0])
        tables.append_commit(spark.createDataFrame([row], tables.COMMITS), base)
    last = commit(spark, base, trees[2], "new").first()
    assert (last["seq"], last["parent_id"]) == (2, "c1")
    for name, tree in zip(("c0", "c1", last["commit_id"]), trees):
        assert rows_of(tables.read_manifest(spark, base, name)) == rows_of(tree)
    assert tables.read_manifest(spark, base).count() == 4


def test_of_two_writers_one_gets_the_place(spark, tmp_path):
    base = str(tmp_path)
    commit(spark, base, manifest(spark, {"a": "1"}), "one")
    ledger.claim(spark, base, 1)
    with pytest.raises(ledger.Taken):
        commit(spark, base, manifest(spark, {"a": "2"}), "late")
    assert tables.read_commits(spark, base).count() == 1
    ledger.release(spark, base, 1)
    assert commit(spark, base, manifest(spark, {"a": "2"}), "two").first()["seq"] == 1


def test_a_failed_commit_gives_its_place_back(spark, tmp_path, monkeypatch):
    base = str(tmp_path)

    def fail(*_):
        raise OSError("disk full")

    with monkeypatch.context() as patched:
        patched.setattr("treeledger.plans.record.append_commit", fail)
        with pytest.raises(OSError):
            commit(spark, base, manifest(spark, {"a": "1"}), "one")
    assert tables.read_commits(spark, base).isEmpty()
    assert commit(spark, base, manifest(spark, {"a": "1"}), "one").first()["seq"] == 0


# Locating.


def test_last_marked(spark, monkeypatch):
    monkeypatch.setattr(iv, "_BLOCK", 4)
    places = spark.range(2, 30).selectExpr("id AS seq")
    marked = spark.createDataFrame([(3,), (4,), (11,), (29,)], "seq long")
    wanted = {(n, max(m for m in (3, 4, 11, 29) if m <= n)) for n in range(3, 30)}
    assert as_set(iv.last_marked(places, marked), "seq", "last") == wanted
    assert iv.last_marked(places, marked.where("false")).isEmpty()


@pytest.mark.parametrize("most_bytes", [1 << 20, -1])
def test_last_marked_by_block(spark, monkeypatch, most_bytes):
    """With the blocks broadcast, and with both sides shuffled."""
    monkeypatch.setattr(iv, "_ROW_BITS", 2)
    monkeypatch.setattr(spread, "MAX_LOOKUP_BYTES", most_bytes)
    places = spark.range(2, 40).selectExpr("id AS seq")
    marked = spark.createDataFrame([(3,), (4,), (5,), (6,), (7,), (11,), (29,)], "seq long")
    rows = places.unionByName(spark.createDataFrame([(None,)], "seq long"))
    for marks in (marked, marked.where("false")):
        known = [r.seq for r in marks.collect()]
        wanted = {(n, max((m for m in known if m <= n), default=None)) for n in range(2, 40)} | {(None, None)}
        found = iv.with_last_marked(rows, "seq", "last", iv.marks_by_block(places, marks), ["seq"])
        assert found.columns == ["seq", "last"] and as_set(found, "seq", "last") == wanted


COLUMNS = ["path", "ref", "kind", "digest", "commit_id", "seq", "found_path", "same_path", "store", "snapshot_id", "reference", "ordinal"]


@pytest.mark.parametrize(("seed", "hot_rows", "any_revision", "store"), [(1, 10**6, False, None), (2, 64, True, None), (3, 64, False, "s1"), (4, 10**6, True, "s0")])
def test_first_candidates_are_those_ranked_first(spark, seed, hot_rows, any_revision, store):
    trees = random_history(seed, commits=12, paths=6)
    ids, commits, manifests = frames(spark, trees)
    rng = random.Random(seed)
    taken = [(f"s{s}", str(n), ids[n], f"s{s}/{n}") for s in range(2) for n in range(12) if rng.random() < 0.3]
    snapshots = spark.createDataFrame(taken, "store string, snapshot_id string, base_commit_id string, reference string")
    stores = spark.createDataFrame([("s0", "/a/*", 1), ("s1", "/b/*", 0)], "store string, url string, ordinal int")
    asked = [(p, ids[n]) for n, t in enumerate(trees) for p in [*t, "none"]] + [("none", "nowhere")]
    requests = spark.createDataFrame(asked, "path string, ref string")
    bound = bind_requests(requests, commits, manifests, snapshots)
    located = locate(requests, commits, manifests, snapshots, stores, any_revision, bound=bound)
    wanted = rank_candidates(located, store).where("eligible AND try_order = 1").select(*COLUMNS)
    found = locate_first(bound, commits, iv.intervals_of_manifests(commits, manifests), snapshots, stores, store, any_revision, hot_rows)
    assert rows_of(found, *COLUMNS) == rows_of(wanted, *COLUMNS) and not found.isEmpty()
    old = classify_requests(requests, commits, manifests, snapshots, stores, None, store, any_revision, located)
    assert rows_of(classify_requests(requests, commits, manifests, snapshots, stores, None, store, any_revision)) == rows_of(old)


@pytest.mark.parametrize(("hot_rows", "most_bytes", "any_revision"), [(10**6, -1, False), (32, 1 << 20, False), (32, -1, False), (32, -1, True)])
def test_first_candidates_of_copied_contents(spark, monkeypatch, hot_rows, most_bytes, any_revision):
    """Contents with copies that come and go; with ``hot_rows`` of 32 one counts as crowded and the others do not."""
    monkeypatch.setattr(spread, "MAX_LOOKUP_BYTES", most_bytes)
    rng, tree, trees = random.Random(7), {}, []
    for _ in range(14):
        for _ in range(3):
            tree[f"f{rng.randrange(9)}"] = ("blob", sha1(str(max(0, rng.randrange(6) - 2))))
        tree.pop(f"f{rng.randrange(9)}", None)
        trees.append(dict(tree))
    ids, commits, manifests = frames(spark, trees)
    taken = [("s0", str(n), ids[n], f"s0/{n}") for n in (1, 2, 5, 9)]
    snapshots = spark.createDataFrame(taken, "store string, snapshot_id string, base_commit_id string, reference string")
    stores = spark.createDataFrame([("s0", "/a/*", 1)], "store string, url string, ordinal int")
    requests = spark.createDataFrame([(p, ids[n]) for n, t in enumerate(trees) for p in t], "path string, ref string")
    bound = bind_requests(requests, commits, manifests, snapshots)
    wanted = rank_candidates(locate(requests, commits, manifests, snapshots, stores, any_revision, bound=bound)).where("try_order = 1")
    found = locate_first(bound, commits, iv.intervals_of_manifests(commits, manifests), snapshots, stores, None, any_revision, hot_rows)
    assert rows_of(found, *COLUMNS) == rows_of(wanted, *COLUMNS)
    # Some lie elsewhere where copies last longer, and some where they end.
    assert {r.same_path for r in found.collect()} == {True, False}


def test_locating_shuffles_requests_only_twice(spark, tmp_path, monkeypatch):
    """Once by content and once by snapshot, where no table is small enough to be sent to all executors."""
    plans = []

    def recorded(df, label):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return stored(df, label)

    monkeypatch.setattr("treeledger.operators.locate.stored", recorded)
    n = 120_000
    events = f"""SELECT id AS event_id, TIMESTAMP_NTZ '2024-01-01' AS ts, id % 1000 AS user_id,
        element_at(array('click', 'signup', 'purchase'), CAST(id * 7 % 11 % 3 + 1 AS INT)) AS event_type FROM range({n})"""
    spark.sql(events).write.parquet(f"{tmp_path}/events.parquet")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = catalog.queries()["locate_chain"](spark, str(tmp_path))
        plans.append(found._jdf.queryExecution().executedPlan().toString())
        rows = found.count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    by_request = [line for plan in plans for line in plan.splitlines() if "Exchange hashpartitioning" in line and any(k in line for k in ("digest", "seq#"))]
    assert rows > n // 2
    # By content, by snapshot with its sources on the other side.
    assert len(by_request) <= 4, by_request


def test_restoring_goes_on_to_other_snapshots(spark, golden, history, tmp_path):
    """The snapshot to try first lacks a file, another one's copy is not there at all."""
    ids, commits, manifests, snapshots, stores = history
    roots = {}
    for store, number, tree in (("aux1", "3", golden.r2), ("aux1", "2", golden.r1), ("aux2", "1", golden.r0)):
        roots[f"{store}/{number}"] = str(tmp_path / store / number)
        for path, text in tree.items():
            if (number, path) != ("3", golden.c):
                full = tmp_path / store / number / path
                full.parent.mkdir(parents=True, exist_ok=True)
                full.write_text(text)
    copies = spark.createDataFrame(list(roots.items()), "reference string, root string")
    requests = spark.createDataFrame([(golden.c, "HEAD"), (golden.a, "HEAD"), (golden.b, "HEAD~2"), (golden.B, "HEAD"), ("x", "HEAD")], "path string, ref string")
    done = restore(requests, str(tmp_path / "out"), commits, manifests, snapshots, stores, copies)
    assert {(r["path"], r["outcome"], r["reference"]) for r in done.collect()} == {
        (golden.c, "restored", "aux1/2"), (golden.a, "restored", "aux1/3"), (golden.b, "restored", "aux2/1"),
        (golden.B, "restored", "aux1/3"), ("x", "directory", None),
    }
    assert (tmp_path / "out" / golden.c).read_text() == "c content"


def test_renames_from_a_change_set(spark):
    old, new = manifest(spark, {"a": "1", "b": "2"}), manifest(spark, {"c": "1", "b": "3"})
    sides = iv.change_set(old, new).selectExpr("path", "old_kind", "old_digest", "kind AS new_kind", "digest AS new_digest")
    assert rows_of(detect_renames(delta_of_sides(sides))) == rows_of(diff(old, new))
