import pytest

from conftest import rows_of, sha1
from treeledger.operators.history import ancestors, decorate, log, resolve_refs
from treeledger.operators.locate import classify_requests, locate, rank_candidates
from treeledger.plans.status import diff_refs


def test_log_in_one_job(golden, history):
    ids, commits, manifests, _, _ = history
    found = log(commits, manifests)
    assert rows_of(found, "seq", "status", "path") == sorted(
        [(0, "A", path) for path in golden.r0]
        + [(1, "R", golden.B), (1, "M", golden.a), (1, "M", golden.d)]
        + [(2, "M", golden.B), (2, "M", golden.a)]
    )
    earlier = log(commits, manifests, ids[1])
    assert {row["seq"] for row in earlier.collect()} == {0, 1}


def test_log_finds_renames_within_a_commit_only(spark):
    commits = spark.createDataFrame(
        [("c0", None, 0, 0, 0, ""), ("c1", "c0", 1, 0, 0, ""), ("c2", "c1", 2, 0, 0, "")],
        "commit_id string, parent_id string, seq long, commit_time long, tz_offset_min int, message string",
    )
    rows = [("a", "c0"), ("k", "c0"), ("k", "c1"), ("k", "c2"), ("b", "c2")]
    manifests = spark.createDataFrame(
        [(path, "blob", sha1(path if path == "k" else "same"), revision) for path, revision in rows],
        "path string, kind string, digest string, revision string",
    )
    assert rows_of(log(commits, manifests).where("seq > 0"), "seq", "status", "path") == [(1, "D", "a"), (2, "A", "b")]
    assert rows_of(diff_refs(commits, manifests, "HEAD~2"), "status", "path") == [("R", "b")]


def test_decorations_in_order(history):
    ids, commits, _, snapshots, stores = history
    named = decorate(commits, snapshots, stores).orderBy("ordinal", "reference")
    shown = {}
    for row in named.collect():
        shown.setdefault(row["commit_id"], []).append(row["reference"])
    assert shown == {
        ids[2]: ["HEAD", "aux1/3", "aux2/2"],
        ids[1]: ["aux1/2"],
        ids[0]: ["aux1/1", "aux2/1"],
    }


def test_names_of_commits(spark, history):
    ids, commits, _, snapshots, _ = history
    asked = ["HEAD", "HEAD~", "HEAD~2", "HEAD~3", "HEAD~0", "aux1/2", ids[0], ids[1][:7], ids[1][:3], "nothing", "aux9/1", ids[2].upper()]
    refs = spark.createDataFrame([(ref,) for ref in asked + asked], "ref string")
    found = {row["ref"]: row["commit_id"] for row in resolve_refs(refs, commits, snapshots).collect()}
    assert found == {
        "HEAD": ids[2], "HEAD~": ids[1], "HEAD~2": ids[0], "HEAD~3": None, "HEAD~0": ids[2],
        "aux1/2": ids[1], ids[0]: ids[0], ids[1][:7]: ids[1], ids[1][:3]: None, "nothing": None,
        "aux9/1": None, ids[2].upper(): ids[2],
    }
    assert resolve_refs(refs, commits.where("false")).where("problem IS NULL").isEmpty()


def test_a_prefix_of_two_commits_is_bad(spark):
    rows = [("abcd1" + "0" * 35, None, 0, 0, 0, ""), ("abcd2" + "0" * 35, "abcd1" + "0" * 35, 1, 0, 0, "")]
    commits = spark.createDataFrame(
        rows, "commit_id string, parent_id string, seq long, commit_time long, tz_offset_min int, message string"
    )
    refs = spark.createDataFrame([("abcd",), ("abcd1",)], "ref string")
    found = {row["ref"]: row["problem"] for row in resolve_refs(refs, commits).collect()}
    assert found == {"abcd": "bad revision", "abcd1": None}


def test_diff_of_names(golden, history):
    ids, commits, manifests, snapshots, _ = history
    delta = diff_refs(commits, manifests, "aux1/1", "aux1/2", snapshots)
    assert rows_of(delta, "status", "path") == [("M", golden.a), ("M", golden.d), ("R", golden.B)]
    assert rows_of(diff_refs(commits, manifests, ids[0][:8], letters="R"), "status", "path") == []
    with pytest.raises(ValueError, match="bad revision: nope"):
        diff_refs(commits, manifests, "nope")


def test_ancestors(history):
    ids, commits, _, _, _ = history
    assert rows_of(ancestors(commits, ids[1]), "seq") == [(0,), (1,)]
    assert ancestors(commits).count() == 3


def located(spark, history, requests, **options):
    ids, commits, manifests, snapshots, stores = history
    frame = spark.createDataFrame(requests, "path string, ref string")
    return frame, locate(frame, commits, manifests, snapshots, stores, **options)


def test_locate_latest_older_and_renamed(spark, golden, history):
    ids = history[0]
    _, found = located(spark, history, [(golden.a, "HEAD"), (golden.a, "aux1/2"), (golden.B, ids[1]), (golden.c, "HEAD")])
    assert rows_of(found, "path", "ref", "reference", "found_path") == sorted(
        [(golden.a, "HEAD", r, golden.a) for r in ("aux1/3", "aux2/2")]
        + [(golden.a, "aux1/2", "aux1/2", golden.a)]
        + [(golden.B, ids[1], "aux1/2", golden.B)]
        + [(golden.B, ids[1], r, golden.b) for r in ("aux1/1", "aux2/1")]
        + [(golden.c, "HEAD", r, golden.c) for r in ("aux1/1", "aux1/2", "aux1/3", "aux2/1", "aux2/2")]
    )


def test_locate_goes_back_only_unless_told(spark, golden, history):
    ids, commits, manifests, snapshots, stores = history
    late = snapshots.where("reference = 'aux1/2'")
    frame = spark.createDataFrame([(golden.b, ids[0])], "path string, ref string")
    assert locate(frame, commits, manifests, late, stores).isEmpty()
    wide = locate(frame, commits, manifests, late, stores, any_revision=True)
    assert rows_of(wide, "reference", "found_path", "same_path") == [("aux1/2", golden.B, False)]


def test_crowded_content_gives_the_same(spark, history):
    """Every file of a snapshot has the same content, and all are asked for."""
    ids, commits, _, snapshots, stores = history
    manifests = spark.range(600).selectExpr(
        "concat('f', lpad(cast(id % 300 AS string), 3, '0')) AS path", "'blob' AS kind",
        f"'{sha1('')}' AS digest", f"if(id < 300, '{ids[0]}', '{ids[2]}') AS revision",
    )
    requests = spark.range(300).selectExpr("concat('f', lpad(cast(id AS string), 3, '0')) AS path", "'HEAD' AS ref")
    plain = locate(requests, commits, manifests, snapshots, stores)
    split = locate(requests, commits, manifests, snapshots, stores, hot_rows=64)
    assert plain.count() == 300 * 4
    assert rows_of(plain, *plain.columns) == rows_of(split, *plain.columns)


def test_order_of_trial(spark, golden, history):
    _, found = located(spark, history, [(golden.c, "HEAD")])
    ranked = rank_candidates(found).orderBy("try_order")
    assert [row["reference"] for row in ranked.collect()] == ["aux1/3", "aux2/2", "aux1/2", "aux1/1", "aux2/1"]
    chosen = rank_candidates(found, "aux2").where("eligible").orderBy("try_order")
    assert [row["reference"] for row in chosen.collect()] == ["aux2/2", "aux2/1"]


def test_outcomes(spark, golden, history):
    ids, commits, manifests, snapshots, stores = history
    extra = spark.createDataFrame(
        [("new", "blob", sha1("only here"), ids[2]), ("ln", "link", sha1("t"), ids[2])], manifests.schema
    )
    manifests = manifests.union(extra)
    lacking = snapshots.where("reference NOT IN ('aux1/3', 'aux2/2')")
    requests = spark.createDataFrame(
        [(golden.a, "aux1/2"), ("x/y", "HEAD"), ("nope", "HEAD"), ("ln", "HEAD"), ("new", "HEAD"), (golden.c, "zzz"), ("here", "zzz"), (golden.c, "HEAD")],
        "path string, ref string",
    )
    existing = spark.createDataFrame([("here",)], "path string")
    found = classify_requests(requests, commits, manifests, lacking, stores, existing, store="aux2")
    assert rows_of(found, "path", "ref", "outcome") == sorted([
        (golden.a, "aux1/2", "excluded_only"), ("x/y", "HEAD", "directory"), ("nope", "HEAD", "unknown_path"),
        ("ln", "HEAD", "link"), ("new", "HEAD", "no_snapshot"), (golden.c, "zzz", "bad_revision"),
        ("here", "zzz", "exists"), (golden.c, "HEAD", "ok"),
    ])
    empty = classify_requests(requests, commits.where("false"), manifests, lacking, stores)
    assert {row["outcome"] for row in empty.collect()} == {"no_commit"}


def test_names_without_steps_are_moved_once(spark, history, monkeypatch):
    """Only names with steps are looked up by what stands before the steps; what has no key meets no ids."""
    from treeledger.operators import history as module

    ids, commits, _, snapshots, _ = history
    moved = []
    plain = module.lookup_join

    def counted(left, right, on, *rest, **more):
        moved.append((on[0], left.count()))
        return plain(left, right, on, *rest, **more)

    monkeypatch.setattr(module, "lookup_join", counted)
    odd = spark.createDataFrame([("odd~1", ids[0]), ("@", ids[1])], "reference string, base_commit_id string")
    names = [ids[0], ids[1][:8].upper(), "aux1/2", "aux1/2~", "odd~1", "@", "@~1", "HEAD", "HEAD~2", "HEAD~9", "nothing", ids[2] + "^", ids[2] + "^2", "master^"]
    refs = spark.createDataFrame([(name,) for name in names], "ref string")
    found = {row["ref"]: row["seq"] for row in module.resolve_refs(refs, commits, snapshots.select("reference", "base_commit_id").unionByName(odd)).collect()}
    assert found == {
        ids[0]: 0, ids[1][:8].upper(): 1, "aux1/2": 1, "aux1/2~": 0, "odd~1": 0, "@": 1, "@~1": 0, "HEAD": 2, "HEAD~2": 0,
        "HEAD~9": None, "nothing": None, ids[2] + "^": 1, ids[2] + "^2": None, "master^": 1,
    }
    stepped = [name for name in names if "~" in name or "^" in name]
    assert sum(n for key, n in moved if key == "_base") <= len(stepped)
    assert [n for key, n in moved if key == "_key"] == [len(names) - 4]  # all but HEAD and master
