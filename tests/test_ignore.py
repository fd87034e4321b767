from conftest import manifest, rows_of
from treeledger.operators.constrain import constrain, exclude
from treeledger.operators.ignore import ignored_dirs, is_ignored, prune_ignored


def paths(spark, *values):
    return spark.createDataFrame([(value,) for value in values], "path string")


def test_flags_and_names(spark):
    listing = paths(
        spark, "a/.git", "a/f", "a/b/g", "c/.svn/x", "c/d", "e/.snapshots/1/f", "e/h", "k/.snapshots", ".hidden", "m/.treeledger/t",
    )
    assert rows_of(prune_ignored(listing)) == [(".hidden",), ("e/h",), ("k/.snapshots",)]
    assert rows_of(ignored_dirs(listing)) == [
        ("a", ".git"), ("c", ".svn"), ("e/.snapshots", ".snapshots"), ("m/.treeledger", ".treeledger"),
    ]


def test_a_flag_in_the_root_leaves_out_everything(spark):
    listing = paths(spark, ".git/HEAD", "a", "b/c")
    assert prune_ignored(listing).isEmpty()
    assert rows_of(ignored_dirs(listing)) == [("", ".git")]
    assert rows_of(is_ignored(paths(spark, "a", "new/x"), listing)) == [("a", True), ("new/x", True)]


def test_only_the_topmost_is_reported(spark):
    listing = paths(spark, "a/.git", "a/b/.svn", "a/b/.snapshots/1/x", "z")
    assert rows_of(ignored_dirs(listing)) == [("a", ".git")]


def test_is_ignored(spark):
    listing = paths(spark, "a/.git", "a/f", "e/.snapshots/1/f", "k/.snapshots")
    asked = paths(spark, "a", "a/new/x", "b", "e", "e/.snapshots", "e/.snapshots/9", "k/.snapshots")
    found = {row["path"]: row["ignored"] for row in is_ignored(asked, listing).collect()}
    assert found == {
        "a": True, "a/new/x": True, "b": False, "e": False, "e/.snapshots": True, "e/.snapshots/9": True, "k/.snapshots": False,
    }


def test_names_and_flags_are_parameters(spark):
    listing = paths(spark, "a/node/x", "b/.stop", "b/c", "d/.git")
    assert rows_of(prune_ignored(listing, names=["node"], flags=[".stop"])) == [("d/.git",)]


def test_constrain_by_list_and_by_table(spark):
    tree = manifest(spark, {"a/b": "1", "a/bc": "2", "a/b/c": "3", "ab": "4", "%_/x": "5", "q'\\": "6"})
    for given, kept in [
        (["a/b"], ["a/b", "a/b/c"]),
        (["a", "a/b"], ["a/b", "a/b/c", "a/bc"]),
        (["%_"], ["%_/x"]),
        (["q'\\"], ["q'\\"]),
        (["nothing"], []),
    ]:
        everything = sorted(row[0] for row in tree.select("path").collect())
        for form in (given, paths(spark, *given)):
            assert [row[0] for row in rows_of(constrain(tree, form), "path")] == kept
            assert [row[0] for row in rows_of(exclude(tree, form), "path")] == [p for p in everything if p not in kept]
    assert constrain(tree, ["."]).count() == 6
    assert constrain(tree, paths(spark, "")).count() == 6


def test_a_list_of_paths_reaches_the_scan(spark, tmp_path):
    manifest(spark, {"a/b": "1", "c": "2"}).write.parquet(f"{tmp_path}/m")
    plan = constrain(spark.read.parquet(f"{tmp_path}/m"), ["a"])._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(path,a/)" in plan
