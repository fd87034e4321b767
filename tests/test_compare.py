import pytest
from pyspark.sql import functions as F

from conftest import manifest, rows_of, sha1
from treeledger.functions.paths import path_change
from treeledger.operators.compare import compare, detect_copies, diff, filter_status, new_content
from treeledger.operators.export import emptied_dirs, raw_lines, rename_plan
from treeledger.plans.status import diff_staged, diff_unstaged, status
from treeledger.sinks.raw import write_raw


def brief(delta):
    return rows_of(delta, "status", "old_path", "new_path")


def test_changes_of_the_golden_tree(spark, golden):
    r0, r1, r2 = (manifest(spark, files) for files in golden.revisions)
    first = diff(r0, r1).orderBy("path").select("status", "old_path", "new_path", "similarity").collect()
    assert [tuple(row) for row in first] == [
        ("R", golden.b, golden.B, 100),
        ("M", golden.a, golden.a, 0),
        ("M", golden.d, golden.d, 0),
    ]
    second = diff(r1, r2).orderBy("path").selectExpr("status", "path", "substr(old_digest, 1, 10) AS d").collect()
    assert [tuple(row) for row in second] == [("M", golden.B, "743ff5540b"), ("M", golden.a, "456b562d01")]
    assert brief(diff_staged(None, r0)) == [("A", None, path) for path in sorted(golden.r0)]


def test_equal_trees_have_no_changes(spark, golden):
    tree = manifest(spark, golden.r0)
    assert diff(tree, tree).isEmpty()
    assert new_content(diff(tree, tree)).first()[0] is False


def test_ties_pair_in_byte_order(spark):
    old = manifest(spark, {"d": "", "z": "", "B": ""})
    new = manifest(spark, {"é": "", "a": "", ".x": "", "A": "", "b": ""})
    assert brief(diff(old, new)) == [
        ("A", None, "b"),
        ("A", None, "é"),
        ("R", "B", ".x"),
        ("R", "d", "A"),
        ("R", "z", "a"),
    ]


def test_edited_move_is_no_rename(spark):
    assert brief(diff(manifest(spark, {"a": "1"}), manifest(spark, {"b": "2"}))) == [("A", None, "b"), ("D", "a", None)]


def test_kind_takes_part(spark):
    old = manifest(spark, {"a": "t", "b": "u"})
    new = manifest(spark, {"a": "t", "c": "u"}, {"a": "link", "c": "link"})
    assert brief(diff(old, new)) == [("A", None, "a"), ("A", None, "c"), ("D", "a", None), ("D", "b", None)]
    assert brief(diff(old, new, typechange=True)) == [("A", None, "c"), ("D", "b", None), ("T", "a", "a")]


def test_rename_limit_keeps_the_first_new_paths(spark):
    old = manifest(spark, {f"old/{n}": str(n) for n in range(9)})
    new = manifest(spark, {f"new/{n}": str(n) for n in range(9)})
    limited = diff(old, new, limit=4)
    assert brief(filter_status(limited, "R")) == [("R", f"old/{n}", f"new/{n}") for n in range(4)]
    assert brief(filter_status(limited, "r")) == [("A", None, f"new/{n}") for n in range(4, 9)] + [
        ("D", f"old/{n}", None) for n in range(4, 9)
    ]
    assert brief(diff(old, new, limit=0)) == brief(compare(old, new))


def test_unreadable_files_may_be_kept_apart(spark):
    zero = "0" * 40
    old = spark.createDataFrame([("a", "blob", zero)], "path string, kind string, digest string")
    new = spark.createDataFrame([("b", "blob", zero)], "path string, kind string, digest string")
    assert brief(diff(old, new)) == [("R", "a", "b")]
    assert brief(diff(old, new, match_unreadable=False)) == [("A", None, "b"), ("D", "a", None)]


def test_copies_come_from_the_first_old_path(spark):
    old = manifest(spark, {"b": "1", "a": "1", "c": "2"})
    new = manifest(spark, {"b": "1", "a": "1", "d": "1", "e": "2", "f": "3"})
    assert brief(diff(old, new, copies=True)) == [("A", None, "f"), ("C", "a", "d"), ("R", "c", "e")]
    assert brief(detect_copies(compare(old, new), old))[1:3] == [("C", "a", "d"), ("C", "c", "e")]


@pytest.mark.parametrize(
    ("letters", "kept"),
    [("AM", "AM"), ("r", "ADM"), ("am", "DR"), ("", "ADMR"), (None, "ADMR"), ("Q", ""), ("q", "ADMR")],
)
def test_filter(spark, letters, kept):
    old = manifest(spark, {"a": "1", "b": "2", "c": "3"})
    new = manifest(spark, {"a": "1!", "d": "2", "e": "5"})
    found = filter_status(diff(old, new), letters).select("status").distinct().collect()
    assert "".join(sorted(row[0] for row in found)) == kept


def test_mixed_filter_is_an_error(spark, golden):
    tree = manifest(spark, golden.r0)
    with pytest.raises(ValueError, match="not a valid"):
        filter_status(diff(tree, tree), "aM")


def test_moves_bring_no_new_content(spark):
    old = manifest(spark, {"a": "1", "b": "2"})
    assert new_content(diff(old, manifest(spark, {"c": "1"}))).first()[0] is False
    assert new_content(diff(old, manifest(spark, {"a": "9", "b": "2"}))).first()[0] is True


def test_path_change_strings(spark):
    pairs = [
        ("x/y/e", "x/y/E", "x/y/{e -> E}"),
        ("a", "A", "a -> A"),
        ("x/y/d", "X/y/d", "{x -> X}/y/d"),
        ("x/y/d", "X/Y/d", "{x/y -> X/Y}/d"),
        ("x/y/d", "x/Y/d", "x/{y -> Y}/d"),
        ("x/y/d", "y/d", "{x/y -> y}/d"),
        ("x/y/d", "x/d", "{x/y -> x}/d"),
        ("a", "x/a", "a -> x/a"),
        ("x/y", "x/y/d", "x/{y -> y/d}"),
        ("a/b", "x/a/b", "{a -> x/a}/b"),
        ("same", "same", "same"),
    ]
    frame = spark.createDataFrame(pairs, "old_path string, new_path string, shown string")
    assert frame.where(F.expr(path_change()) != F.col("shown")).collect() == []


def test_raw_records(spark, golden, tmp_path):
    delta = diff(manifest(spark, golden.r0), manifest(spark, golden.r1))
    lines = [row[0] for row in raw_lines(delta.orderBy("path")).collect()]
    assert lines[0] == "R " + "-".ljust(40) + f"\t{golden.b}\t{golden.B}"
    assert lines[1] == f"M {sha1('a content')}\t{golden.a}"
    write_raw(delta, f"{tmp_path}/raw", nul=True)
    content = b"".join(part.read_bytes() for part in sorted(tmp_path.glob("raw/part-*")))
    fields = content.split(b"\0")
    assert fields[:3] == [("R " + "-".ljust(40)).encode(), golden.b.encode(), golden.B.encode()]
    assert fields[-1] == b""


def test_rename_plan_and_emptied_dirs(spark):
    old = manifest(spark, {"p/q/a": "1", "p/b": "2", "s/t/c": "3", "s/k": "4", "u/v": "5"})
    new = manifest(spark, {"n/a": "1", "n/b": "2", "n/c": "3", "s/k": "4", "u/w": "5"})
    plan = rename_plan(diff(old, new))
    assert rows_of(plan) == [("p/b", "n/b"), ("p/q/a", "n/a"), ("s/t/c", "n/c"), ("u/v", "u/w")]
    assert rows_of(emptied_dirs(old, plan)) == [("p",), ("p/q",), ("s/t",)]
    assert emptied_dirs(old, plan, keep_empty_dirs=True).isEmpty()


def test_paths_restrict_before_renames_are_found(spark, golden):
    moved = {**golden.r0, "x/y/a": golden.r0[golden.a]}
    del moved[golden.a]
    old, new = manifest(spark, golden.r0), manifest(spark, moved)
    assert brief(diff_unstaged(old, new, ["x"])) == [("A", None, "x/y/a")]
    assert brief(diff_unstaged(old, new, [golden.a])) == [("D", golden.a, None)]
    assert brief(diff_unstaged(old, new, [".", "x"])) == [("R", golden.a, "x/y/a")]


def test_status_sections(spark, golden):
    head, working = manifest(spark, golden.r0), manifest(spark, golden.r1)
    staged = manifest(spark, {k: v for k, v in golden.r0.items() if k != golden.b})
    ignored = spark.createDataFrame([("w", ".git"), ("x/z", ".svn")], "path string, reason string")
    shown = status(head, staged, working, ignored=ignored, show_ignored=True)
    assert rows_of(shown, "section", "status", "path") == [
        ("ignored", "X", "w"),
        ("ignored", "X", "x/z"),
        ("staged", "D", golden.b),
        ("unstaged", "A", golden.B),
        ("unstaged", "M", golden.a),
        ("unstaged", "M", golden.d),
    ]
    limited = status(head, staged, working, ["x", "w/in"], ignored, show_ignored=True)
    assert rows_of(limited, "section", "status", "path") == [
        ("ignored", "X", "w/in"),
        ("ignored", "X", "x/z"),
        ("unstaged", "M", golden.d),
    ]
    assert rows_of(status(head, staged, None), "section", "status", "path") == [("staged", "D", golden.b)]
