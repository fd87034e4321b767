from conftest import manifest, rows_of
from treeledger.operators.staging import reset_paths, stage_paths


def paths_of(df):
    return [row[0] for row in rows_of(df, "path")]


def test_stage_everything(spark, golden):
    old, new = manifest(spark, golden.r0), manifest(spark, golden.r1)
    assert rows_of(stage_paths(old, new)) == rows_of(new)
    assert rows_of(stage_paths(old, new, ["."])) == rows_of(new)


def test_stage_file_dir_and_missing(spark, golden):
    old, new = manifest(spark, golden.r0), manifest(spark, golden.r1)
    expected = {**golden.r0, golden.a: golden.r1[golden.a], golden.d: golden.r1[golden.d]}
    del expected[golden.b]
    for paths in ([golden.a, golden.b, "x"], spark.createDataFrame([(golden.a,), (golden.b,), ("x",)], "path string")):
        assert rows_of(stage_paths(old, new, paths)) == rows_of(manifest(spark, expected))


def test_file_and_dir_replace_each_other(spark):
    staged = manifest(spark, {"p": "1", "q/r": "2"})
    working = manifest(spark, {"p/s/t": "3", "q": "4"})
    table = spark.createDataFrame([("p/s/t",), ("q",)], "path string")
    for paths in (["p/s/t", "q"], table):
        assert paths_of(stage_paths(staged, working, paths)) == ["p/s/t", "q"]
    # Nothing arrives below, so the file stays.
    assert paths_of(stage_paths(staged, working, ["p/other"])) == ["p", "q/r"]


def test_ignored_paths_are_skipped(spark):
    staged = manifest(spark, {"w/a": "1", "x/w/b": "2", "x/c": "3"})
    working = manifest(spark, {"x/c": "4"})
    ignored = spark.createDataFrame([("w", ".git"), ("x/w", ".svn")], "path string, reason string")
    # Given directly an ignored path keeps its rows; below a given directory they go.
    assert paths_of(stage_paths(staged, working, ["w/a", "x"], ignored)) == ["w/a", "x/c"]
    assert paths_of(stage_paths(staged, working, ["w/*", "x"], ignored, glob=True)) == ["w/a", "x/c"]


def test_patterns_only_when_asked_for(spark):
    staged = manifest(spark, {"foo?.txt": "", "foo1.txt": "", "foo/2.txt": "", "[a].txt": "", "a.txt": ""})
    working = manifest(spark, {"foo1.txt": "", "foo/2.txt": "", "a.txt": ""})
    assert paths_of(stage_paths(staged, working, ["foo?.txt"])) == ["[a].txt", "a.txt", "foo/2.txt", "foo1.txt"]
    assert paths_of(stage_paths(staged, working, ["foo?.txt"], glob=True)) == ["[a].txt", "a.txt", "foo/2.txt"]
    assert paths_of(stage_paths(staged, working, [r"foo\?.txt"], glob=True)) == [
        "[a].txt", "a.txt", "foo/2.txt", "foo1.txt",
    ]
    assert paths_of(stage_paths(staged, working, ["foo*"], glob=True)) == ["[a].txt", "a.txt"]
    assert paths_of(stage_paths(staged, working, ["[!b].txt"], glob=True)) == ["[a].txt", "foo/2.txt", "foo1.txt", "foo?.txt"]
    # A path that is there is no pattern.
    assert paths_of(stage_paths(staged, working, ["foo1.txt"], glob=True)) == sorted(r[0] for r in staged.select("path").collect())


def test_reset(spark, golden):
    head = manifest(spark, golden.r0)
    staged = manifest(spark, {golden.a: "new", "x/y/n": "n", golden.c: golden.r0[golden.c]})
    assert rows_of(reset_paths(staged, head)) == rows_of(head)
    assert rows_of(reset_paths(staged, head, ["."])) == rows_of(head)
    back = {golden.a: "new", golden.c: golden.r0[golden.c], **{p: golden.r0[p] for p in (golden.d, golden.e, golden.f)}}
    assert rows_of(reset_paths(staged, head, ["x"])) == rows_of(manifest(spark, back))
    assert paths_of(reset_paths(staged, None, ["x"])) == [golden.a, golden.c]
    assert reset_paths(staged, None, [""]).isEmpty()
