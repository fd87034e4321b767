import random

import pytest

from conftest import manifest, rows_of
from treeledger.operators.compare import apply_delta, diff
from treeledger.operators.rollup import changed_dirs, dir_rollup, root_rollup


def random_tree(seed: int) -> dict[str, str]:
    rng = random.Random(seed)
    dirs = ["", "a/", "a/b/", "B/", "é/", "a/b/c/d/"]
    return {rng.choice(dirs) + rng.choice("pqrstuv") + str(rng.randrange(4)): rng.choice("xyz") for _ in range(40)}


@pytest.mark.parametrize("seed", range(4))
def test_diff(spark, seed):
    old_files, new_files = random_tree(seed), random_tree(seed + 100)
    old, new = manifest(spark, old_files), manifest(spark, new_files)
    delta = diff(old, new, copies=seed % 2 == 1)
    assert rows_of(apply_delta(old, delta)) == rows_of(new)

    plain = diff(old, new)
    back = diff(new, old)
    mirrored = {"A": "D", "D": "A", "M": "M", "R": "R"}
    assert sorted((mirrored[r["status"]], r["new_path"] or "", r["old_path"] or "") for r in plain.collect()) == sorted(
        (r["status"], r["old_path"] or "", r["new_path"] or "") for r in back.collect()
    )

    gone = [c for p, c in old_files.items() if p not in new_files]
    fresh = [c for p, c in new_files.items() if p not in old_files]
    assert plain.where("status = 'R'").count() == sum(min(gone.count(c), fresh.count(c)) for c in "xyz")


def test_rollups_are_equal_where_trees_are(spark):
    one = manifest(spark, {"a/x/1": "p", "a/x/2": "q", "b/x/1": "p", "b/x/2": "q", "c": "p"})
    sums = {row["dir"]: tuple(row)[1:] for row in dir_rollup(one).collect()}
    assert set(sums) == {"", "a", "b", "a/x", "b/x"}
    assert sums["a"] == sums["b"] and sums["a/x"] == sums["b/x"]
    assert sums["a"] != sums["a/x"]
    assert sums[""][0] == 5
    assert sums[""] == tuple(root_rollup(one).first())

    two = manifest(spark, {"a/x/1": "p", "a/x/2": "q", "b/x/1": "q", "b/x/2": "p", "d/e": "p"})
    assert rows_of(changed_dirs(dir_rollup(one), dir_rollup(two))) == [("",), ("b",), ("b/x",), ("d",)]
    assert changed_dirs(dir_rollup(one), dir_rollup(one)).isEmpty()
