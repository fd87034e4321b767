"""One identity per directory, equal exactly when everything below is equal."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeledger.functions.digests import lane
from treeledger.functions.paths import proper_ancestors

# Digest and kind have fixed lengths, so the parts need no separator.
_IDENTITY = "sha1(cast(concat(digest, kind, {}) AS binary))"


def dir_rollup(manifest: DataFrame) -> DataFrame:
    """Per directory, the number of files below and two sums over their identities.

    Sums need no order and no list of members: each task adds up what it reads before any row is
    shuffled. They detect changes; they are no proof against a forger.
    """
    inside = manifest.selectExpr(
        "path", "kind", "digest", f"explode({proper_ancestors()}) AS dir"
    ).selectExpr("dir", _IDENTITY.format("substring(path, if(dir = '', 1, length(dir) + 2))") + " AS _id")
    return inside.groupBy("dir").agg(
        F.expr("count(1) AS n_files"),
        F.expr(f"sum({lane('_id', 0)}) AS h1"),
        F.expr(f"sum({lane('_id', 1)}) AS h2"),
    )


def _signed(changes: DataFrame) -> DataFrame:
    """What change sets add and take away: path, kind, digest, sign."""
    return changes.selectExpr(
        "path",
        """explode(concat(if(kind IS NULL, array(), array(struct(1 AS sign, kind, digest))),
            if(old_kind IS NULL, array(), array(struct(-1 AS sign, old_kind AS kind, old_digest AS digest))))) AS e""",
    ).selectExpr("path", "e.sign", "e.kind", "e.digest")


def update_rollup(rollup: DataFrame, changes: DataFrame) -> DataFrame:
    """The rollup of all directories after some changes, from the one before; no manifest is read.

    Counts and sums are added and taken away. A directory that has nothing below it any more is left out.
    """
    moved = _signed(changes).selectExpr("sign", "path", "kind", "digest", f"explode({proper_ancestors()}) AS dir").selectExpr(
        "dir", "sign", _IDENTITY.format("substring(path, if(dir = '', 1, length(dir) + 2))") + " AS _id"
    )
    steps = moved.groupBy("dir").agg(
        F.expr("sum(CAST(sign AS LONG)) AS n_files"),
        F.expr(f"sum(sign * {lane('_id', 0)}) AS h1"),
        F.expr(f"sum(sign * {lane('_id', 1)}) AS h2"),
    )
    names = ["dir", "n_files", "h1", "h2"]
    both = rollup.select(names).unionByName(steps.select(names))
    summed = both.groupBy("dir").agg(*[F.expr(f"CAST(sum({c}) AS {'LONG' if c == 'n_files' else 'DECIMAL(38, 0)'}) AS {c}") for c in names[1:]])
    return summed.where("n_files > 0")


def changed_root(changes: DataFrame) -> DataFrame:
    """What changes add to the rollup of the whole tree, in one row."""
    return _signed(changes).selectExpr("sign", _IDENTITY.format("path") + " AS _id").agg(
        F.expr("coalesce(sum(CAST(sign AS LONG)), 0L) AS n_files"),
        F.expr(f"CAST(coalesce(sum(sign * {lane('_id', 0)}), 0) AS DECIMAL(38, 0)) AS h1"),
        F.expr(f"CAST(coalesce(sum(sign * {lane('_id', 1)}), 0) AS DECIMAL(38, 0)) AS h2"),
    )


def root_rollup(manifest: DataFrame) -> DataFrame:
    """The rollup of the whole tree in one row; an empty tree has zero sums."""
    return manifest.selectExpr(_IDENTITY.format("path") + " AS _id").agg(
        F.expr("count(1) AS n_files"),
        F.expr(f"coalesce(sum({lane('_id', 0)}), 0) AS h1"),
        F.expr(f"coalesce(sum({lane('_id', 1)}), 0) AS h2"),
    )


def changed_dirs(old: DataFrame, new: DataFrame) -> DataFrame:
    """Directories that differ between two rollups, or exist in one only."""
    sides = old.selectExpr("dir", "struct(n_files, h1, h2) AS _old").join(
        new.selectExpr("dir", "struct(n_files, h1, h2) AS _new"), "dir", "full_outer"
    )
    return sides.where("NOT _old <=> _new").select("dir")
