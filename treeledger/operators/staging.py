"""The staged manifest: replace what lies at or below the given paths."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeledger.functions.paths import (
    at_or_below,
    glob_regex,
    normalised,
    proper_ancestors,
    quoted,
)
from treeledger.operators.constrain import Paths, constrain, exclude


def without_ignored(paths: DataFrame, ignored: DataFrame) -> DataFrame:
    """The paths that are in no ignored directory."""
    inside = constrain(paths.select("path").distinct(), ignored)
    return paths.join(inside, "path", "left_anti")


def path_table(manifest: DataFrame, paths: Paths) -> DataFrame:
    if isinstance(paths, DataFrame):
        return paths.select("path")
    rows = [(normalised(path),) for path in paths]
    return manifest.sparkSession.createDataFrame(rows, "path string")


def _replace(staged: DataFrame, source: DataFrame, paths: Paths) -> DataFrame:
    """Rows at or below the paths come from the source, all others stay.

    A file that arrives takes the place of a file that was where it needs a directory.
    """
    columns = ["path", "kind", "digest"]
    kept = exclude(staged.select(columns), paths)
    arriving = constrain(source.select(columns), paths)
    above = arriving.selectExpr(f"explode({proper_ancestors()}) AS path")
    if not isinstance(paths, DataFrame):
        # Only directories above the given paths can be in the way.
        parts = [normalised(path).split("/") for path in paths]
        dirs = sorted({"/".join(p[:n]) for p in parts for n in range(1, len(p))})
        if not dirs:
            return kept.unionByName(arriving)
        above = above.where(F.col("path").isin(dirs))
    return kept.join(above.distinct(), "path", "left_anti").unionByName(arriving)


def stage_paths(
    staged: DataFrame,
    working: DataFrame,
    paths: Paths | None = None,
    ignored: DataFrame | None = None,
    glob: bool = False,
) -> DataFrame:
    """Take the working tree's state of the paths into the staged manifest.

    Without paths everything is taken. A directory replaces all rows below it, a file its own row,
    and a path that is gone removes its rows. Paths in ignored directories are skipped. With
    ``glob`` a path that is gone also removes the rows it matches as a pattern.
    """
    if paths is None:
        return working.select("path", "kind", "digest")
    wanted: Paths = paths
    if ignored is not None:
        wanted = without_ignored(path_table(staged, paths), ignored)
    result = _replace(staged, working, wanted)
    if glob:
        if isinstance(paths, DataFrame):
            raise ValueError("patterns are given as a list")
        for pattern in paths:
            if normalised(pattern) == "":
                continue
            stays = working.where(at_or_below("path", [normalised(pattern)])).exists()
            if ignored is not None:
                parts = normalised(pattern).split("/")
                above = ["/".join(parts[:n]) for n in range(len(parts) + 1)]
                stays = stays | ignored.where(F.col("path").isin(above)).exists()
            matched = F.expr(f"path RLIKE {quoted(glob_regex(pattern))}")
            result = result.where(~matched | stays)
    return result


def reset_paths(
    staged: DataFrame,
    head: DataFrame | None,
    paths: Paths | None = None,
    ignored: DataFrame | None = None,
) -> DataFrame:
    """Set the paths back to the last commit; without a commit they leave the staged manifest."""
    source = head if head is not None else staged.where("false")
    return stage_paths(staged, source, paths, ignored)
