"""Changes in the forms other tools read."""

from pyspark.sql import DataFrame

from treeledger.functions.paths import path_change as short_form
from treeledger.functions.paths import proper_ancestors
from treeledger.functions.status import shown_old_digest
from treeledger.operators.compare import filter_status
from treeledger.schema import DIGEST_LENGTH


def with_path_change(delta: DataFrame) -> DataFrame:
    """Add the display form of the path, which writes shared parts of a rename once."""
    shown = short_form("coalesce(old_path, new_path)", "coalesce(new_path, old_path)")
    return delta.selectExpr("*", f"{shown} AS path_change")


def raw_lines(delta: DataFrame, nul: bool = False) -> DataFrame:
    """One record per change: letter, old digest, old path and, if it differs, the new path.

    Records end where the writer ends them; with ``nul`` the fields in them are separated by NUL.
    """
    separator = "char(0)" if nul else "'\\t'"
    moved = "old_path <> new_path"
    return delta.withColumn("_shown", shown_old_digest()).selectExpr(
        f"""concat_ws({separator},
            concat(status, ' ', rpad(_shown, {DIGEST_LENGTH}, ' ')),
            coalesce(old_path, new_path),
            if({moved}, new_path, NULL)) AS line"""
    )


def rename_plan(delta: DataFrame) -> DataFrame:
    """Moves to replay on a copy before the rest is transferred."""
    return filter_status(delta, "R").selectExpr("old_path AS src", "new_path AS dst")


def emptied_dirs(old: DataFrame, plan: DataFrame, keep_empty_dirs: bool = False) -> DataFrame:
    """Directories of the copy that hold no file any more once the moves are replayed."""
    above = f"explode({proper_ancestors()}) AS dir"
    left = plan.selectExpr("src AS path").selectExpr(above).where("dir <> ''").distinct()
    if keep_empty_dirs:
        return left.where("false")
    remaining = old.select("path").join(plan.selectExpr("src AS path"), "path", "left_anti")
    holding = remaining.unionByName(plan.selectExpr("dst AS path")).selectExpr(above).distinct()
    return left.join(holding, "dir", "left_anti")
