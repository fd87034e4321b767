"""The comparisons users ask for, put together from manifests, commits and paths."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeledger.operators.compare import delta_of_sides, detect_renames, diff, filter_status
from treeledger.operators.constrain import Paths, constrain
from treeledger.operators.history import resolve_names
from treeledger.operators.intervals import net_changes
from treeledger.operators.spread import HOT_ROWS
from treeledger.operators.staging import path_table, without_ignored
from treeledger.schema import DELTA_COLUMNS

_ENTRY = ("path", "kind", "digest")


def diff_refs(
    commits: DataFrame,
    manifests: DataFrame,
    old_ref: str,
    new_ref: str = "HEAD",
    snapshots: DataFrame | None = None,
    letters: str | None = None,
    limit: int | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Differences between two named revisions; only their partitions are read."""
    old, new = (
        manifests.where(F.col("revision") == commit_id).select(*_ENTRY)
        for commit_id in resolve_names([old_ref, new_ref], commits, snapshots)
    )
    delta = diff(old, new, limit=limit, hot_rows=hot_rows)
    return filter_status(delta, letters)


def diff_refs_of_changes(
    commits: DataFrame,
    changes: DataFrame,
    old_ref: str,
    new_ref: str = "HEAD",
    snapshots: DataFrame | None = None,
    letters: str | None = None,
    limit: int | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """The same from the change sets of a history: only what changed between the two is read."""
    ids = resolve_names([old_ref, new_ref], commits, snapshots)
    places = {r["commit_id"]: r["seq"] for r in commits.where(F.col("commit_id").isin(ids)).select("commit_id", "seq").collect()}
    sides = net_changes(changes, places[ids[0]], places[ids[1]])
    delta = detect_renames(delta_of_sides(sides), limit=limit, hot_rows=hot_rows)
    return filter_status(delta, letters)


def _restricted(
    sides: list[DataFrame], paths: Paths | None, ignored: DataFrame | None
) -> list[DataFrame]:
    sides = [side.select(*_ENTRY) for side in sides]
    if paths is None:
        return sides
    if ignored is not None:
        paths = without_ignored(path_table(sides[0], paths), ignored)
    return [constrain(side, paths) for side in sides]


def diff_staged(
    head: DataFrame | None,
    staged: DataFrame,
    paths: Paths | None = None,
    ignored: DataFrame | None = None,
    limit: int | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """What the next commit would record; without a commit yet everything is added."""
    old = head if head is not None else staged.where("false")
    old, new = _restricted([old, staged], paths, ignored)
    return diff(old, new, limit=limit, hot_rows=hot_rows)


def diff_unstaged(
    staged: DataFrame,
    working: DataFrame,
    paths: Paths | None = None,
    ignored: DataFrame | None = None,
    limit: int | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """What was changed since it was staged."""
    old, new = _restricted([staged, working], paths, ignored)
    return diff(old, new, limit=limit, hot_rows=hot_rows)


def status(
    head: DataFrame | None,
    staged: DataFrame,
    working: DataFrame | None,
    paths: Paths | None = None,
    ignored: DataFrame | None = None,
    show_ignored: bool = False,
    limit: int | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Both comparisons in one table, told apart by ``section``; staged only without ``working``."""
    parts = [
        diff_staged(head, staged, paths, ignored, limit, hot_rows).selectExpr("'staged' AS section", "*")
    ]
    if working is not None:
        unstaged = diff_unstaged(staged, working, paths, ignored, limit, hot_rows)
        parts.append(unstaged.selectExpr("'unstaged' AS section", "*"))
    if show_ignored and ignored is not None:
        shown = ignored
        if paths is not None:
            below = constrain(ignored, paths)
            given = path_table(staged, paths)
            inside = constrain(given.distinct(), ignored)
            shown = below.select("path").union(inside.select("path")).distinct()
        empty = {"status": "'X'", "status_name": "'ignored'", "path": "path", "similarity": "0"}
        columns = [
            f"{empty.get(name, 'cast(NULL AS string)')} AS {name}" for name in DELTA_COLUMNS
        ]
        parts.append(shown.selectExpr("'ignored' AS section", *columns))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result
