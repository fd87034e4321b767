"""Restrict a manifest to some paths and what lies below them.

Restrict both sides before looking for renames: a rename with one end outside shows as a lone
deletion or addition.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeledger.functions.paths import ancestors_and_self, at_or_below, normalised
from treeledger.operators.spread import lookup_join

Paths = list[str] | tuple[str, ...] | DataFrame


# Paths of a table that are sent to all executors, and depths they may have, at most.
MAX_PATHS = 100_000
MAX_DEPTHS = 32


def _flagged(manifest: DataFrame, paths: DataFrame) -> DataFrame | None:
    """The manifest with ``_below``, whether a row is at or below one of the paths; None for large tables.

    A row is cut to each depth that the paths have, so a small table needs no shuffle of the manifest.
    """
    deep = "if(path = '', 0, size(split(path, '/')))"
    wanted = paths.select("path").distinct().selectExpr("path", f"{deep} AS depth")
    few = wanted.limit(MAX_PATHS + 1).groupBy("depth").agg(F.expr("count(1) AS n")).limit(MAX_DEPTHS + 1).collect()
    if len(few) > MAX_DEPTHS or sum(row["n"] for row in few) > MAX_PATHS:
        return None
    found, below = manifest, F.lit(any(row["depth"] == 0 for row in few))
    for depth in sorted(row["depth"] for row in few if row["depth"]):
        flag = f"_at{depth}"
        given = wanted.where(f"depth = {depth}").selectExpr("path AS _given", f"true AS {flag}")
        cut = F.substring_index(found["path"], "/", depth)
        found = found.join(F.broadcast(given), cut == given["_given"], "left").drop("_given")
        below = below | F.coalesce(F.col(flag), F.lit(False))
    return found.select(*manifest.columns, below.alias("_below"))


def _marked(manifest: DataFrame, paths: DataFrame) -> DataFrame:
    """The paths of the manifest that are one of the paths or below one; some more than once.

    Every row below a directory meets that directory, so few keys may take most rows.
    """
    below = manifest.selectExpr("path", f"explode({ancestors_and_self()}) AS _above")
    wanted = paths.selectExpr("path AS _above").distinct()
    return lookup_join(below, wanted, ["_above"], "left_semi", ["path"]).select("path")


def constrain(manifest: DataFrame, paths: Paths) -> DataFrame:
    """Keep entries equal to or below any of the paths; unknown paths give nothing.

    A list of paths becomes a filter of the scan, a small table of paths one broadcast join for each
    depth that they have, a large one a join by all directories above a row.
    """
    if isinstance(paths, DataFrame):
        flagged = _flagged(manifest, paths)
        if flagged is not None:
            return flagged.where("_below").drop("_below")
        return manifest.join(_marked(manifest, paths), "path", "left_semi")
    return manifest.where(at_or_below("path", [normalised(path) for path in paths]))


def exclude(manifest: DataFrame, paths: Paths) -> DataFrame:
    """The entries that ``constrain`` drops."""
    if isinstance(paths, DataFrame):
        flagged = _flagged(manifest, paths)
        if flagged is not None:
            return flagged.where("NOT _below").drop("_below")
        return manifest.join(_marked(manifest, paths), "path", "left_anti")
    return manifest.where(f"NOT {at_or_below('path', [normalised(path) for path in paths])}")


def keep_unread(old: DataFrame, new: DataFrame, unread: DataFrame) -> DataFrame:
    """The new manifest with the old entries at and below what could not be read, where it has none itself.

    So what was not read is taken to be as it was, and not for deleted. ``unread`` has ``path``.
    """
    columns = ["path", "kind", "digest"]
    left = constrain(old.select(*columns), unread.select("path"))
    return new.select(*columns).unionByName(left.join(new.select("path"), "path", "left_anti"))
