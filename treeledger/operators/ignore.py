"""Directories that are left out: by their own name, or by a marker entry inside them."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeledger.functions.paths import ancestors_and_self, parent_dir, proper_ancestors, quoted
from treeledger.operators.spread import lookup_join, spread_join
from treeledger.schema import LEDGER_DIR, SKIP_FLAGS, SKIP_NAMES

NAMES = (*SKIP_NAMES, LEDGER_DIR)


def _array(values: Sequence[str]) -> str:
    return "array(" + ", ".join(quoted(value) for value in values) + ")"


def _above(position: str) -> str:
    return f"if({position} = 0, '', substring_index(path, '/', {position}))"


def hits(
    listing: DataFrame, names: Sequence[str] = NAMES, flags: Sequence[str] = SKIP_FLAGS
) -> DataFrame:
    """Every directory that is left out and the name or marker that says so.

    Only directories have names that count: all components of a listed path but the last. A marker
    may be any component and kills the directory that holds it.
    """
    by_name = f"""transform(
        filter(sequence(1, size(_parts)), n -> n < size(_parts) AND array_contains({_array(names)}, _parts[n - 1])),
        n -> struct({_above('n')} AS path, _parts[n - 1] AS reason))"""
    by_flag = f"""transform(
        filter(sequence(1, size(_parts)), n -> array_contains({_array(flags)}, _parts[n - 1])),
        n -> struct({_above('n - 1')} AS path, _parts[n - 1] AS reason))"""
    return (
        listing.selectExpr("path", "split(path, '/') AS _parts")
        .where(f"arrays_overlap(_parts, {_array([*names, *flags])})")
        .selectExpr(f"inline(concat({by_name}, {by_flag}))")
        .groupBy("path")
        .agg(F.expr("min(reason) AS reason"))
    )


def ignored_dirs(
    listing: DataFrame, names: Sequence[str] = NAMES, flags: Sequence[str] = SKIP_FLAGS
) -> DataFrame:
    """The topmost directories that are left out, each with the least name or marker as reason."""
    found = hits(listing, names, flags)
    above = found.selectExpr("path", f"explode({proper_ancestors()}) AS _above")
    covered = lookup_join(above, found.selectExpr("path AS _above"), ["_above"], "left_semi", ["path"])
    return found.join(covered.select("path"), "path", "left_anti")


def prune_ignored(
    listing: DataFrame, names: Sequence[str] = NAMES, flags: Sequence[str] = SKIP_FLAGS
) -> DataFrame:
    """The listing without everything at or below a directory that is left out.

    A path's own components decide most cases without a join. Markers of other rows are looked up
    once per directory, not once per file.
    """
    own = f"""arrays_overlap(slice(split(path, '/'), 1, size(split(path, '/')) - 1), {_array(names)})
              OR arrays_overlap(split(path, '/'), {_array(flags)})"""
    plain = listing.where(f"NOT ({own})").selectExpr("*", f"{parent_dir()} AS _dir")
    flagged = (
        listing.selectExpr("split(path, '/') AS _parts", "path")
        .where(f"arrays_overlap(_parts, {_array(flags)})")
        .selectExpr(
            f"""explode(transform(
                filter(sequence(1, size(_parts)), n -> array_contains({_array(flags)}, _parts[n - 1])),
                n -> {_above('n - 1')})) AS _above"""
        )
        .distinct()
    )
    dirs = plain.select("_dir").distinct()
    above = dirs.selectExpr("_dir", f"explode({ancestors_and_self('_dir')}) AS _above")
    dead = lookup_join(above, flagged, ["_above"], "left_semi", ["_dir"]).select("_dir").distinct()
    return spread_join(plain, dead, ["_dir"], "left_anti", ["path"]).select(*listing.columns)


def is_ignored(
    paths: DataFrame,
    listing: DataFrame,
    names: Sequence[str] = NAMES,
    flags: Sequence[str] = SKIP_FLAGS,
) -> DataFrame:
    """For each path, whether it or a directory above it is left out."""
    asked = paths.select("path").distinct()
    found = hits(listing, names, flags).selectExpr("path AS _above", "true AS _hit")
    own = f"""arrays_overlap(slice(split(path, '/'), 1, size(split(path, '/')) - 1), {_array(names)})
              OR arrays_overlap(split(path, '/'), {_array(flags)})"""
    above = asked.selectExpr("path", f"explode({ancestors_and_self()}) AS _above")
    return (
        lookup_join(above, found, ["_above"], "left", ["path"])
        .groupBy("path")
        .agg(F.expr("coalesce(bool_or(_hit), false) AS _hit"))
        .selectExpr("path", f"_hit OR {own} AS ignored")
    )
