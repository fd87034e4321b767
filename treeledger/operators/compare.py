"""Two manifests in, the changes between them out."""

import functools
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeledger.functions.paths import parent_dir
from treeledger.functions.status import STATUS_NAMES, adds_new_content
from treeledger.operators.spread import HOT_ROWS, lookup_join, rank_in_groups, sample_rows, spread_join
from treeledger.schema import ZERO_DIGEST
from treeledger.session import stored

# Rows of one group that are paired in one task.
_PAIR_BLOCK = 1 << 16

_NAME = "CASE {} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in STATUS_NAMES.items()) + " END AS status_name"


def _side(manifest: DataFrame, scope: Sequence[str], side: str) -> DataFrame:
    return manifest.selectExpr(*scope, "path", f"kind AS {side}_kind", f"digest AS {side}_digest")


def compare(
    old: DataFrame,
    new: DataFrame,
    scope: Sequence[str] = (),
    typechange: bool = False,
    match_unreadable: bool = True,
) -> DataFrame:
    """Paths that were added, deleted or changed; equal entries leave no row.

    A path that turns from file to link or back is deleted and added, or one ``T`` row with
    ``typechange``. ``scope`` names columns that keep several comparisons apart in one job. Two
    unreadable files are equal unless ``match_unreadable`` is off.
    """
    known = "true" if match_unreadable else f"NOT new_digest <=> '{ZERO_DIGEST}'"
    sides = (
        _side(old, scope, "old")
        .join(_side(new, scope, "new"), [*scope, "path"], "full_outer")
        .where(f"NOT (old_kind <=> new_kind AND old_digest <=> new_digest AND {known})")
    )
    return delta_of_sides(sides, scope, typechange)


def delta_of_sides(sides: DataFrame, scope: Sequence[str] = (), typechange: bool = False) -> DataFrame:
    """The changes that rows stand for which differ: path, old_kind, old_digest, new_kind, new_digest."""
    other_kind = "array('T')" if typechange else "array('D', 'A')"
    return (
        sides.selectExpr(
            "*",
            f"""explode(CASE WHEN old_kind IS NULL THEN array('A')
                             WHEN new_kind IS NULL THEN array('D')
                             WHEN old_kind <> new_kind THEN {other_kind}
                             ELSE array('M') END) AS status""",
        )
        .selectExpr(
            *scope,
            "status",
            _NAME.format("status"),
            "if(status = 'A', NULL, path) AS old_path",
            "if(status = 'D', NULL, path) AS new_path",
            "path",
            "if(status = 'A', NULL, old_kind) AS old_kind",
            "if(status = 'D', NULL, new_kind) AS new_kind",
            "if(status = 'A', NULL, old_digest) AS old_digest",
            "if(status = 'D', NULL, new_digest) AS new_digest",
            "0 AS similarity",
        )
    )


def _with_content(delta: DataFrame, scope: Sequence[str], match_unreadable: bool) -> DataFrame:
    """Add what a deleted and an added row must share to be one renamed file.

    Columns that follow from the status are left out, as all rows are shuffled next.
    """
    takes_part = "status IN ('A', 'D')"
    if not match_unreadable:
        takes_part += f" AND coalesce(new_digest, old_digest) <> '{ZERO_DIGEST}'"
    # Rows that take no part are spread by their path.
    return delta.selectExpr(
        *scope,
        "status",
        "path",
        "old_kind",
        "new_kind",
        "old_digest",
        "new_digest",
        f"if({takes_part}, status, '-') AS _side",
        f"if({takes_part}, coalesce(new_kind, old_kind), '-') AS _kind",
        f"if({takes_part}, coalesce(new_digest, old_digest), path) AS _digest",
    )


def detect_renames(
    delta: DataFrame,
    scope: Sequence[str] = (),
    limit: int | None = None,
    match_unreadable: bool = True,
    sample: DataFrame | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Turn a deletion and an addition of the same content into one ``R`` row.

    ``delta`` is what ``compare`` gives. Copies of one content are paired in path order, the first deleted with the first added and so
    on; what is left over stays as it is. With ``limit`` only that many renames per comparison are
    kept, in the order of their new paths. ``sample`` may give a cheaper sample of the delta.
    """
    if sample is None:
        sample = sample_rows(delta, ["path"], hot_rows)
    ranked = rank_in_groups(
        _with_content(delta, scope, match_unreadable),
        [*scope, "_kind", "_digest", "_side"],
        "path",
        "_rank",
        sample=_with_content(sample, scope, match_unreadable),
        hot_rows=hot_rows,
        cluster=[*scope, "_kind", "_digest"],
    ).selectExpr("*", f"(_rank - 1) div {_PAIR_BLOCK} AS _block")

    # In this order a deletion is directly followed by the addition of the same rank.
    group = ", ".join([*scope, "_kind", "_digest", "_block"])
    window = f"OVER (PARTITION BY {group} ORDER BY _rank, _side DESC)"
    paired = (
        ranked.selectExpr(
            "*",
            f"lead(struct(_side, _rank, path)) {window} AS _next",
            f"lag(struct(_side, _rank)) {window} AS _previous",
        )
        .selectExpr(
            "*",
            "coalesce(_side = 'D' AND _next._side = 'A' AND _next._rank = _rank, false) AS _renamed",
            "coalesce(_side = 'A' AND _previous._side = 'D' AND _previous._rank = _rank, false) AS _taken",
        )
        .where("NOT _taken")
        .selectExpr(
            *scope,
            "if(_renamed, 'R', status) AS status",
            "path AS _old_path",
            "if(_renamed, _next.path, path) AS path",
            "old_kind",
            "if(_renamed, old_kind, new_kind) AS new_kind",
            "old_digest",
            "if(_renamed, old_digest, new_digest) AS new_digest",
        )
        .selectExpr(
            *scope,
            "status",
            _NAME.format("status"),
            "if(status = 'A', NULL, _old_path) AS old_path",
            "if(status = 'D', NULL, path) AS new_path",
            "path",
            "old_kind",
            "new_kind",
            "old_digest",
            "new_digest",
            "if(status = 'R', 100, 0) AS similarity",
        )
    )
    return paired if limit is None else _limit_renames(paired, scope, limit, hot_rows)


def _limit_renames(delta: DataFrame, scope: Sequence[str], limit: int, hot_rows: int) -> DataFrame:
    """Split the renames beyond the limit into the deletion and the addition they came from."""
    grouped = delta.selectExpr(
        "*",
        "if(status = 'R', 'R', path) AS _group",
        "concat_ws('/', path, status) AS _order",
    )
    # Kept, as it is looked at twice and each time would pair all renames anew.
    sample = stored(sample_rows(grouped, ["_order"], hot_rows).select(*scope, "_group", "_order"), "sampled")
    ranked = rank_in_groups(
        grouped, [*scope, "_group"], "_order", "_rank", sample=sample, hot_rows=hot_rows
    )
    return (
        ranked.selectExpr("*", f"status = 'R' AND _rank > {limit} AS _split")
        .selectExpr(
            "* EXCEPT (status)",
            "explode(if(_split, array('D', 'A'), array(status))) AS status",
        )
        .selectExpr(
            *scope,
            "status",
            _NAME.format("status"),
            "if(_split AND status = 'A', NULL, old_path) AS old_path",
            "if(_split AND status = 'D', NULL, new_path) AS new_path",
            "if(_split AND status = 'D', old_path, path) AS path",
            "if(_split AND status = 'A', NULL, old_kind) AS old_kind",
            "if(_split AND status = 'D', NULL, new_kind) AS new_kind",
            "if(_split AND status = 'A', NULL, old_digest) AS old_digest",
            "if(_split AND status = 'D', NULL, new_digest) AS new_digest",
            "if(_split, 0, similarity) AS similarity",
        )
    )


def detect_copies(
    delta: DataFrame,
    old: DataFrame,
    scope: Sequence[str] = (),
    hot_rows: int = HOT_ROWS,
    match_unreadable: bool = True,
) -> DataFrame:
    """Mark the additions left after renames whose content the old manifest already had.

    The first old path with the content becomes the source. What is unreadable is no copy of
    anything with ``match_unreadable`` off.
    """
    if not match_unreadable:
        old = old.where(f"digest <> '{ZERO_DIGEST}'")
    sources = (
        old.selectExpr(*scope, "kind AS _kind", "digest AS _digest", "path")
        .groupBy(*scope, "_kind", "_digest")
        .agg(F.expr("min(path) AS _source"))
    )
    candidates = delta.selectExpr(
        "*",
        "if(status = 'A', new_kind, '-') AS _kind",
        "if(status = 'A', new_digest, path) AS _digest",
    )
    found = spread_join(
        candidates, sources, [*scope, "_kind", "_digest"], "left", ["path", "status"], hot_rows
    )
    return found.selectExpr("*", "_source IS NOT NULL AS _copied").selectExpr(
        *scope,
        "if(_copied, 'C', status) AS status",
        "if(_copied, 'copied', status_name) AS status_name",
        "if(_copied, _source, old_path) AS old_path",
        "new_path",
        "path",
        "if(_copied, new_kind, old_kind) AS old_kind",
        "new_kind",
        "if(_copied, new_digest, old_digest) AS old_digest",
        "new_digest",
        "if(_copied, 100, similarity) AS similarity",
    )


def diff(
    old: DataFrame,
    new: DataFrame,
    scope: Sequence[str] = (),
    renames: bool = True,
    copies: bool = False,
    typechange: bool = False,
    limit: int | None = None,
    match_unreadable: bool = True,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Compare two manifests and pair what was moved.

    Crowded contents are looked for in a comparison of two samples: both sides keep the same
    paths, so that job shuffles almost nothing. It runs when this function is called.
    """
    delta = compare(old, new, scope, typechange, match_unreadable)
    if renames:
        parts = [sample_rows(side, ["path"], hot_rows) for side in (old, new)]
        sample = compare(*parts, scope, typechange)
        delta = detect_renames(delta, scope, limit, match_unreadable, sample, hot_rows)
    if copies:
        delta = detect_copies(delta, old, scope, hot_rows, match_unreadable)
    return delta


def differing_dirs(old: DataFrame, new: DataFrame) -> DataFrame:
    """Directories that differ between two stored rollups, found from the root down; below equal ones nothing is looked at.

    Each step reads the children of the directories that differ one level above.
    """
    sides = [side.selectExpr("dir", "struct(n_files, h1, h2) AS _sum", f"if(dir = '', NULL, {parent_dir('dir')}) AS _parent") for side in (old, new)]
    level, found = None, []
    while True:
        parts = [side.where("dir = ''") if level is None else lookup_join(side, level, ["_parent"], "left_semi", ["dir"]) for side in sides]
        both = parts[0].selectExpr("dir", "_sum AS _old").join(parts[1].selectExpr("dir", "_sum AS _new"), "dir", "full_outer")
        level = stored(both.where("NOT _old <=> _new").selectExpr("dir AS _parent"), "differing")
        if level.isEmpty():
            return functools.reduce(DataFrame.unionByName, found, level).selectExpr("_parent AS dir")
        found.append(level)


def in_dirs(manifest: DataFrame, dirs: DataFrame) -> DataFrame:
    """The entries that lie directly in one of the directories, which are sent to the manifest if they are few."""
    placed = manifest.selectExpr("*", f"{parent_dir()} AS dir")
    return lookup_join(placed, dirs, ["dir"], "left_semi", ["path"]).drop("dir")


def diff_pruned(old: DataFrame, new: DataFrame, old_rollup: DataFrame, new_rollup: DataFrame, **options) -> DataFrame:
    """What ``diff`` gives, without comparing what lies in directories whose rollups are equal.

    Copies need the whole old manifest, so they cannot be looked for here.
    """
    if options.get("copies"):
        raise ValueError("copies may come from directories that are left out")
    dirs = differing_dirs(old_rollup, new_rollup)
    return diff(in_dirs(old, dirs), in_dirs(new, dirs), **options)


def filter_status(delta: DataFrame, letters: str | None) -> DataFrame:
    """Keep the statuses in upper-case letters, or all but those in lower-case letters."""
    if not letters:
        return delta
    if letters not in (letters.upper(), letters.lower()):
        raise ValueError(f"not a valid status filter: {letters}")
    listed = sorted(set(letters))
    if letters[0].isupper():
        return delta.where(F.col("status").isin(listed))
    return delta.where(~F.lower("status").isin(listed))


def new_content(delta: DataFrame) -> DataFrame:
    """One row: does anything in the diff bring content that no earlier revision had."""
    return delta.agg(
        F.coalesce(F.bool_or(adds_new_content()), F.lit(False)).alias("adds_new_content")
    )


def apply_delta(old: DataFrame, delta: DataFrame) -> DataFrame:
    """The manifest that the changes turn the old one into. The change table is read once.

    Each change says which path goes and which entry comes; the entries of a path meet in one group, where what
    comes counts before what goes, and that before what was there.
    """
    none = "CAST(NULL AS STRING)"
    moved = delta.selectExpr(
        f"""explode(concat(
            if(status IN ('D', 'R', 'M', 'T'), array(struct(old_path AS path, 1 AS turn, {none} AS kind, {none} AS digest)), array()),
            if(status <> 'D', array(struct(new_path AS path, 2 AS turn, new_kind AS kind, new_digest AS digest)), array()))) AS e"""
    ).select("e.*")
    every = old.selectExpr("path", "0 AS turn", "kind", "digest").unionByName(moved)
    last = every.groupBy("path").agg(F.expr("max_by(struct(kind, digest), turn) AS _entry"))
    return last.where("_entry.kind IS NOT NULL").selectExpr("path", "_entry.kind AS kind", "_entry.digest AS digest")
