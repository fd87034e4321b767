"""Backup stores: check their addresses, find their snapshots, and see what each is a copy of."""

import itertools
import logging
import os
import stat
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pandas as pd
import pyarrow.compute as pc
import pyarrow.dataset as ds
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeledger.operators.spread import lookup_join
from treeledger.schema import LEDGER_DIR, SNAPSHOTS, UNREAD_COPIES
from treeledger.session import ship_package, stored
from treeledger.sources.names import to_name, to_text

logger = logging.getLogger(__name__)

# The parts of an address, after RFC 3986.
_SCHEME = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?"
_AUTHORITY = r"(?://([^/?#]*))?"
_PARTS = _SCHEME + _AUTHORITY + r"([^?#]*)"


def check_stores(stores: DataFrame) -> DataFrame:
    """Stores with the parts of their address and ``store_error``, NULL for one that is usable."""

    def part(number: int) -> str:
        pattern = _PARTS.replace("\\", "\\\\")
        return f"regexp_extract(url, '{pattern}', {number})"

    return (
        stores.selectExpr(
            "*",
            f"lower({part(1)}) AS _scheme",
            f"{part(2)} AS _host",
            f"{part(3)} AS _path",
        )
        .selectExpr(
            "* EXCEPT (_scheme, _host, _path)",
            "if(_scheme = '', 'file', _scheme) AS scheme",
            "_host AS host",
            "_path AS url_path",
            r"""CASE WHEN substring_index(_path, '/', -1) LIKE '%;%' THEN 'parameters must be empty'
                     WHEN url LIKE '%?%' AND instr(url, '?') < if(instr(url, '#') = 0, length(url) + 1, instr(url, '#'))
                          AND NOT url RLIKE '^[^?#]*[?](#|$)' THEN 'query must be empty'
                     WHEN url RLIKE '#.' THEN 'fragment must be empty'
                     WHEN _path = '' THEN 'no path'
                     WHEN _scheme IN ('', 'file') AND _host <> '' THEN 'host must be empty'
                     WHEN _scheme = 'ssh' AND _host = '' THEN 'host must not be empty'
                     WHEN _scheme NOT IN ('', 'file', 'ssh') THEN 'unknown scheme'
                     WHEN instr(_host, '*') > 0 THEN 'host must not contain *'
                     WHEN length(_path) - length(replace(_path, '*', '')) > 1 THEN 'more than one *'
                END AS store_error""",
        )
    )


def snapshot_ids(paths: DataFrame, stores: DataFrame, marker: str = LEDGER_DIR) -> DataFrame:
    """Snapshots that a table of paths shows for each store: the part that ``*`` stands for.

    The paths that count are those inside the ledger folder of a snapshot.
    """
    wild = check_stores(stores).where("store_error IS NULL AND instr(url_path, '*') > 0")
    # A snapshot's address differs from the pattern in one component, so both meet in one key.
    keyed = wild.selectExpr(
        "store",
        "ordinal",
        f"concat(trim('/' FROM url_path), '/{marker}') AS _pattern",
    ).selectExpr(
        "store",
        "ordinal",
        "size(split(_pattern, '/')) AS _depth",
        "size(split(substring_index(_pattern, '*', 1), '/')) AS _place",
        "_pattern",
    )
    keyed = keyed.selectExpr(
        "*",
        "split(_pattern, '/')[_place - 1] AS _component",
        "concat_ws('/', slice(split(_pattern, '/'), 1, _place - 1), '*',"
        " slice(split(_pattern, '/'), _place + 1, _depth)) AS _key",
    ).selectExpr(
        "store",
        "ordinal",
        "_key",
        "substring_index(_component, '*', 1) AS _before",
        "substring_index(_component, '*', -1) AS _after",
    )
    copies = (
        paths.selectExpr("split(trim('/' FROM path), '/') AS _parts")
        .where(f"array_contains(_parts, '{marker}')")
        .selectExpr(f"slice(_parts, 1, array_position(_parts, '{marker}')) AS _parts")
        .distinct()
        .selectExpr("_parts", "explode(sequence(1, size(_parts))) AS _n")
        .selectExpr(
            "_parts[_n - 1] AS _name",
            "concat_ws('/', slice(_parts, 1, _n - 1), '*', slice(_parts, _n + 1, size(_parts))) AS _key",
        )
    )
    # Every path of a host may share a key; the patterns are as few as the stores.
    return (
        lookup_join(copies, keyed, ["_key"], "inner", ["_name", "_key"])
        .where(
            """startswith(_name, _before) AND endswith(_name, _after)
               AND length(_name) >= length(_before) + length(_after)
               AND (_before <> '' OR NOT startswith(_name, '.'))"""
        )
        .selectExpr(
            "store",
            "substring(_name, length(_before) + 1, length(_name) - length(_before) - length(_after)) AS snapshot_id",
        )
        .distinct()
        .selectExpr("store", "snapshot_id", "concat(store, '/', snapshot_id) AS reference")
    )


_COPY = "store string, snapshot_id string, root string, reason string"


class Copies(NamedTuple):
    """What stores hold, and what of them could not be read."""

    found: DataFrame
    unread: DataFrame  # store, snapshot_id (NULL: the store itself), reason


def _apart(read: DataFrame, label: str) -> Copies:
    """Found rows and errors of one reading, which is done once."""
    kept = stored(read, label)
    return Copies(kept.where("reason IS NULL").drop("reason"), kept.where("reason IS NOT NULL").select(*UNREAD_COPIES.names))


def _reason(error: Exception) -> str:
    logger.error("not read: %s", error)
    return to_text(getattr(error, "strerror", None) or str(error) or type(error).__name__)


def _frame(store: str, ids: list, roots: list, reason: str | None = None) -> pd.DataFrame:
    return pd.DataFrame({"store": store, "snapshot_id": ids, "root": roots, "reason": reason}, dtype=object)


def _names(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The names that may stand for ``*``; a store without ``*`` is one snapshot without id."""
    for frame in frames:
        for store, url_path in zip(frame["store"], frame["url_path"]):
            path = to_name(url_path)
            if "*" not in path:
                yield _frame(store, [None], [url_path])
                continue
            before, after = path.split("*")
            parent, start = os.path.split(before)
            end, _, below = after.partition("/")
            try:
                with os.scandir(parent or "/") as entries:
                    names = (
                        n.name
                        for n in entries
                        if n.name.startswith(start) and n.name.endswith(end) and len(n.name) >= len(start) + len(end)
                        and (start or not n.name.startswith("."))
                    )
                    while found := list(itertools.islice(names, 10_000)):
                        ids = [to_text(n[len(start) : len(n) - len(end)]) for n in found]
                        yield _frame(store, ids, [to_text(os.path.join(parent, n, below)) for n in found])
            except OSError as error:
                yield _frame(store, [None], [None], _reason(error))


def _holding(marker: str):
    def holds(root: str) -> bool:
        try:
            return stat.S_ISDIR(os.stat(os.path.join(to_name(root), marker)).st_mode)
        except (FileNotFoundError, NotADirectoryError):
            return False

    def keep(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for row in frame.itertuples(index=False):
                if not pd.isna(row.reason):
                    rows.append(tuple(row))
                    continue
                try:
                    if pd.isna(row.snapshot_id) or holds(row.root):
                        rows.append(tuple(row))
                except OSError as error:
                    rows.append((row.store, row.snapshot_id, row.root, _reason(error)))
            yield pd.DataFrame(rows, columns=frame.columns, dtype=object)

    return keep


def read_copies(stores: DataFrame, marker: str = LEDGER_DIR, tasks: int | None = None) -> Copies:
    """The copies below each mounted store that hold a ledger of their own: store, snapshot_id, root; and errors."""
    ship_package(stores.sparkSession)
    tasks = tasks or stores.sparkSession.sparkContext.defaultParallelism * 4
    usable = check_stores(stores).where("store_error IS NULL AND scheme = 'file'")
    named = usable.repartition("store").mapInPandas(_names, _COPY)
    # One store may have very many copies, so their folders are looked at by other tasks.
    return _apart(named.repartition(tasks, "store", "snapshot_id").mapInPandas(_holding(marker), _COPY), "copies")


def discover_snapshots(
    stores: DataFrame, marker: str = LEDGER_DIR, tasks: int | None = None
) -> DataFrame:
    """The copies that ``read_copies`` finds."""
    return read_copies(stores, marker, tasks).found


def _base_commits(marker: str):
    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            heads, reasons = [], []
            for root in frame["root"]:
                newest, reason = None, None
                folder = os.path.join(to_name(root), marker, "commits")
                try:
                    if os.path.lexists(folder) or not os.path.isdir(to_name(root)):
                        # A column at a time: the place of the largest seq gives the id.
                        for batch in ds.dataset(folder, format="parquet").to_batches(columns=["seq", "commit_id"]):
                            if batch.num_rows:
                                last = pc.max(batch.column("seq"))
                                at = pc.index(batch.column("seq"), last).as_py()
                                place = (last.as_py(), batch.column("commit_id")[at].as_py())
                                newest = place if newest is None else max(newest, place)
                except (OSError, ValueError) as error:
                    newest, reason = None, _reason(error)
                heads.append(newest[1] if newest else None)
                reasons.append(reason)
            yield frame.assign(base_commit_id=heads, reason=reasons)

    return read


def read_base_commits(copies: DataFrame, marker: str = LEDGER_DIR) -> Copies:
    """The newest commit in the ledger of each copy, and the copies whose ledger could not be read.

    A copy without commits gives no row.
    """
    ship_package(copies.sparkSession)
    schema = "store string, snapshot_id string, root string, base_commit_id string, reason string"
    read = _apart(copies.mapInPandas(_base_commits(marker), schema), "base-commits")
    found = read.found.where("base_commit_id IS NOT NULL").selectExpr(
        "store",
        "snapshot_id",
        "base_commit_id",
        "concat_ws('/', store, snapshot_id) AS reference",
        "root",
    )
    return Copies(found, read.unread)


def base_commits(copies: DataFrame, marker: str = LEDGER_DIR) -> DataFrame:
    """The newest commits that ``read_base_commits`` finds."""
    return read_base_commits(copies, marker).found


def newest_commits(commits_of_copies: DataFrame) -> DataFrame:
    """The same from a table of all copies' commits: ``store, snapshot_id, seq, commit_id``."""
    return (
        commits_of_copies.groupBy("store", "snapshot_id")
        .agg(F.expr("max_by(commit_id, seq) AS base_commit_id"))
        .selectExpr(
            "store", "snapshot_id", "base_commit_id", "concat_ws('/', store, snapshot_id) AS reference"
        )
    )


def refresh_snapshots(
    old: DataFrame,
    fresh: DataFrame,
    stores: DataFrame,
    names: Sequence[str] | None = None,
    unread: DataFrame | None = None,
) -> DataFrame:
    """The snapshot table after some stores, or all, were looked at again.

    Rows of those stores are replaced, so vanished snapshots go away; other rows stay. So do the old rows of
    stores and copies in ``unread``: what could not be read is not known to be gone. A name that
    no store has is an error.
    """
    columns = SNAPSHOTS.names
    if unread is not None:
        whole = unread.where("snapshot_id IS NULL").select("store").distinct()
        single = unread.select("store", "snapshot_id").distinct()
        lost = lookup_join(old, whole, ["store"], "left_semi", ["reference"]).unionByName(
            lookup_join(lookup_join(old, whole, ["store"], "left_anti", ["reference"]), single, ["store", "snapshot_id"], "left_semi", ["reference"])
        )
        lost = lost.join(fresh.select("reference"), "reference", "left_anti")
        fresh = fresh.select(*columns).unionByName(lost.select(*columns))
    if names is None:
        return fresh.select(*columns)
    wanted = sorted(set(names))
    known = {row["store"] for row in stores.where(F.col("store").isin(wanted)).select("store").distinct().take(len(wanted))}
    if missing := [name for name in wanted if name not in known]:
        raise ValueError(f"no such store: {', '.join(missing)}")
    chosen = F.col("store").isin(wanted)
    return old.where(~chosen).select(*columns).unionByName(fresh.where(chosen).select(*columns))
