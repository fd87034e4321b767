"""List a directory tree on the executors."""

import logging
import os
import stat
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeledger.functions.paths import normalised
from treeledger.operators.ignore import NAMES
from treeledger.schema import BLOB, LINK, LISTING, SKIP_FLAGS
from treeledger.session import mounted, new_shared_path, ship_package
from treeledger.sources.names import to_name, to_text

logger = logging.getLogger(__name__)

# A directory that was met but not entered yet, and what could not be read, with the reason in place of a target.
_PENDING, _UNREAD = "dir", "unread"
# Entries a task lists before it leaves the rest to others; grows from round to round.
_FIRST_BUDGET = 2_000
_LAST_BUDGET = 500_000
_BATCH = 10_000

_COLUMNS = LISTING.names


def _identity(info: os.stat_result) -> tuple[int, int, int]:
    # File systems may number beyond what a signed number holds; what counts is that it is the same.
    return _signed(info.st_dev), _signed(info.st_ino), info.st_ctime_ns


def _signed(number: int) -> int:
    return (number + (1 << 63)) % (1 << 64) - (1 << 63)


def _pending(path: str) -> tuple:
    return (path, _PENDING, *[None] * (len(_COLUMNS) - 2))


def _unread(path: str, error: OSError) -> tuple:
    logger.error("not read: %s", error)
    return (path, _UNREAD, None, None, to_text(error.strerror or str(error)), None, None, None)


def _entry(root: str, path: str) -> tuple | None:
    """The listing row of one path, or None for what is no file, link or directory."""
    full = os.path.join(root, path)
    try:
        info = os.lstat(full)
    except OSError:
        # Gone since its directory was read: the digest will tell.
        return (to_text(path), BLOB, None, None, None, None, None, None)
    if stat.S_ISLNK(info.st_mode):
        try:
            return (to_text(path), LINK, None, info.st_mtime_ns, to_text(os.readlink(full)), *_identity(info))
        except OSError as error:
            return _unread(to_text(path), error)
    if stat.S_ISDIR(info.st_mode):
        return _pending(to_text(path))
    if stat.S_ISREG(info.st_mode):
        return (to_text(path), BLOB, info.st_size, info.st_mtime_ns, None, *_identity(info))
    return None


def _is_flagged(directory: str, flags: Sequence[str]) -> bool:
    return any(os.path.lexists(os.path.join(directory, flag)) for flag in flags)


def _list_dir(root: str, path: str, names: Sequence[str], flags: Sequence[str]) -> Iterator[tuple]:
    """The rows of one directory, streamed: it may hold any number of entries.

    Where reading stops, the directory itself is a row too, as it may hold more.
    """
    full = os.path.join(root, path) if path else root
    if _is_flagged(full, flags):
        return
    try:
        with os.scandir(full) as entries:
            for found in entries:
                row = _entry(root, f"{path}/{found.name}" if path else found.name)
                if row and not (row[1] == _PENDING and found.name in names):
                    yield row
    except OSError as error:
        yield _unread(to_text(path), error)


def _frames(rows: Iterator[tuple]) -> Iterator[pd.DataFrame]:
    batch: list[tuple] = []
    for row in rows:
        batch.append(row)
        if len(batch) == _BATCH:
            yield _frame(batch)
            batch = []
    if batch:
        yield _frame(batch)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=_COLUMNS)
    return frame.astype({name: "Int64" for name in ("size", "mtime_ns", "dev", "inode", "ctime_ns")})


def _start(root: str, names: Sequence[str], flags: Sequence[str]):
    """Turn given paths into rows, unless a directory above them is left out."""

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for frame in frames:
            for text in frame["path"]:
                path = to_name(text)
                parts = path.split("/") if path else []
                above = [root] + [os.path.join(root, *parts[:n]) for n in range(1, len(parts))]
                skipped = any(part in names for part in parts[:-1]) or (
                    parts and parts[-1] in names and os.path.isdir(os.path.join(root, path))
                )
                if skipped or any(_is_flagged(directory, flags) for directory in above):
                    continue
                if not parts:
                    yield _pending("")
                elif not os.path.isdir(root):
                    # Where the tree is not mounted nothing is known about its paths.
                    yield _unread(text, OSError(None, f"no such directory: {root}"))
                elif os.path.lexists(os.path.join(root, path)):
                    row = _entry(root, path)
                    if row:
                        yield row

    return lambda frames: _frames(rows(frames))


def _walk(root: str, names: Sequence[str], flags: Sequence[str], budget: int):
    """Enter directories until the budget is spent and hand back those that are left."""

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        left = budget
        for frame in frames:
            waiting = [to_name(text) for text in frame["path"]]
            while waiting:
                if left <= 0:
                    yield from (_pending(to_text(path)) for path in waiting)
                    break
                for row in _list_dir(root, waiting.pop(), names, flags):
                    left -= 1
                    if row[1] != _PENDING:
                        yield row
                    elif left > 0:
                        waiting.append(to_name(row[0]))
                    else:
                        yield row
                left -= 1

    return lambda frames: _frames(rows(frames))


class Scan(NamedTuple):
    """What a walk found, and what it could not read."""

    listing: DataFrame
    unread: DataFrame  # path, reason


def scan_tree(spark: SparkSession, root: str, paths: list[str] | None = None, **options) -> DataFrame:
    """The listing that ``walk_tree`` gives."""
    return walk_tree(spark, root, paths, **options).listing


def walk_tree(
    spark: SparkSession,
    root: str,
    paths: list[str] | None = None,
    names: Sequence[str] = NAMES,
    flags: Sequence[str] = SKIP_FLAGS,
    tasks: int | None = None,
    budget: int = _FIRST_BUDGET,
) -> Scan:
    """One row per file and link below the root, or below some paths of it, and one per path that was not read.

    A directory that cannot be listed, or not to its end, and a link that cannot be read are in ``unread``; nothing
    is known about what they hold. A root that an executor lacks is among them.

    Directories that are left out are not entered. The walk goes in rounds: tasks enter the
    directories they were given until they have listed enough, and what is left is dealt out anew,
    so no subtree ties up one task. Each round is a table in the shared folder, which also means a
    lost executor costs one task of one round. The root must be mounted on all executors.
    """
    ship_package(spark)
    root = mounted(root).rstrip("/") or "/"
    tasks = tasks or max(200, 4 * spark.sparkContext.defaultParallelism)
    names, flags = tuple(names), tuple(flags)
    given = sorted({normalised(path) for path in paths}) if paths is not None else [""]
    outermost = [p for p in given if not any(p != q and (q == "" or p.startswith(q + "/")) for q in given)]

    base = new_shared_path(spark, "scan")
    seeds = spark.createDataFrame([(path,) for path in outermost], "path string")
    seeds.mapInPandas(_start(root, names, flags), LISTING).write.parquet(f"{base}/round=0")

    number = 0
    while True:
        pending = (
            spark.read.schema(LISTING)
            .parquet(f"{base}/round={number}")
            .where(F.col("kind") == _PENDING)
            .select("path")
        )
        waiting = pending.count()
        if not waiting:
            break
        number += 1
        allowed = min(_LAST_BUDGET, budget << (2 * (number - 1)))
        (
            pending.repartition(min(tasks, waiting), "path")
            .mapInPandas(_walk(root, names, flags, allowed), LISTING)
            .write.parquet(f"{base}/round={number}")
        )
    every = spark.read.schema(LISTING).parquet(*[f"{base}/round={n}" for n in range(number + 1)])
    return Scan(
        every.where(F.col("kind").isin(BLOB, LINK)),
        every.where(F.col("kind") == _UNREAD).selectExpr("path", "link_target AS reason"),
    )
