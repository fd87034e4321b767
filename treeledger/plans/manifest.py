"""From a directory tree to its manifest, and from a second reading to what went bad."""

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeledger.functions.digests import text_digest, unreadable
from treeledger.functions.paths import normalised
from treeledger.operators.cache import cache_changes, probe_by_path_first, refresh_cache, split_cached
from treeledger.operators.compare import diff
from treeledger.operators.constrain import keep_unread
from treeledger.operators.spread import HOT_ROWS
from treeledger.schema import BLOB, DIGEST_CACHE, LINK
from treeledger.session import new_shared_path
from treeledger.sources.content import digest_files
from treeledger.sources.tree import walk_tree


class TreeState(NamedTuple):
    """A tree as it is now."""

    listing: DataFrame
    manifest: DataFrame  # path, kind, digest, mtime_ns, unreadable
    cache: DataFrame
    links: DataFrame  # digest, link_target
    unread: DataFrame  # path, reason: directories and links that could not be read
    cache_changes: DataFrame  # what of the cache is new, for ``update_cache``


class Unread(RuntimeError):
    """Parts of a tree could not be read, so what is missing there is not known to be gone."""


def settle_unread(manifest: DataFrame, unread: DataFrame, previous: DataFrame | None, mode: str = "refuse") -> DataFrame:
    """A manifest that may be recorded, although some of the tree could not be read.

    ``refuse``: an error if there is anything unread. ``keep``: entries of the previous manifest stay
    there. ``drop``: what was not read is recorded as deleted.
    """
    if mode not in ("refuse", "keep", "drop"):
        raise ValueError(f"not a way to treat what was not read: {mode}")
    if mode == "drop" or unread.isEmpty():
        return manifest
    if mode == "refuse":
        shown = [f"{row['path'] or '.'} ({row['reason']})" for row in unread.orderBy("path").take(5)]
        raise Unread(f"not read: {', '.join(shown)}{', ...' if unread.count() > 5 else ''}")
    return manifest if previous is None else keep_unread(previous, manifest, unread)


def build_manifest(
    spark: SparkSession,
    root: str,
    cache: DataFrame | None = None,
    rehash: bool = False,
    paths: list[str] | None = None,
    **scan_options,
) -> TreeState:
    """Scan a tree, read only files the cache does not know, and say what the cache is now.

    What the walk could not read is in ``unread``; ``settle_unread`` decides about it before a commit.
    Digests are written once to the shared folder, since manifest and cache both need them and no
    file should be read twice. With ``rehash`` all files are read and the cache is rewritten.
    """
    listing, unread = walk_tree(spark, root, paths, **scan_options)
    files = listing.where(F.col("kind") == BLOB)
    if rehash or cache is None:
        hits, misses = split_cached(files, None)
    else:
        # The lookup is needed several times, to deal out the reading and for the manifest.
        looked_up = new_shared_path(spark, "probed")
        probed = probe_by_path_first(files, cache)
        probed.write.partitionBy("cache_state").parquet(looked_up)
        stored = spark.read.schema(probed.schema).parquet(looked_up)
        hits = stored.where("cache_state = 'hit'").drop("cache_state")
        misses = stored.where("cache_state <> 'hit'").drop("cache_state", "digest")

    where = new_shared_path(spark, "digests")
    digested = digest_files(misses, root)
    digested.write.parquet(where)
    read = spark.read.schema(digested.schema).parquet(where)

    links = listing.where(F.col("kind") == LINK).withColumn("digest", text_digest("link_target"))
    columns = ["path", "kind", "digest", "mtime_ns"]
    manifest = (
        hits.select(columns)
        .unionByName(read.select(columns))
        .unionByName(links.select(columns))
        .withColumn("unreadable", unreadable())
    )
    known = cache if cache is not None else spark.createDataFrame([], DIGEST_CACHE)
    below = None if paths is None else [normalised(path) for path in paths]
    fresh = refresh_cache(known, read, hits, below)
    changed = cache_changes(known, read, hits, below)
    return TreeState(listing, manifest, fresh, links.select("digest", "link_target"), unread, changed)


def verify(
    recorded: DataFrame, rehashed: DataFrame, cache: DataFrame, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Compare the record with a fresh reading; ``suspect`` marks content that changed in silence.

    A changed file whose time of change did not move past the cached one was not edited. The cache
    is the one from before the reading; ``rehashed`` carries ``mtime_ns``.
    """
    delta = diff(recorded.select("path", "kind", "digest"), rehashed.select("path", "kind", "digest"), hot_rows=hot_rows)
    times = rehashed.selectExpr("path", "mtime_ns AS _now").join(
        cache.selectExpr("path", "mtime_ns AS _cached"), "path"
    )
    return delta.join(times, "path", "left").selectExpr(
        *delta.columns, "status = 'M' AND coalesce(_now <= _cached, false) AS suspect"
    )
