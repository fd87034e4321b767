"""The digest cache: which files need no reading, and the cache that follows from a run.

A digest belongs to a file, not to its path. An entry is looked up by what the file system knows the
file by (device and inode), so that a moved file is known; where an entry or the file has no such
identity, by path.
"""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeledger.operators.spread import lookup_join
from treeledger.schema import ALGORITHM, CACHE_CHANGES, CACHE_VERSION, DIGEST_CACHE, LISTING, ZERO_DIGEST
from treeledger.session import stored


def complete(df: DataFrame, schema) -> DataFrame:
    """All columns of the schema; those that the table lacks are null."""
    have = set(df.columns)
    return df.select(
        *[F.col(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in schema]
    )


def parse_entries(entries: DataFrame) -> DataFrame:
    """Cache rows from the text form ``version:mtime_ns:algorithm:digest``.

    Text with other than four parts is no entry; a part that is no number becomes NULL, which no
    lookup accepts.
    """
    return (
        entries.selectExpr("path", "split(entry, ':') AS _parts")
        .where("size(_parts) = 4")
        .selectExpr(
            "path",
            "try_cast(_parts[0] AS int) AS version",
            "try_cast(_parts[1] AS bigint) AS mtime_ns",
            "_parts[2] AS algorithm",
            "_parts[3] AS digest",
        )
    )


# An entry of the same file: as long as nothing about the file changed since, a file that is not newer
# is the file that was read. After a move, or where the inode was given to another file, time of
# change and size must be equal. Without identity the same holds for the entry of the path.
_CURRENT = """(coalesce(_entry.ctime_ns = ctime_ns AND _same AND _entry.mtime_ns >= mtime_ns, false)
    OR coalesce(_entry.mtime_ns = mtime_ns AND coalesce(_entry.size = size, true), false))"""


def _with_all_columns(listing: DataFrame) -> DataFrame:
    lacking = [f for f in LISTING if f.name not in listing.columns]
    return listing.withColumns({f.name: F.lit(None).cast(f.dataType) for f in lacking}) if lacking else listing


def _latest_by_file(entry: DataFrame) -> DataFrame:
    """One entry per device and inode: several paths may be one file; what was read last counts."""
    return (
        entry.where("_entry.dev IS NOT NULL AND _entry.inode IS NOT NULL")
        .groupBy(F.expr("_entry.dev AS dev"), F.expr("_entry.inode AS inode"))
        .agg(F.expr("max_by(_entry, struct(_entry.mtime_ns, _entry.path)) AS _of_file"))
    )


def _judged(found: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``cache_state`` and ``digest`` from the entries of the file and of the path."""
    return (
        found.selectExpr(
            "*",
            "_of_file IS NOT NULL AS _same",
            # The entry of a path counts only if it may be the entry of this file.
            "_of_file IS NULL AND _of_path.inode IS NOT NULL AND inode IS NOT NULL AS _other",
            "coalesce(_of_file, _of_path) AS _entry",
        )
        .selectExpr(
            "*",
            f"""CASE WHEN _entry IS NULL THEN 'absent'
                     WHEN _other THEN 'replaced'
                     WHEN NOT _entry.version <=> {CACHE_VERSION} THEN 'bad_version'
                     WHEN NOT _entry.algorithm <=> '{ALGORITHM}' THEN 'bad_algorithm'
                     WHEN NOT {_CURRENT} THEN 'outdated'
                     WHEN coalesce(_entry.digest, '') = '' THEN 'empty'
                     WHEN _entry.digest = '{ZERO_DIGEST}' THEN 'unreadable'
                     ELSE 'hit' END AS cache_state""",
        )
        .selectExpr(
            *[f"`{column}`" for column in columns],
            "cache_state",
            "if(cache_state = 'hit', _entry.digest, NULL) AS digest",
        )
    )


def probe_cache(listing: DataFrame, cache: DataFrame) -> DataFrame:
    """The listing with what the cache says: ``cache_state`` and, for a hit, ``digest``.

    An entry of the path that belongs to another file is ``replaced``.
    """
    entry = complete(cache, DIGEST_CACHE).selectExpr("path", "struct(*) AS _entry")
    by_file = _latest_by_file(entry)
    # What has no identity is spread by its path, where it finds nothing.
    file_key = "concat(dev, ':', inode)"
    found = (
        _with_all_columns(listing).join(entry.withColumnRenamed("_entry", "_of_path"), "path", "left")
        .selectExpr("*", f"coalesce({file_key}, path) AS _file")
        .join(by_file.selectExpr(f"{file_key} AS _file", "_of_file"), "_file", "left")
    )
    return _judged(found, listing.columns)


def probe_by_path_first(listing: DataFrame, cache: DataFrame) -> DataFrame:
    """As ``probe_cache``, with one shuffle of the listing however many files are known.

    Nearly every file lies where its own entry says, so a join by path settles it. Only what is left
    (new, moved, replaced or changed files) is looked up by device and inode, and of the cache only
    the entries of those files are sought. A path whose own entry is a hit is settled by it, also
    where another path of the same file was read later.
    """
    entry = complete(cache, DIGEST_CACHE).selectExpr("path", "struct(*) AS _entry")
    by_path = (
        _with_all_columns(listing).join(entry.withColumnRenamed("_entry", "_of_path"), "path", "left")
        .selectExpr("*", "if(_of_path.dev = dev AND _of_path.inode = inode, _of_path, NULL) AS _of_file")
    )
    whole = [*by_path.columns[:-2], "_of_path"]
    settled = "(cache_state = 'hit' AND _of_path.dev <=> dev AND _of_path.inode <=> inode) OR dev IS NULL OR inode IS NULL"
    first = _judged(by_path, whole).selectExpr("* EXCEPT (_of_path)", f"coalesce({settled}, false) AS _settled", f"if({settled}, NULL, _of_path) AS _of_path")
    first = stored(first, "probed-by-path")
    left_over = first.where("NOT _settled").select(*whole)
    wanted = left_over.select("dev", "inode").distinct()
    of_files = lookup_join(
        entry.selectExpr("_entry.dev AS dev", "_entry.inode AS inode", "path", "_entry"), wanted, ["dev", "inode"], "left_semi", ["path"]
    )
    second = _judged(left_over.join(_latest_by_file(of_files), ["dev", "inode"], "left"), listing.columns)
    return first.where("_settled").select(*listing.columns, "cache_state", "digest").unionByName(second)


def split_cached(
    listing: DataFrame, cache: DataFrame | None, rehash: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Files whose digest is known, and files that must be read. ``rehash`` trusts no entry."""
    if rehash or cache is None:
        return listing.selectExpr("*", "cast(NULL AS string) AS digest").where("false"), listing
    probed = probe_cache(listing, cache)
    hits = probed.where("cache_state = 'hit'").drop("cache_state")
    misses = probed.where("cache_state <> 'hit'").drop("cache_state", "digest")
    return hits, misses


def _entries(digests: DataFrame) -> DataFrame:
    wanted = {"version": f"{CACHE_VERSION}", "algorithm": f"'{ALGORITHM}'"}
    found = complete(digests, DIGEST_CACHE)
    return found.selectExpr(*[f"{wanted[n]} AS {n}" if n in wanted else n for n in DIGEST_CACHE.names])


def refresh_cache(
    cache: DataFrame,
    digests: DataFrame,
    hits: DataFrame | None = None,
    below: Sequence[str] | None = None,
) -> DataFrame:
    """The cache after files were read.

    What could not be read gets no entry, so the next run tries again. With ``hits``, the files of
    the listing that were known, the cache has what was listed and no path that is gone; ``below``
    gives the paths that were listed if not all were, and entries elsewhere stay.
    """
    fresh = _entries(digests.where(f"digest <> '{ZERO_DIGEST}'"))
    known = complete(cache, DIGEST_CACHE)
    if hits is None:
        stays = known.join(digests.select("path"), "path", "left_anti")
        return stays.select(*DIGEST_CACHE.names).unionByName(fresh)
    listed = _entries(hits).unionByName(fresh)
    if below is None:
        return listed
    return known.where(_outside(below)).unionByName(listed)


def _outside(below: Sequence[str]):
    """Whether a path lies at or below none of the given ones."""
    outside = F.lit(True)
    for path in below:
        if path in ("", "."):
            outside = F.lit(False)
        outside = outside & ~((F.col("path") == path) | F.col("path").startswith(path.rstrip("/") + "/"))
    return outside


def cache_changes(
    cache: DataFrame,
    digests: DataFrame,
    hits: DataFrame | None = None,
    below: Sequence[str] | None = None,
) -> DataFrame:
    """What ``refresh_cache`` would change, as rows of the cache with ``gone``: true for a path to forget.

    One full outer join by path; what stays as it is gives no row, so what is stored for a run
    follows what changed. Without ``hits`` only what was read changes.
    """
    fresh = _entries(digests.where(f"digest <> '{ZERO_DIGEST}'"))
    known = complete(cache, DIGEST_CACHE)
    if hits is None:
        known = known.join(digests.select("path"), "path", "left_semi")
        listed = fresh
    else:
        listed = _entries(hits).unionByName(fresh)
        if below is not None:
            known = known.where(~_outside(below))
    old = known.selectExpr("path", f"struct({', '.join(DIGEST_CACHE.names)}) AS _old")
    new = listed.selectExpr("path", f"struct({', '.join(DIGEST_CACHE.names)}) AS _new")
    values = [f"_new.{name} AS {name}" for name in DIGEST_CACHE.names[1:]]
    return (
        old.join(new, "path", "full").where("NOT _old <=> _new")
        .selectExpr("path", *values, "_new IS NULL AS gone").select(*CACHE_CHANGES.names)
    )
