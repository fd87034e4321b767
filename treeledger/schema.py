"""Table schemas and the fixed values shared by all operators."""

from pyspark.sql import types as T

# Digest form, cache entry version, names and markers that exclude a directory.
ALGORITHM = "sha1"
DIGEST_LENGTH = 40
ABBREVIATED_LENGTH = 10
ZERO_DIGEST = "0" * DIGEST_LENGTH
BLOCK_SIZE = 65536
CACHE_VERSION = 1
SKIP_NAMES = (".snapshots", ".sod")
SKIP_FLAGS = (".git", ".svn", ".sodignore")

# The directory in which this engine keeps its own tables inside a tracked tree.
LEDGER_DIR = ".treeledger"

BLOB = "blob"
LINK = "link"


def _struct(*fields: tuple) -> T.StructType:
    return T.StructType([T.StructField(name, kind, nullable) for name, kind, nullable in fields])


_S, _L, _I, _B = T.StringType(), T.LongType(), T.IntegerType(), T.BooleanType()

LISTING = _struct(
    ("path", _S, False),
    ("kind", _S, False),
    ("size", _L, True),
    ("mtime_ns", _L, True),
    ("link_target", _S, True),
    # What the file system knows the file by, whatever its path.
    ("dev", _L, True),
    ("inode", _L, True),
    ("ctime_ns", _L, True),
)

# What could not be read, a directory with all below it or a link, and why.
UNREAD = _struct(("path", _S, False), ("reason", _S, True))

# The same for stores and their copies.
UNREAD_COPIES = _struct(("store", _S, False), ("snapshot_id", _S, True), ("reason", _S, True))

DIGEST_CACHE = _struct(
    ("path", _S, False),
    ("version", _I, True),
    ("mtime_ns", _L, True),
    ("algorithm", _S, True),
    ("digest", _S, True),
    ("size", _L, True),
    ("dev", _L, True),
    ("inode", _L, True),
    ("ctime_ns", _L, True),
)

# What a run changed in the cache: entries to put in place, and paths to forget.
CACHE_CHANGES = T.StructType([*DIGEST_CACHE.fields, T.StructField("gone", _B, False)])

# Where the rows of each bucket of the stored cache lie; NULL for a bucket without rows.
CACHE_BUCKETS = _struct(("bucket", _I, False), ("version", _L, True), ("n_rows", _L, False))

MANIFEST = _struct(("path", _S, False), ("kind", _S, False), ("digest", _S, False))

STORED_MANIFEST = T.StructType([*MANIFEST.fields, T.StructField("revision", _S, False)])

# What a commit changed: the entry before and after, NULL where there was or is none.
CHANGES = _struct(
    ("seq", _L, False),
    ("path", _S, False),
    ("old_kind", _S, True),
    ("old_digest", _S, True),
    ("kind", _S, True),
    ("digest", _S, True),
)

# Entries with the commit that brought them, and the one that took them away.
STATES = T.StructType([*MANIFEST.fields, T.StructField("from_seq", _L, False)])
INTERVALS = T.StructType([*STATES.fields, T.StructField("to_seq", _L, True)])

LINK_TARGETS = _struct(("digest", _S, False), ("link_target", _S, False))

COMMITS = _struct(
    ("commit_id", _S, False),
    ("parent_id", _S, True),
    ("seq", _L, False),
    ("commit_time", _L, False),
    ("tz_offset_min", _I, False),
    ("message", _S, True),
)

# The rollup of the whole tree after a commit, kept with its row.
ROOTS = _struct(("commit_id", _S, False), ("n_files", _L, True), ("h1", T.DecimalType(38, 0), True), ("h2", T.DecimalType(38, 0), True))

STORES = _struct(("store", _S, False), ("url", _S, False), ("ordinal", _I, False))

SNAPSHOTS = _struct(
    ("store", _S, False),
    ("snapshot_id", _S, True),
    ("base_commit_id", _S, False),
    ("reference", _S, False),
)

DELTA_COLUMNS = (
    "status",
    "status_name",
    "old_path",
    "new_path",
    "path",
    "old_kind",
    "new_kind",
    "old_digest",
    "new_digest",
    "similarity",
)
