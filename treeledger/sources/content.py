"""Read files and compute their digests on the executors."""

import hashlib
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treeledger.functions.digests import text_digest
from treeledger.schema import ALGORITHM, BLOB, BLOCK_SIZE, LINK, LISTING, ZERO_DIGEST
from treeledger.session import mounted, ship_package
from treeledger.sources.names import to_name

# Bytes and files that make one task; a larger file is a task of its own.
TASK_BYTES = 1 << 30
TASK_FILES = 20_000
MAX_TASKS = 100_000

_WITH_DIGEST = T.StructType([*LISTING.fields, T.StructField("digest", T.StringType())])


def file_digest(path: str) -> str:
    """The digest of a file read in blocks; forty zeros if any part cannot be read."""
    digest = hashlib.new(ALGORITHM)
    try:
        with open(path, "rb", buffering=0) as content:
            while block := content.read(BLOCK_SIZE):
                digest.update(block)
    except OSError:
        return ZERO_DIGEST
    return digest.hexdigest()


def _digests(root: str):
    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            # Rows go out in small batches, as reading the files behind one batch may take long.
            for start in range(0, len(frame), 1000):
                part = frame.iloc[start : start + 1000]
                found = [file_digest(os.path.join(root, to_name(path))) for path in part["path"]]
                yield part.assign(digest=found)

    return add


def digest_files(
    listing: DataFrame, root: str, tasks: int | None = None, task_bytes: int = TASK_BYTES
) -> DataFrame:
    """The listing with a digest per row: of the content, or of a link's target text.

    Files are dealt to tasks by a hash of their path, about ``task_bytes`` to each. A file as
    large as that gets a task of its own, apart from the small ones.
    """
    ship_package(listing.sparkSession)
    root = mounted(root)
    listing = listing.select(*LISTING.names)
    files = listing.where(F.col("kind") == BLOB)
    if tasks is None:
        total = files.agg(
            F.expr("coalesce(sum(size), 0) AS n_bytes"), F.expr("count(1) AS n_files")
        ).first()
        tasks = max(1, -(-total["n_bytes"] // task_bytes), -(-total["n_files"] // TASK_FILES))
        if total["n_files"] > 1:
            parallel = listing.sparkSession.sparkContext.defaultParallelism
            tasks = max(tasks, min(parallel, total["n_files"]))
        tasks = min(tasks, MAX_TASKS)
    large = F.coalesce(F.col("size") >= task_bytes, F.lit(False))
    shared = files.where(~large).repartition(tasks, "path")
    alone = files.where(large).repartitionByRange(tasks, "size", "path")
    links = listing.where(F.col("kind") == LINK).withColumn("digest", text_digest("link_target"))
    return (
        shared.mapInPandas(_digests(root), _WITH_DIGEST)
        .unionByName(alone.mapInPandas(_digests(root), _WITH_DIGEST))
        .unionByName(links)
    )
