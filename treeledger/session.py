"""What a session provides: a folder for intermediate tables, and this package on its executors."""

import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession

# Rows and bytes that a Python worker gets at once where texts are handed over; a longer text is a batch of its own.
BATCH_ROWS, BATCH_BYTES = 512, 8 << 20

_local_roots: dict[str, str] = {}
_shipped: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` as the cluster sets it.

    Only a session without that setting (a local test) gets a temporary folder of its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        configured = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder shared by all executors")
    app = spark.sparkContext.applicationId
    if app not in _local_roots:
        _local_roots[app] = tempfile.mkdtemp(prefix="treeledger-")
    return _local_roots[app]


def new_shared_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """The frame as a table in the shared folder, so that what uses it several times computes it once."""
    path = new_shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def mounted(path: str) -> str:
    """The plain file system path of a folder that executors reach through a mount."""
    parsed = urlparse(path)
    if parsed.scheme not in ("", "file"):
        raise ValueError(f"not reachable through the file system: {path}")
    return parsed.path if parsed.scheme else path


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, for what runs in Python there."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="treeledger-code-"), "treeledger")
    parent, name = os.path.split(package)
    spark.sparkContext.addPyFile(shutil.make_archive(archive, "zip", parent, name))
    _shipped.add(app)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs that run in here hand rows to Python in batches of bounded bytes; what was set before holds again after."""
    limits = {
        "spark.sql.execution.arrow.maxRecordsPerBatch": str(BATCH_ROWS),
        "spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH_BYTES),
    }
    before = {name: spark.conf.get(name) for name in limits}
    try:
        for name, value in limits.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
