import hashlib
import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TESTDATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("treeledger-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def sha1(text: str) -> str:
    return hashlib.sha1(text.encode()).hexdigest()


def rows_of(df, *columns):
    """The rows as sorted tuples, for comparison."""
    chosen = df.select(*columns) if columns else df
    return sorted((tuple(row) for row in chosen.collect()), key=lambda r: [(v is None, str(v)) for v in r])


class Golden:
    """Six files and two changes; names hold blanks, brackets and a star on purpose."""

    a, b, c, B = "a  (-_*).txt", "b  (-_*).txt", "c  (-_*).txt", "B  (-_*).txt"
    d, e, f = "x/y/d  (-_*).txt", "x/y/e  (-_*).txt", "x/y/f  (-_*).txt"

    r0 = {a: "a content", b: "b content", c: "c content", d: "d content", e: "e content", f: "f content"}
    r1 = {a: "a changed content", B: "b content", c: "c content", d: "d changed content", e: "e content", f: "f content"}
    r2 = {**r1, a: "a twice changed content", B: "b changed content"}
    revisions = [r0, r1, r2]


def manifest(spark, files: dict[str, str], kinds: dict[str, str] | None = None):
    kinds = kinds or {}
    rows = [(path, kinds.get(path, "blob"), sha1(content)) for path, content in files.items()]
    return spark.createDataFrame(rows, "path string, kind string, digest string")


@pytest.fixture
def golden():
    return Golden


@pytest.fixture
def history(spark):
    """Commits, manifests, snapshots and stores of the six-file tree."""
    ids = [sha1(f"commit {n}") for n in range(3)]
    commits = spark.createDataFrame(
        [(ids[n], ids[n - 1] if n else None, n, 86400 * n, 60, f"Change {n}") for n in range(3)],
        "commit_id string, parent_id string, seq long, commit_time long, tz_offset_min int, message string",
    )
    manifests = spark.createDataFrame(
        [
            (path, "blob", sha1(content), ids[n])
            for n, files in enumerate(Golden.revisions)
            for path, content in files.items()
        ],
        "path string, kind string, digest string, revision string",
    )
    taken = [("aux1", "1", 0), ("aux1", "2", 1), ("aux1", "3", 2), ("aux2", "1", 0), ("aux2", "2", 2)]
    snapshots = spark.createDataFrame(
        [(store, number, ids[n], f"{store}/{number}") for store, number, n in taken],
        "store string, snapshot_id string, base_commit_id string, reference string",
    )
    stores = spark.createDataFrame([("aux1", "/a/*", 0), ("aux2", "/b/*", 1)], "store string, url string, ordinal int")
    return ids, commits, manifests, snapshots, stores
