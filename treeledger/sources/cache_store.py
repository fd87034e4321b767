"""The digest cache on disk: buckets by path, of which a run writes those it changes.

Below ``digest_cache``:

    rows/version=V/bucket=B    the entries of a bucket, as version V wrote them
    heads/version=V            for each bucket, the version that wrote it last, and its rows

A version counts once its head is complete; a job that failed before leaves folders that no head
names. Earlier heads stay readable. ``claims`` holds an empty file for each version that a writer took,
so of two writers one gets ``Taken`` and nothing is lost in silence.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeledger.operators.spread import lookup_join
from treeledger.schema import CACHE_BUCKETS, CACHE_CHANGES, DIGEST_CACHE
from treeledger.session import stored
from treeledger.sources import ledger

# Entries of a bucket, about: what a run writes anew for one changed file.
BUCKET_ROWS = 65_536
# A cache that will have grown by this factor since its buckets were counted gets more of them first.
_GROWTH = 4


def _heads(spark: SparkSession, base: str) -> list[int]:
    return ledger.complete_numbers(spark, f"{base}/digest_cache/heads", ("version",))


def has_buckets(spark: SparkSession, base: str) -> bool:
    return bool(_heads(spark, base))


def buckets(spark: SparkSession, base: str, version: int | None = None) -> DataFrame:
    """bucket, version, n_rows of the newest version, or of an earlier one."""
    return spark.read.schema(CACHE_BUCKETS).parquet(f"{base}/digest_cache/heads/version={_heads(spark, base)[-1] if version is None else version}")


def _rows(spark: SparkSession, base: str, held: list) -> DataFrame:
    folders = [f"{base}/digest_cache/rows/version={b['version']}/bucket={b['bucket']}" for b in held if b["version"] is not None]
    return spark.read.schema(DIGEST_CACHE).parquet(*folders) if folders else spark.createDataFrame([], DIGEST_CACHE)


def read(spark: SparkSession, base: str, version: int | None = None) -> DataFrame:
    return _rows(spark, base, buckets(spark, base, version).collect())


def _bucket(n: int) -> str:
    return f"CAST(pmod(xxhash64(path), {n}) AS INT)"


def _write(rows: DataFrame, base: str, held: dict, n: int, touched: int) -> None:
    """Write the buckets of these rows as a new version; of all others the head keeps what it says."""
    spark = rows.sparkSession
    done = _heads(spark, base)
    version = done[-1] + 1 if done else 0
    ledger.claim(spark, f"{base}/digest_cache", version)
    try:
        where = f"{base}/digest_cache/rows/version={version}"
        # A bucket is one file; its rows are in path order, so that path filters skip row groups.
        dealt = rows.withColumn("bucket", F.expr(_bucket(n))).repartition(max(1, touched), "bucket")
        dealt.sortWithinPartitions("bucket", "path").write.mode("overwrite").partitionBy("bucket").parquet(where)
        if any(f.isDirectory() for f in ledger.listed(spark, where)):
            counts = {r["bucket"]: r["n"] for r in spark.read.parquet(where).groupBy("bucket").agg(F.expr("count(1) AS n")).collect()}
        else:
            counts = {}
        head = held | {b: (version, c) for b, c in counts.items()}
        table = spark.createDataFrame([(b, *head.get(b, (None, 0))) for b in range(n)], CACHE_BUCKETS)
        table.coalesce(1).write.mode("overwrite").parquet(f"{base}/digest_cache/heads/version={version}")
    except Exception:
        ledger.release(spark, f"{base}/digest_cache", version)
        raise


def write_whole(cache: DataFrame, base: str, n: int | None = None) -> None:
    """Store a cache anew, in as many buckets as its rows ask for."""
    rows = cache.select(*DIGEST_CACHE.names)
    if n is None:
        rows = stored(rows, "cache")
        n = max(1, -(-rows.count() // BUCKET_ROWS))
    _write(rows, base, {}, n, min(n, 4096))


def apply_changes(spark: SparkSession, base: str, changes: DataFrame) -> int:
    """Put changes into the stored cache, and say how many buckets were written.

    Only buckets with a change are read and written. The driver sees numbers of buckets, no entries.
    """
    changes = stored(changes.select(*CACHE_CHANGES.names), "cache-changes")
    known = buckets(spark, base).collect()
    n = len(known)
    touched = {r["bucket"] for r in changes.selectExpr(f"{_bucket(n)} AS bucket").distinct().collect()}
    if not touched:
        return 0
    held = {b["bucket"]: (b["version"], b["n_rows"]) for b in known}
    # Changes count too: a first run may fill an empty cache of one bucket.
    grown = sum(b["n_rows"] for b in known) + changes.count() > _GROWTH * n * BUCKET_ROWS
    old = _rows(spark, base, [b for b in known if grown or b["bucket"] in touched])
    stays = lookup_join(old, changes.select("path"), ["path"], "left_anti", ["path"])
    rows = stays.select(*DIGEST_CACHE.names).unionByName(changes.where("NOT gone").select(*DIGEST_CACHE.names))
    if grown:
        write_whole(rows, base)
        return len(buckets(spark, base).collect())
    _write(rows, base, {b: v for b, v in held.items() if b not in touched}, n, min(len(touched), 4096))
    return len(touched)
