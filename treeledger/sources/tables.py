"""Keep manifests, commits, snapshots and the digest cache as parquet tables below one folder."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treeledger.operators.cache import complete
from treeledger.operators.intervals import manifests_of
from treeledger.schema import COMMITS, DIGEST_CACHE, LINK_TARGETS, MANIFEST, ROOTS, SNAPSHOTS, STORED_MANIFEST
from treeledger.sources import cache_store, ledger


def write_manifest(manifest: DataFrame, base: str, revision: str) -> None:
    """Store one revision, in path order within its files so that path filters skip row groups.

    Ranges keep files of similar size whatever the paths are.
    """
    (
        manifest.select(*MANIFEST.names)
        .repartitionByRange("path")
        .sortWithinPartitions("path")
        .write.mode("overwrite")
        .parquet(f"{base}/manifest/revision={revision}")
    )


def read_manifest(spark: SparkSession, base: str, revision: str | None = None) -> DataFrame:
    """All stored revisions, or one without the ``revision`` column.

    Revisions are read from the history of change sets, or are partitions of full copies where they were
    written as such. All of them at once are as many rows as the tree has times the commits.
    """
    if not ledger.has_history(spark, base):
        stored = spark.read.schema(STORED_MANIFEST).parquet(f"{base}/manifest")
        return stored if revision is None else stored.where(F.col("revision") == revision).select(*MANIFEST.names)
    commits = read_commits(spark, base)
    start = ledger.first_change(spark, base)
    if revision is None:
        head = commits.agg(F.expr("max(seq) AS seq")).first()["seq"]
        found = manifests_of(ledger.read_intervals(spark, base, head), commits.where(F.col("seq") >= start))
        if start > 0:
            # Older commits were kept as full copies.
            older = commits.where(F.col("seq") < start).selectExpr("commit_id AS revision")
            stored = spark.read.schema(STORED_MANIFEST).parquet(f"{base}/manifest")
            found = found.unionByName(stored.join(F.broadcast(older), "revision", "left_semi"))
        return found
    place = commits.where(F.col("commit_id") == revision).select("seq").first()
    if place is None:
        return spark.createDataFrame([], MANIFEST)
    if place["seq"] < start:
        return spark.read.schema(STORED_MANIFEST).parquet(f"{base}/manifest").where(F.col("revision") == revision).select(*MANIFEST.names)
    return ledger.manifest_at(spark, base, place["seq"])


def append_commit(commit: DataFrame, base: str) -> None:
    """Make a commit visible. The rollup of its tree, if it is given, is kept with it."""
    root = [name for name in ROOTS.names[1:] if name in commit.columns]
    commit.select(*COMMITS.names, *root).coalesce(1).write.mode("append").parquet(f"{base}/commits")


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def read_commits(spark: SparkSession, base: str) -> DataFrame:
    if not _exists(spark, f"{base}/commits"):
        return spark.createDataFrame([], COMMITS)
    return spark.read.schema(COMMITS).parquet(f"{base}/commits")


def read_root(spark: SparkSession, base: str, commit_id: str) -> dict | None:
    """The rollup of the whole tree after a commit, if it is kept."""
    roots = spark.read.schema(ROOTS).parquet(f"{base}/commits").where(F.col("commit_id") == commit_id)
    found = roots.where("n_files IS NOT NULL").first()
    return found.asDict() if found else None


def read_history(spark: SparkSession, base: str) -> DataFrame:
    """The change sets of all commits."""
    head = read_commits(spark, base).agg(F.expr("max(seq) AS seq")).first()["seq"]
    return ledger.read_changes(spark, base, upto=-1 if head is None else head)


def _generations(spark: SparkSession, base: str, name: str) -> dict[int, bool]:
    """The numbers of all generations, and whether each was written to its end."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(f"{base}/{name}")
    system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(where):
        return {}
    found = {}
    for status in system.listStatus(where):
        label, _, number = status.getPath().getName().partition("=")
        if label == "generation" and number.isdigit():
            done = jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")
            found[int(number)] = system.exists(done)
    return found


def _write_generation(table: DataFrame, base: str, name: str, schema: T.StructType) -> None:
    """Store a whole table anew; the generation it was derived from stays as it is.

    A generation without its mark of success was left by a job that failed, and counts for nothing
    but its number.
    """
    number = max(_generations(table.sparkSession, base, name), default=-1) + 1
    table.select(*schema.names).write.parquet(f"{base}/{name}/generation={number}")


def _read_generation(spark: SparkSession, base: str, name: str, schema: T.StructType) -> DataFrame:
    done = [number for number, complete in _generations(spark, base, name).items() if complete]
    if not done:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{base}/{name}/generation={max(done)}")


def write_snapshots(snapshots: DataFrame, base: str) -> None:
    """Store what ``refresh_snapshots`` gives; a store that lost all its snapshots has no rows."""
    _write_generation(snapshots, base, "snapshots", SNAPSHOTS)


def read_snapshots(spark: SparkSession, base: str) -> DataFrame:
    return _read_generation(spark, base, "snapshots", SNAPSHOTS)


def write_cache(cache: DataFrame, base: str, n_buckets: int | None = None) -> None:
    """Store a whole cache; one that does not tell files apart, as from text entries, gets empty columns."""
    cache_store.write_whole(complete(cache, DIGEST_CACHE), base, n_buckets)


def update_cache(spark: SparkSession, base: str, changes: DataFrame) -> int:
    """Store what ``cache_changes`` gives; only buckets with a change are written. Their number."""
    if not cache_store.has_buckets(spark, base):
        # A cache of the older form, whole generations, becomes buckets.
        write_cache(read_cache(spark, base), base)
    return cache_store.apply_changes(spark, base, changes)


def read_cache(spark: SparkSession, base: str) -> DataFrame:
    if cache_store.has_buckets(spark, base):
        return cache_store.read(spark, base)
    return _read_generation(spark, base, "digest_cache", DIGEST_CACHE)


def append_links(links: DataFrame, base: str) -> None:
    """Keep the target texts of links, by digest, to make the links anew one day."""
    spark = links.sparkSession
    new = links.select(*LINK_TARGETS.names).distinct()
    if _exists(spark, f"{base}/links"):
        new = new.join(read_links(spark, base).select("digest"), "digest", "left_anti")
    new.write.mode("append").parquet(f"{base}/links")


def read_links(spark: SparkSession, base: str) -> DataFrame:
    if not _exists(spark, f"{base}/links"):
        return spark.createDataFrame([], LINK_TARGETS)
    return spark.read.schema(LINK_TARGETS).parquet(f"{base}/links")


def save_bucketed(manifests: DataFrame, table: str, buckets: int) -> None:
    """Store revisions in a catalog table bucketed by path.

    Comparing two of its revisions needs no shuffle: equal paths are in equal buckets already.
    """
    (
        manifests.select(*STORED_MANIFEST.names)
        .write.partitionBy("revision")
        .bucketBy(buckets, "path")
        .sortBy("path")
        .saveAsTable(table)
    )
