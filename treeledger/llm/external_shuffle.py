"""Sharding: a two-pass external shuffle, so that every order of the rows is equally likely.

The first pass scatters rows uniformly over buckets by a seeded hash of the row's place in the input,
so copies, and rows that share an id, go to any bucket. There are as many buckets as it takes for one
to fit into a task's memory. The second pass shuffles each bucket by itself (the SQL function
``shuffle`` swaps as Fisher and Yates do) and writes it. Buckets one after the other are the shuffled
table; a shard is a run of that order, and the numbers of rows of two shards differ by one at most.
Where a bucket begins in the whole is known once all are written, from their counts alone. All of it
is SQL.

``docs`` must give its rows in the same order whenever it is computed, as a table read from files
does and the result of a shuffle does not (store that first); then a lost executor loses no row. The
same seed on the same files in the same splits gives the same order.

Nulls in any column are kept; a missing text has size 1 and the check sum of the empty text. Long
texts are rows like any other; one longer than a bucket fills its bucket. Repeated rows and equal texts
are spread like others and stay in whole number. An empty table gives no row. Other columns,
whatever their names, come along within ``row``.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeledger.llm.shared import keyed_join, stored

# Bytes of text in a bucket, about. A task holds a bucket a few times over while it shuffles.
BUCKET_BYTES = 24 << 20
# Bytes that a row weighs besides its text.
_ROW_BYTES = 64
# Buckets whose counts are added up together.
_ADDED = 4096


def size_of(text: str) -> str:
    """SQL for the bytes of a text in UTF-8 and one more."""
    return f"coalesce(CAST(octet_length({text}) AS LONG), 0L) + 1L"


def shuffled_buckets(docs: DataFrame, seed: int = 7, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Scatter, shuffle and write: bucket, place (from 0 in the bucket), row (all columns of docs)."""
    weight = docs.selectExpr(f"sum({size_of('text')} + {_ROW_BYTES}L) AS n").first()["n"] or 0
    buckets = min(max(1, -(-weight // bucket_bytes)), (1 << 31) - 1)
    numbered = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).selectExpr(
        "row", "monotonically_increasing_id() AS n"
    )
    scattered = numbered.selectExpr(f"CAST(pmod(xxhash64({seed}L, n), {buckets}) AS INT) AS bucket", "n", "row")
    # One bucket is one task, which the bucket's number also seeds.
    gathered = scattered.repartitionById(buckets, "bucket").groupBy("bucket").agg(F.expr("collect_list(struct(n, row)) AS held"))
    in_order = "array_sort(held, (a, b) -> CASE WHEN a.n < b.n THEN -1 WHEN a.n > b.n THEN 1 ELSE 0 END)"
    dealt = gathered.select("bucket", F.posexplode(F.shuffle(F.expr(in_order), seed)).alias("place", "held"))
    return stored(dealt.selectExpr("bucket", "place", "held.row AS row"), "buckets")


def bucket_starts(buckets: DataFrame) -> DataFrame:
    """bucket, start: the rows in all buckets before. Added up in two levels."""
    counts = stored(buckets.groupBy("bucket").agg(F.expr("count(1) AS n")), "bucket-counts")
    before = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    parts = counts.groupBy(F.expr(f"bucket DIV {_ADDED}").alias("part")).agg(F.expr("sum(n) AS total"))
    # At most 2^31 / 4096 parts, whatever the data.
    parts = parts.selectExpr("part", f"coalesce(sum(total) OVER (ORDER BY part {before}), 0L) AS base")
    within = counts.selectExpr(
        "bucket",
        f"bucket DIV {_ADDED} AS part",
        f"coalesce(sum(n) OVER (PARTITION BY bucket DIV {_ADDED} ORDER BY bucket {before}), 0L) AS start",
    )
    return stored(within.join(F.broadcast(parts), "part").selectExpr("bucket", "base + start AS start"), "bucket-starts")


def in_shards(buckets: DataFrame, shards: int) -> DataFrame:
    """shard, slot (gapless from 0 in the shard), row. Reads no more of the rows than is asked for."""
    total = buckets.count()
    placed = keyed_join(buckets, bucket_starts(buckets), ["bucket"]).selectExpr("row", "start + place AS position")
    shard = f"position * {shards} DIV {max(total, 1)}"
    return placed.selectExpr("row", "position", f"{shard} AS shard").selectExpr(
        "CAST(shard AS INT) AS shard", f"position - (shard * {total} + {shards - 1}) DIV {shards} AS slot", "row"
    )


def write_shards(docs: DataFrame, folder: str, shards: int, seed: int = 7, bucket_bytes: int = BUCKET_BYTES) -> None:
    """Write the shuffled rows as parquet below ``folder``, one subfolder per shard, with their slots.

    A bucket lies in one shard or in neighbouring ones, so a task writes few files.
    """
    in_shards(shuffled_buckets(docs, seed, bucket_bytes), shards).write.partitionBy("shard").parquet(folder)


def shard_documents(docs: DataFrame, shards: int = 8) -> DataFrame:
    """Where each document lies, from the shuffled buckets as they were written."""
    return in_shards(shuffled_buckets(docs), shards).selectExpr(
        "CAST(row.doc_id AS LONG) AS doc_id",
        f"{size_of('row.text')} AS size",
        "crc32(CAST(coalesce(row.text, '') AS BINARY)) AS text_crc32",
        "'rows' AS law",
        "shard",
        "slot",
        "CAST(NULL AS INT) AS grown_shard",
    )
