"""The history of a ledger on disk: change sets, now and then a full state, and what a reader needs of them.

Below ``history``:

    changes/seq=N     the change set of commit N
    packed/upto=N     the change sets after the one packed before, up to N, as one table
    states/seq=N      the full tree after commit N, with the commit that brought each entry
    closed/seq=N      intervals that ended after the state before, up to commit N

A commit writes its change set. Every PACK commits those are packed, so a reader opens a bounded number of
files for each. A state is written when as many changes have come since the last one as the tree
has entries, so all states together take no more than all changes do. A folder counts once its job
has left its mark of success in it. ``claims`` holds one empty file for each commit that a writer took.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeledger.operators.intervals import intervals_of_changes, state_at
from treeledger.schema import CHANGES, INTERVALS, STATES

# Change sets that lie apart, at most.
PACK = 32
# Rows of a file, about.
_FILE_ROWS = 1_000_000


class Taken(RuntimeError):
    """Another writer has taken this place in the history."""


def _path(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def listed(spark: SparkSession, folder: str) -> list:
    """What lies in a folder; nothing where there is none."""
    where, system = _path(spark, folder)
    return list(system.listStatus(where)) if system.exists(where) else []


def complete_numbers(spark: SparkSession, folder: str, labels: tuple[str, ...]) -> list[int]:
    """The numbers N of the folders label=N that were written to their end, ascending."""
    found = []
    for status in listed(spark, folder):
        label, _, number = status.getPath().getName().partition("=")
        mark, system = _path(spark, f"{status.getPath()}/_SUCCESS")
        if label in labels and number.isdigit() and system.exists(mark):
            found.append(int(number))
    return sorted(found)


def _numbers(spark: SparkSession, base: str, name: str) -> list[int]:
    """The complete folders of one kind, by number, ascending."""
    return complete_numbers(spark, f"{base}/history/{name}", ("seq", "upto"))


def claim(spark: SparkSession, base: str, seq: int) -> None:
    """Take a place in the history; only one writer can. A writer that died is overruled by ``release``."""
    where, system = _path(spark, f"{base}/claims/{seq}")
    if system.getUri().getScheme() == "file":
        # The file system of mounted folders creates a file that is there without complaint.
        files = spark.sparkContext._jvm.java.nio.file
        system.mkdirs(where.getParent())
        local = files.Path.of(where.toUri().getPath(), spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.java.lang.String, 0))
        attributes = spark.sparkContext._gateway.new_array(files.attribute.FileAttribute, 0)
        make = lambda: files.Files.createFile(local, attributes)
    else:
        make = lambda: system.create(where, False).close()
    try:
        make()
    except Exception as error:
        if system.exists(where):
            raise Taken(f"commit {seq} is being written by another writer") from error
        raise


def release(spark: SparkSession, base: str, seq: int) -> None:
    """Give a place back that was taken and not written."""
    where, system = _path(spark, f"{base}/claims/{seq}")
    system.delete(where, False)


def _write(table: DataFrame, path: str, rows: int) -> None:
    """In path order, so that path filters skip row groups; small tables as one file."""
    files = max(1, -(-rows // _FILE_ROWS))
    dealt = table.coalesce(1) if files == 1 else table.repartitionByRange(files, "path")
    dealt.sortWithinPartitions("path").write.mode("overwrite").parquet(path)


def has_history(spark: SparkSession, base: str) -> bool:
    where, system = _path(spark, f"{base}/history/changes")
    return system.exists(where)


def first_change(spark: SparkSession, base: str) -> int:
    """Where the history starts; commits before that are kept as full copies."""
    return min([*_numbers(spark, base, "changes"), *_numbers(spark, base, "packed")], default=0)


def write_changes(changes: DataFrame, base: str, seq: int, rows: int) -> None:
    _write(changes.selectExpr(f"{seq}L AS seq", *CHANGES.names[1:]), f"{base}/history/changes/seq={seq}", rows)


def read_changes(spark: SparkSession, base: str, after: int = -1, upto: int | None = None) -> DataFrame:
    """The change sets of the commits in (after, upto], each read once: packed, or by itself where it is not yet."""
    packed = _numbers(spark, base, "packed")
    last = packed[-1] if packed else -1
    single = [n for n in _numbers(spark, base, "changes") if n > max(after, last) and (upto is None or n <= upto)]
    starts = dict(zip(packed, [-1, *packed]))
    whole = [n for n in packed if n > after and (upto is None or starts[n] < upto)]
    folders = [f"{base}/history/packed/upto={n}" for n in whole] + [f"{base}/history/changes/seq={n}" for n in single]
    if not folders:
        return spark.createDataFrame([], CHANGES)
    found = spark.read.schema(CHANGES).parquet(*folders).where(F.col("seq") > after)
    return found if upto is None else found.where(F.col("seq") <= upto)


def read_state(spark: SparkSession, base: str, seq: int) -> DataFrame:
    """path, kind, digest, from_seq after commit ``seq``, from the last full state before it and the changes since."""
    states = [n for n in _numbers(spark, base, "states") if n <= seq]
    if states and states[-1] == seq:
        return spark.read.schema(STATES).parquet(f"{base}/history/states/seq={seq}")
    start = spark.read.schema(STATES).parquet(f"{base}/history/states/seq={states[-1]}") if states else None
    changes = read_changes(spark, base, states[-1] if states else -1, seq)
    return intervals_of_changes(changes, start).where("to_seq IS NULL").select(*STATES.names)


def read_intervals(spark: SparkSession, base: str, upto: int) -> DataFrame:
    """path, kind, digest, from_seq, to_seq of the commits up to one; what ends later lasts."""
    states = [n for n in _numbers(spark, base, "states") if n <= upto]
    start = spark.read.schema(STATES).parquet(f"{base}/history/states/seq={states[-1]}") if states else None
    found = intervals_of_changes(read_changes(spark, base, states[-1] if states else -1, upto), start).select(*INTERVALS.names)
    if states:
        closed = spark.read.schema(INTERVALS).parquet(*[f"{base}/history/closed/seq={n}" for n in states])
        found = found.unionByName(closed)
    return found


def settle(spark: SparkSession, base: str, seq: int, n_files: int) -> None:
    """After commit ``seq``: pack change sets, and write a state if enough has changed since the last one."""
    packed = _numbers(spark, base, "packed")
    last = packed[-1] if packed else -1
    states = _numbers(spark, base, "states")
    since = states[-1] if states else -1
    changed = read_changes(spark, base, since, seq).count()
    # The first change set is as good as a state.
    due = since < seq and changed > max(n_files, 1) * (1 if states else 2)
    if seq - last >= PACK or due and seq > last:
        some = read_changes(spark, base, last, seq)
        _write(some, f"{base}/history/packed/upto={seq}", some.count())
    if due:
        start = spark.read.schema(STATES).parquet(f"{base}/history/states/seq={since}") if states else None
        intervals = intervals_of_changes(read_changes(spark, base, since, seq), start)
        # The state comes last: it is what makes the closed intervals count.
        _write(intervals.where("to_seq IS NOT NULL").select(*INTERVALS.names), f"{base}/history/closed/seq={seq}", changed)
        _write(intervals.where("to_seq IS NULL").select(*STATES.names), f"{base}/history/states/seq={seq}", n_files)


def manifest_at(spark: SparkSession, base: str, seq: int) -> DataFrame:
    return state_at(read_state(spark, base, seq).selectExpr("*", "CAST(NULL AS LONG) AS to_seq"), seq)
