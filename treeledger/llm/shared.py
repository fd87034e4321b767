"""What the operators have in common: stored intermediate tables, documents as bytes, measured joins.

Intermediate tables lie in the folder that ``spark.checkpoint.dir`` names, so any executor may be
lost and any task repeated.
"""

import gc
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treeledger.session import new_shared_path, ship_package

# Documents that a Python worker gets at once; bounds its memory together with their lengths.
BATCH_ROWS = 512
# Bytes of a batch, about; a longer text is a batch of its own.
BATCH_BYTES = 8 << 20
# A table of keys is broadcast only when it was measured and has at most this many rows and bytes.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 48 << 20


def prepare(spark: SparkSession) -> None:
    """Make this package importable on the executors and hand documents over in small batches."""
    ship_package(spark)
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))
    try:
        given = int(spark.conf.get(size).rstrip("bB"))
    except ValueError:
        given = 0
    if not 0 < given <= BATCH_BYTES:
        spark.conf.set(size, str(BATCH_BYTES))


_held: dict = {}


def of_worker(key, make: Callable):
    """What a Python worker keeps from one task to the next: one thing at a time, and what it kept before goes."""
    if key not in _held:
        _held.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        _held[key] = make()
    return _held[key]


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back, which also cuts its lineage."""
    path = new_shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(nullable(df.schema)).parquet(path)


def nullable(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema])


def texts(column: pa.Array) -> list[bytes]:
    """The texts of a batch in UTF-8; a missing one is empty."""
    if pa.types.is_null(column.type):
        return [b""] * len(column)
    return [value or b"" for value in pc.cast(column, pa.large_binary()).to_pylist()]


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that the table does not have yet, whatever its case."""
    taken = {name.lower() for name in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def with_column_from_text(
    df: DataFrame, name: str, kind: str, values: Callable[[list[bytes]], pa.Array], text: str = "text"
) -> DataFrame:
    """Add one column made from the texts of each batch; all other columns pass through."""
    place = df.columns.index(text)
    schema = T.StructType([*df.schema, T.StructField(name, T.DataType.fromDDL(kind))])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = values(texts(batch.column(place)))
            yield pa.RecordBatch.from_arrays([*batch.columns, column], [*batch.schema.names, name])

    return df.mapInArrow(add, schema)


def _bytes(name: str, kind: T.DataType) -> str:
    """SQL for about the bytes that a value takes in a row."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return f"coalesce(octet_length({name}), 0) + 16"
    if isinstance(kind, T.ArrayType):
        inner = kind.elementType
        fields = inner.fields if isinstance(inner, T.StructType) else [inner]
        if not any(isinstance(getattr(f, "dataType", f), (T.StringType, T.BinaryType, T.ArrayType, T.MapType, T.StructType)) for f in fields):
            return f"coalesce(size({name}), 0) * {8 * len(fields) + (24 if isinstance(inner, T.StructType) else 0)} + 32"
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return f"coalesce(octet_length(to_json(struct({name}))), 0) + 32"
    return "8"


def fits(table: DataFrame, most: int = BROADCAST_ROWS) -> bool:
    """Whether a stored table is small enough to be sent to all executors, by its rows and bytes."""
    size = " + ".join(["16", *[_bytes(f"`{f.name}`", f.dataType) for f in table.schema]])
    rows, taken = table.selectExpr("count(1)", f"coalesce(sum({size}), 0)").first()
    return rows <= most and taken <= BROADCAST_BYTES


def keyed_join(
    left: DataFrame, keys: DataFrame, on: Sequence[str], how: str = "inner", most: int = BROADCAST_ROWS
) -> DataFrame:
    """Join with a stored table of keys: broadcast if it was measured and is small, else by shuffle."""
    if fits(keys, most):
        keys = F.broadcast(keys)
    return left.join(keys, list(on), how)
