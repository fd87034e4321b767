"""Token-id files of patched frame-of-reference blocks.

Ids of documents, each with an end id, lie one after the other in ascending doc_id order. A block
holds BLOCK ids: its least id is subtracted, the differences are packed at the width that a given
share of them fits into, and the higher bits of the others are kept as a list of exceptions.

A shard file:

    head      8 bytes "PFORv1\\0\\0"
    blocks    u32 least id, u16 ids, u16 exceptions, u8 width, 3 bytes 0; packed low bits, lowest
              bit first, filled up to whole bytes; places of the exceptions as u16; their high bits as u32
    index     u64 per block: where in the file it begins; u64 per document: its first id, and one
              more for the end; i64 per document: its doc_id (with a u8 per document: 1 if it has one)
    tail      u64 each: where the index begins, ids, blocks, documents

All numbers are little-endian. A manifest table holds the shards: number, file, ids, documents, and
the ids of all shards before. A task writes its file under a name of its own and renames it when it
is complete, so a task may be repeated or run twice at a time.

Nulls: a missing text is empty and has the end id only. Rows without doc_id come first. Rows that
share a doc_id stay together, in the order of their texts' bytes. Other columns are ignored. An empty
table gives no shard.
"""

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

from treeledger.llm.ranges import range_number, range_starts
from treeledger.llm.shared import prepare, stored, texts
from treeledger.llm.word_ids import WordEncoder
from treeledger.session import new_shared_path

BLOCK = 4096
# The share of a block's ids that its width holds.
SHARE = 0.95
_MAGIC = b"PFORv1\0\0"
_TAIL = struct.Struct("<QQQQ")
_BLOCK = struct.Struct("<IHHB3x")
# Documents in a shard, about.
SHARD_ROWS = 4096


def pack_block(ids: np.ndarray, share: float = SHARE) -> bytes:
    least = int(ids.min())
    rest = (ids - least).astype(np.uint32)
    widths = np.ceil(np.log2(rest.astype(np.float64) + 1)).astype(np.int64)
    width = int(np.sort(widths)[max(0, int(np.ceil(share * len(ids))) - 1)])
    places = np.flatnonzero(widths > width)
    bits = (rest[:, None] >> np.arange(width, dtype=np.uint32)) & 1
    packed = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()
    high = (rest[places] >> np.uint32(width)).astype("<u4").tobytes()
    return _BLOCK.pack(least, len(ids), len(places), width) + packed + places.astype("<u2").tobytes() + high


def unpack_block(data: memoryview | bytes, at: int = 0) -> np.ndarray:
    least, count, exceptions, width = _BLOCK.unpack_from(data, at)
    at += _BLOCK.size
    size = (count * width + 7) // 8
    bits = np.unpackbits(np.frombuffer(data, np.uint8, size, at), count=count * width, bitorder="little")
    values = np.zeros(count, np.uint32)
    for bit, column in enumerate(bits.reshape(count, width).T):
        values |= column.astype(np.uint32) << np.uint32(bit)
    at += size
    places = np.frombuffer(data, "<u2", exceptions, at)
    values[places] |= np.frombuffer(data, "<u4", exceptions, at + 2 * exceptions) << np.uint32(width)
    return values + np.uint32(least)


class ShardWriter:
    """Writes one shard; memory holds a block and the index."""

    def __init__(self, out):
        self.out, self.at = out, len(_MAGIC)
        self.blocks: list[int] = []
        self.starts, self.doc_ids = [0], []
        self.waiting: list[np.ndarray] = []
        self.held = 0
        out.write(_MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_id)
        self.starts.append(self.starts[-1] + len(ids))
        self.waiting.append(ids)
        self.held += len(ids)
        if self.held >= BLOCK:
            ready = np.concatenate(self.waiting)
            full = len(ready) - len(ready) % BLOCK
            for i in range(0, full, BLOCK):
                self._block(ready[i : i + BLOCK])
            self.waiting, self.held = [ready[full:]], len(ready) - full

    def _block(self, ids: np.ndarray) -> None:
        data = pack_block(ids)
        self.blocks.append(self.at)
        self.out.write(data)
        self.at += len(data)

    def finish(self) -> None:
        """Write what is left, the index and the tail."""
        if self.held:
            self._block(np.concatenate(self.waiting))
        known = np.array([d is not None for d in self.doc_ids], np.uint8)
        ids = np.array([d or 0 for d in self.doc_ids], "<i8")
        for part in (np.array(self.blocks, "<u8"), np.array(self.starts, "<u8"), ids, known):
            self.out.write(part.tobytes())
        self.out.write(_TAIL.pack(self.at, self.starts[-1], len(self.blocks), len(self.doc_ids)))


class ShardReader:
    """Reads a shard block by block, or the ids of one document by its place."""

    def __init__(self, file):
        self.file = file
        size = file.size()
        if file.read_at(len(_MAGIC), 0) != _MAGIC:
            raise ValueError("not a shard of token ids")
        index, self.n_ids, n_blocks, n_docs = _TAIL.unpack(file.read_at(_TAIL.size, size - _TAIL.size))
        data = file.read_at(size - _TAIL.size - index, index)
        self.blocks = np.append(np.frombuffer(data, "<u8", n_blocks), np.uint64(index)).astype(np.int64)
        self.starts = np.frombuffer(data, "<u8", n_docs + 1, 8 * n_blocks).astype(np.int64)
        at = 8 * (n_blocks + n_docs + 1)
        known = np.frombuffer(data, np.uint8, n_docs, at + 8 * n_docs)
        self.doc_ids = [int(d) if k else None for d, k in zip(np.frombuffer(data, "<i8", n_docs, at), known)]

    def block(self, number: int) -> np.ndarray:
        begin, end = int(self.blocks[number]), int(self.blocks[number + 1])
        return unpack_block(self.file.read_at(end - begin, begin))

    def document(self, place: int) -> np.ndarray:
        """The ids of one document; reads only the blocks that hold them."""
        begin, end = int(self.starts[place]), int(self.starts[place + 1])
        if begin == end:
            return np.empty(0, np.uint32)
        first = begin // BLOCK
        ids = np.concatenate([self.block(n) for n in range(first, (end - 1) // BLOCK + 1)])
        return ids[begin - first * BLOCK : end - first * BLOCK]

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        """All documents in order; every block is read once."""
        held, held_from, following = np.empty(0, np.uint32), 0, 0
        for place, doc_id in enumerate(self.doc_ids):
            begin, end = int(self.starts[place]), int(self.starts[place + 1])
            parts = [held[begin - held_from :]]
            have = held_from + len(held)
            while have < end:
                parts.append(self.block(following))
                have += len(parts[-1])
                following += 1
            held, held_from = np.concatenate(parts) if len(parts) > 1 else parts[0], begin
            yield doc_id, held[: end - begin]


def write_ids(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 2) -> DataFrame:
    """Write the shards below ``folder``, which all executors reach; returns the manifest."""
    spark = docs.sparkSession
    prepare(spark)
    end = np.array([end_id], "<u2").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder.of_worker(tokenizer)
        for batch in batches:
            ids = pa.array([value + end for value in encoder.encode(texts(batch.column(2)))], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), ids], ["part", "doc_id", "ids"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(folder)
        done = []
        part, shard, name, out, own = None, None, "", None, ""

        def close() -> None:
            shard.finish()
            out.close()
            system.move(own, f"{root}/{name}")
            done.append((part, name, shard.starts[-1], len(shard.doc_ids)))

        for batch in batches:
            for number, doc_id, ids in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if number != part:
                    if part is not None:
                        close()
                    part, name = number, f"shard-{number:08d}.pfor"
                    own = f"{root}/.{name}-{uuid.uuid4().hex}"
                    out = system.open_output_stream(own)
                    shard = ShardWriter(out)
                shard.add(doc_id, np.frombuffer(ids, "<u2").astype(np.uint32))
        if part is not None:
            close()
        columns = list(zip(*done)) or [[]] * 4
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(c), k) for c, k in zip(columns, kinds)], ["shard", "file", "n_ids", "n_docs"]
        )

    system, root = fs.FileSystem.from_uri(folder)
    system.create_dir(root, recursive=True)
    plain = docs.selectExpr("CAST(doc_id AS LONG) AS doc_id", "text")
    starts = range_starts(plain, "doc_id", SHARD_ROWS)
    ranged = plain.selectExpr(f"CAST({range_number('doc_id', starts)} AS INT) AS part", "doc_id", "text")
    encoded = ranged.mapInArrow(encode, "part int, doc_id long, ids binary")
    # Each range of ids is a task and a shard.
    sorted_ = encoded.repartitionById(len(starts) + 1, "part").sortWithinPartitions("part", "doc_id", "ids")
    shards = stored(sorted_.mapInArrow(write, "shard long, file string, n_ids long, n_docs long"), "shards")
    # One row per shard.
    return shards.selectExpr(
        "shard",
        f"concat('{folder}/', file) AS file",
        "n_ids",
        "n_docs",
        "coalesce(sum(n_ids) OVER (ORDER BY shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ids_before",
    )


def read_documents(manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens and ids_crc32 of each document in the files."""
    prepare(manifest.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                system, path = fs.FileSystem.from_uri(name)
                with system.open_input_file(path) as file:
                    reader = ShardReader(file)
                    rows = [
                        (doc_id, before + int(start), len(ids), zlib.crc32(ids.astype("<u4").tobytes()))
                        for (doc_id, ids), start in zip(reader.documents(), reader.starts)
                    ]
                columns = list(zip(*rows)) or [[]] * 4
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(c), pa.int64()) for c in columns], ["doc_id", "start", "n_tokens", "ids_crc32"]
                )

    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    files = manifest.select("file", "ids_before").repartition(n, "file")
    return files.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Write the ids to files in the shared folder and describe the documents as the files have them."""
    spark: SparkSession = docs.sparkSession
    return read_documents(write_ids(docs, tokenizer, new_shared_path(spark, "token-ids"), end_id))
