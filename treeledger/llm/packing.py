"""Packing: documents into windows of a fixed length by the sum-of-squares rule.

A document is tokenized and gets an end id. Full windows are cut off its front; the rest is an item
of less than a window. Windows that are partly filled are counted by their fill level in an array.
An item goes to the level, or to a new window, that leaves the least sum of squares of these counts,
so no level piles up and there is nearly always a window that an item fills exactly. Each task packs
what it reads, document by document, and holds only its partly filled windows. A level that holds
nothing is not looked at.

When a task ends, the windows still open are emptied, the least filled first: their pieces are cut
to fill up the others. What remains at the very end is laid out in windows whose length is a power
of two, which need no padding. So every window is full, at the price of one cut for most of the few
windows open at the end.

Nulls and empty texts are one piece that holds the end id only. Repeated rows are packed each by
itself. Rows without doc_id are packed like others. Other columns are ignored; an empty table gives
no piece. The number of a sequence holds the task's number and is the same when a task is repeated.
"""

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from treeledger.llm.shared import prepare, texts
from treeledger.llm.word_ids import WordEncoder

# Sequences of a task are numbered below this.
_PER_TASK = 1 << 36


class Piece(NamedTuple):
    doc: int  # place of the document in the task
    start: int  # of its ids
    length: int
    sequence: int
    offset: int


class SumOfSquares:
    """Windows by fill level. Yields a window's pieces once it is full."""

    def __init__(self, window: int):
        self.window = window
        self.counts = np.zeros(window + 1, np.int64)  # open windows at each level
        self.open: list[list[list[tuple[int, int, int]]]] = [[] for _ in range(window + 1)]
        self.made = 0

    def _close(self, pieces: list[tuple[int, int, int]]) -> Iterator[Piece]:
        offset = 0
        for doc, start, length in pieces:
            yield Piece(doc, start, length, self.made, offset)
            offset += length
        self.made += 1

    def level_for(self, size: int) -> int:
        """The level whose window takes an item so that the counts' squares sum up least; 0: a new one."""
        levels = np.flatnonzero(self.counts[1 : self.window - size + 1]) + 1
        counts, above = self.counts[levels], self.counts[levels + size]
        # One window fewer at its level, one more at the higher level, which does not count when full.
        change = np.where(levels + size == self.window, 1 - 2 * counts, 2 * (above - counts) + 2)
        if not len(levels) or change.min() > 2 * self.counts[size] + 1:
            return 0
        # Of equal changes the fullest window.
        return int(levels[len(change) - 1 - np.argmin(change[::-1])])

    def add(self, doc: int, length: int) -> Iterator[Piece]:
        start = 0
        while length - start >= self.window:
            yield from self._close([(doc, start, self.window)])
            start += self.window
        size = length - start
        if not size:
            return
        level = self.level_for(size)
        pieces = self.open[level].pop() if level else []
        if level:
            self.counts[level] -= 1
        pieces.append((doc, start, size))
        if level + size == self.window:
            yield from self._close(pieces)
        else:
            self.open[level + size].append(pieces)
            self.counts[level + size] += 1

    def finish(self) -> Iterator[Piece]:
        """Fill the fuller windows from the least filled, then lay out the rest without padding."""
        rest = [pieces for level in self.open for pieces in level]  # least filled first
        self.open, self.counts = [[] for _ in range(self.window + 1)], np.zeros(self.window + 1, np.int64)
        low, high = 0, len(rest) - 1
        while low < high:
            room = self.window - sum(p[2] for p in rest[high])
            while room and low < high:
                doc, start, length = rest[low].pop()
                taken = min(room, length)
                # The last ids of the piece go, its front stays where it is.
                rest[high].append((doc, start + length - taken, taken))
                if taken < length:
                    rest[low].append((doc, start, length - taken))
                room -= taken
                low += not rest[low]
            if not room:
                yield from self._close(rest[high])
                high -= 1
        left = rest[low] if rest and low <= high else []
        size = sum(p[2] for p in left)
        while size:
            room = 1 << (size.bit_length() - 1)
            size -= room
            window = []
            while room:
                doc, start, length = left.pop()
                taken = min(room, length)
                window.append((doc, start + length - taken, taken))
                if taken < length:
                    left.append((doc, start, length - taken))
                room -= taken
            yield from self._close(window)


FIELDS = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_NAMES = [field.split()[0] for field in FIELDS.split(", ")]


def pack(docs: DataFrame, tokenizer: str, window: int = 2048, end_id: int = 1) -> DataFrame:
    """The pieces of all documents. ``tokenizer`` is a file that every executor has."""
    prepare(docs.sparkSession)
    end = np.array([end_id], "<u2").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer = WordEncoder.of_worker(tokenizer), SumOfSquares(window)
        first = TaskContext.get().partitionId() * _PER_TASK
        # Documents with ids that no piece has been written for yet: doc_id, ids from a place on, ids not written, the place, all ids.
        waiting: dict[int, list] = {}
        number = 0

        def rows(pieces: list[Piece]) -> pa.RecordBatch:
            made = []
            for piece in pieces:
                known = waiting[piece.doc]
                begin = 2 * (piece.start - known[3])
                part = known[1][begin : begin + 2 * piece.length]
                crc = zlib.crc32(np.frombuffer(part, "<u2").astype("<u4").tobytes())
                made.append((known[0], piece.start, piece.length, crc, known[4], first + piece.sequence, piece.offset))
                known[2] -= piece.length
                if not known[2]:
                    del waiting[piece.doc]
            columns = list(zip(*made)) or [[]] * len(_NAMES)
            return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], _NAMES)

        for batch in batches:
            found = texts(batch.column(1))
            pieces: list[Piece] = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.encode(found)):
                ids += end
                waiting[number] = [doc_id, ids, len(ids) // 2, 0, len(ids) // 2]
                pieces += packer.add(number, len(ids) // 2)
                number += 1
            yield rows(pieces)
            # Of long documents only the item behind the full windows still waits.
            for known in [waiting[n] for n in range(number - len(found), number) if n in waiting]:
                if known[2] < known[4]:
                    known[1], known[3] = known[1][2 * (known[4] - known[2]) :], known[4] - known[2]
        yield rows(list(packer.finish()))

    return docs.selectExpr("CAST(doc_id AS LONG) AS doc_id", "text").mapInArrow(run, FIELDS)
