"""BPE encoding and decoding that reuses content-defined chunks.

A text is cut where a rolling hash of the bytes before a place has a given pattern, so passages that
documents share are cut at the same places whatever stands around them. A worker encodes each
distinct chunk once and keeps its ids. Chunks cut pretokens and merges apart; so every join is
repaired: what lies between the outermost safe places of the two chunks is encoded anew as one piece,
with a stretch beyond the safe place on each side. The piece must begin and end with the very ids that
the chunks have for these stretches. A chunk without such stretches does not end the piece, which grows
over it; should the ids differ, the whole text is encoded in one piece.

A safe place is a blank that follows something else that is not white space and is followed by none. It ends a
pretoken whatever stands around it: no pretoken goes on through it, and the next begins with the
blank. Text without blanks (Chinese, base64) has none and is encoded in one piece, without reuse.
Very long runs of white space are left to the ``tokenizers`` library. A long text takes several times its length in memory.

Nulls and empty texts have no ids. The literal text of the end-of-text token is that token, as the
library has it. Repeated rows and other columns pass through. An empty table gives an empty result.
"""

import hashlib
import re
import sys
from array import array
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from treeledger.llm.shared import of_worker, prepare, texts

# A place ends a chunk when these bits of its hash are zero: a chunk has 512 bytes on average.
CHUNK_BITS = 9
# Bytes that the hash of a place covers; a power of two.
HASHED = 32
# A chunk is cut at this length at the latest.
LONGEST = 4096
# Bytes that the chunks a worker remembers take, about.
KEPT_BYTES = 96 << 20
# White space in a row from which on the fast encoder is not asked: its pattern goes one level deeper for each.
LONG_SPACE = 20_000

_SPECIAL = b"<|endoftext|>"
# Fixed value: how the vocabulary's text is cut into pretokens.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# A blank after a character that is no white space and before one that is none. Of characters beyond
# ASCII only those of two bytes are looked at, without those that hold white space.
_SAFE = re.compile(rb"(?:(?<=[!-~])|(?<=[\xc3-\xdf][\x80-\xbf])) (?=[!-~\xc3-\xdf])")


def cut_points(text: bytes) -> list[int]:
    """Where the chunks of a text end; never within a character."""
    size = len(text)
    if size <= HASHED:
        return [size] if size else []
    data = np.frombuffer(text, np.uint8)
    # The hash of the 1, 2, 4, ... bytes before a place, each from two of the one before.
    rolled, factor = (data.astype(np.uint32) + 1) * np.uint32(2654435761), 0x01000193
    width = 1
    while width < HASHED:
        rolled[width:] += rolled[:-width] * np.uint32(factor)
        factor = factor * factor % (1 << 32)
        width *= 2
    ends = np.flatnonzero(rolled[HASHED - 1 : -1] >> np.uint32(32 - CHUNK_BITS) == 0) + HASHED
    found, last = [], 0
    for end in [*ends.tolist(), size]:
        while end - last > LONGEST:
            last = _character(text, last + LONGEST)
            found.append(last)
        end = _character(text, end)
        if end > last:
            found.append(end)
            last = end
    return found


def _character(text: bytes, place: int) -> int:
    """The place, or where the character ends that it lies within."""
    while place < len(text) and text[place] & 0xC0 == 0x80:
        place += 1
    return place


_LONG = re.compile(rf"\s{{{LONG_SPACE}}}")


class _Chunk(NamedTuple):
    head: bytes  # text before the first safe place
    first: bytes  # text between the first and the second one
    first_ids: bytes
    inner: bytes  # ids of what lies between first and last
    last_ids: bytes
    last: bytes  # text between the last two safe places
    tail: bytes  # text behind


class ChunkCodec:
    """Encodes and decodes with the byte-level vocabulary of a ``tokenizers`` file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.end = self.tokenizer.token_to_id(_SPECIAL.decode())
        letters = byte_letters()
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.bytes_of = [b""] * size
        for token, number in self.tokenizer.get_vocab(with_added_tokens=True).items():
            special = number == self.end
            self.bytes_of[number] = token.encode() if special else bytes(letters[c] for c in token)
        # The ids are handed out as this machine lays out array("I"), which is the format of the results.
        if sys.byteorder != "little" or array("I").itemsize != 4:
            raise ValueError("made for little-endian machines")
        self.encode_plain = self._fast_encoder()
        self.chunks: dict[bytes, _Chunk | None] = {}
        self.kept = 0

    @classmethod
    def of_worker(cls, path: str) -> "ChunkCodec":
        """The codec of this Python worker, which serves one task after the other."""
        return of_worker(("chunks", path), lambda: cls(path))

    def _fast_encoder(self):
        """Encodes text without special tokens; the same vocabulary by ranks gives the same ids, faster."""
        import tiktoken

        ranks = {value: i for i, value in enumerate(self.bytes_of) if i != self.end and value}
        encoding = tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        return encoding.encode_ordinary

    def _chunk(self, chunk: bytes) -> _Chunk | None:
        """The parts of a chunk; None if it has fewer than four safe places."""
        if chunk in self.chunks:
            return self.chunks[chunk]
        if self.kept > KEPT_BYTES:
            self.chunks.clear()
            self.kept = 0
        found, safe = None, [m.start() for m in _SAFE.finditer(chunk)]
        if len(safe) > 3:
            a, b, c, d = safe[0], safe[1], safe[-2], safe[-1]
            first, last = chunk[a:b], chunk[c:d]
            found = _Chunk(chunk[:a], first, self._ids(first), self._ids(chunk[b:c]), self._ids(last), last, chunk[d:])
        self.chunks[chunk] = found
        self.kept += 500 + (len(chunk) + len(found.inner) + 400 if found else len(chunk))
        return found

    def _ids(self, text: bytes) -> bytes:
        if not text:
            return b""
        written = text.decode()
        if len(text) >= LONG_SPACE and _LONG.search(written):
            return array("I", self.tokenizer.encode(written, add_special_tokens=False).ids).tobytes()
        return array("I", self.encode_plain(written)).tobytes()

    def _part(self, part: bytes) -> list[bytes]:
        """The ids of a text without special tokens."""
        ids: list[bytes] = []
        begin, join, before = 0, b"", b""
        for end in cut_points(part):
            whole = part[begin:end]
            begin = end
            chunk = self._chunk(whole)
            if chunk is None:
                # It does not end the join: the piece encoded anew grows.
                join += whole
                continue
            found = self._ids(join + chunk.head + chunk.first)
            if not (found.startswith(before) and found.endswith(chunk.first_ids)):
                return [self._ids(part)]
            ids += (found, chunk.inner)
            join, before = chunk.last + chunk.tail, chunk.last_ids
        found = self._ids(join)
        return [*ids, found] if found.startswith(before) else [self._ids(part)]

    def encode(self, text: bytes) -> bytes:
        """The ids as unsigned 32-bit numbers."""
        ids: list[bytes] = []
        for i, part in enumerate(text.split(_SPECIAL)):
            if i:
                ids.append(array("I", [self.end]).tobytes())
            ids += self._part(part)
        return b"".join(ids)

    def decode(self, ids: bytes) -> bytes:
        """The text in UTF-8; bytes that form no character become replacement characters."""
        found = b"".join(map(self.bytes_of.__getitem__, array("I", ids)))
        return found.decode("utf-8", "replace").encode()


def byte_letters() -> dict[str, int]:
    """The letters that the vocabulary writes bytes with: printable ones themselves, the others from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def encode_and_decode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit numbers) and the text decoded from them."""
    return _apply(
        docs,
        tokenizer,
        "doc_id long, ids binary, decoded binary",
        lambda ids, decoded: (ids, decoded),
        [pa.binary(), pa.binary()],
    )


def digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of the ids and of the decoded text, without handing these on."""
    return _apply(
        docs,
        tokenizer,
        "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string",
        lambda ids, decoded: (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest()),
        [pa.int64(), pa.string(), pa.string()],
    )


def _apply(docs: DataFrame, tokenizer: str, schema: str, describe, kinds: list[pa.DataType]) -> DataFrame:
    prepare(docs.sparkSession)
    names = [field.split()[0] for field in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = ChunkCodec.of_worker(tokenizer)
        for batch in batches:
            rows = []
            for text in texts(batch.column(1)):
                ids = codec.encode(text)
                rows.append(describe(ids, codec.decode(ids)))
            columns = list(zip(*rows)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(list(c), k) for c, k in zip(columns, kinds)]], names
            )

    return docs.selectExpr("CAST(doc_id AS LONG) AS doc_id", "text").mapInArrow(run, schema)
