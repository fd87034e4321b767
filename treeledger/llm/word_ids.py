"""Ids of whole texts by a word tokenizer that drops white space, with what each word gives kept.

The tokenizer cuts at white space before anything else, and what it makes of a word does not depend
on its neighbours. So a text's ids are those of its words, one after the other. Texts are taken in
slices cut at white space; each word is looked up, byte by byte, among those that the worker
remembers, and the library encodes the new ones. A text of any length takes the memory of a slice
besides itself and its ids, but for a word that is longer than a slice. What is remembered is bounded in bytes.
"""

import re
from collections.abc import Iterator

import numpy as np

from treeledger.llm.bpe import byte_letters
from treeledger.llm.shared import of_worker

# Bytes that the words a worker remembers take, about, and what one takes besides its letters.
KEPT_BYTES, _WORD_BYTES = 144 << 20, 160
# Bytes of text that are cut into words at once, about.
SLICE = 1 << 20
# Ids from here on do not fit into the two bytes they are kept in.
_MOST = 1 << 16

# Small letters of one byte, and those of two that neither case nor composition changes; then ASCII marks.
_PLAIN = re.compile(rb"((?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+)([!-/:-@\[-`{-~]*)")
_SPACE = re.compile(rb"[\t-\r ]")
# No character with a lower first byte is a mark that a letter before it could be composed with.
_LEAST_MARK = 0xC4


def _capitals_kept(texts: bytes, lowered: bytes) -> bytes:
    """The lowered texts, but with those of A-Z kept that marks may follow.

    The library composes before it lowers, and some small letters have composed forms that their capitals lack.
    """
    data = np.frombuffer(texts, np.uint8)
    before = np.flatnonzero(data[1:] >= _LEAST_MARK)
    kept = before[(data[before] >= 65) & (data[before] <= 90)]
    if not len(kept):
        return lowered
    found = np.frombuffer(lowered, np.uint8).copy()
    found[kept] = data[kept]
    return found.tobytes()


def lowered_words(text: bytes) -> list[bytes]:
    """The words of a text, A-Z lowered where that changes no id and makes no special token."""
    low = text.lower()
    if b"|>" in low:
        return text.split()
    return (low if text.isascii() else _capitals_kept(text, low)).split()


def slices(text: bytes) -> Iterator[bytes]:
    """The text in pieces of about SLICE bytes, each but the last one with white space at its end."""
    at = 0
    while len(text) - at > SLICE:
        gap = _SPACE.search(text, at + SLICE)
        end = gap.end() if gap else len(text)
        yield text[at:end]
        at = end
    yield text[at:]


class _Known(dict):
    """The number of each word; a word that is met for the first time gets the next one and is to be learned."""

    def __init__(self):
        super().__init__()
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        self.new.append(word)
        return number


class WordEncoder:
    """Encodes texts with the ``tokenizers`` file at ``path``."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        if self.tokenizer.get_vocab_size(with_added_tokens=True) > _MOST:
            raise ValueError("this encoder keeps ids in two bytes")
        # How the vocabulary writes the bytes that are not printable letters.
        self.written = {b: letter for letter, b in byte_letters().items()}
        self._forget()

    def _forget(self) -> None:
        self.known, self.kept = _Known(), 0
        self.ids = np.empty(1 << 16, np.uint16)  # of all words, one after the other
        self.begins = np.zeros(1 << 16, np.int64)  # of each word's ids; one more for the end

    @classmethod
    def of_worker(cls, path: str) -> "WordEncoder":
        """The encoder of this Python worker, which serves one task after the other."""
        return of_worker(("words", path), lambda: cls(path))

    def _learn(self) -> None:
        words, self.known.new = self.known.new, []
        # Marks behind letters are a piece of their own.
        parts = [_PLAIN.fullmatch(word) for word in words]
        others = [word.decode("utf-8", "replace") for word, part in zip(words, parts) if part is None]
        found = iter(self.tokenizer.encode_batch_fast(others, add_special_tokens=False))
        # Most words with marks are known without them. Nothing but the model itself changes a plain word.
        tokenize, written, known, some = self.tokenizer.model.tokenize, self.written, self.known, len(self.known) - len(words)
        made: dict[bytes, list[int]] = {b"": []}

        def of_piece(piece: bytes) -> list[int]:
            number = known.get(piece, some)
            if number < some:
                return self.ids[self.begins[number] : self.begins[number + 1]].tolist()
            if piece not in made:
                made[piece] = [t.id for t in tokenize(piece.decode("latin-1").translate(written))]
            return made[piece]

        lists = [next(found).ids if part is None else of_piece(part[1]) + of_piece(part[2]) for part in parts]
        first, new = len(self.known) - len(words), np.fromiter((i for ids in lists for i in ids), np.uint16)
        last = self.begins[first] + np.cumsum([len(ids) for ids in lists])
        while len(self.begins) < len(self.known) + 1:
            self.begins = np.concatenate([self.begins, np.zeros_like(self.begins)])
        while len(self.ids) < last[-1]:
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        self.ids[self.begins[first] : last[-1]] = new
        self.begins[first + 1 : len(self.known) + 1] = last
        self.kept += sum(map(len, words)) + _WORD_BYTES * len(words)

    def _ids(self, words: list[bytes], counts: list[int]) -> list[bytes]:
        """The ids of so many words each."""
        if self.kept > KEPT_BYTES:
            self._forget()
        known = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        if self.known.new:
            self._learn()
        sizes = self.begins[known + 1] - self.begins[known]
        last = np.concatenate([[0], np.cumsum(sizes)])
        places = np.arange(last[-1]) + np.repeat(self.begins[known] - last[:-1], sizes)
        ids = self.ids[places].astype("<u2").tobytes()
        limits = 2 * last[np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])]
        return [ids[a:b] for a, b in zip(limits[:-1].tolist(), limits[1:].tolist())]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 16-bit numbers."""
        found: list[list[bytes]] = [[] for _ in texts]
        words: list[bytes] = []
        counts: list[int] = []
        whose: list[int] = []
        held = 0

        def flush() -> None:
            for i, ids in zip(whose, self._ids(words, counts)):
                found[i].append(ids)
            words.clear(), counts.clear(), whose.clear()

        for i, text in enumerate(texts):
            for part in slices(text):
                some = lowered_words(part)
                words += some
                counts.append(len(some))
                whose.append(i)
                held += len(part)
                if held >= SLICE:
                    flush()
                    held = 0
        flush()
        return [b"".join(parts) for parts in found]
