"""Token ids of whole texts, encoded piece by piece with a cache.

A text may be cut before a single space that follows a character other than white space: neither
vocabulary has a token across such a place, so the ids of the pieces joined are those of the text.
Most words repeat, so most pieces come from the cache; the rest go to the tokenizer. Words of
letters alone go to its model directly, without the steps that cut texts into words.
"""

from __future__ import annotations

import os
import re
import sys
import unicodedata
from array import array
from functools import lru_cache

import numpy as np

CACHE_PIECES = 250_000
LONGEST_CACHED = 100  # characters; longer pieces are encoded each time

# White space before a space that does not start a word: cut such texts at single spaces only.
_UNSAFE = re.compile(r"\s (?:\s|\Z)")
_SAFE_CUT = re.compile(r"(?<=\S) (?=\S)")
_MARKS = ",.!?;:%*#$&()"  # no part of a contraction or of a special token
_PROBES = ("a", " the", " Word", " é", " straße", " ÜBER", " ñandú", "Ação", " 漢字", " don", " i")


def _byte_letters() -> dict[int, str]:
    """Letter of each byte in byte-level vocabularies: printable bytes stand for themselves."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


_LETTERS = _byte_letters()
_SPACE = _LETTERS[32]


def _byte_level(piece: str) -> str:
    return piece.encode().decode("latin-1").translate(_LETTERS)


def _spaced_word(piece: str) -> str | None:
    """Model input of a word, its space included; None if it is not of letters alone."""
    if not piece.lstrip(" ").isalpha():
        return None
    return piece.replace(" ", _SPACE) if piece.isascii() else _byte_level(piece)


def _lower_word(piece: str) -> str | None:
    """Model input of a word in lower case, without its space."""
    word = piece.lstrip(" ")
    if word.isascii():
        return word.lower() if word.isalpha() else None
    word = unicodedata.normalize("NFC", word)
    if "Σ" in word:  # its lower case depends on its place
        return None
    word = word.lower()
    return _byte_level(word) if word.isalpha() else None


class _Pieces(dict):
    """Ids of pieces, learned when first asked for; keys lack the ``space`` before the piece."""

    def __init__(self, encoder: PieceEncoder, space: str):
        super().__init__()
        self.encoder, self.space, self.older = encoder, space, {}

    def age(self) -> None:
        """Forget pieces that were not used since the last call; the others come back when used."""
        self.older = self.copy()
        self.clear()

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            ids = self._of_parts(piece)
            if ids is None:
                ids = self.encoder.one(self.space + piece)
        if len(piece) <= LONGEST_CACHED and "\n" not in piece:
            self[piece] = ids
        return ids

    def _of_parts(self, piece: str) -> bytes | None:
        """Ids of a word with marks after it, or of two lines; None for any other piece."""
        word = piece.rstrip(_MARKS)
        if word != piece and word[-1:].lower().isalpha():
            # Marks after a letter are a token sequence of their own.
            return self[word] + self.encoder.mark(piece[len(word) :])
        before, line, after = piece.partition("\n")
        one_line = before and after and "\n" not in after
        if one_line and not before[-1].isspace() and not after[0].isspace():
            return self[before] + self.encoder.mark(line) + self.encoder.first[after]
        return None


@lru_cache(maxsize=2)
def encoder_of(path: str) -> PieceEncoder:
    """The encoder of a worker process: its tasks share vocabulary and cache."""
    return PieceEncoder(path)


class PieceEncoder:
    """Encodes texts with the tokenizer in ``path``; ids come back as little-endian bytes.

    ``width`` is 2 bytes an id if the vocabulary allows it, else 4.
    """

    def __init__(self, path: str, cache_pieces: int = CACHE_PIECES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a task on each core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.code = "H" if self.width == 2 else "I"  # of arrays, little-endian here
        if sys.byteorder != "little":
            raise RuntimeError("ids are packed in the machine's order, which must be little-endian")
        self.dtype = np.dtype(f"<u{self.width}")
        self.cache_pieces = cache_pieces
        self.word_form = None
        self.marks: dict[str, bytes] = {}
        forms = (_spaced_word, _lower_word)
        self.word_form = next((f for f in forms if self._agrees(f)), None)
        self.first, self.later = _Pieces(self, ""), _Pieces(self, " ")

    def _pack(self, ids: list[int]) -> bytes:
        return array(self.code, ids).tobytes()

    def _word(self, form: str) -> bytes:
        return self._pack([t.id for t in self.tokenizer.model.tokenize(form)])

    def _whole(self, piece: str) -> bytes:
        return self._pack(self.tokenizer.encode(piece, add_special_tokens=False).ids)

    def _agrees(self, form) -> bool:
        return all(self._word(form(p)) == self._whole(p) for p in _PROBES)

    def mark(self, marks: str) -> bytes:
        if marks not in self.marks:
            if len(self.marks) > self.cache_pieces:
                self.marks.clear()
            self.marks[marks] = self._whole(marks)
        return self.marks[marks]

    def one(self, piece: str) -> bytes:
        form = self.word_form(piece) if self.word_form else None
        return self._word(form) if form else self._whole(piece)

    def encode(self, text: str) -> bytes:
        for cache in (self.first, self.later):
            if len(cache) > self.cache_pieces:
                cache.age()
        parts = _SAFE_CUT.split(text) if _UNSAFE.search(text) else text.split(" ")
        head = self.first[parts[0]]
        return head + b"".join(map(self.later.__getitem__, parts[1:])) if len(parts) > 1 else head
