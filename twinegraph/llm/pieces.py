"""Ids of whole texts from a public tokenizer, with repeated pieces encoded once.

A text that holds ordinary characters only is cut where the tokenizer's own
pre-tokenizer always cuts; each different piece is encoded by the tokenizers
library once per worker and kept in a bounded table. Every other text goes to
the library whole, so the ids are always the library's.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable

import numpy as np
import regex

#: Letters, digits and signs on which every version of Unicode's tables agrees.
ORDINARY = re.compile("[^\t\n\r\x20-\x7e\xa1-įı-ɏ]")
#: White space at which a byte-level cut would need to look beyond its own piece.
UNEVEN = ("  ", " \n", "\n ", "\n\n", "\t", "\r")
#: Entries of the younger half of a table of kept results.
MOST_KEPT = 300_000
#: The patterns by which the two public tokenizers cut text before they merge.
PATTERNS = {
    "byte": r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+",
    "word": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+",
}


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes for themselves, the rest from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return {b: chr(b) if b in shown else chr(next(rest)) for b in range(256)}


class Kept(dict):
    """Results by piece, made at their first use. Two halves bound it: when the younger is full it becomes the older, and what is used again moves back."""

    def __init__(self, make: Callable[[str], bytes]):
        super().__init__()
        self.make, self.older = make, {}

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= MOST_KEPT:
            self.older = dict(self)
            self.clear()
        if (out := self.older.get(piece)) is None:
            out = self.make(piece)
        self[piece] = out
        return out


class PieceEncoder:
    """``encode(text)`` gives the ids as little-endian unsigned 32-bit integers.

    kind: "byte" keeps white space in its pieces, "word" drops it and folds case.
    """

    def __init__(self, path: str, kind: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.kind = kind
        self.cut = regex.compile(PATTERNS[kind]).findall
        self.letters = byte_letters()
        self.merges = self.tokenizer.model.tokenize
        self.words = Kept(self._word)
        self.lead = " " if kind == "byte" else ""
        self.kept = Kept(self._piece)

    def _whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _piece(self, piece: str) -> bytes:
        if piece.isalpha():  # letters alone are one pre-token
            return self._word(self.lead + piece)
        return b"".join(map(self.words.__getitem__, self.cut(self.lead + piece)))

    def _word(self, word: str) -> bytes:
        """Ids of one pre-token, by the library's own merges."""
        plain = word.replace(" ", self.letters[32]) if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.merges(plain)]).tobytes()

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if ORDINARY.search(text) or any(s in text for s in self.special):
            return self._whole(text)
        if self.kind == "word":
            return b"".join(map(self.kept.__getitem__, text.lower().split()))
        if text[-1].isspace() or any(s in text for s in UNEVEN):
            return self._whole(text)
        pieces = text.split(" ")  # a lone blank opens a pre-token, so it belongs to the piece after it
        first = pieces.pop(0)
        return b"".join(map(self.words.__getitem__, self.cut(first))) + b"".join(map(self.kept.__getitem__, pieces))


_made: dict[tuple[str, str], PieceEncoder] = {}


def encoder(path: str, kind: str) -> PieceEncoder:
    """One encoder for each tokenizer in a worker process."""
    if (path, kind) not in _made:
        _made[path, kind] = PieceEncoder(path, kind)
    return _made[path, kind]
