"""Operator 5: exact BPE by backtracking over longest matches, and decoding through an offset table.

Encoding. A sequence of tokens is the result of the merges exactly when every pair
of neighbours is: when merging the two tokens' joined letters gives the two back.
An Aho-Corasick automaton over the vocabulary finds the tokens that
start at each place of a word. From the left, the longest is tried first; one that is not
compatible with its left neighbour gives way to the next shorter, and where none is left
the last token is taken back and its place marked, so each place fails at most once
and the work is linear in the word. Pair compatibility is kept in a table that fills as
pairs are met, each decided once by merging the pair's letters in rank order.

Words that repeat are encoded once per worker (bounded table). Around
that stand the tokenizer's own steps: special tokens are cut out first, then NFC, white space
to blanks and lower case, then the cut into words, then bytes to letters with an end mark.

Decoding. All tokens' texts stand one after another in one byte array with a table of
offsets; the bytes of a text are gathered with one index per byte. Tokens
are joined by blanks, as the library does for a tokenizer without a decoder.

Defined results: a null or empty text has no ids and decodes to an empty text; rows that repeat
get the same row each; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table
from .pieces import MOST_KEPT, ORDINARY, PATTERNS, Kept, byte_letters

#: Stands for the end of a word inside the automaton; no byte's letter.
END = "￿"
END_TEXT = "</w>"


class Merges:
    """A vocabulary with ranked merges, and the exact encoder over it."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], end_text: str = END_TEXT):
        import ahocorasick

        mark = lambda t: t[: -len(end_text)] + END if end_text and t.endswith(end_text) and len(t) > len(end_text) else t
        self.ids = {mark(t): i for t, i in vocab.items()}
        self.rank: dict[tuple[str, str], int] = {}
        for r, (a, b) in enumerate(merges):
            self.rank.setdefault((mark(a), mark(b)), r)
        self.pairs: dict[tuple[str, str], bool] = {}
        self.automaton = ahocorasick.Automaton()
        for t in self.ids:
            if t != END and self.merge(t) == [t]:  # a token that its own letters don't lead to never appears
                self.automaton.add_word(t, t)
        self.automaton.make_automaton()

    @staticmethod
    def letters(text: str) -> list[str]:
        out = list(text)
        if out and out[-1] == END:
            out[-2:] = [out[-2] + END] if len(out) > 1 else [END]
        return out

    def merge(self, text: str) -> list[str]:
        """The merges as they are defined: the lowest rank first, of equals the leftmost. For short strings."""
        parts = self.letters(text)
        while len(parts) > 1:
            ranks = [self.rank.get(p, -1) for p in zip(parts, parts[1:], strict=False)]
            known = [r for r in ranks if r >= 0]
            if not known:
                break
            i = ranks.index(min(known))
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def compatible(self, a: str, b: str) -> bool:
        if (ok := self.pairs.get((a, b))) is None:
            if len(self.pairs) > 2 * MOST_KEPT:
                self.pairs = {}
            ok = self.pairs[a, b] = self.merge(a + b) == [a, b]
        return ok

    def encode(self, word: str) -> list[str]:
        """Tokens of a word whose letters end in END."""
        n = len(word)
        starts: list[list[str]] = [[] for _ in range(n)]
        for end, t in self.automaton.iter(word):
            starts[end + 1 - len(t)].append(t)  # by end, so the longest comes last
        dead = bytearray(n + 1)
        out: list[str] = []
        tries: list[int] = []
        at, left = 0, len(starts[0])
        while at < n:
            while left:
                left -= 1
                t = starts[at][left]
                if not dead[at + len(t)] and (not out or self.compatible(out[-1], t)):
                    out.append(t)
                    tries.append(left)
                    at += len(t)
                    left = len(starts[at]) if at < n else 0
                    break
            else:
                if not out:
                    raise ValueError("letters outside the vocabulary")
                dead[at] = 1
                at -= len(out.pop())
                left = tries.pop()
        return out


class WordBpe:
    """Texts to ids and back for a tokenizer file with word ends, without calling the tokenizer library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        vocab = spec["model"]["vocab"]
        self.merges = Merges(vocab, merges, spec["model"]["end_of_word_suffix"] or "")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_cut = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")")
        self.cut = regex.compile(PATTERNS["word"]).findall
        self.letters = byte_letters()
        self.words = Kept(self._word)
        self.pieces = Kept(lambda piece: b"".join(map(self.words.__getitem__, self.cut(piece))))
        texts = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        for t, i in [*vocab.items(), *self.special.items()]:
            texts[i] = t.encode() + b" "
        self.offsets = np.cumsum([0, *map(len, texts)])
        self.flat = np.frombuffer(b"".join(texts), np.uint8)

    def _word(self, word: str) -> bytes:
        found = self.merges.encode(word.encode().decode("latin-1").translate(self.letters) + END)
        return array("I", [self.merges.ids[t] for t in found]).tobytes()

    def _plain(self, text: str) -> bytes:
        if ORDINARY.search(text):
            text = unicodedata.normalize("NFC", text)
            pieces = regex.split(r"\s+", text.replace("Σ", "σ").lower())
        else:
            pieces = text.lower().split()
        return b"".join(map(self.pieces.__getitem__, pieces))

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if not any(s in text for s in self.special):
            return self._plain(text)
        return b"".join(array("I", [self.special[p]]).tobytes() if p in self.special else self._plain(p) for p in self.special_cut.split(text) if p)

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 of the tokens joined by blanks."""
        x = np.frombuffer(ids, "<u4")
        if not x.size:
            return b""
        first, size = self.offsets[x], self.offsets[x + 1] - self.offsets[x]
        ends = np.cumsum(size)
        return self.flat[np.arange(ends[-1]) + np.repeat(first - ends + size, size)].tobytes()[:-1]


_made: dict[str, WordBpe] = {}


def word_bpe(path: str) -> WordBpe:
    if path not in _made:
        _made[path] = WordBpe(path)
    return _made[path]


DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_rows(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens, and the digests of the ids and of the text they decode to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(tokenizer)
        for b in batches:
            ids = [bpe.encode(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()), pa.array([hashlib.sha256(bpe.decode(x)).hexdigest() for x in ids], pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, DIGESTS)


def op5_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_rows(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
