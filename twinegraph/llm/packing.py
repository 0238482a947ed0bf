"""Operator 10: documents packed into fixed windows by the sum-of-squares rule.

Online, in the order the documents come: a document of s tokens goes to the
fill level h (of a partly filled window, or 0 for a new one) that makes
the sum over levels of the squared number of windows at that level least. The
counts stand in an array of one place per level, so a placement looks at all
levels at once. Whole windows are cut off documents longer than a window first.
When the input ends, the windows that are still partly filled are closed:
their pieces are strung together, cut at window ends, and the last sequence is
cut at powers of two, so that nothing is padded.

Each input partition packs its own rows without a shuffle; a sequence never
spans partitions. Small input partitions are read together, up to about ``LEAST_TASK_BYTES`` of the table's files a task, since
what is still open at a task's end is cut, not placed by the rule. ``sequence_id`` is the partition's number times 2^36 plus a
count. At most ``most_open`` windows are open at a time; beyond that the
emptiest half is closed as above, no piece is dropped.

Defined results: a null or empty text is one piece that holds the end id; rows
that repeat a doc_id are packed each by itself; null keys stay null; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, table
from .pieces import encoder

WINDOW = 4096
MOST_OPEN = 8192
LEAST_TASK_BYTES = 64 << 20
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Packer:
    """Feeds (key, ids as unsigned 32-bit bytes); gives rows (key, start, length, crc32, doc_tokens, sequence, offset)."""

    def __init__(self, window: int = WINDOW, most_open: int = MOST_OPEN, first_sequence: int = 0):
        self.window, self.most_open = window, most_open
        self.sequence = first_sequence
        self.at: list[list[list[tuple]]] = [[] for _ in range(window)]  # windows by fill level: lists of pieces
        self.counts = np.zeros(window + 1, np.int64)  # level 0 and the full level always count nothing
        self.open = 0
        self.ready: list[tuple] = []

    def _level(self, s: int) -> int:
        """The level to put s tokens on. Taking a window from h to h + s changes the sum of squares by 2 N[h+s] + 1 - 2 N[h] + 1; a new window takes from no level and a full one adds to none."""
        w, n = self.window, self.counts
        top = w - s
        gain = 2 * (n[s : w + 1] - n[: top + 1])
        gain[0] -= 1
        gain[top] -= 1
        usable = n[: top + 1] > 0
        usable[0] = True
        gain = np.where(usable, gain, np.iinfo(np.int64).max)
        best = gain.min()
        return int(np.flatnonzero(gain == best)[-1])  # of equals the fullest

    def _emit(self, pieces: list[tuple]) -> None:
        offset = 0
        for key, start, ids, total in pieces:
            n = len(ids) // 4
            self.ready.append((key, start, n, zlib.crc32(ids), total, self.sequence, offset))
            offset += n
        self.sequence += 1

    def add(self, key, ids: bytes) -> None:
        total, w = len(ids) // 4, self.window
        start = 0
        while total - start >= w:
            self._emit([(key, start, ids[4 * start : 4 * (start + w)], total)])
            start += w
        s = total - start
        if not s:
            return
        h = self._level(s)
        pieces = self.at[h].pop() if h else []
        if h:
            self.counts[h] -= 1
            self.open -= 1
        pieces.append((key, start, ids[4 * start :], total))
        if h + s == w:
            self._emit(pieces)
            return
        self.at[h + s].append(pieces)
        self.counts[h + s] += 1
        self.open += 1
        if self.open > self.most_open:
            self._close(self.open // 2, last=False)

    def _close(self, n: int, last: bool) -> None:
        """Empty the n emptiest windows: full windows are cut from their pieces in turn."""
        todo: list[tuple] = []
        for h in range(1, self.window):
            while self.at[h] and n:
                todo += self.at[h].pop()
                self.counts[h] -= 1
                self.open -= 1
                n -= 1
        room, pieces = self.window, []
        for key, start, ids, total in todo:
            while len(ids) // 4 >= room:
                self._emit([*pieces, (key, start, ids[: 4 * room], total)])
                start, ids, room, pieces = start + room, ids[4 * room :], self.window, []
            if ids:
                pieces.append((key, start, ids, total))
                room -= len(ids) // 4
        if not pieces:
            return
        fill = self.window - room
        if not last:
            self.at[fill].append(pieces)
            self.counts[fill] += 1
            self.open += 1
            return
        for bit in reversed(range(fill.bit_length())):
            size = 1 << bit
            if fill & size:
                out, left = [], size
                while left:
                    key, start, ids, total = pieces.pop(0)
                    k = min(left, len(ids) // 4)
                    out.append((key, start, ids[: 4 * k], total))
                    if k < len(ids) // 4:
                        pieces.insert(0, (key, start + k, ids[4 * k :], total))
                    left -= k
                self._emit(out)

    def take(self) -> list[tuple]:
        out, self.ready = self.ready, []
        return out

    def finish(self) -> list[tuple]:
        self._close(self.open, last=True)
        return self.take()


def rows_batch(rows: Iterable[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * 7
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], [x.split()[0] for x in PIECES.split(", ")])


def pack(docs: DataFrame, tokenizer: str, kind: str = "word", end_id: int = 2, window: int = WINDOW, most_open: int = MOST_OPEN) -> DataFrame:
    """Pieces of all rows of ``docs`` (doc_id, text), see the module's text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, end = encoder(tokenizer, kind), struct.pack("<I", end_id)
        packer = Packer(window, most_open, TaskContext.get().partitionId() << 36)
        for b in batches:
            for key, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                packer.add(key, enc.encode(text.as_py()) + end)
            if len(packer.ready) > 10_000:
                yield rows_batch(packer.take())
        yield rows_batch(packer.finish())

    small_batches(docs.sparkSession)
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    docs = docs.coalesce(max(1, min(1 << 30, -(-size // LEAST_TASK_BYTES))))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, PIECES)


def op10_pack(spark, sf_dir: str) -> DataFrame:
    """All documents, whole, packed into windows of 4096 tokens."""
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
