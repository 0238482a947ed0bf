"""Operator 9: removal of long repeated strings by a column-wise multi-document suffix order.

Every byte that some string of ``length`` bytes covers which also starts
anywhere else, in the same document or another, is removed. Strings are
judged on the input.

1. Anchors. The places of a text whose window of ``half`` bytes has the least hash
   among ``length - half + 1`` neighbours. A string of ``length`` bytes holds
   such a window, at a place that its own content fixes, so equal strings share
   the window and its place in them. Of ordinary text one byte in 137 is an anchor;
   only its window's hash, the hash of its whole surroundings and its place are shuffled.
2. Anchors whose window occurs once can't be in a repeated string. Where all of the
   surroundings occur again, every string around the anchor is repeated. Both
   are settled by counting, whatever the size of the group.
3. What is left, one document per different surroundings of a window that
   occurs with other ones, is compared to the byte in a collection of short documents,
   aligned at their anchors. The collection's Burrows-Wheeler transform is built
   column by column: each round inserts one symbol of every document, the new
   order follows from the last order and the symbols inserted, and the common
   prefixes of neighbours are updated in the same pass. Equal strings stand in
   the same column, so a round's suffixes are compared with each other only,
   and a round's block of the transform and of the prefixes is one append to
   sequential files. A suffix with a common prefix of ``length`` with a neighbour is repeated.
4. Windows with more different surroundings than ``most_group`` are first
   dealt out: one half of the starts needs its left part equal, the other its
   right part, so the part's hash joins the key and the range of starts is halved,
   until a group is small enough or one start is left. Rows that agree on all that a range can
   cover are repeated there, and only one of them goes on.
   No group is ever larger than ``most_group`` in one task, and none is dropped.

Byte equality in 2 and 4 rests on pairs of 64-bit hashes, in 3 on the bytes.

Passages counted in words (``remove_repeats`` with ``words``) go the same way: a text becomes
a string of ``CODE`` bytes for each word, so ``words`` words are a string of one length, however
short they are and whatever blanks stand between them. Anchors, columns and rounds are then words, not bytes. Equality of words rests on 32-bit hashes.

Defined results: a null or empty text has nothing to remove; repeated rows are
copies of each other; a null key is a key like any other; an empty table gives no rows;
other columns are kept by ``remove_repeats`` and not read by the query.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, give_back, table, with_text, written

LENGTH = 400
#: Rows of one group in a task: some 100 MB with their byte matrix.
MOST_GROUP = 50_000
#: Small groups share a collection of about so many documents.
AT_ONCE = 4096
#: Bytes that stand for a word where passages are counted in words.
CODE = 4

BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_letters = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _powers[0].size < n:
        size = 1 << max(14, (n - 1).bit_length())
        for i, b in enumerate((BASE, INVERSE)):
            x = np.full(size, b, np.uint64)
            x[0] = 1
            _powers[i] = np.cumprod(x, dtype=np.uint64)
    return _powers[0], _powers[1]


def prefix_hashes(text: np.ndarray) -> np.ndarray:
    """P with P[j] - P[i] the unscaled hash of text[i:j]; text: bytes, or words' codes of 32 bits."""
    up, _ = _power_tables(text.size + 1)
    out = np.zeros(text.size + 1, np.uint64)
    letters = _letters[text] if text.dtype == np.uint8 else _stir(text.astype(np.uint64) + np.uint64(BASE))
    np.cumsum(letters * up[: text.size], dtype=np.uint64, out=out[1:])
    return out


def _stir(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return x ^ (x >> np.uint64(27))


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each text[start:end] by its content and length."""
    _, down = _power_tables(prefix.size)
    return _stir((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def sliding(x: np.ndarray, w: int, keep: np.ufunc, pad: int) -> np.ndarray:
    """The least or greatest value of each w neighbours."""
    y = np.concatenate([x, np.full(-x.size % w, pad, np.uint64)]).reshape(-1, w)
    ahead = keep.accumulate(y, axis=1).ravel()
    behind = keep.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    m = x.size - w + 1
    return keep(behind[:m], ahead[w - 1 : w - 1 + m])


def anchors(text: np.ndarray, length: int, half: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor places of a text of ``length`` bytes at least, their windows' hashes, and the text's prefix hashes.

    A place is an anchor where its window's hash is the least of some ``length - half + 1`` neighbours.
    """
    prefix = prefix_hashes(text)
    n, w = text.size - half + 1, length - half + 1
    _, down = _power_tables(prefix.size)
    own = _stir((prefix[half:] - prefix[:n]) * down[:n])
    least = sliding(own, w, np.minimum, 2**64 - 1)
    padded = np.concatenate([np.zeros(w - 1, np.uint64), least, np.zeros(w - 1, np.uint64)])
    at = np.flatnonzero(sliding(padded, w, np.maximum, 0) == own)
    return at, own[at], prefix


class CollectionOrder:
    """The suffix order of equally long documents, one column a round, from the last to the first.

    ``order`` lists the documents by their suffixes from the column on;
    ``common`` is the length of the prefix that each shares with the one before it.
    Each round appends the symbols it inserts, in suffix order, which are the column's
    block of the transform, and the common prefixes to the files of ``folder``.
    """

    def __init__(self, columns: np.ndarray, folder: str | None = None):
        """columns: one row per column of the documents."""
        self.columns = columns
        self.order = np.arange(columns.shape[1])
        self.common = np.zeros(columns.shape[1], np.int64)
        self.files = [open(os.path.join(folder, x), "ab") for x in ("transform", "prefixes")] if folder else []

    def insert(self, column: int) -> None:
        symbols = self.columns[column][self.order]
        new = np.argsort(symbols, kind="stable")  # by the symbol, then by the order so far
        s = symbols[new]
        same = np.flatnonzero(s[1:] == s[:-1]) + 1
        common = np.zeros(s.size, np.int64)
        # One more than the least common prefix on the way between the two places.
        common[same] = self._between(new[same - 1] + 1, new[same]) + 1
        for f, x in zip(self.files, (symbols, common.astype("<u4")), strict=False):
            f.write(x.tobytes())
        self.order, self.common = self.order[new], common

    def _between(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The least of common[first..last], both included, by runs of doubling length."""
        out = self.common[last].copy()
        far = np.flatnonzero(last > first)
        if far.size:
            a, b = first[far], last[far]
            level, row = np.frexp((b - a + 1).astype(np.float64))[1] - 1, self.common
            for k in range(int(level.max()) + 1):
                if k:
                    row = np.minimum(row[: -(1 << k - 1)], row[1 << k - 1 :])
                at = np.flatnonzero(level == k)
                if at.size:
                    out[far[at]] = np.minimum(row[a[at]], row[b[at] - (1 << k) + 1])
        return out

    def close(self) -> None:
        for f in self.files:
            f.close()


#: Symbols by their bytes, and what stands where a text ends: no byte of UTF-8 and no word's code equals it.
SYMBOLS = {1: np.uint8, 4: np.uint32}
NOTHING = {1: 255, 4: 2**32 - 1}


def repeated_starts(columns: np.ndarray, length: int) -> np.ndarray:
    """columns: of documents of ``reach`` symbols before an anchor, then ``length`` from it on. Entry [i, s]: whether the string of
    ``length`` that starts s before the anchor of document i is also in another one at the same place."""
    reach = columns.shape[0] - length
    found = np.zeros((columns.shape[1], reach + 1), bool)
    with tempfile.TemporaryDirectory() as folder:
        c = CollectionOrder(columns, folder)
        for column in reversed(range(columns.shape[0])):
            c.insert(column)
            if column <= reach:
                same = c.common >= length
                same[:-1] |= same[1:]
                found[c.order[same], reach - column] = True
        c.close()
    return found


def runs_of(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first and last place of each run of true entries."""
    edge = np.zeros((flags.shape[0], flags.shape[1] + 2), np.int8)
    edge[:, 1:-1] = flags
    step = np.diff(edge, axis=1)
    row, first = np.nonzero(step == 1)
    return row, first, np.nonzero(step == -1)[1] - 1


ANCHORS = "key long, around long, doc long, n_bytes long, places array<long>"
SURROUNDINGS = "key long, around long, bytes binary, skip long"
RANGES = "key long, around long, lo long, hi long"


def _batch(schema: str, *cols) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    names = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(cols, names, strict=True)], [n for n, _ in names])


def _anchor_rows(length: int, half: int, unit: int):
    """A row per document, window and surroundings, with all the places where the document has them: what repeats inside a document stays one row.

    Lengths and places are in bytes; anchors stand at multiples of ``unit``.
    """
    n, w, reach = length // unit, half // unit, (length - half) // unit
    kind = SYMBOLS[unit]

    def batch(out: list[tuple]) -> pa.RecordBatch:
        key, around, doc, size, times, places = map(np.concatenate, zip(*out, strict=True))
        offsets = np.concatenate([[0], np.cumsum(times)])
        cols = [pa.array(c, pa.int64()) for c in (key, around, doc, size)] + [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(places, pa.int64()))]
        return pa.RecordBatch.from_arrays(cols, [x.split()[0] for x in ANCHORS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                x = np.frombuffer(text.as_buffer(), kind) if text.is_valid else np.zeros(0, kind)
                if x.size < n:
                    continue
                at, own, prefix = anchors(x, n, w)
                first, last = np.maximum(at - reach, 0), np.minimum(at + n, x.size)
                around = (span_hash(prefix, first, last) + (at - first).astype(np.uint64)).view(np.int64)
                own = own.view(np.int64)
                order = np.lexsort((at, around, own))
                own, around = own[order], around[order]
                new = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (around[1:] != around[:-1])]))
                times = np.diff(np.append(new, at.size))
                out.append((own[new], around[new], np.full(new.size, doc), np.full(new.size, x.size * unit), times, at[order] * unit))
                if len(out) >= 500 or at.size > 1 << 20:
                    yield batch(out)
                    out = []
            if out:
                yield batch(out)
        give_back()

    return run


def _surroundings(length: int, half: int):
    reach = length - half

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for text, wanted in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                x = text.as_buffer().to_pybytes()
                for w in wanted:
                    p = w["place"]
                    out.append((w["key"], w["around"], x[max(0, p - reach) : p + length], max(0, reach - p)))
                if len(out) >= 4000:
                    yield _batch(SURROUNDINGS, *zip(*out, strict=True))
                    out = []
            if out:
                yield _batch(SURROUNDINGS, *zip(*out, strict=True))
        give_back()

    return run


def _part_keys(length: int, half: int):
    """part: the hash of what any start between lo and hi needs, lo bytes before the anchor and length - hi from it on; rows
    whose text ends before are dropped. same: the hash of all that such starts can cover, as far as the text goes."""
    reach = length - half

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = dict(zip(b.schema.names, b.columns, strict=True))
            lo, hi, skip = (cols[c].to_pylist() for c in ("lo", "hi", "skip"))
            parts, same, keep = [], [], []
            for i, (key, x) in enumerate(zip(cols["key"].to_pylist(), cols["bytes"].to_pylist(), strict=True)):
                anchor = reach - skip[i]
                first, last = anchor - lo[i], anchor + length - hi[i]
                if first < 0 or last > len(x):
                    continue
                first0, last0 = max(0, anchor - hi[i]), min(len(x), anchor + length - lo[i])
                head = b"%d %d %d " % (key, lo[i], hi[i])
                keep.append(i)
                parts.append(hashlib.blake2b(head + x[first:last], digest_size=16).hexdigest())
                same.append(hashlib.blake2b(head + b"%d " % (anchor - first0) + x[first0:last0], digest_size=16).hexdigest())
            t = pa.Table.from_batches([b]).take(keep)
            for name, values in (("part", parts), ("same", same)):
                t = t.set_column(t.schema.get_field_index(name), name, pa.array(values, pa.string()))
            yield from t.combine_chunks().to_batches()

    return run


def _compare(length: int, half: int, at_once: int, unit: int):
    """Groups of one part, sorted, compared in collections of up to ``at_once`` documents and the rest of a group."""
    n, reach, kind = length // unit, (length - half) // unit, SYMBOLS[unit]

    def ranges(rows: list[tuple]) -> pa.RecordBatch:
        columns = np.empty((reach + n, len(rows)), kind)
        lo, hi = np.empty(len(rows), np.int64), np.empty(len(rows), np.int64)
        for k in range(0, len(rows), 1024):
            part = rows[k : k + 1024]
            wide = np.full((len(part), reach + n), NOTHING[unit], kind)
            for i, (_, _, x, skip, a, z) in enumerate(part):
                own, before = np.frombuffer(x, kind), skip // unit
                wide[i, before : before + own.size] = own
                lo[k + i], hi[k + i] = max(a, (reach + n - before - own.size) * unit), min(z, (reach - before) * unit)
            columns[:, k : k + len(part)] = wide.T
        s = np.arange(reach + 1)[None, :] * unit
        r, first, last = runs_of(repeated_starts(columns, n) & (s >= lo[:, None]) & (s <= hi[:, None]))
        key, around = np.asarray([x[0] for x in rows], np.int64), np.asarray([x[1] for x in rows], np.int64)
        return _batch(RANGES, key[r], around[r], first * unit, last * unit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        part = None
        for b in batches:
            cols = [b.column(b.schema.get_field_index(c)).to_pylist() for c in ("part", "key", "around", "bytes", "skip", "lo", "hi")]
            for p, *row in zip(*cols, strict=True):
                if p != part and len(held) >= at_once:
                    yield ranges(held)
                    held = []
                part = p
                held.append(tuple(row))
        if held:
            yield ranges(held)
        held = []
        give_back()

    return run


def repeated_spans(docs: DataFrame, length: int = LENGTH, most_group: int = MOST_GROUP, unit: int = 1) -> DataFrame:
    """(doc, n_bytes, spans) of the texts with something to remove; docs: (doc, n_bytes, bytes). spans: (first, last) of bytes, last exclusive, unordered.

    With ``unit``, texts are symbols of so many bytes, and only strings that start and end at whole symbols count.
    """
    half = max(1, length * 8 // 25 // unit) * unit
    reach = length - half
    long = docs.where(F.col("n_bytes") >= length)
    temporary: list[DataFrame] = []

    def kept(df: DataFrame, tag: str) -> DataFrame:
        temporary.append(out := written(df, tag))
        return out

    found = kept(long.select("doc", "bytes").mapInArrow(_anchor_rows(length, half, unit), ANCHORS), "anchors")
    times = F.sum(F.size("places")).alias("n")
    # Written first, so that the join has an exchange of its own on either side and a hot window's rows can be dealt to several tasks.
    windows = found.groupBy("key").agg(times, F.min("around").alias("least"), F.max("around").alias("most")).where(F.col("n") > 1)
    windows = kept(windows.select("key", (F.col("least") != F.col("most")).alias("mixed")), "windows")
    again = kept(found.join(windows, "key").select(*found.columns, "mixed"), "again")
    forget(found)
    mixed = again.where("mixed")
    kinds = kept(mixed.groupBy("key", "around").agg(times, F.min(F.struct("doc", "n_bytes", F.element_at("places", 1).alias("place"))).alias("one")), "kinds")
    wanted = kinds.select("one.doc", "one.n_bytes", F.struct("key", "around", "one.place").alias("w")).groupBy("doc", "n_bytes").agg(F.collect_list("w").alias("wanted"))
    around = long.join(wanted, ["doc", "n_bytes"]).select("bytes", "wanted").mapInArrow(_surroundings(length, half), SURROUNDINGS).dropDuplicates(["key", "around"])
    todo = kept(around.select("*", F.lit(0).cast("long").alias("lo"), F.lit(reach).cast("long").alias("hi"), F.col("key").cast("string").alias("part")), "around")
    results = [kinds.where("n > 1").select("key", "around", F.lit(0).cast("long").alias("lo"), F.lit(reach).cast("long").alias("hi"))]
    while True:
        sizes = todo.groupBy("part").agg(F.count("*").alias("n")).where("n > 1")
        small = todo.join(sizes.where(F.col("n") <= most_group), "part").drop("n")
        results.append(small.repartition("part").sortWithinPartitions("part").mapInArrow(_compare(length, half, min(most_group, AT_ONCE), unit), RANGES))
        if sizes.where(F.col("n") > most_group).limit(1).count() == 0:
            break
        # A hot window: each half of the starts needs more of the surroundings to be equal.
        large = todo.join(sizes.where(F.col("n") > most_group), "part")
        mid = F.floor((F.col("lo") + F.col("hi")) / (2 * unit)) * unit
        halves = large.withColumn("h", F.explode(F.array(F.struct(F.col("lo").alias("a"), mid.alias("z")), F.struct((mid + unit).alias("a"), F.col("hi").alias("z")))))
        halves = halves.select("key", "around", "bytes", "skip", F.col("h.a").alias("lo"), F.col("h.z").alias("hi"), "part", F.lit("").alias("same"))
        halves = kept(halves.mapInArrow(_part_keys(length, half), halves.schema), "parts")
        # Rows that agree on all that the half can cover are repeated throughout it, and one of them goes on.
        twice = halves.groupBy("part", "same").agg(F.count("*").alias("n")).where("n > 1")
        results.append(halves.join(twice, ["part", "same"]).select("key", "around", "lo", "hi"))
        todo = kept(halves.dropDuplicates(["part", "same"]).drop("same"), "parts")
    ranges = results[0]
    for r in results[1:]:
        ranges = ranges.unionByName(r)
    hit = mixed.join(ranges, ["key", "around"]).select("doc", "n_bytes", "places", "lo", "hi").unionByName(
        again.where("not mixed").select("doc", "n_bytes", "places", F.lit(0).cast("long").alias("lo"), F.lit(reach).cast("long").alias("hi")))
    # A start is in the text, and so is its string's end.
    lo, hi = lambda p: F.greatest(F.col("lo"), p + length - F.col("n_bytes")), lambda p: F.least(F.col("hi"), p)
    inside = F.filter("places", lambda p: lo(p) <= hi(p))
    spans = F.transform(inside, lambda p: F.struct((p - hi(p)).alias("first"), (p - lo(p) + length).alias("last")))
    hit = hit.select("doc", "n_bytes", spans.alias("spans")).where(F.size("spans") > 0)
    out = written(hit.groupBy("doc", "n_bytes").agg(F.flatten(F.collect_list("spans")).alias("spans")), "spans")
    del found, windows, again, mixed, kinds, todo, results, hit, ranges
    forget(*temporary)
    return out


def merged(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The maximal runs that spans (last exclusive) cover, in order."""
    if not first.size:
        return first, last
    order = np.argsort(first, kind="stable")
    first, last = first[order], np.maximum.accumulate(last[order])
    new = np.flatnonzero(np.concatenate([[True], first[1:] > last[:-1]]))
    return first[new], last[np.append(new[1:] - 1, last.size - 1)]


def cut(text: bytes, first: np.ndarray, last: np.ndarray) -> tuple[bytes, int, int]:
    """The bytes outside the spans, how many were inside, and in how many runs."""
    first, last = merged(first, last)
    if not first.size:
        return text, 0, 0
    edges = zip([0, *last.tolist()], [*first.tolist(), len(text)], strict=True)
    return b"".join([text[a:z] for a, z in edges]), int((last - first).sum()), first.size


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows (doc, n_bytes, bytes, row): the key is a hash of the document's id and text, so copies under other ids stay apart."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.xxhash64(F.col("doc_id"), text).alias("doc"), F.octet_length(text).cast("long").alias("n_bytes"), text.cast("binary").alias("bytes"), F.struct("*").alias("row"))


def word_edges(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place and end of each word: what stands between white space."""
    blank = (text == 32) | ((text >= 9) & (text <= 13))
    step = np.diff(np.concatenate([[1], blank.astype(np.int8), [1]]))
    return np.flatnonzero(step == -1), np.flatnonzero(step == 1)


CODES = "doc long, n_text long, n_bytes long, bytes binary"


def _codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts as their words' codes of ``CODE`` bytes, none of them NOTHING; n_text: bytes of the text, n_bytes: of its codes."""
    for b in batches:
        out = []
        for text in b.column(2):
            x = np.frombuffer(text.as_buffer(), np.uint8)
            codes = (span_hash(prefix_hashes(x), *word_edges(x)) >> np.uint64(32)).astype("<u4")
            out.append(np.minimum(codes, NOTHING[CODE] - 1).tobytes())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([len(x) for x in out], pa.int64()), pa.array(out, pa.binary())], [x.split()[0] for x in CODES.split(", ")])
    give_back()


def word_spans(text: bytes, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes from the first word to the last of each passage; first and last: spans of the text's codes."""
    if not first.size:
        return first, last
    begin, end = word_edges(np.frombuffer(text, np.uint8))
    return begin[first // CODE], end[last // CODE - 1]


SPANS = "array<struct<first:bigint,last:bigint>>"


def _repeats(keyed: DataFrame, length: int, most_group: int, words: int) -> DataFrame:
    """(doc, n_bytes, spans, passages) of the texts with something to remove; passages are spans of the texts' codes."""
    spans = repeated_spans(keyed.select("doc", "n_bytes", "bytes"), length, most_group)
    if not words:
        return spans.withColumn("passages", F.lit(None).cast(SPANS))
    coded = written(keyed.select("doc", "n_bytes", "bytes").mapInArrow(_codes, CODES), "codes")
    passages = repeated_spans(coded.select("doc", "n_bytes", "bytes"), CODE * words, most_group, CODE)
    sizes = coded.select("doc", "n_bytes", "n_text").distinct()
    passages = written(passages.join(sizes, ["doc", "n_bytes"]).select("doc", F.col("n_text").alias("n_bytes"), F.col("spans").alias("passages")), "passages")
    forget(coded)
    return spans.join(passages, ["doc", "n_bytes"], "full")


DIGESTS = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passage_bytes long"


def _each(column: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(first, last) of each row's spans; none for a null."""
    offsets = column.offsets.to_numpy()
    first, last = (column.values.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    for a, z, known in zip(offsets[:-1].tolist(), offsets[1:].tolist(), valid, strict=True):
        z = z if known else a
        yield first[a:z], last[a:z]


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for key, text, spans, passages in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), _each(b.column(2)), _each(b.column(3)), strict=True):
            kept, removed, runs = cut(text, *spans)
            begin, end = merged(*word_spans(text, *passages))
            out.append((key, len(text), removed, runs, hashlib.sha256(kept).hexdigest(), int((end - begin).sum())))
        yield _batch(DIGESTS, *(zip(*out, strict=True) if out else [()] * 6))
    give_back()


#: Words of the least passage that counts in ``n_passage_bytes``.
PASSAGE = 51


def op9_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """The contract's columns, for strings of ``LENGTH`` bytes, and n_passage_bytes: bytes in passages of ``PASSAGE`` words or more that also stand
    anywhere else, which may be shorter than that; they are counted, not removed."""
    keyed = _keyed(table(spark, sf_dir, "documents").select("doc_id", "text"))
    repeats = _repeats(keyed, LENGTH, MOST_GROUP, PASSAGE)
    joined = keyed.select("doc", "n_bytes", "bytes", F.col("row.doc_id").cast("long").alias("doc_id")).join(repeats, ["doc", "n_bytes"], "left")
    return joined.select("doc_id", "bytes", "spans", "passages").mapInArrow(_digests, DIGESTS)


def remove_repeats(docs: DataFrame, length: int = LENGTH, most_group: int = MOST_GROUP, words: int = 0) -> DataFrame:
    """The rows with their texts cut; characters of which only a part is left go. ``n_chars`` follows where it exists.

    With ``words``, every passage of so many words that also stands anywhere else goes too; both are judged on the input.
    """
    keyed = _keyed(docs)
    joined = keyed.join(_repeats(keyed, length, most_group, words), ["doc", "n_bytes"], "left").select(F.col("row").alias("doc"), "bytes", "spans", "passages")

    @F.pandas_udf("string")
    def left(bytes_: pd.Series, spans_: pd.Series, passages_: pd.Series) -> pd.Series:
        ends = lambda s: [np.asarray([x[k] for x in s], np.int64) for k in ("first", "last")]
        out = []
        for x, s, p in zip(bytes_, spans_, passages_, strict=True):
            both = zip(ends(s), word_spans(x, *ends(p)), strict=True)
            out.append(cut(x, *map(np.concatenate, both))[0].decode("utf-8", "ignore"))
        return pd.Series(out, dtype=object)

    none = F.array().cast(SPANS)
    joined = joined.withColumn("shorter", F.when(F.col("spans").isNotNull() | F.col("passages").isNotNull(), left("bytes", F.coalesce("spans", none), F.coalesce("passages", none))))
    return joined.select(*with_text(docs.columns, F.coalesce("shorter", "doc.text")))
