"""Operator 2: token ids in binary shards, with a minimal perfect hash index over the document keys.

One file per shard, little-endian throughout::

    magic "TWIDS001" | width u32 | n_docs u64 | n_keys u64 | n_ids u64 | n_levels u32 | level sizes u64 each
    payload     n_ids ids of ``width`` bytes (2 where every id fits, else 4), documents in ascending key order
    keys        n_docs i64, in file order; has_key n_docs u8 (0: the key was null)
    offsets     n_docs + 1 u64, in ids from the start of the payload
    levels      the bit arrays of the perfect hash, packed, each padded to 64 bits
    prints      n_keys u32, the fingerprint of the key that owns the slot
    slots       n_keys u64 first document of the key, n_keys u32 how many documents share it

A lookup hashes the key once per level until a set bit is met, takes that bit's
rank as its slot, compares the fingerprint and reads the ids at the slot's
offset: constant time, one read of the payload.

Defined results: a null text has only the end id; a null key is stored first
and is reached by position, not by key; rows that repeat a key are stored
one after another and a lookup returns all of them; an empty table gives no
shard. Other columns of the input are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import new_folder, table, written
from .pieces import encoder

MAGIC = b"TWIDS001"
GAMMA = 2.0
#: A shard is closed at so many bytes of ids, so a task holds one at a time.
SHARD_BYTES = 32 << 20


def mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of integer keys, another for each seed."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Distinct integer keys to 0..n-1, without the keys themselves.

    Each level is a bit array; a key that is alone on its bit ends there, the
    others go on to the next level. The slot is the rank of the key's bit.
    """

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.bases = np.cumsum([0, *(int(x.sum()) for x in levels)])
        self.ranks = [np.cumsum(x, dtype=np.int64) - x for x in levels]

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels, left = [], np.asarray(keys, np.int64)
        while left.size:
            size = max(64, int(GAMMA * left.size))
            at = mix(left, len(levels)) % np.uint64(size)
            counts = np.bincount(at.astype(np.int64), minlength=size)
            levels.append((counts == 1).astype(np.uint8))
            left = left[counts[at.astype(np.int64)] > 1]
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """-1 for a key that meets no bit; a foreign key can also meet one, so compare its fingerprint."""
        keys = np.asarray(keys, np.int64)
        out = np.full(keys.size, -1, np.int64)
        left = np.arange(keys.size)
        for i, bits in enumerate(self.levels):
            at = (mix(keys[left], i) % np.uint64(bits.size)).astype(np.int64)
            hit = bits[at] == 1
            out[left[hit]] = self.bases[i] + self.ranks[i][at[hit]]
            left = left[~hit]
        return out


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mix(np.asarray(keys, np.int64), 0xF1) >> np.uint64(32)).astype(np.uint32)


def shard_bytes(keys: list[int | None], ids: list[bytes]) -> bytes:
    """The file of documents in ascending key order; ``ids``: each one's as unsigned 32-bit integers."""
    flat = np.frombuffer(b"".join(ids), "<u4")
    width = 2 if not flat.size or flat.max() < 65536 else 4
    offsets = np.cumsum([0, *(len(x) // 4 for x in ids)]).astype("<u8")
    has = np.asarray([k is not None for k in keys], np.uint8)
    known = np.asarray([k if k is not None else 0 for k in keys], "<i8")
    own, first, count = np.unique(known[has == 1], return_index=True, return_counts=True)
    first = first + int((has == 0).sum())  # nulls come first
    index = PerfectHash.build(own)
    slot = index.slots(own)
    prints, starts, many = np.zeros(own.size, "<u4"), np.zeros(own.size, "<u8"), np.zeros(own.size, "<u4")
    prints[slot], starts[slot], many[slot] = fingerprints(own), first, count
    bits = [np.packbits(x, bitorder="little").tobytes() for x in index.levels]
    bits = [x + b"\0" * (-len(x) % 8) for x in bits]
    head = MAGIC + struct.pack("<IQQQI", width, len(keys), own.size, flat.size, len(bits)) + b"".join(struct.pack("<Q", x.size) for x in index.levels)
    return b"".join([head, flat.astype(f"<u{width}").tobytes(), known.tobytes(), has.tobytes(), offsets.tobytes(), *bits, prints.tobytes(), starts.tobytes(), many.tobytes()])


class Shard:
    """A shard file's content, opened for keyed and sequential access."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a shard of token ids")
        self.width, self.n_docs, n_keys, n_ids, n_levels = struct.unpack_from("<IQQQI", data, 8)
        at = 8 + struct.calcsize("<IQQQI")
        sizes = struct.unpack_from(f"<{n_levels}Q", data, at)
        at += 8 * n_levels

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, n, at)
            at += out.nbytes
            return out

        self.payload = take(f"<u{self.width}", n_ids)
        self.keys, self.has_key, self.offsets = take("<i8", self.n_docs), take("u1", self.n_docs), take("<u8", self.n_docs + 1)
        levels = [np.unpackbits(take("u1", (n + 63) // 64 * 8), bitorder="little")[:n] for n in sizes]
        self.index = PerfectHash(levels)
        self.prints, self.starts, self.many = take("<u4", n_keys), take("<u8", n_keys), take("<u4", n_keys)

    def ids(self, position: int) -> np.ndarray:
        return self.payload[int(self.offsets[position]) : int(self.offsets[position + 1])].astype("<u4")

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First position and number of documents of each key; -1 and 0 for keys that are not here."""
        keys = np.asarray(keys, np.int64)
        slot = self.index.slots(keys)
        there = slot >= 0
        there[there] = self.prints[slot[there]] == fingerprints(keys[there])
        first, many = np.full(keys.size, -1, np.int64), np.zeros(keys.size, np.int64)
        first[there], many[there] = self.starts[slot[there]], self.many[slot[there]]
        return first, many

    def get(self, key: int) -> list[np.ndarray]:
        first, many = self.find(np.asarray([key]))
        return [self.ids(int(first[0]) + i) for i in range(int(many[0]))]


def put_file(uri: str, data: bytes) -> None:
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    with store.open_output_stream(path) as out:
        out.write(data)


def get_file(uri: str) -> bytes:
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    with store.open_input_file(path) as f:
        return f.read()


#: Shards that a task reads one after the other, where there are many.
SHARDS_A_TASK = 8
MANIFEST = "part int, seq int, path string, n_docs long, n_ids long, low long, high long"


def write_store(docs: DataFrame, folder: str, tokenizer: str, kind: str = "byte", end_id: int = 0, shard_bytes_at: int = SHARD_BYTES) -> DataFrame:
    """Encode (doc_id, text) and write shards under ``folder`` (a URI all executors reach).

    Returns the manifest, one row per shard with ``base``, the ids before it.
    The one shuffle is a range exchange on the key. A repeated attempt of a
    task writes files of other names; the manifest names those of the attempt
    that counted.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyspark import TaskContext

        part, seq, enc, end = TaskContext.get().partitionId(), 0, encoder(tokenizer, kind), struct.pack("<I", end_id)
        keys: list[int | None] = []
        ids: list[bytes] = []
        held = 0

        def close() -> pa.RecordBatch:
            nonlocal seq, held
            path = f"{folder}/shard-{part:06d}-{seq:06d}-{uuid.uuid4().hex[:12]}.ids"
            put_file(path, shard_bytes(keys, ids))
            own = [k for k in keys if k is not None]
            row = [part, seq, path, len(keys), held // 4, own[0] if own else None, own[-1] if own else None]
            keys.clear()
            ids.clear()
            seq, held = seq + 1, 0
            names = [x.split()[0] for x in MANIFEST.split(", ")]
            kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}
            return pa.RecordBatch.from_arrays([pa.array([v], kinds[x.split()[1]]) for v, x in zip(row, MANIFEST.split(", "), strict=True)], names)

        for b in batches:
            for key, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if held >= shard_bytes_at:  # a key with many documents goes on in the next shard
                    yield close()
                x = enc.encode(text.as_py()) + end
                keys.append(key)
                ids.append(x)
                held += len(x)
        if keys:
            yield close()

    parts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    manifest = written(parts.mapInArrow(write, MANIFEST), "manifest")
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)  # one row per shard, not per document
    return manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).cast("long"))


ENTRIES = "doc_id long, start long, n_tokens long, ids_crc32 long"


def read_entries(manifest: DataFrame) -> DataFrame:
    """Each stored document, fetched from the files by its key."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                shard = Shard(get_file(path))
                nulls = int((shard.has_key == 0).sum())
                keys = shard.keys[nulls:]
                own = np.unique(keys)
                first, many = shard.find(own)
                at = np.concatenate([np.arange(nulls), np.repeat(first, many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)])
                named = np.concatenate([np.zeros(nulls, np.int64), np.repeat(own, many)])
                offsets = shard.offsets.astype(np.int64)
                crc = [zlib.crc32(shard.ids(p).tobytes()) for p in at.tolist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(named, pa.int64(), mask=np.arange(named.size) < nulls), pa.array(base + offsets[at], pa.int64()), pa.array(offsets[at + 1] - offsets[at], pa.int64()), pa.array(crc, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    # The manifest is a few small rows, so Spark would read every shard in one task if it were left to choose.
    shards = max(1, manifest.count())
    tasks = min(shards, max(64, shards // SHARDS_A_TASK))
    return manifest.select("path", "base").repartition(tasks, "path").mapInArrow(read, ENTRIES)


def op2_token_store(spark, sf_dir: str) -> DataFrame:
    """All documents through the store: written as shards, read back by key."""
    import public_tokenizers

    return read_entries(write_store(table(spark, sf_dir, "documents"), new_folder(spark, "ids"), public_tokenizers.path("byte_bpe_50k.json"), "byte", 0))
