"""Operator 3: quality classifier, a byte-level convolutional network in numpy.

A text's UTF-8 bytes are embedded, with one more channel that tells whether the last
four bytes also stand ``NEAR[0]`` to ``NEAR[1]`` bytes earlier, cut into overlapping chunks of ``WIDTH``
bytes every ``STRIDE`` bytes over the whole document (the end is padded), and
each chunk meets ``FILTERS`` learned filters. Each filter's response is pooled twice
over all chunks of the document, by its greatest and by its mean value, and a small
dense layer turns the pooled values and the text's length into one probability.
Long texts are worked through in blocks, so memory does not grow with the text, and the
pools are exact over all blocks.

Training: labelled rows outside the held-out fold, at most ``MOST_ROWS`` of
them (those with the least hash of their id) and ``MOST_BYTES`` of text together,
reach the driver; that is the documented bound of the sample. Rows of the rarer class
weigh more, so that both classes weigh the same. Gradients are written out by hand, Adam does the steps and
all draws are seeded. The weights, some 15 KB, go to the workers with the closure.

The score depends on the bytes only; labels, lang, source and doc_id are not inputs.

Defined results: a null or empty text is one chunk of padding and gets its score;
an empty label table (or one class only) gives the score of the share of good rows, 0.5 if
there are none; rows that repeat get the same score each; an empty table gives no rows;
other columns are not read by ``score`` and are kept by ``keep_good``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

WIDTH, STRIDE = 16, 8
EMBED, FILTERS, HIDDEN = 6, 32, 16
DEPTH = EMBED + 1
NEAR = (2, 24)
PAD = 256
MOST_ROWS = 6000
MOST_BYTES = 24 << 20
BLOCK = 1 << 16
EPOCHS, BATCH, RATE = 6, 32, 0.004
#: The fold that training never sees.
FOLDS, HELD_OUT = 3, 1


class ByteConv:
    """Parameters: E bytes' embedding, W and b filters, V and c dense layer, u and d output."""

    def __init__(self, seed: int = 11):
        r = np.random.default_rng(seed)
        f = lambda *s, scale: (r.standard_normal(s) * scale).astype(np.float32)
        self.p = {
            "E": f(257, EMBED, scale=0.5),
            "W": f(WIDTH * DEPTH, FILTERS, scale=1.4 / np.sqrt(WIDTH * DEPTH)),
            "b": np.zeros(FILTERS, np.float32),
            "V": f(2 * FILTERS + 1, HIDDEN, scale=1.4 / np.sqrt(2 * FILTERS)),
            "c": np.zeros(HIDDEN, np.float32),
            "u": f(HIDDEN, scale=0.3),
            "d": np.zeros((), np.float32),
        }
        self.p["E"][PAD] = 0

    @staticmethod
    def padded(text: bytes) -> np.ndarray:
        """Byte numbers, padded so that the chunks cover them all."""
        n = max(1, -(-max(0, len(text) - WIDTH) // STRIDE) + 1)
        x = np.full((n - 1) * STRIDE + WIDTH, PAD, np.int16)
        x[: len(text)] = np.frombuffer(text, np.uint8)
        return x

    @staticmethod
    def recurs(x: np.ndarray) -> np.ndarray:
        """Whether the four bytes that end at each place also end a little earlier."""
        out = np.zeros(x.size, bool)
        for lag in range(NEAR[0], min(NEAR[1], x.size - 4) + 1):
            same = x[lag:] == x[:-lag]
            out[lag + 3 :] |= same[3:] & same[2:-1] & same[1:-2] & same[:-3]
        return out & (x != PAD)

    def responses(self, x: np.ndarray, again: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Chunks (n, WIDTH * DEPTH) and filter responses (n, FILTERS) of padded byte numbers."""
        e = np.empty((x.size, DEPTH), np.float32)
        e[:, :EMBED] = self.p["E"][x]
        e[:, EMBED] = again
        n = (x.size - WIDTH) // STRIDE + 1
        view = np.lib.stride_tricks.as_strided(e, (n, WIDTH * DEPTH), (STRIDE * DEPTH * e.itemsize, e.itemsize))
        chunks = np.ascontiguousarray(view)
        return chunks, np.maximum(chunks @ self.p["W"] + self.p["b"], 0)

    def pooled(self, text: bytes) -> np.ndarray:
        x = self.padded(text)
        n = (x.size - WIDTH) // STRIDE + 1
        again = self.recurs(x)
        top, total = np.zeros(FILTERS, np.float32), np.zeros(FILTERS, np.float64)
        for lo in range(0, n, BLOCK):
            k = min(BLOCK, n - lo)
            part = slice(lo * STRIDE, (lo + k - 1) * STRIDE + WIDTH)
            _, h = self.responses(x[part], again[part])
            np.maximum(top, h.max(axis=0), out=top)
            total += h.sum(axis=0, dtype=np.float64)
        return np.concatenate([top, total / n, [np.log1p(len(text)) / 10]]).astype(np.float32)

    def probability(self, pooled: np.ndarray) -> np.ndarray:
        p = self.p
        z = np.maximum(pooled @ p["V"] + p["c"], 0) @ p["u"] + p["d"]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30).astype(np.float64)))

    def gradients(self, text: bytes, label: float, weight: float) -> dict[str, np.ndarray]:
        p, x = self.p, self.padded(text)
        chunks, h = self.responses(x, self.recurs(x))
        n = h.shape[0]
        at = h.argmax(axis=0)
        q = np.concatenate([h[at, np.arange(FILTERS)], h.mean(axis=0), [np.log1p(len(text)) / 10]]).astype(np.float32)
        a = np.maximum(q @ p["V"] + p["c"], 0)
        z = float(a @ p["u"] + p["d"])
        dz = np.float32((1 / (1 + np.exp(-np.clip(z, -30, 30))) - label) * weight)
        da = dz * p["u"] * (a > 0)
        dq = p["V"] @ da
        dh = np.broadcast_to(dq[FILTERS : 2 * FILTERS] / n, h.shape).copy()
        dh[at, np.arange(FILTERS)] += dq[:FILTERS]
        dh *= h > 0
        dchunks = (dh @ p["W"].T).reshape(n, WIDTH, DEPTH)[:, :, :EMBED]
        de = np.zeros((x.size, EMBED), np.float32)
        for k in range(WIDTH // STRIDE):
            de[k * STRIDE : k * STRIDE + n * STRIDE] += dchunks[:, k * STRIDE : (k + 1) * STRIDE].reshape(n * STRIDE, EMBED)
        dE = np.stack([np.bincount(x, de[:, k], 257) for k in range(EMBED)], axis=1).astype(np.float32)
        dE[PAD] = 0
        return {"E": dE, "W": chunks.T @ dh, "b": dh.sum(axis=0), "V": np.outer(q, da), "c": da, "u": dz * a, "d": dz}

    def fit(self, texts: list[bytes], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 5) -> ByteConv:
        good = labels.mean() if labels.size else 0.5
        if not labels.size or not 0 < good < 1:  # nothing to tell apart
            for k in ("u", "E"):
                self.p[k][...] = 0
            good = (labels.sum() + 1) / (labels.size + 2)
            self.p["d"] = np.float32(np.log(good / (1 - good)))
            return self
        weights = np.where(labels > 0, 0.5 / good, 0.5 / (1 - good))
        r = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        t = 0
        steps = epochs * -(-len(texts) // BATCH)
        for _ in range(epochs):
            order = r.permutation(len(texts))
            for lo in range(0, len(texts), BATCH):
                t += 1
                batch = order[lo : lo + BATCH]
                total: dict[str, np.ndarray] = {}
                for i in batch.tolist():
                    for k, g in self.gradients(texts[i], float(labels[i]), float(weights[i]) / batch.size).items():
                        total[k] = total[k] + g if k in total else g
                rate = RATE * (1 - t / (steps + 1))
                for k, g in total.items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    s[k] = 0.99 * s[k] + 0.01 * g * g
                    self.p[k] = (self.p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.99**t)) + 1e-7)).astype(np.float32)
        return self


def fold(doc_id) -> F.Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS


def train(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS, most_bytes: int = MOST_BYTES) -> ByteConv:
    """Fit on the labelled rows outside the held-out fold, up to the two bounds."""
    # ids are chosen first, from the narrow label table alone
    chosen = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("quality in (0, 1) and doc_id is not null")
    chosen = chosen.where(fold(F.col("doc_id")) != HELD_OUT).groupBy("doc_id").agg(F.max("quality").alias("quality"), F.min("quality").alias("least")).where("quality = least")
    # Half of the bound for each class: the rarer one is then not drowned.
    share = most_rows // 2
    picked = None
    for q in (0, 1):
        part = chosen.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(share).select("doc_id", "quality")
        picked = part if picked is None else picked.unionByName(part)
    sizes = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("bytes"))
    rows = sizes.join(F.broadcast(picked), "doc_id").where(F.octet_length("bytes") <= most_bytes // 64).select("doc_id", "quality", "bytes")
    texts: list[bytes] = []
    good: list[int] = []
    left = most_bytes
    for r in sorted(rows.collect(), key=lambda r: (hash(r["doc_id"] * 2654435761 % 4294967291), r["bytes"])):
        if len(r["bytes"]) <= left and len(texts) < most_rows:
            texts.append(bytes(r["bytes"]))
            good.append(r["quality"])
            left -= len(r["bytes"])
    return ByteConv().fit(texts, np.asarray(good, np.float64))


SCORES = "doc_id long, held_out boolean, score double, predicted int"


def score(docs: DataFrame, model: ByteConv) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q = np.asarray([model.pooled(t.as_buffer().to_pybytes()) for t in b.column(2)], np.float32).reshape(-1, 2 * FILTERS + 1)
            s = model.probability(q)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold(F.col("doc_id")) == HELD_OUT).alias("held_out"), text.alias("bytes")).mapInArrow(run, SCORES)


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows that the classifier accepts, with all their columns; it is fitted on ``docs`` and ``labels``."""
    model = train(docs, labels)

    @F.pandas_udf("double")
    def scored(text: pd.Series) -> pd.Series:
        q = np.asarray([model.pooled(t) for t in text], np.float32).reshape(-1, 2 * FILTERS + 1)
        return pd.Series(model.probability(q))

    packed = docs.select(F.struct("*").alias("row"))
    text = F.coalesce(F.col("row.text").cast("string"), F.lit("")).cast("binary")
    return packed.where(scored(text) >= least).select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def op3_quality_score(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
