"""Strings to unit vectors: a pluggable encoder, by default hashed character n-grams."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.terms import split_literal
from ..functions.text import is_readable

Encoder = Callable[[list[str]], np.ndarray]


def mean_pool(tokens: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """(n, t, d) token vectors and (n, t) mask to (n, d) means over the unmasked."""
    kept = np.where(mask[:, :, None], tokens, 0.0)
    return kept.sum(axis=1) / np.maximum(mask.sum(axis=1, keepdims=True), 1)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def ngram_encoder(dim: int = 256, sizes: tuple[int, ...] = (2, 3, 4)) -> Encoder:
    """Counts of a string's n-grams, hashed to ``dim`` signed places, as a unit vector. The same everywhere."""

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim))
        for i, t in enumerate(texts):
            t = f"^{t.lower()}$"
            for n in sizes:
                for k in range(len(t) - n + 1):
                    h = zlib.crc32(t[k : k + n].encode())
                    out[i, h % dim] += 1 if h >> 31 else -1
        return unit(out)

    return encode


def encode_texts(texts: DataFrame, encoder: Callable[[], Encoder] = ngram_encoder, batch: int = 128) -> DataFrame:
    """(key, vec) of a column ``key``; the encoder is made once per task."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = encoder()
        for x in frames:
            for lo in range(0, len(x), batch):
                keys = x["key"].iloc[lo : lo + batch].tolist()
                yield pd.DataFrame({"key": keys, "vec": list(f(keys))})

    return texts.select("key").mapInPandas(run, "key string, vec array<double>")


def embedding_corpus(triples: DataFrame) -> DataFrame:
    """The distinct readable strings of a graph with more than one character; short numbers count as strings here."""
    from .literals import literal_terms

    dates = ["xsd:date", "xsd:gYear", "xsd:gYearMonth", "xsd:datetime"]
    lit = literal_terms(triples).select(split_literal(F.col("term"), dates, least_digits=10).alias("l"))
    return lit.where((F.col("l.kind") == "string") & (F.length("l.lex") > 1) & is_readable(F.col("l.lex"))).select(F.col("l.lex").alias("key")).distinct()
