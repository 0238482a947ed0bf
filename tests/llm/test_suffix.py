"""Operator 9 against a brute-force count of all strings."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from twinegraph.llm import suffix


def brute(texts, length):
    """Bytes, removed bytes, runs and the digest of what is left, by counting every string."""
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(t), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~gone])).hexdigest()))
    return out


def corpus(seed, n=60):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 7)))
    prose = lambda k: " ".join(word() for _ in range(k))
    passage, licence = prose(40), prose(25)
    out = []
    for i in range(n):
        t = prose(r.randint(0, 120))
        if i % 3 == 0:
            at = r.randint(0, len(t))
            t = t[:at] + passage[r.randint(0, 20) : len(passage) - r.randint(0, 20)] + t[at:]
        if i % 4 == 0:
            t = licence + t
        if i % 7 == 0 and out:
            t = r.choice(out)
        if i % 11 == 0 and out:
            o = r.choice(out)
            t = o[: len(o) // 2] + "#" + o[len(o) // 2 :]
        out.append(t)
    return [*out, "", "a" * 300, "a" * 200, "abc" * 100, "xyz" * 20, prose(3) * 9]


def brute_passages(texts, words):
    """Bytes in passages of so many words that also start anywhere else."""
    places = [[m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", t)] for t in texts]
    window = lambda t, p, i: tuple(t[a:z] for a, z in p[i : i + words])
    n = Counter(window(t, p, i) for t, p in zip(texts, places, strict=True) for i in range(len(p) - words + 1))
    out = []
    for t, p in zip(texts, places, strict=True):
        hit = {x for i in range(len(p) - words + 1) if n[window(t, p, i)] > 1 for x in range(p[i][0], p[i + words - 1][1])}
        out.append(len(hit))
    return out


@pytest.mark.parametrize(("length", "most"), [(50, 20_000), (50, 3), (33, 8)])
def test_whole_operator(spark, length, most):
    texts = corpus(length + most)
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(0, texts[0], "x"), (None, texts[1], "x"), (901, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    keyed = suffix._keyed(docs)
    repeats = suffix._repeats(keyed, length, most, 7)
    got = keyed.select("doc", "n_bytes", "bytes", "row.doc_id").join(repeats, ["doc", "n_bytes"], "left").select("doc_id", "bytes", "spans", "passages").mapInArrow(suffix._digests, suffix.DIGESTS).collect()
    raw = [(t or "").encode() for _, t, _ in rows]
    want = [(k, *x, n) for (k, _, _), x, n in zip(rows, brute(raw, length), brute_passages(raw, 7), strict=True)]
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))
    kept = {r["doc_id"]: r["text"] for r in suffix.remove_repeats(docs.where("doc_id is not null and doc_id > 0"), length, most).collect()}
    want = dict(zip([r[0] for r in rows if r[0]], brute([(r[1] or "").encode() for r in rows if r[0]], length), strict=True))
    assert all(len((kept[k] or "").encode()) <= w[0] - w[1] for k, w in want.items())
    assert all(kept[k] == dict((r[0], r[1]) for r in rows)[k] for k, w in want.items() if not w[1])


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, n_chars long")
    assert suffix.remove_repeats(docs).collect() == []


def test_collection_order_and_files(tmp_path):
    rows = np.random.default_rng(5).integers(0, 3, (40, 12)).astype(np.uint16)
    c = suffix.CollectionOrder(np.ascontiguousarray(rows.T), str(tmp_path))
    for column in reversed(range(12)):
        before = c.order.copy()
        c.insert(column)
        ends = [tuple(rows[i, column:]) for i in c.order]
        assert ends == sorted(ends)
        for a, b, n in zip(ends, ends[1:], c.common[1:], strict=False):
            assert n == next((k for k in range(len(a)) if a[k] != b[k]), len(a))
        block = np.frombuffer(rows[before, column].tobytes(), np.uint16)
        assert (np.sort(block) == rows[c.order, column]).all()
    c.close()
    assert (tmp_path / "transform").stat().st_size == rows.nbytes
