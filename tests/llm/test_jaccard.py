"""Operator 7 against the similarities of all pairs."""

import random

import numpy as np
import pytest

from twinegraph.llm import jaccard


def real(text, words=5):
    w = (text or "").split()
    k = min(words, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefé") for _ in range(r.randint(2, 6)))
    out = []
    for g in range(14):
        base = [word() for _ in range(r.randint(60, 150))]
        for _ in range(r.choice([1, 1, 2, 5, 25])):
            w = list(base)
            for _ in range(r.randint(0, 4)):
                w[r.randrange(len(w))] = word()
            out.append(" ".join(w))
        out.append("\n".join(base[:50]) + " tail")
    return [*out, out[0], out[0] + "  ", "", " \n", None, "one two", "one  two", "one", "three " * 40]


@pytest.mark.parametrize("block", [2048, 7])
def test_links_and_groups(spark, block):
    texts = corpus(block)
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(0, texts[0], 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, class int")
    got = jaccard.join_rows(docs, block=block).collect()
    sets = [real(t) for _, t, _ in rows]
    n = len(rows)
    link = np.array([[i != j and bool(sets[i]) and bool(sets[j]) and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) for j in range(n)] for i in range(n)])
    want = sorted((rows[i][0], int(link[i].sum())) for i in range(n))
    assert sorted((g["doc_id"], g["n_links"] or 0) for g in got) == want
    root = list(range(n))
    for _ in range(n):
        new = [min([root[i], *(root[j] for j in np.flatnonzero(link[i]))]) for i in range(n)]
        if new == root:
            break
        root = new
    by = {}
    for g in got:
        by.setdefault(g["group"] if g["group"] is not None else ("none", g["doc_id"]), set()).add(g["doc_id"])
    expected = {}
    for i in range(n):
        expected.setdefault(root[i], set()).add(rows[i][0])
    assert sorted(map(sorted, by.values())) == sorted(map(sorted, expected.values()))
    left = jaccard.one_of_each(docs).collect()
    assert sorted({r["doc_id"] for r in left}) == sorted(min(v) for v in expected.values())


def test_pruning_table_keeps_the_threshold():
    least = jaccard.least_matches(0.8, 1e-6)
    assert all(0 < m < 0.8 * 16 * (k + 1) for k, m in enumerate(least))


def test_intersections_agree():
    r = np.random.default_rng(3)
    sets = [np.unique(r.integers(0, 60, 40)).astype(np.uint64) for _ in range(12)]
    i, j = np.triu_indices(12, 1)
    want = [np.intersect1d(sets[a], sets[b]).size for a, b in zip(i, j)]
    assert (jaccard._common_counts(sets, np.tile(i, 3), np.tile(j, 3)) == np.tile(want, 3)).all()


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, n_chars long")
    assert jaccard.one_of_each(docs).collect() == []
