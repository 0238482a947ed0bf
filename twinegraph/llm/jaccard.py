"""Operator 7: n-gram Jaccard join with Bayesian candidate pruning.

Texts are sets of five-word shingles (words: runs without white space, case
kept; a shorter text is one shingle). All pairs of texts whose sets have a
Jaccard similarity of at least ``threshold`` are links.

1. Rows with the same set form a class; from here on a class counts once, so copies never pair up.
2. Candidates: MinHash bands. A band bucket is only ever reduced to its least member; each
   other member gets an edge to it, so a bucket of any size costs its own length.
   The components of these edges hold every candidate pair.
3. A component is compared in blocks. Within a block pair, fresh MinHash values are compared
   a few at a time; with a uniform prior, a pair goes as soon as the posterior
   chance of reaching the threshold falls below ``tolerance``. What is left is verified
   on the whole sets. A task returns each class's number of links and a spanning
   forest of the links it saw, never the pairs.
4. The forests' components are the groups.

A pair at the threshold escapes all 32 bands of 6 values with a chance of 6e-5, and pruning with one
of ``tolerance``; both fall fast above the threshold. There is no cap on buckets, components or partners:
a component of m classes costs (m / block)^2 / 2 tasks, as its exact link counts need. Blocks are
bounded by rows and by bytes, so long near copies only make more of them; one text must fit a worker.

Defined results: a null or blank text has no shingles and links to nothing, itself included;
rows that repeat are copies of each other; a null doc_id takes part and is passed
over for ``class_id`` where the group has another; an empty table gives no rows. ``join_rows``
reads doc_id and text only; ``one_of_each`` keeps all columns.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, written
from .suffix import _letters, _power_tables, _stir, prefix_hashes, span_hash

WORDS = 5
THRESHOLD = 0.8
TOLERANCE = 1e-6
BANDS, ROWS = 32, 6
FRESH, STEP = 96, 16
BLOCK = 2048
#: Bytes of texts in a block, as an average over a component's blocks.
BLOCK_BYTES = 32 << 20

_seeds = np.random.default_rng(70771)
_mult = (_seeds.integers(1, 1 << 32, BANDS * ROWS + FRESH, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_add = _seeds.integers(0, 1 << 32, BANDS * ROWS + FRESH, dtype=np.uint64).astype(np.uint32)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def shingles(text: bytes, words: int = WORDS) -> np.ndarray:
    """The distinct 64-bit hashes of a text's shingles, sorted."""
    x = np.frombuffer(text, np.uint8)
    edge = np.diff(np.concatenate([[True], _SPACE[x], [True]]).astype(np.int8))
    first, last = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not first.size:
        return np.zeros(0, np.uint64)
    own = span_hash(prefix_hashes(x), first, last)
    k = min(words, own.size)
    up, _ = _power_tables(k + 1)
    out = np.zeros(own.size - k + 1, np.uint64)
    for i in range(k):
        out += own[i : i + out.size] * up[i + 1]
    return np.unique(_stir(out))


def minhashes(s: np.ndarray, first: int, n: int) -> np.ndarray:
    """MinHash values first..first+n of a set."""
    h = (s >> np.uint64(32)).astype(np.uint32) ^ s.astype(np.uint32)
    out = np.full(n, 0xFFFFFFFF, np.uint32)
    a, b = _mult[first : first + n, None], _add[first : first + n, None]
    for i in range(0, h.size, 512):
        v = h[None, i : i + 512] * a + b
        v ^= v >> np.uint32(15)
        v *= np.uint32(0x2C1B3C6D)
        np.minimum(out, v.min(axis=1), out=out)
    return out


@cache
def least_matches(threshold: float, tolerance: float, fresh: int = FRESH, step: int = STEP) -> tuple[int, ...]:
    """After step, 2 step, ... compared values: the fewest matches at which Pr(J >= threshold) is still ``tolerance``.

    With a uniform prior, m matches of k leave J a Beta(m+1, k-m+1), so that chance is Pr(Bin(k+1, threshold) <= m).
    """
    out = []
    for k in range(step, fresh + 1, step):
        total, m = 0.0, -1
        while total < tolerance:
            m += 1
            total += comb(k + 1, m) * threshold**m * (1 - threshold) ** (k + 1 - m)
        out.append(m)
    return tuple(out)


SETS = "doc long, n_bytes long, n long, s1 long, s2 long, bands array<long>"


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, n, s1, s2, bands = [], [], [], [], []
            for text in b.column(1):
                x = text.as_buffer().to_pybytes()
                s = shingles(x, words)
                size.append(len(x))
                n.append(s.size)
                s1.append(int(np.bitwise_xor.reduce(_stir(s + np.uint64(0x51)))) if s.size else 0)
                s2.append(int(np.add.reduce(_stir(s ^ np.uint64(0xA7A7A7A7)))) if s.size else 0)
                if s.size:
                    v = minhashes(s, 0, BANDS * ROWS).reshape(BANDS, ROWS).astype(np.uint64)
                    up, _ = _power_tables(ROWS + 2)
                    key = _stir((v * up[1 : ROWS + 1]).sum(axis=1, dtype=np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64) * _letters[7])
                    bands.append(key.view(np.int64))
                else:
                    bands.append(np.zeros(0, np.int64))
            lens = np.cumsum([0, *(x.size for x in bands)])
            flat = np.concatenate(bands) if bands else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array(np.asarray(s1, np.uint64).view(np.int64)), pa.array(np.asarray(s2, np.uint64).view(np.int64)), pa.ListArray.from_arrays(pa.array(lens, pa.int32()), pa.array(flat))],
                ["doc", "n_bytes", "n", "s1", "s2", "bands"],
            )

    return run


class Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def tie(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)
        return i != j


def _common_counts(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets i[k] and j[k]; many pairs over few sets go through products of 0/1 matrices."""
    if i.size <= 8 * len(sets):
        return np.asarray([np.intersect1d(sets[a], sets[b], assume_unique=True).size for a, b in zip(i.tolist(), j.tolist(), strict=True)], np.int64)
    used = np.unique(np.concatenate([i, j]))
    row = np.zeros(len(sets), np.int64)
    row[used] = np.arange(used.size)
    own = np.repeat(np.arange(used.size), [sets[u].size for u in used])
    values, at, times = np.unique(np.concatenate([sets[u] for u in used]), return_inverse=True, return_counts=True)
    shared = times > 1
    column = np.cumsum(shared) - 1
    keep = shared[at]
    own, at = own[keep], column[at[keep]]
    order = np.argsort(at, kind="stable")
    own, at = own[order], at[order]
    out = np.zeros((used.size, used.size), np.float32)
    width = 4096
    for lo in range(0, int(shared.sum()), width):
        a, z = np.searchsorted(at, [lo, lo + width])
        m = np.zeros((used.size, width), np.float32)
        m[own[a:z], at[a:z] - lo] = 1
        out += m @ m.T
    return out[row[i], row[j]].astype(np.int64)


def block_links(texts: list[bytes], left: int, threshold: float, tolerance: float, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The linked pairs (i, j) of texts; with ``left`` > 0 only those between the first ``left`` and the rest."""
    sets = [shingles(t, words) for t in texts]
    sizes = np.asarray([s.size for s in sets])
    values = np.asarray([minhashes(s, BANDS * ROWS, FRESH) for s in sets])
    least = least_matches(threshold, tolerance)
    pi, pj = [], []
    for i in range(left or len(texts)):
        j = np.arange(left or i + 1, len(texts))
        j = j[np.minimum(sizes[j], sizes[i]) >= threshold * np.maximum(sizes[j], sizes[i])]  # sizes alone bound the similarity
        m = np.zeros(j.size, np.int64)
        for step, need in enumerate(least):
            part = slice(step * STEP, (step + 1) * STEP)
            m += (values[j, part] == values[i, part]).sum(axis=1)
            on = m >= need
            j, m = j[on], m[on]
            if not j.size:
                break
        pi.append(np.full(j.size, i))
        pj.append(j)
    i, j = np.concatenate(pi), np.concatenate(pj)
    if i.size:
        both = _common_counts(sets, i, j)
        on = both >= threshold * (sizes[i] + sizes[j] - both) - 1e-9
        i, j = i[on], j[on]
    return i, j


LINKS = "class long, other long, docs long, texts long"


def _link_rows(threshold: float, tolerance: float, words: int):
    def solve(rows: list[tuple]) -> tuple[list[int], list[int | None], list[int], list[int]]:
        rows.sort(key=lambda r: r[0])  # the left block first
        left = sum(r[0] == rows[0][0] for r in rows) % len(rows)
        i, j = block_links([r[3] for r in rows], left, threshold, tolerance, words)
        copies = np.asarray([r[2] for r in rows])
        docs, texts = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        for a, b in ((i, j), (j, i)):
            np.add.at(docs, a, copies[b])
            np.add.at(texts, a, 1)
        forest, out = Forest(len(rows)), ([], [], [], [])
        for a, b in zip(i.tolist(), j.tolist(), strict=True):
            if forest.tie(a, b):
                for o, x in zip(out, (rows[a][1], rows[b][1], 0, 0), strict=True):
                    o.append(x)
        for k in np.flatnonzero(texts).tolist():
            for o, x in zip(out, (rows[k][1], None, int(docs[k]), int(texts[k])), strict=True):
                o.append(x)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        part = None
        out: tuple = ([], [], [], [])

        def flush() -> pa.RecordBatch:
            b = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["class", "other", "docs", "texts"])
            for c in out:
                c.clear()
            return b

        for b in batches:
            g, bi, bj, side, c, copies, text = (b.column(k).to_pylist() for k in range(7))
            for key, *row in zip(zip(g, bi, bj, strict=True), side, c, copies, text, strict=True):
                if key != part and held:
                    for o, x in zip(out, solve(held), strict=True):
                        o += x
                    held = []
                part = key
                held.append(tuple(row))
            if len(out[0]) > 10_000:
                yield flush()
        if held:
            for o, x in zip(out, solve(held), strict=True):
                o += x
        yield flush()

    return run


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (a, b); root: the least node of its component.

    Each round hooks every node to its least lower neighbour, follows these hooks to their ends, and puts the
    ends in the place of the nodes: edges inside one tree go, repeated ones become one, so what is left shrinks with every round
    and a hot group is a single node after the first. Every round is written, so lost executors cost one round.
    """
    way = lambda a, b: (F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
    edges = written(edges.where("a <> b").select(*way("a", "b")).distinct(), "edges")
    nodes = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).distinct()
    labels = nodes.withColumn("root", F.col("node"))
    while True:
        hooks = written(edges.groupBy("a").agg(F.min("b").alias("root")), "hooks")
        while True:
            upper = hooks.select(F.col("a").alias("root"), F.col("root").alias("upper"))
            hooks = written(hooks.join(upper, "root", "left").select("a", F.coalesce("upper", "root").alias("root"), F.col("upper").isNotNull().alias("moved")), "hooks")
            if hooks.where("moved").limit(1).count() == 0:
                break
            hooks = hooks.drop("moved")
        ends = hooks.select(F.col("a").alias("end"), F.col("root").alias("over"))
        labels = written(labels.join(ends, labels["root"] == ends["end"], "left").select("node", F.coalesce("over", "root").alias("root")), "labels")
        one = edges.join(ends, edges["a"] == ends["end"]).select(F.col("over").alias("a"), "b")
        both = one.join(ends, one["b"] == ends["end"], "left").select("a", F.coalesce("over", "b").alias("b"))
        edges = written(both.where("a <> b").select(*way("a", "b")).distinct(), "edges")
        if edges.limit(1).count() == 0:
            return labels


def join_rows(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, words: int = WORDS, block: int = BLOCK) -> DataFrame:
    """doc (hash of doc_id and text), doc_id, class, group, n_docs (of the class), links to documents and to texts."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", text).alias("doc"), text.cast("binary").alias("bytes"))
    sets = rows.select("doc", "bytes").mapInArrow(_sets(words), SETS).withColumn("class", F.when(F.col("n") > 0, F.xxhash64("n", "s1", "s2")))
    sets = written(sets.select("doc", "class", "n_bytes", "bands"), "sets")
    classes = written(sets.where("class is not null").groupBy("class").agg(F.count("*").alias("n_docs"), F.min("doc").alias("one"), F.max("n_bytes").alias("n_bytes"), F.first("bands").alias("bands")), "classes")
    placed = classes.select("class", F.explode("bands").alias("band"))
    roots = placed.groupBy("band").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low < high")
    # A class has one low member per band at most. It keeps its edge to the least of them; the others
    # get one to it instead, which in a group of many near copies is the same few edges for all.
    hooks = placed.join(roots, "band").where("class > low").groupBy("class").agg(F.min("low").alias("to"), F.collect_set("low").alias("lows"))
    ends = F.explode(F.concat(F.array("class"), F.array_remove("lows", F.col("to"))))
    edges = hooks.select(ends.alias("a"), F.col("to").alias("b")).distinct()
    parts = components(edges).withColumnRenamed("node", "class")
    parts = parts.join(classes.select("class", "n_docs", "n_bytes", "one"), "class")
    blocks = F.ceil(F.greatest(F.count("*") / block, F.sum("n_bytes") / BLOCK_BYTES)).cast("int")
    sized = parts.join(parts.groupBy("root").agg(blocks.alias("blocks")), "root")
    sized = sized.withColumn("own", F.when(F.col("blocks") > 1, F.pmod(F.xxhash64("class"), F.col("blocks"))).otherwise(0).cast("int"))
    wanted = written(sized.select("root", "class", "n_docs", F.col("one").alias("doc"), "blocks", "own"), "wanted")
    # One row stands for its class; a row that repeats it, id and text, is passed over again.
    # ``wanted`` grows with the input, so it is never broadcast: the same exchange at every size.
    found = rows.select("doc", "bytes").join(wanted.hint("merge"), "doc").dropDuplicates(["class"])
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    spread = found.withColumn("with", other).select(
        "root", F.least("own", "with").alias("bi"), F.greatest("own", "with").alias("bj"), F.col("own").alias("side"), "class", "n_docs", "bytes")
    spread = spread.repartition("root", "bi", "bj").sortWithinPartitions("root", "bi", "bj")
    links = written(spread.mapInArrow(_link_rows(threshold, tolerance, words), LINKS), "links")
    groups = components(links.where("other is not null").select(F.col("class").alias("a"), F.col("other").alias("b"))).select(F.col("node").alias("class"), F.col("root").alias("group"))
    counts = links.where("other is null").groupBy("class").agg(F.sum("docs").alias("docs"), F.sum("texts").alias("texts"))
    known = classes.select("class", "n_docs").join(groups, "class", "left").join(counts, "class", "left")
    known = known.select("class", "n_docs", F.coalesce("group", "class").alias("group"), (F.coalesce("docs", F.lit(0)) + F.col("n_docs") - 1).alias("n_links"), F.coalesce("texts", F.lit(0)).alias("n_text_links"))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", text).alias("doc"))
    same = sets.select("doc", "class").distinct()
    return own.join(same, "doc").join(known, "class", "left")


def op7_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """doc_id, class_id (least doc_id of the linked group), copy_id (least doc_id with the same shingles), n_links (other documents linked), n_text_links (other sets linked)."""
    rows = join_rows(table(spark, sf_dir, "documents"))
    least = rows.where("class is not null").groupBy("class", "group").agg(F.min("doc_id").alias("copy_id"))
    firsts = least.groupBy("group").agg(F.min("copy_id").alias("class_id"))
    ids = least.join(firsts, "group").select("class", "class_id", "copy_id")
    return rows.join(ids, "class", "left").select(
        "doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("copy_id", "doc_id").alias("copy_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("n_text_links", F.lit(0)).cast("long").alias("n_text_links"))


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows with one document of each linked group left: the one with the least id. Rows without shingles stay; of rows that repeat id and text one stays."""
    rows = join_rows(docs, threshold).where("group is not null")
    first = rows.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "doc")).alias("least"))
    drop = rows.join(first, "group").where(F.col("doc") != F.col("least.doc")).select("doc").distinct()
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    packed = docs.select(F.xxhash64("doc_id", text).alias("doc"), F.struct("*").alias("row")).join(drop, "doc", "left_anti").dropDuplicates(["doc"])
    return packed.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
