"""Operator 1: nearest neighbours by inner product, a vantage-point tree per shard.

Inner products become distances by one more coordinate: with M at least the
length of every vector of a shard, x' = (x, sqrt(M^2 - |x|^2)) and q' = (q, 0) have
|x' - q'|^2 = M^2 + |q|^2 - 2 q.x, so the largest product is the least distance
and the triangle inequality holds. Distances only decide what is skipped; what is kept and
ranked are inner products of the original vectors in double precision. Vectors are dealt to bands of
lengths (powers of two) before anything else, so M is of the order of its own vectors, however long others are.

Build: equal vectors form one entry that holds all their ids in order (a query
never needs more than its first k + 1, so only those are kept). A band's entries go to the nearest of a few
pivots drawn from a bounded sample (``SAMPLE`` rows); a pivot's entries are split further by hash
into shards of about ``SHARD`` entries. Every row is indexed. Each shard is a tree of
vantage points: an entry, the median distance to it, the nearer half, the farther half; leaves hold up to ``LEAF`` entries.

Search: a first pass sends each query to the shard of the pivot with the largest product and
learns the (k + 1)-th best product there. A second pass sends it to every other shard that its
pivot distance does not rule out. In a tree, a half is skipped when
``factor`` * (distance to the vantage point past the median) exceeds the distance that the (k + 1)-th product so far stands for;
the same factor scales the bound of whole shards. Factor 1 restores exact search, greater factors skip more.
Queries go to the leaf on their own side first; then all queries that reach a node are worked on together, each node once.
All entries that tie with the last place, within rounding, are kept until the exact products and then the least ids rank them.

Vectors that are null, empty, zero or hold null or non-finite components take
no part; nor do vectors of another length than the most common one. Rows that
repeat an id with its vector count once; a query never finds its own id. An empty table gives no rows.
Components may be as large as 1e150.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import table, written

LEAF = 64
SHARD = 8192
SAMPLE = 4096
MOST_PIVOTS = 1000
FACTOR = 1.1
QUERY_BLOCK = 512
#: What rounding may do to a product or a distance, as a share of the lengths involved.
ROUNDING = 1e-12
ROUNDING_OF_DISTANCE = 1e-7


def apart(lengths: np.ndarray, q: np.ndarray, products: np.ndarray) -> np.ndarray:
    """Distances of queries of length q from lifted points of length ``lengths`` by their inner products."""
    return np.sqrt(np.maximum(lengths**2 + q**2 - 2 * products, 0))


class Tree:
    """A vantage-point tree over the rows of ``points``, lifted to the length of the longest, kept as arrays of nodes."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF, seed: int = 3):
        self.points = points
        norms = (points**2).sum(axis=1)
        self.longest = float(np.sqrt(norms.max())) * (1 + 1e-12) if norms.size else 0.0
        self.lift = np.sqrt(np.maximum(self.longest**2 - norms, 0))
        self.order = np.arange(points.shape[0])
        self.nodes: list[tuple] = []  # (lo, hi, vantage or -1, median, near, far)
        self.leaf, self.r = leaf, np.random.default_rng(seed)
        if points.shape[0]:
            self._build(0, points.shape[0])

    def _build(self, lo: int, hi: int) -> int:
        me = len(self.nodes)
        self.nodes.append((lo, hi, -1, 0.0, -1, -1))
        if hi - lo <= self.leaf:
            return me
        own = self.order[lo:hi]
        v = own[self.r.integers(own.size)]
        d = np.sqrt(((self.points[own] - self.points[v]) ** 2).sum(axis=1) + (self.lift[own] - self.lift[v]) ** 2)
        half = own.size // 2
        split = np.argpartition(d, half)
        self.order[lo:hi] = own[split]
        median = float(d[split[half]])
        near = self._build(lo, lo + half)
        far = self._build(lo + half, hi)
        self.nodes[me] = (lo, hi, int(v), median, near, far)
        return me

    def search(self, queries: np.ndarray, k: int, floor: np.ndarray, factor: float) -> list[tuple[np.ndarray, float]]:
        """For each query the rows whose product may be among the k largest and no less than ``floor``, all that tie included, and the k-th product of those (-inf if fewer)."""
        out: list[tuple[np.ndarray, float]] = []
        for lo in range(0, queries.shape[0], QUERY_BLOCK):
            out += self._block(queries[lo : lo + QUERY_BLOCK], k, floor[lo : lo + QUERY_BLOCK], factor)
        return out

    def _block(self, queries: np.ndarray, k: int, floor: np.ndarray, factor: float) -> list[tuple[np.ndarray, float]]:
        n = queries.shape[0]
        if not self.nodes:
            return [(np.zeros(0, np.int64), -np.inf)] * n
        length = np.sqrt((queries**2).sum(axis=1))
        blur = ROUNDING * length * self.longest
        best = np.full((n, k), -np.inf)
        least = floor.astype(np.float64)
        kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def leaf(lo: int, hi: int, who: np.ndarray) -> None:
            own = self.order[lo:hi]
            products = queries[who] @ self.points[own].T
            q, x = np.nonzero(products >= (least[who] - blur[who])[:, None])
            if not q.size:
                return
            kept.append((who[q], own[x], products[q, x]))
            hit = np.unique(q)  # the others' best stay as they are
            both = np.concatenate([best[who[hit]], products[hit]], axis=1)
            best[who[hit]] = -np.partition(-both, k - 1, axis=1)[:, :k]
            least[who[hit]] = np.maximum(least[who[hit]], best[who[hit]].min(axis=1))

        def sides(node: int, who: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            _, _, v, median, _, _ = self.nodes[node]
            d = apart(self.longest, length[who], queries[who] @ self.points[v])
            return d, d < median

        home = np.empty(n, np.int64)  # the leaf on a query's own side all the way down

        def settle(node: int, who: np.ndarray) -> None:
            lo, hi, v, _, near, far = self.nodes[node]
            if v < 0:
                home[who] = node
                leaf(lo, hi, who)
                return
            _, inner = sides(node, who)
            for child, own in ((near, who[inner]), (far, who[~inner])):
                if own.size:
                    settle(child, own)

        def visit(node: int, who: np.ndarray) -> None:
            lo, hi, v, median, near, far = self.nodes[node]
            if v < 0:
                who = who[home[who] != node]
                if who.size:
                    leaf(lo, hi, who)
                return
            d, inner = sides(node, who)
            for child, mine in ((near, inner), (far, ~inner)):
                reach = apart(self.longest, length[who], least[who])
                own = who[mine | ~beyond(factor * np.abs(d - median), reach, self.longest + length[who])]
                if own.size:
                    visit(child, own)

        # Own leaves first, for bounds; then every node once, with all queries that it is not ruled out for.
        settle(0, np.arange(n))
        visit(0, np.arange(n))
        if not kept:
            return [(np.zeros(0, np.int64), -np.inf)] * n
        who, rows, products = (np.concatenate(x) for x in zip(*kept, strict=True))
        on = products >= (least - blur)[who]
        who, rows = who[on], rows[on]
        by = np.argsort(who, kind="stable")
        parts = np.split(rows[by], np.searchsorted(who[by], np.arange(1, n)))
        return [(p, float(b)) for p, b in zip(parts, best.min(axis=1), strict=True)]


def beyond(gap: np.ndarray, reach: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether a gap is over the reach by more than rounding can be."""
    return gap > reach * (1 + 1e-9) + ROUNDING_OF_DISTANCE * size


def _matrix(column) -> np.ndarray:
    """The rows of a list column of equal lengths."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def clean(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) of the rows that take part: v has finite doubles, not all zero, and the most common length."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    fine = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(
        "vec_id is not null and v is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)")
    top = fine.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return fine.where(F.size("v") == (top[0]["n"] if top else 0))


FOUND = "query_id long, vec_id long, score double, floor double"


def _search(k: int, factor: float, first: bool):
    """Rows sorted by shard and kind. A shard's entries (kind 0) make its tree; its queries (kind 1) stream through it in blocks."""

    def answer(tree: Tree, entries: list[tuple], own: np.ndarray, asked: list[tuple], out: list[tuple]) -> None:
        if not entries:
            if first:
                out.extend((a[1], None, None, None) for a in asked)
            return
        q = np.asarray([a[2] for a in asked])
        floor = np.asarray([-np.inf if a[4] is None else a[4] for a in asked])
        for a, qv, (at, last) in zip(asked, q, tree.search(q, k + 1, floor, factor), strict=True):
            scores = (own[at] * qv).sum(axis=1)
            found = sorted((-s, i) for s, e in zip(scores.tolist(), at.tolist(), strict=True) for i in entries[e][3] if i != a[1])[:k]
            reach = last if np.isfinite(last) else None
            if first and not found:
                out.append((a[1], None, None, reach))
            out.extend((a[1], i, -s, reach) for s, i in found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries: list[tuple] = []
        asked: list[tuple] = []
        shard, tree, own, out = None, None, np.zeros((0, 1)), []

        def flush() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) or [()] * 4
            b = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64(), pa.float64()), strict=True)], ["query_id", "vec_id", "score", "floor"])
            out.clear()
            return b

        for b in batches:
            c = {n: b.column(i) for i, n in enumerate(b.schema.names)}
            m = _matrix(c["v"])
            for s, kind, i, ids, floor, x in zip(*(c[n].to_pylist() for n in ("shard", "kind", "vec_id", "ids", "floor")), m, strict=True):
                if asked and (s != shard or len(asked) >= QUERY_BLOCK):
                    answer(tree, entries, own, asked, out)
                    asked = []
                    yield flush()
                if s != shard:
                    shard, tree, entries = s, None, []
                if kind == 0:
                    entries.append((kind, i, x, ids, floor))
                    continue
                if tree is None:  # a shard's entries come before its queries
                    own = np.asarray([e[2] for e in entries]).reshape(len(entries), -1)
                    tree = Tree(own)
                asked.append((kind, i, x, ids, floor))
        if asked:
            answer(tree, entries, own, asked, out)
        yield flush()

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, factor: float = FACTOR, shard: int = SHARD) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of ``vectors`` with the largest inner product with each query; both have (vec_id, embedding)."""
    rows = clean(vectors)
    # One entry per different vector, with its first k + 1 ids; the ranking keeps no more than those of each task before the exchange.
    order = Window.partitionBy("v").orderBy("vec_id")
    ids = rows.distinct().withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k + 1)
    entries = written(ids.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "entries")
    # A band holds vectors of lengths between two powers of two; there are at most some 1,000 of them.
    band = F.floor(F.log2(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))).cast("long")
    entries = entries.withColumn("band", band)
    counts = {r["band"]: r["n"] for r in entries.groupBy("band").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    share = {x: max(1, min(SAMPLE, MOST_PIVOTS * n // max(total, 1), n // shard)) for x, n in counts.items()}
    nth = F.row_number().over(Window.partitionBy("band").orderBy(F.xxhash64("v"), "v"))
    sample = entries.select("band", "v", nth.alias("nth")).where(F.col("nth") <= max([1, *share.values()])).collect()
    sample = sorted((r["band"], r["nth"], r["v"]) for r in sample if r["nth"] <= share[r["band"]])
    bands = np.asarray([x[0] for x in sample], np.int64)
    pivots = np.asarray([x[2] for x in sample], np.float64) if sample else np.zeros((0, 1))
    longest = 2.0 ** (bands + 1.0) * (1 + 1e-9)
    up = lambda x, m: np.sqrt(np.maximum(m**2 - (x**2).sum(axis=1), 0))
    lift = up(pivots, longest)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, own = _matrix(b.column(0)), b.column(2).to_numpy()
            pivot, far = np.zeros(len(b), np.int64), np.zeros(len(b))
            for one in np.unique(own):
                rows, mine = np.flatnonzero(own == one), np.flatnonzero(bands == one)
                flat = ((x[rows] ** 2).sum(axis=1)[:, None] + (pivots[mine] ** 2).sum(axis=1)[None, :] - 2 * x[rows] @ pivots[mine].T)
                d = np.sqrt(np.maximum(flat, 0) + (up(x[rows], longest[mine[0]])[:, None] - lift[mine][None, :]) ** 2)
                near = d.argmin(axis=1)
                pivot[rows], far[rows] = mine[near], d[np.arange(rows.size), near]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(pivot), pa.array(far)], ["v", "ids", "pivot", "far"])

    placed = entries.select("v", "ids", "band").mapInArrow(place, "v array<double>, ids array<long>, pivot long, far double")
    sizes = placed.groupBy("pivot").agg(F.ceil(F.count("*") / shard).alias("parts"))
    placed = written(placed.join(F.broadcast(sizes), "pivot").withColumn("part", F.pmod(F.xxhash64("v", F.lit(1)), "parts")), "placed")  # one row per pivot: MOST_PIVOTS and one per band
    # What a pivot's entries span: distances from it, nearest to farthest.
    spans = sorted(tuple(r) for r in placed.groupBy("pivot").agg(F.max("parts"), F.min("far"), F.max("far")).collect())
    at = np.asarray([x[0] for x in spans], np.int64)
    parts, low, high = (np.asarray([x[i] for x in spans], t) for i, t in ((1, np.int64), (2, np.float64), (3, np.float64)))

    asked = clean(queries).dropDuplicates(["vec_id"])

    def route(home: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not len(b) or not at.size:
                    continue
                q = _matrix(b.column(1))
                length = np.sqrt((q**2).sum(axis=1))[:, None]
                products = q @ pivots[at].T
                first = products.argmax(axis=1)
                if home:
                    who, shards = np.arange(len(b)), at[first] * 1_000_000
                else:
                    floor = b.column(2).to_numpy(zero_copy_only=False).astype(np.float64)
                    floor = np.where(np.isnan(floor), -np.inf, floor)[:, None]
                    size = longest[at][None, :]
                    d = apart(size, length, products)
                    gap = np.maximum(0, np.maximum(low - d, d - high))
                    # no product is larger than the two lengths give
                    open_ = ~beyond(factor * gap, apart(size, length, floor), size + length) & (size * length * (1 + 1e-9) >= floor)
                    who, pivot = np.nonzero(open_)
                    part = np.arange(int(parts[pivot].sum())) - np.repeat(np.cumsum(parts[pivot]) - parts[pivot], parts[pivot])
                    who, pivot = np.repeat(who, parts[pivot]), np.repeat(pivot, parts[pivot])
                    other = (pivot != first[who]) | (part > 0)
                    who, shards = who[other], at[pivot[other]] * 1_000_000 + part[other]
                rows = pa.array(who)
                yield pa.RecordBatch.from_arrays([pa.array(shards, pa.int64()), b.column(0).take(rows), b.column(1).take(rows), b.column(2).take(rows)], ["shard", "vec_id", "v", "floor"])

        return run

    side = placed.select((F.col("pivot") * 1_000_000 + F.col("part")).alias("shard"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("vec_id"), "v", "ids", F.lit(None).cast("double").alias("floor"))
    routed = "shard long, vec_id long, v array<double>, floor double"

    def pass_over(q: DataFrame, home: bool) -> DataFrame:
        q = q.mapInArrow(route(home), routed).select("shard", F.lit(1).alias("kind"), "vec_id", "v", F.lit(None).cast("array<long>").alias("ids"), "floor")
        both = side.unionByName(q).repartition("shard").sortWithinPartitions("shard", "kind", "vec_id", F.xxhash64("v"))
        return written(both.mapInArrow(_search(k, factor, home), FOUND), "found")

    first = pass_over(asked.select("vec_id", "v", F.lit(None).cast("double").alias("floor")), True)
    floors = first.groupBy("query_id").agg(F.max("floor").alias("floor")).withColumnRenamed("query_id", "vec_id")
    rest = pass_over(asked.join(floors, "vec_id", "left").select("vec_id", "v", "floor"), False)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    both = first.unionByName(rest).where("vec_id is not null").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return both.select("query_id", "rank", "vec_id", "score")


def op1_vptree_search(spark, sf_dir: str) -> DataFrame:
    """The 20 nearest of every vector whose id is divisible by 20."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0))
