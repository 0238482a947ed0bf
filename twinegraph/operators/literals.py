"""Literals of two graphs matched by kind: strings, dates, quantities, digits and embeddings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.terms import date_prefixes, is_close, is_literal, prefix_score, split_literal
from .rounds import cut

REL = 1e-9
SAME_PRODUCT = 1e-9


def literal_terms(triples: DataFrame) -> DataFrame:
    """(term, lit): the distinct literals of a graph with their parts.

    The generator keeps later filters above the parts, so they are worked out once and not copied into every condition.
    """
    terms = triples.where(is_literal(F.col("s"))).select(F.col("s").alias("term")).distinct()
    return terms.select("term", F.explode(F.array(split_literal(F.col("term")))).alias("lit"))


def buckets(triples: DataFrame) -> DataFrame:
    """(term, bucket, key, num): what each literal is compared by; strings stand under their text and its lower case."""
    t = literal_terms(triples)
    kind = F.when(F.col("lit.kind") == "date", "date").when((F.col("lit.kind") == "number") & F.col("lit.dtype").isNotNull(), "quantity").when(F.col("lit.kind") == "number", "digit").otherwise("string")
    keys = F.when(F.col("lit.kind") == "normalised", F.array("lit.norm")).when(kind == "string", F.array_distinct(F.array("lit.lex", F.lower("lit.lex")))).otherwise(F.array("lit.lex"))
    # the keys of a number without its text: a string that failed to be a number keeps its own
    return t.select("term", kind.alias("bucket"), F.col("lit.num").alias("num"), F.explode(keys).alias("key")).select("term", "bucket", "key", "num")


def match_equal(b1: DataFrame, b2: DataFrame, *kinds: str) -> DataFrame:
    """(e1, e2, score): equal, non-empty keys of the same bucket, one of ``kinds``; a join for all of them."""
    a = b1.where(F.col("bucket").isin(*kinds) & (F.trim("key", F.lit('"')) != "")).select(F.col("term").alias("e1"), "bucket", "key")
    b = b2.where(F.col("bucket").isin(*kinds)).select(F.col("term").alias("e2"), "bucket", "key")
    return a.join(b, ["bucket", "key"]).select("e1", "e2").distinct().withColumn("score", F.lit(1.0))


def match_date_prefix(b1: DataFrame, b2: DataFrame) -> DataFrame:
    """Dates of the first graph without an equal in the second, by the longest prefix that the second has."""
    a = b1.where("bucket = 'date'").select(F.col("term").alias("e1"), "key")
    b = b2.where("bucket = 'date'").select(F.col("term").alias("e2"), "key")
    rest = a.join(b.select("key"), "key", "left_anti")
    steps = rest.select("e1", F.posexplode(date_prefixes(F.col("key"))).alias("step", "prefix"))
    hits = steps.join(b.select(F.col("key").alias("prefix")).distinct(), "prefix", "left_semi")
    longest = hits.groupBy("e1").agg(F.min_by("prefix", "step").alias("key"))
    return longest.join(b, "key").select("e1", "e2", prefix_score(F.col("key")).alias("score"))


def match_quantity(b1: DataFrame, b2: DataFrame, rel: float = REL) -> DataFrame:
    """Numbers within ``rel`` of each other, as an equi join on logarithmic bands.

    Numbers that close lie in the same band of ten times that width or in neighbouring ones, so one side stands in three bands.
    """
    band = F.when(F.col("num") == 0, F.lit(0)).otherwise(F.floor(F.log(F.abs("num")) / np.log1p(10 * rel)))
    side = lambda b, e: b.where("bucket = 'quantity'").select(F.col("term").alias(e), "num", F.signum("num").alias("sign"), band.cast("long").alias("band"))
    a = side(b1, "e1").withColumn("band", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1))).alias("a")
    b = side(b2, "e2").alias("b")
    close = is_close(F.col("a.num"), F.col("b.num"), rel)
    return a.join(b, ["sign", "band"]).where(close).select("e1", "e2").distinct().withColumn("score", F.lit(1.0))


def match_embedding(e1: DataFrame, e2: DataFrame, threshold: float, block: int = 4096) -> DataFrame:
    """(key1, key2, score): each key's nearest of the other side by inner product, where it reaches ``threshold``.

    Different texts may have one vector, so of products that are equal to nine places a key's own one wins; else the
    greatest, then the least key. (key, vec) on both sides, unit vectors. No product is greater than that of the two lengths, so a key
    whose own product reaches the greatest one possible needs no search (``_own_nearest``). The others go block against block: rows are dealt to
    numbered blocks, each pair of blocks is one matrix product in one task, and only the best of a block
    per key goes on to the final maximum.
    """
    own = cut(_own_nearest(e1, e2))
    near = _block_nearest(e1.join(own.select(F.col("key1").alias("key")), "key", "left_anti"), e2, block)
    return own.unionByName(near).where(F.col("score") >= threshold)


def _own_nearest(e1: DataFrame, e2: DataFrame) -> DataFrame:
    """(key1, key2, score): the keys of both sides whose own product no other can pass."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, p: s + p)
    longest = e2.select(F.max(F.sqrt(dot(F.col("vec"), F.col("vec")))).alias("x")).first()["x"]
    if longest is None:
        return e1.select(F.col("key").alias("key1"), F.col("key").alias("key2"), F.lit(0.0).alias("score")).limit(0)
    both = e1.select("key", "vec").join(e2.select("key", F.col("vec").alias("vec2")), "key")
    both = both.select("key", dot(F.col("vec"), F.col("vec2")).alias("score"), (F.sqrt(dot(F.col("vec"), F.col("vec"))) * longest).alias("most"))
    best = both.groupBy(F.col("key").alias("key1")).agg(F.max("score").alias("score"), F.max("most").alias("most"))  # a key may repeat
    return best.where((F.col("score") >= F.col("most") - SAME_PRODUCT / 2) & ~F.isnan("score")).select("key1", F.col("key1").alias("key2"), "score")


def _block_nearest(e1: DataFrame, e2: DataFrame, block: int) -> DataFrame:
    """(key1, key2, score): each key's nearest, by products of all pairs."""
    e1 = cut(e1)
    n1 = e1.select(F.ceil(F.count("*") / block).alias("n")).first()["n"]
    if not n1:
        return e1.select(F.col("key").alias("key1"), F.col("key").alias("key2"), F.lit(0.0).alias("score"))
    n2 = e2.select(F.ceil(F.count("*") / block).alias("n")).first()["n"] or 1
    deal = lambda e, own, n, other, m, side: e.select("key", F.transform("vec", lambda x: x.cast("double")).alias("vec"), F.lit(side).alias("side"), F.pmod(F.xxhash64("key"), F.lit(n)).alias(own), F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias(other))
    both = deal(e1, "i", n1, "j", n2, 0).select("i", "j", "side", "key", "vec").unionByName(deal(e2, "j", n2, "i", n1, 1).select("i", "j", "side", "key", "vec"))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {0: [], 1: []}
        at = None

        def solve() -> pa.RecordBatch:
            a, b = held[0], held[1]
            k1, k2, s = [], [], []
            if a and b:
                names = sorted(range(len(b)), key=lambda x: b[x][0])  # of equals the least key
                scores = np.asarray([x[1] for x in a]) @ np.asarray([b[x][1] for x in names]).T
                top = scores.argmax(axis=1)
                place = {b[n][0]: t for t, n in enumerate(names)}
                for row, (key, _) in enumerate(a):
                    own = place.get(key)
                    if own is not None and scores[row, own] >= scores[row, top[row]] - SAME_PRODUCT:
                        top[row] = own
                k1, k2, s = [x[0] for x in a], [b[names[t]][0] for t in top], scores[np.arange(len(a)), top].tolist()
            held[0], held[1] = [], []
            return pa.RecordBatch.from_arrays([pa.array(k1, pa.string()), pa.array(k2, pa.string()), pa.array(s, pa.float64())], ["key1", "key2", "score"])

        for x in batches:
            for i, j, side, key, vec in zip(*(c.to_pylist() for c in x.columns), strict=True):
                if at != (i, j):
                    if at is not None:
                        yield solve()
                    at = (i, j)
                held[side].append((key, vec))
        yield solve()

    found = both.repartition("i", "j").sortWithinPartitions("i", "j").mapInArrow(best, "key1 string, key2 string, score double")
    by = Window.partitionBy("key1")
    own = (F.col("key1") == F.col("key2")) & (F.col("score") >= F.max("score").over(by) - SAME_PRODUCT)
    order = by.orderBy(F.desc("own"), F.desc("score"), "key2")
    return found.withColumn("own", own).withColumn("r", F.row_number().over(order)).where("r = 1").select("key1", "key2", "score")


def map_literals(triples1: DataFrame, triples2: DataFrame, seeds: DataFrame | None = None, embeddings: tuple[DataFrame, DataFrame] | None = None, threshold: float = 0.5) -> DataFrame:
    """(e1, e2, score) of all literals. Exact matches beat embeddings, seeds beat both."""
    b1, b2 = cut(buckets(triples1)), cut(buckets(triples2))  # each is read several times
    out = match_equal(b1, b2, "date", "digit", "string").unionByName(match_date_prefix(b1, b2)).unionByName(match_quantity(b1, b2))
    if embeddings is not None:
        strings1 = b1.where("bucket = 'string'").select(F.col("term").alias("e1"), "key")
        strings2 = b2.where("bucket = 'string'").select(F.col("term").alias("e2"), F.col("key").alias("key2"))
        loose = strings1.join(strings2.select(F.col("key2").alias("key")), "key", "left_anti")
        near = match_embedding(embeddings[0].join(loose.select("key").distinct(), "key", "left_semi"), embeddings[1], threshold)
        found = loose.join(near.withColumnRenamed("key1", "key"), "key").join(strings2, "key2").select("e1", "e2", "score")
        settled = out.where(F.col("score") > 0.995).select("e1").distinct()
        out = out.unionByName(found.join(settled, "e1", "left_anti")).groupBy("e1", "e2").agg(F.max("score").alias("score"))
    if seeds is not None:
        out = out.join(seeds.select("e1").distinct(), "e1", "left_anti").unionByName(seeds.select("e1", "e2", "score"))
    return out
