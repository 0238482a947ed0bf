"""Alignments against gold pairs. Empty denominators give null, not an error."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def prf(tp: Column, fp: Column, fn: Column) -> list[Column]:
    p, r = F.try_divide(tp, tp + fp), F.try_divide(tp, tp + fn)
    return [p.alias("precision"), r.alias("recall"), F.try_divide(2 * p * r, p + r).alias("f1")]


def one_partner(assign: DataFrame) -> DataFrame:
    order = Window.partitionBy("e1").orderBy(F.desc("score"), "e2")
    return assign.withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")


def openea(assign: DataFrame, gold: DataFrame, prefix: str = "http://dbpedia.org/resource/") -> DataFrame:
    """One row: tp, fp, fn, precision, recall, f1 of one partner per e1 under ``prefix``."""
    pred = one_partner(assign.where(F.col("e1").startswith(prefix))).select("e1", "e2", F.lit(1).alias("in_pred"))
    both = pred.join(gold.select("e1", "e2").distinct().withColumn("in_gold", F.lit(1)), ["e1", "e2"], "full")
    hit = lambda p, g: F.coalesce(F.sum(F.when(F.col("in_pred").isNotNull() == F.lit(p), F.when(F.col("in_gold").isNotNull() == F.lit(g), 1))), F.lit(0)).cast("long")
    sums = both.agg(hit(True, True).alias("tp"), hit(True, False).alias("fp"), hit(False, True).alias("fn"))
    return sums.select("tp", "fp", "fn", *prf(F.col("tp"), F.col("fp"), F.col("fn")))


def hits_and_mrr(gold: DataFrame, same_as: DataFrame, k: int = 10) -> DataFrame:
    """One row: Hit@1, Hit@k and mean reciprocal rank over the gold pairs; ranks up to k + 1 count for the last."""
    order = Window.partitionBy("e1").orderBy(F.desc("score"), "e2")
    same_as = same_as.join(gold.select("e1").distinct(), "e1", "left_semi")  # no other node's ranks are asked for
    ranked = same_as.withColumn("r", F.row_number().over(order)).withColumn("top", F.rank().over(Window.partitionBy("e1").orderBy(F.desc("score"))) == 1)
    rows = gold.join(ranked.where(F.col("r") <= k + 1), ["e1", "e2"], "left")
    tied = F.coalesce(F.col("top"), F.lit(False))
    mean = lambda c: F.try_divide(F.sum(F.coalesce(c, F.lit(0.0))), F.count("*"))
    return rows.agg(
        mean(F.when(tied, 1.0)).alias("hit1"),
        mean(F.when(tied | (F.col("r") <= k), 1.0)).alias("hit10"),
        mean(F.lit(1.0) / F.col("r")).alias("mrr"),
    )


def confidence_interval(p: Column, n: Column, confidence: float = 0.95) -> tuple[Column, Column]:
    """Normal approximation, cut to [0, 1]; null without observations."""
    z = NormalDist().inv_cdf(1 - (1 - confidence) / 2)
    half = z * F.sqrt(F.try_divide(p * (1 - p), n))
    return F.greatest(F.lit(0.0), p - half), F.least(F.lit(1.0), p + half)


def best_properties(same: DataFrame, similar: DataFrame, prefix1: str, prefix2: str, threshold: float = 0.1) -> DataFrame:
    """(e1, e2, score): the best equal property per e1 above the threshold, else similar pairs of which neither side is matched yet."""
    fits = (F.col("score") > threshold) & F.col("e1").startswith(prefix1) & F.col("e2").startswith(prefix2)
    best = lambda d: one_partner(d.where(fits))
    first = best(same)
    rest = similar.join(first.select("e1"), "e1", "left_anti").join(first.select("e2"), "e2", "left_anti")
    return first.unionByName(best(rest))


def one_to_one(scores: DataFrame, local1: Column, local2: Column, last_wins: bool = False) -> DataFrame:
    """Each e1's best e2, equal local names first among ties, then each e2 with its best e1.

    ``last_wins`` keeps the greatest e1 of an e2 instead of the best scored one.
    """
    order = Window.partitionBy("e1").orderBy(F.desc("score"), F.when(local1 == local2, 0).otherwise(1), "e2")
    best = scores.withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")
    back = Window.partitionBy("e2").orderBy(*([F.desc("e1")] if last_wins else [F.desc("score"), "e1"]))
    return best.withColumn("r", F.row_number().over(back)).where("r = 1").drop("r")


def by_kind(pred: DataFrame, gold: DataFrame, thresholds: dict[str, float], parity: bool = False) -> DataFrame:
    """(kind, tp, fp, fn, precision, recall, f1) per kind and over all kinds together (kind ``overall``).

    A gold e1 whose prediction is another e2 is a false positive and a false negative. With
    ``parity`` it is only the latter, so precision is 1 wherever anything is right.
    """
    limit = F.coalesce(*[F.when(F.col("kind") == k, F.lit(v)) for k, v in thresholds.items()], F.lit(0.0))
    p = pred.where(F.col("score") > limit).select("kind", "e1", F.col("e2").alias("found"))
    rows = gold.select("kind", "e1", "e2").join(p, ["kind", "e1"], "left")
    right = F.coalesce(F.col("found") == F.col("e2"), F.lit(False))
    wrong = F.col("found").isNotNull() & ~right & F.lit(not parity)
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    sums = rows.rollup("kind").agg(n(right).alias("tp"), n(wrong).alias("fp"), n(~right).alias("fn"))
    return sums.select(F.coalesce("kind", F.lit("overall")).alias("kind"), "tp", "fp", "fn", *prf(F.col("tp"), F.col("fp"), F.col("fn")))
