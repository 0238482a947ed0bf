"""The command line: align the two graphs of a dataset, write the result, the clean pairs and the rounds' figures.

    python -m twinegraph --dataset OpenEA/D_W_15K_V2/ --data_dir /data --save_dir /out
"""

from __future__ import annotations

import argparse
import logging
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluate
from ..operators.graph import inverse_closure
from ..sources import loaders, sinks
from .fixpoint import Aligner, Params, result_rows

log = logging.getLogger("twinegraph")


def arguments(words: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="twinegraph", description="Align two knowledge graphs without training.")
    p.add_argument("--dataset", default="OpenEA/D_W_15K_V2/", help="folder (or, for small tests, file prefix) under --data_dir; its name picks the loader")
    p.add_argument("--data_dir", default="data")
    p.add_argument("--save_dir", default="save")
    p.add_argument("--save_file", default="results.ttl")
    p.add_argument("--trainingdata", default=None, help="pairs to start from, with an optional score")
    p.add_argument("--gold", default=None, help="tab-separated gold pairs to evaluate against")
    p.add_argument("--prefix", default="", help="nodes of graph 1 that the evaluation looks at")
    p.add_argument("--alpha", type=float, default=3.0)
    p.add_argument("--init", type=float, default=0.7)
    p.add_argument("--gramN", type=int, default=100)
    p.add_argument("--epsilon", type=float, default=0.1)
    return p.parse_known_args(words)[0]


def progress_rows(spark: SparkSession, rounds: list[dict]) -> DataFrame:
    """A row per round: its number, the sum of scores, its change, pairs that rose, assigned pairs and seconds since the start."""
    kinds = "round int, total double, change double, risen long, assigned long, seconds double"
    return spark.createDataFrame([tuple(r[k.split()[0]] for k in kinds.split(", ")) for r in rounds], kinds)


def run(spark: SparkSession, a: argparse.Namespace) -> DataFrame | None:
    """Writes ``save_file`` and its ``.progress`` beside it; gives the evaluation's row where there is a gold file."""
    t1, t2 = loaders.load_dataset(spark, f"{a.data_dir}/{a.dataset}")
    seeds = loaders.load_seeds(spark, f"{a.data_dir}/{a.trainingdata}") if a.trainingdata else None
    rounds: list[dict] = []

    def watch(figures: dict) -> None:
        rounds.append(figures)
        log.info("round %(round)d: total %(total).4f, change %(change).4f, %(risen)d risen, %(assigned)d assigned, %(seconds).1f s", figures)

    params = Params(a.alpha, a.init, a.gramN, a.epsilon)
    found = Aligner(inverse_closure(t1), inverse_closure(t2), params).run(seeds, watch=watch)
    out = f"{a.save_dir}/{a.save_file}"
    sinks.write_results(result_rows(found), out)
    progress_rows(spark, rounds).coalesce(1).write.mode("overwrite").json(out + ".progress")
    if a.gold:
        return evaluate.openea(found.assign, loaders.load_openea_gold(spark, a.gold), a.prefix)
    return None


def evaluate_folder(spark: SparkSession, results: dict[str, str], gold: dict[str, str], prefix: str = "") -> DataFrame:
    """A row per name: precision, recall and F1 of a result's lines against its gold file, with the interval of each share."""
    out = None
    for name, path in results.items():
        pairs = loaders.load_results(spark, path, prefix)
        row = evaluate.openea(pairs, loaders.load_openea_gold(spark, gold[name]), prefix)
        low, high = evaluate.confidence_interval(F.col("recall"), F.col("tp") + F.col("fn"))
        row = row.select(F.lit(name).alias("name"), "*", low.alias("recall_low"), high.alias("recall_high"))
        out = row if out is None else out.unionByName(row)
    if out is None:
        raise ValueError("no results to evaluate")
    return out


def alpha_sweep(t1: DataFrame, t2: DataFrame, gold: DataFrame, alphas: list[float], prefix: str = "") -> DataFrame:
    """A row per alpha: precision, recall, F1 and seconds of a whole alignment, for a plot of the sensitivity."""
    out = None
    for alpha in alphas:
        began = time.time()
        found = Aligner(t1, t2, Params(alpha=alpha)).run()
        row = evaluate.openea(found.assign, gold, prefix).select(F.lit(alpha).alias("alpha"), "precision", "recall", "f1", F.lit(time.time() - began).alias("seconds"))
        out = row if out is None else out.unionByName(row)
    if out is None:
        raise ValueError("no alphas")
    return out


def main(words: list[str] | None = None) -> None:
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(message)s")
    spark = SparkSession.builder.appName("twinegraph").getOrCreate()
    row = run(spark, arguments(words))
    if row is not None:
        print(row.first().asDict())
