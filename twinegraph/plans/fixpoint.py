"""The whole alignment: literals, bootstrap, then rounds of entity and predicate rules until the scores stand still.

Each round's state is written, so that a plan never spans two rounds and a lost executor costs one
round at most. The start's pairs, which grow with the degrees of shared nodes, are no part of that
state: the rounds need each node's best pairs only (``first``), which come from blocks of pairs with one score,
and the pairs whose scores rose since (``risen``). All pairs are made when somebody asks for them, and go through no exchange.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import rules
from ..operators.functionality import functionality, merge_least, pair_functionality
from ..operators.literals import map_literals
from ..operators.rounds import cut


@dataclass
class Params:
    alpha: float = 3.0
    init: float = 0.7
    gram_n: int = 100
    epsilon: float = 0.1
    most_rounds: int = 101
    most_pairs: int | None = None  # of a subject's facts, for the functionality of two predicates


@dataclass
class Start:
    """The start's pairs as blocks of pairs with one score, and the literals' pairs."""

    t1: DataFrame
    t2: DataFrame
    blocks: DataFrame
    known: DataFrame

    def rows(self, asked: DataFrame | None = None) -> DataFrame:
        """(e1, e2, score), a pair may repeat; of the nodes in ``asked`` (e1) only, which others' pairs aren't made for."""
        t1, known = self.t1, self.known
        if asked is not None:
            nodes = asked.select("e1").distinct()
            t1, known = t1.join(nodes.withColumnRenamed("e1", "o"), "o", "left_semi").select("s", "p", "o"), known.join(nodes, "e1", "left_semi")
        return rules.bootstrap_rows(t1, self.t2, self.blocks).unionByName(known)

    @cached_property
    def parts(self) -> rules.Parts:
        return rules.bootstrap_parts(self.t1, self.t2, self.blocks, self.known)

    def total(self) -> float:
        return self.parts.total()


@dataclass
class Alignment:
    """The state after a round. What only the next round or a reader needs is made when it is asked for."""

    aligner: Aligner
    begin: Start
    risen: DataFrame | None
    best: DataFrame
    before: Alignment | None = None
    sums: list[float] = field(default_factory=list)

    @cached_property
    def first(self) -> DataFrame:
        return cut(self.best)

    @cached_property
    def assign(self) -> DataFrame:
        return cut(rules.second_choice(self.first))

    @cached_property
    def inclusions(self) -> tuple[DataFrame, DataFrame]:
        t1, t2, a, keys = self.aligner.t1, self.aligner.t2, self.aligner.params.alpha, ["p", "q"]
        sub12, sub21 = rules.inclusion_of_closed(t1, t2, self.assign, a), rules.inclusion_of_closed(t2, t1, rules.flipped(self.assign), a)
        if self.before is not None:
            old12, old21 = self.before.inclusions
            sub12, sub21 = rules.monotone_merge(sub12, old12, keys), rules.monotone_merge(sub21, old21, keys)
            self.before = None
        return cut(sub12), cut(sub21)

    @property
    def sub12(self) -> DataFrame:
        return self.inclusions[0]

    @property
    def sub21(self) -> DataFrame:
        return self.inclusions[1]

    @cached_property
    def quasi(self) -> DataFrame:
        return cut(rules.quasi_equivalence(self.sub12, self.sub21))

    @property
    def same_as(self) -> DataFrame:
        """(e1, e2, score) of all pairs."""
        return self.begin.parts.rows(self.risen)

    def same_as_of(self, asked: DataFrame) -> DataFrame:
        """``same_as`` of the nodes in ``asked`` (e1)."""
        rows = self.begin.rows(asked)
        if self.risen is not None:
            rows = rows.unionByName(self.risen.join(asked.select("e1").distinct(), "e1", "left_semi"))
        return rules.fuzzy_or(rows, ["e1", "e2"], F.col("score"))


class Aligner:
    """Holds what does not change between rounds: both graphs and their functionalities."""

    def __init__(self, t1: DataFrame, t2: DataFrame, params: Params | None = None):
        self.params = params or Params()
        self.t1, self.t2 = cut(t1.select("s", "p", "o")), cut(t2.select("s", "p", "o"))
        self.fun = cut(merge_least(functionality(self.t1), functionality(self.t2), ["p"]))

    @cached_property
    def fun2(self) -> DataFrame:
        return cut(merge_least(*(pair_functionality(t, self.params.most_pairs) for t in (self.t1, self.t2)), ["pa", "pb"]))

    def start(self, seeds: DataFrame | None = None, embeddings: tuple[DataFrame, DataFrame] | None = None) -> Alignment:
        known = cut(map_literals(self.t1, self.t2, seeds, embeddings, self.params.init))
        blocks = cut(rules.bootstrap_blocks(self.t1, self.t2, rules.bilateral_max(known), self.fun))
        first = rules.bootstrap_first(self.t1, self.t2, blocks, known)
        return Alignment(self, Start(self.t1, self.t2, blocks, known), None, first)

    def round(self, now: Alignment) -> Alignment:
        chosen = rules.chosen_parts(self.t1, self.t2, now.assign, now.quasi, self.params.gram_n)
        new = rules.chosen_scores(chosen, self.t1, self.t2, self.fun, self.fun2, now.assign)
        fresh = cut(rules.guarded(new, now.assign))
        pair = ["e1", "e2"]
        # A pair that was not its node's best and didn't rise can't become it.
        first = rules.first_choice(rules.monotone_merge(fresh, now.first, pair))
        risen = fresh if now.risen is None else cut(rules.monotone_merge(fresh, now.risen, pair))
        return Alignment(self, now.begin, risen, first, now)

    def run(self, seeds: DataFrame | None = None, embeddings: tuple[DataFrame, DataFrame] | None = None, watch: Callable[[dict], None] | None = None) -> Alignment:
        """Rounds until the sum of all scores moves by less than epsilon. ``watch`` gets a dict of each round's figures."""
        began = time.time()
        now = self.start(seeds, embeddings)
        now.sums = [now.begin.total()]
        for i in range(self.params.most_rounds):
            after = self.round(now)
            after.sums = [*now.sums, now.sums[0] + self._gain(after)]
            now = after
            if watch is not None:
                watch({"round": i + 1, "total": now.sums[-1], "change": now.sums[-1] - now.sums[-2], "risen": now.risen.count(), "assigned": now.assign.count(), "seconds": time.time() - began})
            if abs(now.sums[-1] - now.sums[-2]) < self.params.epsilon:
                break
        return now

    @staticmethod
    def _gain(now: Alignment) -> float:
        """What the risen pairs add to the sum of the start's scores."""
        old = now.begin.parts.scores(now.risen).withColumnRenamed("score", "old")
        more = F.greatest(F.col("score") - F.coalesce("old", F.lit(0.0)), F.lit(0.0))
        return now.risen.join(old, ["e1", "e2"], "left").agg(F.sum(more)).first()[0] or 0.0


def result_rows(a: Alignment, least_predicate: float = 0.1) -> DataFrame:
    """(left, relation, right, score): predicates above the limit in both directions, then all pairs of nodes."""
    both = a.sub12.unionByName(a.sub21).groupBy("p", "q").agg(F.max("score").alias("score"))
    subs = both.where(F.col("score") > least_predicate).select(F.col("p").alias("left"), F.lit("rdfs:subPropertyOf").alias("relation"), F.col("q").alias("right"), "score")
    same = a.same_as.where("score > 0").select(F.col("e1").alias("left"), F.lit("owl:sameAs").alias("relation"), F.col("e2").alias("right"), "score")
    return subs.unionByName(same)
