"""The alignment rules over scored pairs.

``same_as`` (e1, e2, score) relates nodes of graph 1 to nodes of graph 2; ``assign`` is its
bilateral maximum; ``quasi`` (p, q, score) relates predicates. Minimum is AND, maximum
is OR. Ties are broken by total orders over scores at nine places, so results don't depend on
the partitioning or the order of additions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.terms import invert, is_inverse, is_literal
from .rounds import cut

PRIOR_SAME, PRIOR_OTHER = 1.0, 0.1
SETTLED = 0.95
MOST_EVIDENCE = 100
LONGEST_RULE = 20


def fuzzy_or(rows: DataFrame, keys: list[str], score: Column) -> DataFrame:
    """The greatest score per key, cut at 1, where it is above 0."""
    return rows.groupBy(*keys).agg(F.max(F.least(score, F.lit(1.0))).alias("score")).where("score > 0")


def additive(rows: DataFrame, keys: list[str], score: Column) -> DataFrame:
    """The sum of scores per key, cut at 1."""
    return rows.groupBy(*keys).agg(F.least(F.lit(1.0), F.sum(score)).alias("score"))


def monotone_merge(new: DataFrame, old: DataFrame, keys: list[str]) -> DataFrame:
    return new.unionByName(old).groupBy(*keys).agg(F.max("score").alias("score"))


def predicate_prior(p: Column, q: Column) -> Column:
    return F.when(p == q, PRIOR_SAME).otherwise(PRIOR_OTHER)


def first_choice(same_as: DataFrame) -> DataFrame:
    """The pairs that are the best of their e1. The maxima come from a grouped aggregate, which combines before the exchange."""
    best = same_as.groupBy("e1").agg(F.max("score").alias("best"))
    return same_as.join(best, "e1").where("score = best").select("e1", "e2", "score")


def second_choice(rows: DataFrame) -> DataFrame:
    """Of first choices those that are the best of their e2; a term that is its own partner keeps no other."""
    best = rows.groupBy("e2").agg(F.max("score").alias("best"))
    found = rows.join(best, "e2").where("score = best").drop("best")
    own = found.where("e1 = e2").select("e1")
    return found.join(own, "e1", "left_anti").unionByName(found.where("e1 = e2")).select("e1", "e2", "score")


def bilateral_max(same_as: DataFrame) -> DataFrame:
    """Pairs that are the best of their e1 and, among those, the best of their e2; a term that is its own partner keeps no other."""
    return second_choice(first_choice(same_as))


def best_scores(assign: DataFrame, side: str) -> DataFrame:
    return assign.groupBy(F.col(side).alias("node")).agg(F.max("score").alias("best"))


def degrees(triples: DataFrame) -> DataFrame:
    return triples.groupBy("s", "p").agg(F.count("*").alias("deg"))


def bootstrap_blocks(t1: DataFrame, t2: DataFrame, assign: DataFrame, fun: DataFrame) -> DataFrame:
    """(e1, p1, e2, p2, score): each assigned pair with each of its two predicates.

    All objects around a pair by the same two predicates get one score, so it is worked out once
    here, before any pair of objects is made.
    """

    def side(t: DataFrame, e: str, p: str, w: str) -> DataFrame:
        per = t.groupBy("s", "p").agg(F.count("*").alias("deg"), F.count_if(~is_literal(F.col("o"))).alias("open")).where("open > 0")
        return per.join(fun, "p").select(F.col("s").alias(e), F.col("p").alias(p), F.least(F.lit(1.0) / F.col("deg"), "f").alias(w))

    rows = side(t1, "e1", "p1", "w1").join(assign, "e1").join(side(t2, "e2", "p2", "w2"), "e2")
    score = F.least("score", "w1", "w2", predicate_prior(F.col("p1"), F.col("p2")), F.lit(1.0))
    return rows.select("e1", "p1", "e2", "p2", score.alias("score")).where("score > 0")


def _objects(t: DataFrame, e: str, p: str, o: str) -> DataFrame:
    return t.where(~is_literal(F.col("o"))).select(F.col("s").alias(e), F.col("p").alias(p), F.col("o").alias(o))


def bootstrap_rows(t1: DataFrame, t2: DataFrame, blocks: DataFrame) -> DataFrame:
    """(e1, e2, score): every pair of objects of every block. A pair stands as often as blocks hold it."""
    rows = _objects(t1, "e1", "p1", "o1").join(blocks, ["e1", "p1"]).join(_objects(t2, "e2", "p2", "o2"), ["e2", "p2"])
    return rows.select(F.col("o1").alias("e1"), F.col("o2").alias("e2"), "score")


def bootstrap(t1: DataFrame, t2: DataFrame, assign: DataFrame, fun: DataFrame) -> DataFrame:
    """Scores of the objects around assigned pairs, by the predicates' functionality and prior."""
    blocks = cut(bootstrap_blocks(t1, t2, assign, fun))
    return bootstrap_parts(t1, t2, blocks, blocks.select("e1", "e2", "score").limit(0)).rows()


def _classes(members: DataFrame, node: str, keys: list[str], name: str) -> DataFrame:
    """(node, keys, class): nodes that are members of the same keys have the same class, a 128-bit sum over them."""
    mark = lambda seed: F.bit_xor(F.xxhash64(F.lit(seed), *keys))
    by = members.groupBy(node).agg(F.struct(F.count("*").alias("n"), mark(1).alias("x"), mark(2).alias("y")).alias(name))
    return members.join(by, node).select(node, *keys, name)


@dataclass
class Parts:
    """All pairs of ``blocks`` and other pairs, unmade: nodes in the same large blocks share a class, pairs of classes stand for the pairs of their nodes.

    ``one`` (o1, c1) and ``two`` (o2, c2) hold the classes, ``classes`` (c1, c2, score) their pairs, ``few`` (e1, e2, score) the pairs of small blocks and the other ones.
    """

    one: DataFrame
    two: DataFrame
    classes: DataFrame
    few: DataFrame

    def beside(self, rows: DataFrame) -> DataFrame:
        """rows (e1, e2, score) with ``have``, the score that the large blocks give the pair, null if none."""
        own = rows.join(self.one.withColumnRenamed("o1", "e1"), "e1", "left").join(self.two.withColumnRenamed("o2", "e2"), "e2", "left")
        return own.join(self.classes.withColumnRenamed("score", "have"), ["c1", "c2"], "left")

    def total(self) -> float:
        n = lambda c, name: c.groupBy(c.columns[1]).agg(F.count("*").alias(name))
        total = self.classes.join(n(self.one, "n1"), "c1").join(n(self.two, "n2"), "c2").agg(F.sum(F.col("score") * F.col("n1") * F.col("n2"))).first()[0]
        more = self.beside(self.few).agg(F.sum(F.greatest(F.col("score") - F.coalesce("have", F.lit(0.0)), F.lit(0.0)))).first()[0]
        return (total or 0.0) + (more or 0.0)

    def scores(self, asked: DataFrame) -> DataFrame:
        """(e1, e2, score) of the asked pairs (e1, e2) that there are."""
        pair = ["e1", "e2"]
        known = self.beside(asked.select(*pair).distinct()).join(self.few.select(*pair, F.col("score").alias("other")), pair, "left")
        return known.select(*pair, F.greatest("have", "other").alias("score")).where("score is not null")

    def rows(self, risen: DataFrame | None = None, chunk: int = 256) -> DataFrame:
        """(e1, e2, score) of all pairs, each once; ``risen`` (e1, e2, score) are further pairs or higher scores.

        Pairs of classes are opened as lists of nodes, so no pair goes through an exchange; those that ``few`` or ``risen`` hold too are left out there.
        """
        few = self.few if risen is None else fuzzy_or(self.few.unionByName(risen.select("e1", "e2", "score")), ["e1", "e2"], F.col("score"))
        few = cut(self.beside(few))

        def lists(nodes: DataFrame, o: str, c: str, k: str, m: str) -> tuple[DataFrame, DataFrame]:
            n = nodes.groupBy(c).agg(F.ceil(F.count("*") / chunk).alias("n"))
            numbered = nodes.join(n, c).select(c, F.pmod(F.xxhash64(o), F.col("n")).alias(k), o)
            return numbered, numbered.groupBy(c, k).agg(F.collect_list(o).alias(m))

        at1, lists1 = lists(self.one, "o1", "c1", "k1", "m1")
        at2, lists2 = lists(self.two, "o2", "c2", "k2", "m2")
        held = few.where("have is not null").select("e1", "e2")
        held = held.join(at1.withColumnRenamed("o1", "e1"), "e1").join(at2.withColumnRenamed("o2", "e2"), "e2")
        keys = ["c1", "k1", "c2", "k2"]
        held = held.groupBy(*keys, "e1").agg(F.collect_list("e2").alias("e2s")).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("e1", "e2s"))).alias("held"))
        spark = few.sparkSession
        tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
        opened = self.classes.join(lists1, "c1").join(lists2, "c2").join(held, keys, "left").repartition(tasks, *keys)
        opened = opened.select("score", "held", "m2", F.explode("m1").alias("e1")).withColumn("out", F.try_element_at("held", F.col("e1")))
        opened = opened.select("e1", F.explode(F.when(F.col("out").isNull(), F.col("m2")).otherwise(F.array_except("m2", "out"))).alias("e2"), "score")
        return opened.unionByName(few.select("e1", "e2", F.greatest("score", "have").alias("score")))


def bootstrap_parts(t1: DataFrame, t2: DataFrame, blocks: DataFrame, others: DataFrame, small: int = 64) -> Parts:
    """All pairs of ``blocks`` and ``others`` as ``Parts``; only blocks of ``small`` pairs at most and ``others`` are paired."""
    o1, o2 = _objects(t1, "e1", "p1", "o1"), _objects(t2, "e2", "p2", "o2")
    size = lambda o, e, p, n: o.groupBy(e, p).agg(F.count("*").alias(n))
    sized = blocks.join(size(o1, "e1", "p1", "n1"), ["e1", "p1"]).join(size(o2, "e2", "p2", "n2"), ["e2", "p2"])
    sized = cut(sized.withColumn("large", F.col("n1") * F.col("n2") > small))
    large = sized.where("large").select("e1", "p1", "e2", "p2", "score")
    c1 = cut(_classes(o1.join(large.select("e1", "p1").distinct(), ["e1", "p1"], "left_semi"), "o1", ["e1", "p1"], "c1"))
    c2 = cut(_classes(o2.join(large.select("e2", "p2").distinct(), ["e2", "p2"], "left_semi"), "o2", ["e2", "p2"], "c2"))
    keys = c1.select("c1", "e1", "p1").distinct().join(large, ["e1", "p1"]).join(c2.select("c2", "e2", "p2").distinct(), ["e2", "p2"])
    few = bootstrap_rows(t1, t2, sized.where("not large").select("e1", "p1", "e2", "p2", "score")).unionByName(others.select("e1", "e2", "score"))
    return Parts(cut(c1.select("o1", "c1").distinct()), cut(c2.select("o2", "c2").distinct()), cut(fuzzy_or(keys, ["c1", "c2"], F.col("score"))), cut(fuzzy_or(few, ["e1", "e2"], F.col("score"))))


def bootstrap_total(t1: DataFrame, t2: DataFrame, blocks: DataFrame, others: DataFrame, small: int = 64) -> float:
    """The sum of the best scores of all pairs of ``blocks`` and ``others``, without making the pairs of large blocks."""
    return bootstrap_parts(t1, t2, blocks, others, small).total()


def bootstrap_first(t1: DataFrame, t2: DataFrame, blocks: DataFrame, others: DataFrame) -> DataFrame:
    """``first_choice`` of the bootstrap's pairs and ``others`` (e1, e2, score), without making the other pairs.

    A node's best score is the best of its blocks, and only blocks with that score are opened.
    """
    mine = _objects(t1, "e1", "p1", "o1")
    top = mine.join(blocks.groupBy("e1", "p1").agg(F.max("score").alias("score")), ["e1", "p1"]).select(F.col("o1").alias("e1"), "score")
    best = top.unionByName(others.select("e1", "score")).groupBy("e1").agg(F.max("score").alias("best"))
    opened = mine.join(best.withColumnRenamed("e1", "o1"), "o1").join(blocks, ["e1", "p1"]).where("score = best")
    rows = opened.join(_objects(t2, "e2", "p2", "o2"), ["e2", "p2"]).select(F.col("o1").alias("e1"), F.col("o2").alias("e2"), "score")
    return rows.unionByName(others.join(best, "e1").where("score = best").select("e1", "e2", "score")).distinct()


def inclusion(src: DataFrame, dst: DataFrame, assign: DataFrame, alpha: float) -> DataFrame:
    """(p, q, score): how far facts of p have a counterpart under q. assign: (e1 in src, e2 in dst, score).

    A fact gives its best counterpart's score once, then a predicate's facts add up.
    """
    a = assign.select(F.col("e1").alias("s"), F.col("e2").alias("s2"), F.col("score").alias("vs"))
    b = assign.select(F.col("e1").alias("o"), F.col("e2").alias("o2"), F.col("score").alias("vo"))
    d = dst.select(F.col("s").alias("s2"), F.col("p").alias("q"), F.col("o").alias("o2"))
    hits = src.select("s", "p", "o").join(a, "s").join(b, "o").join(d, ["s2", "o2"])
    best = hits.groupBy("s", "p", "o", "q").agg(F.max(F.least("vs", "vo")).alias("best"))
    facts = src.groupBy("p").agg(F.count("*").alias("n"))
    total = best.groupBy("p", "q").agg(F.sum("best").alias("total"))
    return total.join(facts, "p").select("p", "q", F.least(F.lit(1.0), F.col("total") * alpha / F.col("n")).alias("score")).where("score > 0")


def inclusion_of_closed(src: DataFrame, dst: DataFrame, assign: DataFrame, alpha: float) -> DataFrame:
    """``inclusion`` where both graphs are closed under inverse predicates: p- is in q- as far as p is in q, so half the facts suffice."""
    half = inclusion(src.where(~is_inverse(F.col("p"))), dst, assign, alpha)
    ways = F.array(F.struct("p", "q"), F.struct(invert(F.col("p")).alias("p"), invert(F.col("q")).alias("q")))
    return half.select("score", F.explode(ways).alias("w")).select("w.p", "w.q", "score")


def flipped(assign: DataFrame) -> DataFrame:
    return assign.select(F.col("e2").alias("e1"), F.col("e1").alias("e2"), "score")


def quasi_equivalence(sub12: DataFrame, sub21: DataFrame) -> DataFrame:
    """(p, q, score): the better of the two inclusions."""
    back = sub21.select(F.col("q").alias("p"), F.col("p").alias("q"), "score")
    return sub12.select("p", "q", "score").unionByName(back).groupBy("p", "q").agg(F.max("score").alias("score"))


def _open_facts(t1: DataFrame, assign: DataFrame, quasi: DataFrame, most: int) -> DataFrame:
    """(s1, o, pm): for each open node s1 its ``most`` facts that promise most."""
    best1 = best_scores(assign, "e1")
    settled = best1.where(F.col("best") > SETTLED).select(F.col("node").alias("s1"))
    q_best = quasi.groupBy("p").agg(F.max("score").alias("q_best"))
    facts = t1.where(~is_literal(F.col("s"))).select(F.col("s").alias("s1"), "p", "o").join(settled, "s1", "left_anti")
    known = facts.join(best1.select(F.col("node").alias("o"), F.col("best").alias("a_best")), "o").join(q_best.select("p"), "p", "left_semi")
    known = known.select("s1", "o", invert(F.col("p")).alias("pm"), "a_best").join(q_best.withColumnRenamed("p", "pm"), "pm")
    order = Window.partitionBy("s1").orderBy(F.desc(F.round(F.least("a_best", "q_best"), 9)), "o", "pm")
    return known.withColumn("r", F.row_number().over(order)).where(F.col("r") <= most).select("s1", "o", "pm")


def _counterparts(t2: DataFrame, assign: DataFrame, quasi: DataFrame) -> DataFrame:
    """(o, pm, o2, q, va, vq): what a fact's node and predicate may stand for in the other graph.

    Of an o2's predicates those that fit pm best, which depends on no s1 and no s2 and so is settled before either is joined.
    """
    there = t2.where(~is_literal(F.col("o"))).select(F.col("s").alias("o2"), F.col("p").alias("q")).distinct()
    pairs = assign.select(F.col("e1").alias("o"), F.col("e2").alias("o2"), F.col("score").alias("va"))
    links = quasi.select(F.col("p").alias("pm"), "q", F.col("score").alias("vq")).where("vq > 0")
    rows = there.join(links, "q").withColumn("top", F.max("vq").over(Window.partitionBy("o2", "pm"))).where("vq = top").drop("top")
    return pairs.join(rows, "o2").select("o", "pm", "o2", "q", "va", "vq")


def _others(t2: DataFrame) -> DataFrame:
    return t2.where(~is_literal(F.col("o"))).select(F.col("s").alias("o2"), F.col("p").alias("q"), F.col("o").alias("s2"))


def _one_each(pieces: DataFrame) -> DataFrame:
    """A neighbour counts once on either side of a candidate pair."""
    one = Window.partitionBy("s1", "s2", "o", "pm").orderBy(F.desc("vq"), "o2", "q")
    pieces = pieces.repartition("s1", "s2").withColumn("r", F.row_number().over(one)).where("r = 1").drop("r")
    first = Window.partitionBy("s1", "s2", "o2", "q").orderBy(F.desc(F.round(F.least("va", "vq"), 9)), "o", "pm")
    return pieces.withColumn("r", F.row_number().over(first)).where("r = 1").select("s1", "s2", "o", "pm", "o2", "q", "va", "vq")


def evidence_search(t1: DataFrame, t2: DataFrame, assign: DataFrame, quasi: DataFrame, most: int = MOST_EVIDENCE) -> DataFrame:
    """(s1, s2, o, pm, o2, q, va, vq): for each open node s1, what speaks for s2, one piece per neighbour on both sides.

    A fact of s1 with one counterpart that no other fact of s1 has gives pieces that can't
    clash, so they go out as they are joined; only the others are sorted.
    """
    ways = _open_facts(t1, assign, quasi, most).join(_counterparts(t2, assign, quasi), ["o", "pm"]).repartition("s1")
    n = lambda *by: F.count("*").over(Window.partitionBy("s1", *by))
    ways = cut(ways.withColumn("alone", (n("o", "pm") == 1) & (n("o2", "q") == 1)))
    pieces = ways.join(_others(t2), ["o2", "q"])
    cols = ["s1", "s2", "o", "pm", "o2", "q", "va", "vq"]
    return pieces.where("alone").select(*cols).unionByName(_one_each(pieces.where("not alone").select(*cols)))


def evidence_selection(evidence: DataFrame, assign: DataFrame) -> DataFrame:
    """The evidence of each s1's candidates with the most pieces, settled candidates left out; rk orders a candidate's pieces."""
    settled = best_scores(assign, "e2").where(F.col("best") > SETTLED).select(F.col("node").alias("s2"))
    rows = evidence.join(settled, "s2", "left_anti")
    counts = rows.groupBy("s1", "s2").agg(F.count("*").alias("n"))
    most = counts.groupBy("s1").agg(F.max("n").alias("most"))
    kept = counts.join(most, "s1").where("n = most").select("s1", "s2")
    order = Window.partitionBy("s1", "s2").orderBy(F.desc(F.round(F.least("va", "vq"), 9)), "o", "pm", "o2", "q")
    return rows.join(kept, ["s1", "s2"]).withColumn("rk", F.row_number().over(order))


#: Candidates that a last fact may lead to before it is opened without a look at them. It decides the order of work, not the result.
HUB = 1
PIECE = ["s1", "s2", "o", "pm", "o2", "q", "va", "vq"]


def _ranked(rows: DataFrame) -> DataFrame:
    order = Window.partitionBy("s1", "s2").orderBy(F.desc(F.round(F.least("va", "vq"), 9)), "o", "pm", "o2", "q")
    return rows.withColumn("rk", F.row_number().over(order))


@dataclass
class Chosen:
    """Chosen evidence: ``ranked`` (a piece and its rk), and ``single`` (s1, o, pm, o2, q, va, vq), unmade: everything in ``others`` (o2, q, s2) that it leads to is a candidate with this one piece."""

    ranked: DataFrame
    single: DataFrame
    others: DataFrame

    def rows(self) -> DataFrame:
        single = self.single.join(self.others, ["o2", "q"]).select(*PIECE, F.lit(1).alias("rk"))
        return self.ranked.select(*PIECE, "rk").unionByName(single)


def chosen_parts(t1: DataFrame, t2: DataFrame, assign: DataFrame, quasi: DataFrame, most: int = MOST_EVIDENCE, hub: int = HUB) -> Chosen:
    """``evidence_selection`` of ``evidence_search``, without pairing all nodes around a hub with each other.

    A node's facts are opened from the one with the fewest candidates on. Every candidate found is held against all facts, from its own
    side or from the node's, whichever has fewer. Where one of n facts' candidates has ``least`` pieces, one with as many is among those of any
    n - least + 1 facts, so the others are left unopened. Candidates that only the last of n facts leads to have one piece;
    they are chosen where no other candidate has two, and then need not be held against anything.
    """
    settled = best_scores(assign, "e2").where(F.col("best") > SETTLED).select(F.col("node").alias("s2"))
    others = cut(_others(t2).join(settled, "s2", "left_anti"))
    counterparts = _counterparts(t2, assign, quasi).join(others.groupBy("o2", "q").agg(F.count("*").alias("fan")), ["o2", "q"])
    ways = _open_facts(t1, assign, quasi, most).join(counterparts, ["o", "pm"]).repartition("s1")
    n = lambda *by: F.count("*").over(Window.partitionBy("s1", *by))
    ways = ways.withColumn("alone", (n("o", "pm") == 1) & (n("o2", "q") == 1)).withColumn("wide", F.sum("fan").over(Window.partitionBy("s1", "o", "pm")))
    ways = ways.withColumn("nth", F.dense_rank().over(Window.partitionBy("s1").orderBy("wide", "o", "pm")))
    own = Window.partitionBy("s1")
    ways = ways.withColumn("facts", F.max("nth").over(own)).withColumn("ways", F.count("*").over(own))
    ways = cut(ways.withColumn("last", F.col("alone") & (F.col("nth") == F.col("facts")) & (F.col("wide") > hub)))
    cols = ["s1", "o", "pm", "o2", "q", "va", "vq"]

    def found(opened: DataFrame) -> DataFrame:
        return opened.select("s1", "ways", "o2", "q").join(others, ["o2", "q"]).select("s1", "ways", "s2").distinct()

    def held(candidates: DataFrame) -> DataFrame:
        """All pieces of the candidates."""
        sized = cut(candidates.join(others.groupBy("s2").agg(F.count("*").alias("deg")), "s2"))
        by1 = sized.where("ways <= deg").select("s1", "s2").join(ways.select(*cols), "s1").join(others, ["o2", "q", "s2"])
        by2 = sized.where("ways > deg").select("s1", "s2").join(others, "s2").join(ways.select(*cols), ["s1", "o2", "q"])
        return cut(_one_each(by1.select(*PIECE).unionByName(by2.select(*PIECE))).withColumn("n", F.count("*").over(Window.partitionBy("s1", "s2"))))

    best = lambda rows: rows.groupBy("s1").agg(F.max("n").alias("least"))
    near = held(found(ways.where("nth = 1 and not last")))
    open_ = ways.where("nth > 1 and not last").join(best(near), "s1").where("nth <= facts - least + 1")
    far = held(found(open_).join(near.select("s1", "s2").distinct(), ["s1", "s2"], "left_anti"))
    rows = near.unionByName(far)
    top = cut(best(rows))
    single = ways.where("last").join(top.where("least > 1"), "s1", "left_anti").select(*cols)
    return Chosen(_ranked(rows.join(top, "s1").where("n = least").select(*PIECE)), single, others)


def chosen_evidence(t1: DataFrame, t2: DataFrame, assign: DataFrame, quasi: DataFrame, most: int = MOST_EVIDENCE, hub: int = HUB) -> DataFrame:
    """The rows of ``chosen_parts``."""
    return chosen_parts(t1, t2, assign, quasi, most, hub).rows()


def _degrees(t: DataFrame, s: str, p: str, n: str) -> DataFrame:
    return t.groupBy(F.col("s").alias(s), F.col("p").alias(p)).agg(F.count("*").alias(n))


def _shared(asked: DataFrame, triples: DataFrame, node: str, p: str, deg: str) -> DataFrame:
    """(s1, s2, rk, n): how many neighbours the first rk pieces have in common, from rk 2 on. ``deg`` is a piece's number of facts.

    What they share is among the neighbours of the first or of the second piece, whichever has fewer, and those are
    looked up for the other pieces; a neighbour counts at rk when it is its rk-th.
    """
    facts = triples.select("s", "p", F.col("o").alias("near"))
    asked = asked.select("s1", "s2", "rk", F.col(node).alias("s"), F.col(p).alias("p"), F.col(deg).alias("deg"))
    several = asked.where("rk <= 2").groupBy("s1", "s2").agg(F.count("*").alias("k"), F.min(F.struct("deg", "s", "p")).alias("least")).where("k = 2")
    near = several.select("s1", "s2", "least.s", "least.p").join(facts, ["s", "p"]).select("s1", "s2", "near")
    held = asked.select("s1", "s2", "rk", "s", "p").join(near, ["s1", "s2"]).join(facts, ["s", "p", "near"], "left_semi")
    nth = F.row_number().over(Window.partitionBy("s1", "s2", "near").orderBy("rk"))
    return held.withColumn("nth", nth).where("nth = rk and rk > 1").groupBy("s1", "s2", "rk").agg(F.count("*").alias("n"))


def rule_scores(chosen: DataFrame, t1: DataFrame, t2: DataFrame, fun: DataFrame, fun2: DataFrame, longest: int = LONGEST_RULE) -> DataFrame:
    """(e1, e2, score): the best over rules made of the first 1, 2, ... pieces of evidence.

    All pieces of a candidate are facts of both its nodes, so where one of the first rk pieces has a single neighbour, that is all they
    share; only the others are looked up.
    """
    chosen = chosen.where(F.col("rk") <= longest).join(_degrees(t1, "o", "pm", "deg1"), ["o", "pm"]).join(_degrees(t2, "o2", "q", "deg2"), ["o2", "q"])
    cand = Window.partitionBy("s1", "s2")
    upto = cand.orderBy("rk").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = chosen.repartition("s1", "s2").withColumn("f1", F.min("rk").over(Window.partitionBy("s1", "s2", "o"))).withColumn("f2", F.min("rk").over(Window.partitionBy("s1", "s2", "o2")))
    rows = rows.withColumn("alike", F.min(F.when(F.col("f1") == F.col("f2"), 1).otherwise(0)).over(upto))
    rows = rows.withColumn("ha", F.col("rk") / F.sum(F.lit(1.0) / F.col("va")).over(upto)).withColumn("hq", F.col("rk") / F.sum(F.lit(1.0) / F.col("vq")).over(upto))
    rows = rows.withColumn("pm1", F.lag("pm").over(cand.orderBy("rk"))).withColumn("q1", F.lag("q").over(cand.orderBy("rk")))
    rows = rows.withColumn("few1", F.min("deg1").over(upto)).withColumn("few2", F.min("deg2").over(upto))
    rows = cut(rows.where("alike = 1"))
    first = lambda k: F.when((F.col("rk") == 1) | (F.col(f"few{k}") == 1), F.col(f"few{k}"))
    rows = rows.withColumn("n1", first(1)).withColumn("n2", first(2))
    key = ["s1", "s2", "rk"]
    more = rows.where("n1 is null or n2 is null")
    more = more.join(_shared(rows.where("few1 > 1"), t1, "o", "pm", "deg1").withColumnRenamed("n", "m1"), key, "left").join(_shared(rows.where("few2 > 1"), t2, "o2", "q", "deg2").withColumnRenamed("n", "m2"), key, "left")
    more = more.withColumn("n1", F.coalesce("n1", "m1")).withColumn("n2", F.coalesce("n2", "m2")).drop("m1", "m2").where("n1 is not null and n2 is not null")
    rows = rows.where("n1 is not null and n2 is not null").unionByName(more)
    one = lambda p, name: F.broadcast(fun.select(F.col("p").alias(p), F.col("f").alias(name)))  # noqa: E731  one row per predicate
    two = lambda a, b, name: fun2.select(F.col("pa").alias(a), F.col("pb").alias(b), F.col("f").alias(name))
    rows = rows.join(one("pm", "g1"), "pm", "left").join(one("q", "g2"), "q", "left")
    rows = rows.withColumns({"xa": F.least("pm", "pm1"), "xb": F.greatest("pm", "pm1"), "ya": F.least("q", "q1"), "yb": F.greatest("q", "q1")})
    rows = rows.join(two("xa", "xb", "h1"), ["xa", "xb"], "left").join(two("ya", "yb", "h2"), ["ya", "yb"], "left")
    pick = lambda g, h: F.when(F.col("rk") == 1, F.coalesce(g, F.lit(1.0))).when(F.col("rk") == 2, F.coalesce(h, F.lit(1.0))).otherwise(F.lit(1.0))
    score = F.least("ha", "hq", F.lit(1.0) / F.col("n1"), F.lit(1.0) / F.col("n2"), pick("g1", "h1"), pick("g2", "h2"), F.lit(1.0))
    return rows.groupBy(F.col("s1").alias("e1"), F.col("s2").alias("e2")).agg(F.max(score).alias("score")).where("score > 0")


def chosen_scores(chosen: Chosen, t1: DataFrame, t2: DataFrame, fun: DataFrame, fun2: DataFrame, assign: DataFrame | None = None) -> DataFrame:
    """``rule_scores`` of the rows of ``chosen``; where ``assign`` is given, of single pieces only those that beat their e1's best assignment.

    What a single piece gives is worked out once for all the candidates that it leads to.
    """
    one = lambda p, name: F.broadcast(fun.select(F.col("p").alias(p), F.col("f").alias(name)))  # noqa: E731  one row per predicate
    rows = chosen.single.join(_degrees(t1, "o", "pm", "n1"), ["o", "pm"]).join(_degrees(t2, "o2", "q", "n2"), ["o2", "q"]).join(one("pm", "g1"), "pm", "left").join(one("q", "g2"), "q", "left")
    back = lambda c: F.lit(1) / (F.lit(1.0) / F.col(c))  # noqa: E731  a harmonic mean of one, rounded as rule_scores does
    score = F.least(back("va"), back("vq"), F.lit(1.0) / F.col("n1"), F.lit(1.0) / F.col("n2"), F.coalesce("g1", F.lit(1.0)), F.coalesce("g2", F.lit(1.0)), F.lit(1.0))
    rows = rows.select("s1", "o2", "q", score.alias("score")).where("score > 0")
    if assign is not None:
        rows = rows.join(best_scores(assign, "e1").withColumnRenamed("node", "s1"), "s1", "left").where("score > coalesce(best, 0.0D)").drop("best")
    single = rows.join(chosen.others, ["o2", "q"]).select(F.col("s1").alias("e1"), F.col("s2").alias("e2"), "score")
    return rule_scores(chosen.ranked, t1, t2, fun, fun2).unionByName(single)


def guarded(new: DataFrame, assign: DataFrame) -> DataFrame:
    """New scores that beat both nodes' best assignment so far."""
    b1 = best_scores(assign, "e1").select(F.col("node").alias("e1"), F.col("best").alias("b1"))
    b2 = best_scores(assign, "e2").select(F.col("node").alias("e2"), F.col("best").alias("b2"))
    bar = F.greatest(F.coalesce("b1", F.lit(0.0)), F.coalesce("b2", F.lit(0.0)))
    return new.join(b1, "e1", "left").join(b2, "e2", "left").where(F.col("score") > bar).select("e1", "e2", "score")


def guarded_merge(same_as: DataFrame, new: DataFrame, assign: DataFrame) -> DataFrame:
    """New scores count where they beat both nodes' best assignment so far; the higher of old and new stays."""
    return monotone_merge(guarded(new, assign), same_as.select("e1", "e2", "score"), ["e1", "e2"])
