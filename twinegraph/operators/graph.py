"""A knowledge graph as a DataFrame of triples (s, p, o), closed under inverse predicates.

Every access below is a projection, filter, join or aggregate over that one table, so
filters reach the scan and nothing is collected.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.terms import invert, is_inverse, is_literal
from .rounds import cut

TRIPLE = ["s", "p", "o"]


def inverse_closure(triples: DataFrame) -> DataFrame:
    """The distinct triples and, for each, the one that reads it backwards."""
    keys = [c for c in triples.columns if c not in TRIPLE]
    # both directions from one pass over the rows: a union would read and work out its input twice
    ways = F.array(F.struct(*TRIPLE), F.struct(F.col("o").alias("s"), invert(F.col("p")).alias("p"), F.col("s").alias("o")))
    return triples.select(*keys, F.explode(ways).alias("t")).select(*keys, *[F.col(f"t.{c}").alias(c) for c in TRIPLE]).distinct()


class KnowledgeGraph:
    """``triples`` holds both directions; nothing runs before an action."""

    def __init__(self, triples: DataFrame):
        self.triples = triples

    @classmethod
    def of(cls, facts: DataFrame) -> KnowledgeGraph:
        return cls(inverse_closure(facts))

    # changes give a new graph
    def add(self, facts: DataFrame) -> KnowledgeGraph:
        return KnowledgeGraph(self.triples.unionByName(inverse_closure(facts)).distinct())

    def remove(self, facts: DataFrame) -> KnowledgeGraph:
        return KnowledgeGraph(self.triples.join(inverse_closure(facts), TRIPLE, "left_anti"))

    def load_turtle(self, path: str) -> KnowledgeGraph:
        from ..sources.turtle import read_turtle

        return self.add(read_turtle(self.triples.sparkSession, path))

    # access
    def contains(self, facts: DataFrame) -> DataFrame:
        """The given triples that the graph holds."""
        return facts.select(*TRIPLE).distinct().join(self.triples, TRIPLE, "left_semi")

    def size(self) -> DataFrame:
        return self.triples.agg(F.count("*").alias("size"))

    def predicates(self) -> DataFrame:
        return self.triples.select("p").distinct()

    def attributes(self) -> DataFrame:
        """Predicates with a literal subject, and their inverses."""
        p = self.triples.where(is_literal(F.col("s"))).select("p").distinct()
        return p.unionByName(p.select(invert(F.col("p")).alias("p"))).distinct()

    def predicate_counts(self) -> DataFrame:
        return self.triples.groupBy("p").agg(F.count("*").alias("n_facts"))

    def local_functionality(self) -> DataFrame:
        """1 / number of objects, for each subject and predicate."""
        return self.triples.groupBy("s", "p").agg((F.lit(1.0) / F.count("*")).alias("f"))

    def local_functionality_of(self, asked: DataFrame) -> DataFrame:
        """asked: (id, s, p) lists, repeated rows count once; 1 / number of objects that all of a list's (s, p) share, 0 if there is none.

        A list of one is a count of facts. A longer list only looks at the objects of its rarest (s, p), and of
        those at the ones that have as many asked (s, p) at all as the list is long; each of them is
        then looked up for the rest of the list. So the work follows the shortest lists of objects, not the longest.
        """
        asked = asked.select("id", "s", "p").distinct()
        wanted = self.triples.join(asked.select("s", "p").distinct(), ["s", "p"], "left_semi")
        degree = wanted.groupBy("s", "p").agg(F.count("*").alias("deg"))
        rare = F.min(F.struct(F.coalesce("deg", F.lit(0)).alias("deg"), "s", "p")).alias("rare")
        lists = cut(asked.join(degree, ["s", "p"], "left").groupBy("id").agg(F.count("*").alias("k"), rare).select("id", "k", "rare.*"))
        many = lists.where("k > 1 and deg > 0")
        held = wanted.groupBy("o").agg(F.count("*").alias("held")).where("held > 1")
        near = wanted.join(many.select("s", "p").distinct(), ["s", "p"], "left_semi").join(held, "o")
        maybe = many.alias("m").join(near.alias("n"), (F.col("m.s") == F.col("n.s")) & (F.col("m.p") == F.col("n.p")) & (F.col("held") >= F.col("k"))).select("id", "k", F.col("n.o").alias("o"))
        shared = maybe.join(asked, "id").join(wanted, [*TRIPLE]).groupBy("id", "k", "o").agg(F.count("*").alias("n")).where("n = k")
        found = shared.groupBy("id").agg(F.count("*").alias("n_shared"))
        ones = lists.where("k = 1").select("id", F.col("deg").alias("n_shared"))
        rest = lists.where("k > 1").select("id").join(found, "id", "left")
        return ones.unionByName(rest).select("id", F.when(F.col("n_shared") > 0, F.lit(1.0) / F.col("n_shared")).otherwise(0.0).alias("f"))

    def triples_where(self, s: str | None = None, p: list[str] | None = None, o: str | None = None) -> DataFrame:
        out = self.triples
        if s is not None:
            out = out.where(F.col("s") == s)
        if p:
            out = out.where(F.col("p").isin(p))
        if o is not None:
            out = out.where(F.col("o") == o)
        return out

    def triples_with_subject(self, s: str, *p: str) -> DataFrame:
        return self.triples_where(s=s, p=list(p))

    def triples_with_predicate(self, *p: str) -> DataFrame:
        return self.triples_where(p=list(p))

    def triples_with_object(self, o: str, *p: str) -> DataFrame:
        """Read backwards: the triples whose subject is ``o``, inverse predicates where ``p`` asks for some."""
        return self.triples_where(s=o, p=[x[:-1] if x.endswith("-") else x + "-" for x in p])

    def objects(self, s: str | None = None, p: str | None = None) -> DataFrame:
        return self.triples_where(s=s, p=[p] if p else None).select("o").distinct()

    def subjects(self, p: str | None = None, o: str | None = None) -> DataFrame:
        return self.triples_where(p=[p] if p else None, o=o).select("s").distinct()

    def some_subject(self) -> DataFrame:
        return self.triples.select("s").limit(1)

    def heads_with_predicates(self, counts: dict[str, int], most: int = 11) -> DataFrame:
        """Triples of the subjects that have every predicate at least so often, up to ``most`` facts a predicate in order of object."""
        asked = self.triples.where(F.col("p").isin(list(counts)))
        enough = asked.groupBy("s", "p").agg(F.count("*").alias("n")).where(reduce(lambda a, b: a | b, [(F.col("p") == p) & (F.col("n") >= n) for p, n in counts.items()]))
        heads = enough.groupBy("s").agg(F.count("*").alias("k")).where(F.col("k") == len(counts)).select("s")
        nth = F.row_number().over(Window.partitionBy("s", "p").orderBy("o"))
        return asked.join(heads, "s", "left_semi").withColumn("nth", nth).where(F.col("nth") <= most).drop("nth")

    def list_items(self, starts: DataFrame) -> DataFrame:
        """(start, position, item) of RDF lists.

        Every cell finds the head of its list by doubling: a round replaces a pointer
        to an earlier cell by that cell's own pointer, so lists of n items take log n rounds. A cell has one predecessor at most.
        """
        item = self.triples.where("p = 'rdf:first'").select(F.col("s").alias("cell"), F.col("o").alias("item"))
        back = self.triples.where("p = 'rdf:rest' and o <> 'rdf:nil'").select(F.col("o").alias("cell"), F.col("s").alias("up"))
        at = item.select("cell").join(back, "cell", "left").select("cell", F.coalesce("up", "cell").alias("up"), F.when(F.col("up").isNull(), 0).otherwise(1).alias("n"))
        at = cut(at)
        while True:
            step = at.select(F.col("cell").alias("up"), F.col("up").alias("further"), F.col("n").alias("more"))
            at = cut(at.join(step, "up").select("cell", F.col("further").alias("up"), (F.col("n") + F.col("more")).alias("n"), (F.col("more") > 0).alias("moved")))
            if at.where("moved").isEmpty():
                break
            at = at.drop("moved")
        first = starts.join(at, starts["start"] == at["cell"]).select("start", "up", F.col("n").alias("skip"))
        return at.join(item, "cell").join(first, "up").where("n >= skip").select("start", (F.col("n") - F.col("skip")).cast("int").alias("position"), "item")

    def to_text(self) -> DataFrame:
        """One line per subject, its facts in order, inverse predicates left out."""
        facts = self.triples.where(~is_inverse(F.col("p"))).select("s", F.struct(F.concat_ws(" ", "p", "o").alias("f")).alias("f"))
        lines = F.array_join(F.transform(F.sort_array(F.collect_list("f")), lambda x: x["f"]), " ; ")
        return facts.groupBy("s").agg(lines.alias("facts")).select(F.concat("s", F.lit(" "), "facts", F.lit(" .")).alias("value"))


def node_terms(triples: DataFrame, column: str = "s") -> DataFrame:
    return triples.select(F.col(column).alias("term")).distinct()


def unmatched(rows: DataFrame, best: Column, above: float = 0.95) -> DataFrame:
    """Rows whose best score is not above the limit at which a match counts as settled."""
    return rows.where(~(F.coalesce(best, F.lit(0.0)) > above))
