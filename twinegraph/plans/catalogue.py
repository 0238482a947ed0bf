"""The queries over the star-schema tables, by name, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import terms, text
from ..operators import evaluate, functionality, literals, rules
from ..operators.graph import KnowledgeGraph
from ..operators.rounds import cut
from ..sources import loaders, sinks
from .fixpoint import Aligner, Params, result_rows
from .tables import GRAPHS_SQL, LINES_SQL, facts, graph, line_facts, read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return keep


def shown(df: DataFrame, *scores: str) -> DataFrame:
    """Scores to nine places, so that engines that add in another order agree."""
    return df.withColumns({c: F.round(c, 9) for c in scores})


def G(tail: str, extra: str = "") -> str:  # noqa: N802
    return f"WITH {GRAPHS_SQL}{', ' + extra if extra else ''} {tail}"


INV = lambda p: f"CASE WHEN {p} LIKE '%-' THEN substr({p}, 1, length({p}) - 1) ELSE {p} || '-' END"
LIT = lambda t: f"(regexp_matches({t}, '^\"[^\"]*\"') OR regexp_matches({t}, '^\"?[+-]?[0-9.]+\"?$'))"


# --- graph access


@query("triples_inverse_closure", G("SELECT s, p, o FROM t1"))
def _(spark, d):
    return graph(spark, d, 1)


@query("triples_distinct", G("SELECT s, p, o FROM t2_facts"))
def _(spark, d):
    f = facts(spark, d, 2)
    return f.unionByName(f).distinct()


@query("graph_size", G("SELECT count(*)::BIGINT AS size FROM t1"))
def _(spark, d):
    return KnowledgeGraph(graph(spark, d, 1)).size()


@query("predicates", G("SELECT DISTINCT p FROM t1"))
def _(spark, d):
    return KnowledgeGraph(graph(spark, d, 1)).predicates()


@query("attributes", G(f"SELECT DISTINCT p FROM (SELECT p FROM t1 WHERE {LIT('s')} UNION ALL SELECT {INV('p')} FROM t1 WHERE {LIT('s')})"))
def _(spark, d):
    return KnowledgeGraph(graph(spark, d, 1)).attributes()


@query("predicate_counts", G("SELECT p, count(*)::BIGINT AS n_facts FROM t1 GROUP BY p"))
def _(spark, d):
    return KnowledgeGraph(graph(spark, d, 1)).predicate_counts()


@query("local_functionality", G("SELECT s, p, round(1.0::DOUBLE / count(*), 9) AS f FROM t1 GROUP BY s, p"))
def _(spark, d):
    return shown(KnowledgeGraph(graph(spark, d, 1)).local_functionality(), "f")


@query("local_functionality_multi", f"""WITH {LINES_SQL}, a AS (
  SELECT DISTINCT 'o' || l_orderkey AS id, 'p' || l_partkey AS s FROM lineitem), b AS (SELECT o AS s, s AS o FROM lines WHERE p = 'part'),
  k AS (SELECT id, count(*) AS k FROM a GROUP BY id),
  n AS (SELECT id, o, count(*) AS n FROM a JOIN b USING (s) GROUP BY id, o),
  f AS (SELECT id, count(*) AS m FROM n JOIN k USING (id) WHERE n = k GROUP BY id)
SELECT id, round(coalesce(1.0::DOUBLE / m, 0), 9) AS f FROM k LEFT JOIN f USING (id)""")
def _(spark, d):
    li = read(spark, d, "lineitem")
    asked = li.select(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("id"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("s"), F.lit("part-").alias("p")).distinct()
    return shown(KnowledgeGraph.of(line_facts(spark, d).where("p = 'part'")).local_functionality_of(asked), "f")


@query("objects_of", G("SELECT DISTINCT o FROM t1 WHERE p = 'a:nation'"))
def _(spark, d):
    return KnowledgeGraph(graph(spark, d, 1)).objects(p="a:nation")


@query("subjects_of", G("SELECT DISTINCT s FROM t1 WHERE p = 'a:region' AND o = 'a:r1'"))
def _(spark, d):
    return KnowledgeGraph(graph(spark, d, 1)).subjects(p="a:region", o="a:r1")


@query("all_nodes", G("SELECT DISTINCT s FROM t1"))
def _(spark, d):
    return KnowledgeGraph(graph(spark, d, 1)).subjects()


@query("triples_with_subject", G("SELECT s, p, o FROM t1 WHERE s = 'a:n3'"))
def _(spark, d):
    return KnowledgeGraph(graph(spark, d, 1)).triples_with_subject("a:n3")


@query("triples_with_predicate", G("SELECT s, p, o FROM t1 WHERE p IN ('a:region', 'a:nation-')"))
def _(spark, d):
    return KnowledgeGraph(graph(spark, d, 1)).triples_with_predicate("a:region", "a:nation-")


@query("triples_with_object", G("SELECT s, p, o FROM t1 WHERE s = 'a:r2' AND p = 'a:region-'"))
def _(spark, d):
    return KnowledgeGraph(graph(spark, d, 1)).triples_with_object("a:r2", "a:region")


@query("graph_contains", G("SELECT s, p, o FROM t1 WHERE s LIKE 'a:n%' AND p = 'a:region'"))
def _(spark, d):
    asked = facts(spark, d, 1).where("p = 'a:region'")
    return KnowledgeGraph(graph(spark, d, 1)).contains(asked.unionByName(facts(spark, d, 2)))


@query("graph_remove", G("SELECT s, p, o FROM t1 WHERE p NOT IN ('a:balance', 'a:balance-')"))
def _(spark, d):
    g = KnowledgeGraph(graph(spark, d, 1))
    return g.remove(g.triples.where("p = 'a:balance'")).triples


@query("graph_add", G("SELECT s, p, o FROM t1 UNION SELECT s, p, o FROM t2"))
def _(spark, d):
    return KnowledgeGraph(graph(spark, d, 1)).add(facts(spark, d, 2)).triples


@query("graph_to_text", G(f"SELECT s || ' ' || string_agg(p || ' ' || o, ' ; ' ORDER BY p || ' ' || o) || ' .' AS value FROM t1 WHERE p NOT LIKE '%-' GROUP BY s"))
def _(spark, d):
    return KnowledgeGraph(graph(spark, d, 1)).to_text()


@query("heads_with_all_predicates", f"""WITH {LINES_SQL}, t AS (SELECT s, p, o FROM lines UNION SELECT o, p || '-', s FROM lines),
  n AS (SELECT s, p, count(*) AS n FROM t WHERE p IN ('order-', 'part-', 'supplier-') GROUP BY s, p HAVING count(*) >= 3)
SELECT s, p, o FROM (SELECT *, row_number() OVER (PARTITION BY s, p ORDER BY o) AS nth FROM t WHERE p = 'part-' AND s IN (SELECT s FROM n WHERE p = 'part-')) WHERE nth <= 11""")
def _(spark, d):
    return KnowledgeGraph.of(line_facts(spark, d)).heads_with_predicates({"part-": 3})


@query("list_items", """SELECT 'o' || l_orderkey AS start, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1)::INTEGER AS position, 'p' || l_partkey AS item FROM lineitem""")
def _(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    li = read(spark, d, "lineitem").select(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("start"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("item"), F.row_number().over(w).alias("n"), F.lead("l_linenumber").over(w).isNull().alias("last"))
    cell = lambda n: F.when(n == 1, F.col("start")).otherwise(F.concat("start", F.lit("_"), n.cast("string")))
    first = li.select(cell(F.col("n")).alias("s"), F.lit("rdf:first").alias("p"), F.col("item").alias("o"))
    rest = li.select(cell(F.col("n")).alias("s"), F.lit("rdf:rest").alias("p"), F.when(F.col("last"), "rdf:nil").otherwise(cell(F.col("n") + 1)).alias("o"))
    return KnowledgeGraph(first.unionByName(rest)).list_items(li.where("n = 1").select("start"))


# --- functionality

FUN = lambda t: f"SELECT p, count(DISTINCT s)::DOUBLE / count(*) AS f FROM {t} GROUP BY p"


def PAIR_FUN(t: str) -> str:  # noqa: N802
    return f"""SELECT pa, pb, count(DISTINCT (oa, ob))::DOUBLE / count(*) AS f FROM (
  SELECT least({INV('a.p')}, {INV('b.p')}) AS pa, greatest({INV('a.p')}, {INV('b.p')}) AS pb, least(a.o, b.o) AS oa, greatest(a.o, b.o) AS ob
  FROM {t}_n a JOIN {t}_n b ON a.s = b.s AND a.i < b.i AND a.i * a.n - a.i * (a.i + 1) / 2 + b.i - a.i - 1 < 100001) GROUP BY pa, pb"""


def NUMBERED(t: str) -> str:  # noqa: N802
    return f"{t}_n AS (SELECT s, p, o, row_number() OVER (PARTITION BY s ORDER BY p, o) - 1 AS i, count(*) OVER (PARTITION BY s) AS n FROM {t})"


FUN_CTE = f"fun AS (SELECT p, min(f) AS f FROM ({FUN('t1')} UNION ALL {FUN('t2')}) GROUP BY p)"
FUN2_CTE = f"{NUMBERED('t1')}, {NUMBERED('t2')}, fun2 AS (SELECT pa, pb, min(f) AS f FROM ({PAIR_FUN('t1')} UNION ALL {PAIR_FUN('t2')}) GROUP BY pa, pb)"


@query("functionality_1gram", G(f"SELECT p, round(f, 9) AS f FROM ({FUN('t1')})"))
def _(spark, d):
    return shown(functionality.functionality(graph(spark, d, 1)), "f")


@query("functionality_2gram", G(f"SELECT pa, pb, round(f, 9) AS f FROM ({PAIR_FUN('t1')})", NUMBERED("t1")))
def _(spark, d):
    return shown(functionality.pair_functionality(graph(spark, d, 1), functionality.MOST_PAIRS), "f")


@query("functionality_2gram_lines", f"WITH {LINES_SQL}, {NUMBERED('lines')} SELECT pa, pb, round(f, 9) AS f FROM ({PAIR_FUN('lines')})")
def _(spark, d):
    return shown(functionality.pair_functionality(line_facts(spark, d), functionality.MOST_PAIRS), "f")


@query("functionality_2gram_for", f"WITH {LINES_SQL}, two AS (SELECT * FROM lines WHERE p IN ('part', 'supplier')), {NUMBERED('two')} SELECT pa, pb, round(f, 9) AS f FROM ({PAIR_FUN('two')})")
def _(spark, d):
    return shown(functionality.pair_functionality_for(line_facts(spark, d), ["part", "supplier"], 11, functionality.MOST_PAIRS), "f")


@query("functionality_merge_min", G("SELECT p, round(f, 9) AS f FROM fun", FUN_CTE))
def _(spark, d):
    return shown(functionality.merge_least(functionality.functionality(graph(spark, d, 1)), functionality.functionality(graph(spark, d, 2)), ["p"]), "f")


# --- text and literals


@query("numeric_normalize", "SELECT s_suppkey, regexp_replace(s_name, '[^0-9]', '', 'g') AS digits FROM supplier")
def _(spark, d):
    return read(spark, d, "supplier").select("s_suppkey", terms.numeric_normalization(F.col("s_name")).alias("digits"))


@query("readable_filter", r"""SELECT doc_id, coalesce(NOT starts_with(text, 'http:') AND (length(text) - length(regexp_replace(text, '[^\p{L}]', '', 'g'))) * -1 + length(text) > 0.5 * length(text), false) AS human FROM documents""".replace("(length(text) - length(regexp_replace(text, '[^\\p{L}]', '', 'g'))) * -1 + length(text)", "length(regexp_replace(text, '[^\\p{L}]', '', 'g'))"))
def _(spark, d):
    return read(spark, d, "documents").select("doc_id", text.is_human_readable(F.col("text")).alias("human"))


@query("jaccard_tokens", """SELECT p_partkey, round(len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))), 9) AS score FROM (
  SELECT p_partkey, list_distinct(string_split(p_name, ' ')) AS a, list_distinct(string_split(p_type, ' ')) AS b FROM part)""")
def _(spark, d):
    return shown(read(spark, d, "part").select("p_partkey", text.jaccard_similarity(F.col("p_name"), F.col("p_type")).alias("score")), "score")


@query("reorder_brackets", """SELECT p_partkey, array_to_string(list_sort(list_distinct(string_split(p_name || ' ' || p_type, ' '))), ' ') || ' (' || p_brand || ')' AS value FROM part""")
def _(spark, d):
    return read(spark, d, "part").select("p_partkey", text.reorder_brackets(F.concat_ws(" ", "p_name", F.concat(F.lit("("), "p_brand", F.lit(")")), "p_type")).alias("value"))


@query("unicode_round_trip", "SELECT doc_id, CASE WHEN regexp_matches(text, '_u[0-9A-F]{4}_') OR contains(text, '\\u') THEN 'escapes' ELSE sha256(text) END AS digest FROM documents")
def _(spark, d):
    """Every document; a text that holds escapes already can't be told from an encoded one and is marked."""
    back = F.sha2(terms.decode_escapes(text.unicode_encode(F.col("text"))).cast("binary"), 256)
    held = F.col("text").rlike("_u[0-9A-F]{4}_") | F.contains("text", F.lit("\\u"))
    return read(spark, d, "documents").select("doc_id", F.when(held, "escapes").otherwise(back).alias("digest"))


@query("pattern_equal", """WITH l AS (SELECT l_orderkey, list(l_suppkey ORDER BY l_linenumber, l_suppkey, l_quantity) AS a, list(l_quantity ORDER BY l_linenumber, l_suppkey, l_quantity) AS b FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, [list_position(a, x) FOR x IN a] = [list_position(b, x) FOR x IN b] AS alike FROM l""")
def _(spark, d):
    parts = F.sort_array(F.collect_list(F.struct("l_linenumber", "l_suppkey", "l_quantity")))
    rows = read(spark, d, "lineitem").groupBy("l_orderkey").agg(parts.alias("x"))
    return rows.select("l_orderkey", text.pattern_equal(F.transform("x", lambda r: r["l_suppkey"]), F.transform("x", lambda r: r["l_quantity"])).alias("alike"))


@query("harmonic_mean", "SELECT l_orderkey, round(count(*) / sum(1.0::DOUBLE / l_quantity), 9) AS h FROM lineitem GROUP BY l_orderkey")
def _(spark, d):
    rows = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_quantity").alias("x"))
    return shown(rows.select("l_orderkey", text.harmonic_mean(F.col("x")).alias("h")), "h")


@query("literal_split", G(f"""SELECT s AS term, regexp_extract(s, '^"([^"]*)"', 1) AS lex, CASE WHEN s LIKE '%xsd:date' OR s LIKE '%xsd:gYearMonth' THEN 'date' WHEN s LIKE '%xsd:integer' THEN 'number' ELSE 'string' END AS kind
FROM (SELECT DISTINCT s FROM (SELECT s FROM t1 UNION ALL SELECT s FROM t2) WHERE {LIT('s')})"""))
def _(spark, d):
    both = graph(spark, d, 1).unionByName(graph(spark, d, 2))
    return literals.literal_terms(both).select("term", F.col("lit.lex").alias("lex"), F.col("lit.kind").alias("kind"))


BUCKETS = lambda t: f"""SELECT DISTINCT s AS term, CASE WHEN s LIKE '%xsd:date' OR s LIKE '%xsd:gYearMonth' THEN 'date' WHEN s LIKE '%xsd:integer' THEN 'quantity' ELSE 'string' END AS bucket, unnest(CASE WHEN s LIKE '%^^%' THEN [regexp_extract(s, '^"([^"]*)"', 1)] ELSE list_distinct([regexp_extract(s, '^"([^"]*)"', 1), lower(regexp_extract(s, '^"([^"]*)"', 1))]) END) AS key FROM {t} WHERE {LIT('s')}"""
BUCKET_CTE = f"b1 AS ({BUCKETS('t1')}), b2 AS ({BUCKETS('t2')})"
STRING_SQL = "SELECT DISTINCT b1.term AS e1, b2.term AS e2, 1.0::DOUBLE AS score FROM b1 JOIN b2 USING (key) WHERE b1.bucket = 'string' AND b2.bucket = 'string'"
DATE_SQL = STRING_SQL.replace("'string'", "'date'")
QUANTITY_SQL = STRING_SQL.replace("'string'", "'quantity'")
PREFIX_SQL = """SELECT b1.term AS e1, b2.term AS e2, 2 / 3.0::DOUBLE AS score FROM b1 JOIN b2 ON substr(b1.key, 1, 7) = b2.key
WHERE b1.bucket = 'date' AND b2.bucket = 'date' AND b1.key NOT IN (SELECT key FROM b2 WHERE bucket = 'date')"""
MATCH_CTE = f"{BUCKET_CTE}, lits AS ({STRING_SQL} UNION ALL {DATE_SQL} UNION ALL {QUANTITY_SQL} UNION ALL {PREFIX_SQL})"


def _buckets(spark, d):
    return literals.buckets(graph(spark, d, 1)), literals.buckets(graph(spark, d, 2))


@query("literal_buckets", G("SELECT term, bucket, key FROM b1", BUCKET_CTE))
def _(spark, d):
    return literals.buckets(graph(spark, d, 1)).select("term", "bucket", "key")


@query("literal_match_string", G(STRING_SQL, BUCKET_CTE))
def _(spark, d):
    return literals.match_equal(*_buckets(spark, d), "string")


@query("literal_match_date", G(DATE_SQL, BUCKET_CTE))
def _(spark, d):
    return literals.match_equal(*_buckets(spark, d), "date")


@query("literal_match_date_prefix", G(f"SELECT e1, e2, round(score, 9) AS score FROM ({PREFIX_SQL})", BUCKET_CTE))
def _(spark, d):
    return shown(literals.match_date_prefix(*_buckets(spark, d)), "score")


@query("literal_match_quantity", G(QUANTITY_SQL, BUCKET_CTE))
def _(spark, d):
    return literals.match_quantity(*_buckets(spark, d))


@query("literal_match_digit", """SELECT DISTINCT '"' || a.l_suppkey || '"' AS e1, '"' || s_suppkey || '"' AS e2, 1.0::DOUBLE AS score FROM lineitem a JOIN supplier ON l_suppkey = s_suppkey""")
def _(spark, d):
    q = lambda c: F.concat(F.lit('"'), F.col(c).cast("string"), F.lit('"')).alias("s")
    a, b = read(spark, d, "lineitem").select(q("l_suppkey")), read(spark, d, "supplier").select(q("s_suppkey"))
    return literals.match_equal(literals.buckets(a), literals.buckets(b), "digit")


@query("quantity_closeness", """SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON abs(c_acctbal - s_acctbal) <= 1e-3 * greatest(abs(c_acctbal), abs(s_acctbal))""")
def _(spark, d):
    side = lambda t, k, v: read(spark, d, t).select(F.col(k).cast("string").alias("term"), F.lit("quantity").alias("bucket"), F.col(v).alias("num"))
    found = literals.match_quantity(side("customer", "c_custkey", "c_acctbal"), side("supplier", "s_suppkey", "s_acctbal"), 1e-3)
    return found.select(F.col("e1").cast("long").alias("c_custkey"), F.col("e2").cast("long").alias("s_suppkey"))


@query("score_literals", G(f"""SELECT score, count(*)::BIGINT AS n FROM (SELECT CASE WHEN s LIKE '%xsd:integer' AND o2 LIKE '%xsd:integer' THEN (regexp_extract(s, '^"([^"]*)"', 1) = regexp_extract(o2, '^"([^"]*)"', 1))::INT::DOUBLE
  WHEN s LIKE '%xsd:integer' OR o2 LIKE '%xsd:integer' THEN 0.0::DOUBLE ELSE (regexp_extract(s, '^"([^"]*)"', 1) = regexp_extract(o2, '^"([^"]*)"', 1))::INT::DOUBLE END AS score
  FROM (SELECT a.o AS s, b.o AS o2 FROM t1_facts a JOIN t2_facts b ON substr(a.s, 2) = substr(b.s, 2) WHERE {LIT('a.o')} AND {LIT('b.o')})) GROUP BY score"""))
def _(spark, d):
    side = lambda kb, c: facts(spark, d, kb).where(terms.is_literal(F.col("o"))).select(F.substring("s", 2, 99).alias("k"), terms.split_literal(F.col("o")).alias(c))
    return side(1, "x").join(side(2, "y"), "k").groupBy(terms.score_literals(F.col("x"), F.col("y")).alias("score")).agg(F.count("*").alias("n"))


@query("literal_match_all", G("SELECT e1, e2, round(score, 9) AS score FROM lits", MATCH_CTE))
def _(spark, d):
    return shown(literals.map_literals(graph(spark, d, 1), graph(spark, d, 2)), "score")


@query("literal_match_embedding", """WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), s AS (
  SELECT a.vec_id AS key1, b.vec_id AS key2, list_inner_product(a.v, b.v) AS score FROM v a JOIN v b ON a.label < 5 AND b.label >= 5),
 r AS (SELECT *, row_number() OVER (PARTITION BY key1 ORDER BY score DESC, key2::VARCHAR) AS r FROM s)
SELECT key1::VARCHAR AS key1, key2::VARCHAR AS key2, round(score, 6) AS score FROM r WHERE r = 1 AND score >= 0.1""")
def _(spark, d):
    v = read(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("key"), F.col("embedding").alias("vec"), "label")
    return literals.match_embedding(v.where("label < 5"), v.where("label >= 5"), 0.1).select("key1", "key2", F.round("score", 6).alias("score"))


# --- rules


def BILATERAL(src: str, name: str) -> str:  # noqa: N802
    return f"""{name}_r AS (SELECT * FROM (SELECT *, max(score) OVER (PARTITION BY e1) AS m FROM {src}) WHERE score = m),
  {name}_c AS (SELECT e1, e2, score FROM (SELECT e1, e2, score, max(score) OVER (PARTITION BY e2) AS m FROM {name}_r) WHERE score = m),
  {name} AS (SELECT e1, e2, score FROM {name}_c WHERE e1 = e2 OR e1 NOT IN (SELECT e1 FROM {name}_c WHERE e1 = e2))"""


def INCLUSION(src: str, dst: str, assign: str) -> str:  # noqa: N802
    return f"""SELECT p, q, least(1.0::DOUBLE, 3.0::DOUBLE * sum(best) / any_value(n)) AS score FROM (
  SELECT f.s, f.p, f.o, d.p AS q, max(least(x.score, y.score)) AS best FROM {src} f JOIN {assign} x ON f.s = x.e1 JOIN {assign} y ON f.o = y.e1 JOIN {dst} d ON d.s = x.e2 AND d.o = y.e2
  GROUP BY f.s, f.p, f.o, d.p) JOIN (SELECT p, count(*) AS n FROM {src} GROUP BY p) USING (p) GROUP BY p, q"""


BOOT = f"""deg1 AS (SELECT s, p, count(*) AS n FROM t1 GROUP BY s, p), deg2 AS (SELECT s, p, count(*) AS n FROM t2 GROUP BY s, p),
  boot AS (SELECT f.o AS e1, g.o AS e2, max(least(a.score, 1.0::DOUBLE / deg1.n, 1.0::DOUBLE / deg2.n, u.f, v.f, CASE WHEN f.p = g.p THEN 1.0::DOUBLE ELSE 0.1::DOUBLE END)) AS score
    FROM a0 a JOIN t1 f ON f.s = a.e1 JOIN t2 g ON g.s = a.e2 JOIN deg1 ON deg1.s = f.s AND deg1.p = f.p JOIN deg2 ON deg2.s = g.s AND deg2.p = g.p JOIN fun u ON u.p = f.p JOIN fun v ON v.p = g.p
    WHERE NOT {LIT('f.o')} AND NOT {LIT('g.o')} GROUP BY f.o, g.o)"""
START_CTE = f"{MATCH_CTE}, {FUN_CTE}, {BILATERAL('lits', 'a0')}, {BOOT}, same1 AS (SELECT e1, e2, max(score) AS score FROM (SELECT * FROM boot UNION ALL SELECT * FROM lits) GROUP BY e1, e2), {BILATERAL('same1', 'a1')}, a1f AS (SELECT e2 AS e1, e1 AS e2, score FROM a1), sub12 AS ({INCLUSION('t1', 't2', 'a1')}), sub21 AS ({INCLUSION('t2', 't1', 'a1f')}), quasi AS (SELECT p, q, max(score) AS score FROM (SELECT * FROM sub12 UNION ALL SELECT q AS p, p AS q, score FROM sub21) GROUP BY p, q)"
EVIDENCE_CTE = f"""best1 AS (SELECT e1 AS node, max(score) AS best FROM a1 GROUP BY e1), best2 AS (SELECT e2 AS node, max(score) AS best FROM a1 GROUP BY e2), qb AS (SELECT p, max(score) AS best FROM quasi GROUP BY p),
 ev1 AS (SELECT s1, o, pm FROM (SELECT *, row_number() OVER (PARTITION BY s1 ORDER BY round(least(a_best, q_best), 9) DESC, o, pm) AS r FROM (
   SELECT f.s AS s1, f.o, {INV('f.p')} AS pm, best1.best AS a_best, qm.best AS q_best FROM t1 f JOIN best1 ON best1.node = f.o JOIN qb ON qb.p = f.p JOIN qb qm ON qm.p = {INV('f.p')}
   WHERE NOT {LIT('f.s')} AND f.s NOT IN (SELECT node FROM best1 WHERE best > 0.95))) WHERE r <= 100),
 ev2 AS (SELECT * FROM (SELECT *, max(vq) OVER (PARTITION BY s1, o, pm, o2) AS top FROM (
   SELECT s1, ev1.o, pm, a.e2 AS o2, g.p AS q, g.o AS s2, a.score AS va, quasi.score AS vq FROM ev1 JOIN a1 a ON a.e1 = ev1.o JOIN t2 g ON g.s = a.e2 JOIN quasi ON quasi.p = pm AND quasi.q = g.p WHERE NOT {LIT('g.o')})) WHERE vq = top),
 ev3 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY s1, o, pm, s2 ORDER BY vq DESC, o2, q) AS r FROM ev2) WHERE r = 1),
 ev AS (SELECT s1, s2, o, pm, o2, q, va, vq FROM (SELECT * EXCLUDE (r), row_number() OVER (PARTITION BY s1, s2, o2, q ORDER BY round(least(va, vq), 9) DESC, o, pm) AS r FROM ev3) WHERE r = 1),
 open AS (SELECT * FROM ev WHERE s2 NOT IN (SELECT node FROM best2 WHERE best > 0.95)),
 cnt AS (SELECT *, max(n) OVER (PARTITION BY s1) AS most FROM (SELECT s1, s2, count(*) AS n FROM open GROUP BY s1, s2)),
 chosen AS (SELECT open.*, row_number() OVER (PARTITION BY s1, s2 ORDER BY round(least(va, vq), 9) DESC, o, pm, o2, q)::INTEGER AS rk FROM open JOIN cnt USING (s1, s2) WHERE n = most)"""
SHARED = lambda t, o, p: f"SELECT s1, s2, rk, count(*) AS n FROM (SELECT s1, s2, rk, row_number() OVER (PARTITION BY s1, s2, near ORDER BY rk) AS nth FROM (SELECT s1, s2, rk, t.o AS near FROM c20 JOIN {t} t ON t.s = c20.{o} AND t.p = c20.{p})) WHERE nth = rk GROUP BY s1, s2, rk"
RULE_CTE = f"""c20 AS (SELECT * FROM chosen WHERE rk <= 20), c21 AS (SELECT *, min(rk) OVER (PARTITION BY s1, s2, o) AS f1, min(rk) OVER (PARTITION BY s1, s2, o2) AS f2 FROM c20),
 c22 AS (SELECT *, min((f1 = f2)::INT) OVER w AS alike, rk / sum(1.0::DOUBLE / va) OVER w AS ha, rk / sum(1.0::DOUBLE / vq) OVER w AS hq, lag(pm) OVER x AS pm1, lag(q) OVER x AS q1 FROM c21
   WINDOW w AS (PARTITION BY s1, s2 ORDER BY rk ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), x AS (PARTITION BY s1, s2 ORDER BY rk)),
 n1 AS ({SHARED('t1', 'o', 'pm')}), n2 AS ({SHARED('t2', 'o2', 'q')}),
 rule AS (SELECT s1 AS e1, s2 AS e2, max(least(ha, hq, 1.0::DOUBLE / n1.n, 1.0::DOUBLE / n2.n, 1.0::DOUBLE,
     CASE rk WHEN 1 THEN coalesce(g1.f, 1.0) WHEN 2 THEN coalesce(h1.f, 1.0) ELSE 1.0 END, CASE rk WHEN 1 THEN coalesce(g2.f, 1.0) WHEN 2 THEN coalesce(h2.f, 1.0) ELSE 1.0 END)) AS score
   FROM c22 JOIN n1 USING (s1, s2, rk) JOIN n2 USING (s1, s2, rk) LEFT JOIN fun g1 ON g1.p = pm LEFT JOIN fun g2 ON g2.p = q
   LEFT JOIN fun2 h1 ON h1.pa = least(pm, pm1) AND h1.pb = greatest(pm, pm1) AND pm1 IS NOT NULL LEFT JOIN fun2 h2 ON h2.pa = least(q, q1) AND h2.pb = greatest(q, q1) AND q1 IS NOT NULL
   WHERE alike = 1 GROUP BY s1, s2),
 fresh AS (SELECT e1, e2, rule.score FROM rule LEFT JOIN best1 x ON x.node = e1 LEFT JOIN best2 y ON y.node = e2 WHERE rule.score > greatest(coalesce(x.best, 0), coalesce(y.best, 0))),
 same2 AS (SELECT e1, e2, max(score) AS score FROM (SELECT * FROM fresh UNION ALL SELECT * FROM same1) GROUP BY e1, e2)"""


def _started(spark, d) -> tuple[Aligner, object]:
    a = Aligner(graph(spark, d, 1), graph(spark, d, 2), Params(most_pairs=functionality.MOST_PAIRS))  # as the SQL of the queries from here has it
    return a, a.start()


@query("predicate_prior", G("SELECT a.p, b.p AS q, CASE WHEN a.p = b.p THEN 1.0::DOUBLE ELSE 0.1::DOUBLE END AS score FROM (SELECT DISTINCT p FROM t1) a, (SELECT DISTINCT p FROM t2) b"))
def _(spark, d):
    p, q = (KnowledgeGraph(graph(spark, d, i)).predicates() for i in (1, 2))
    return p.join(F.broadcast(q.withColumnRenamed("p", "q"))).select("p", "q", rules.predicate_prior(F.col("p"), F.col("q")).alias("score"))  # predicates only


@query("bilateral_max_assign", G("SELECT e1, e2, round(score, 9) AS score FROM a0", f"{MATCH_CTE}, {BILATERAL('lits', 'a0')}"))
def _(spark, d):
    return shown(rules.bilateral_max(cut(literals.map_literals(graph(spark, d, 1), graph(spark, d, 2)))), "score")


@query("bootstrap_entities", G("SELECT e1, e2, round(score, 9) AS score FROM boot", START_CTE.split(", same1 AS")[0]))
def _(spark, d):
    t1, t2 = cut(graph(spark, d, 1)), cut(graph(spark, d, 2))
    fun = functionality.merge_least(functionality.functionality(t1), functionality.functionality(t2), ["p"])
    return shown(rules.bootstrap(t1, t2, rules.bilateral_max(cut(literals.map_literals(t1, t2))), fun), "score")


@query("best_match_ties", G("SELECT e1, e2, round(score, 9) AS score FROM a1", START_CTE))
def _(spark, d):
    return shown(_started(spark, d)[1].assign, "score")


@query("predicate_inclusion", G("SELECT p, q, round(score, 9) AS score FROM sub12", START_CTE))
def _(spark, d):
    return shown(_started(spark, d)[1].sub12, "score")


@query("predicate_monotone_merge", G("SELECT p, q, round(max(score), 9) AS score FROM (SELECT * FROM sub12 UNION ALL SELECT p, q, 0.5::DOUBLE FROM sub12) GROUP BY p, q", START_CTE))
def _(spark, d):
    s = _started(spark, d)[1].sub12
    return shown(rules.monotone_merge(s, s.withColumn("score", F.lit(0.5)), ["p", "q"]), "score")


@query("quasi_equivalence", G("SELECT p, q, round(score, 9) AS score FROM quasi", START_CTE))
def _(spark, d):
    return shown(_started(spark, d)[1].quasi, "score")


@query("evidence_search", G("SELECT s1, s2, o, pm, o2, q, round(va, 9) AS va, round(vq, 9) AS vq FROM ev", f"{START_CTE}, {EVIDENCE_CTE}"))
def _(spark, d):
    a, now = _started(spark, d)
    return shown(rules.evidence_search(a.t1, a.t2, now.assign, now.quasi), "va", "vq")


@query("evidence_selection", G("SELECT s1, s2, o, pm, o2, q, rk FROM chosen", f"{START_CTE}, {EVIDENCE_CTE}"))
def _(spark, d):
    a, now = _started(spark, d)
    return rules.chosen_evidence(a.t1, a.t2, now.assign, now.quasi).select("s1", "s2", "o", "pm", "o2", "q", "rk")


@query("ngram_rule_scores", G("SELECT e1, e2, round(score, 9) AS score FROM rule", f"{FUN2_CTE}, {START_CTE}, {EVIDENCE_CTE}, {RULE_CTE}"))
def _(spark, d):
    a, now = _started(spark, d)
    chosen = rules.chosen_parts(a.t1, a.t2, now.assign, now.quasi)
    return shown(rules.chosen_scores(chosen, a.t1, a.t2, a.fun, a.fun2), "score")


@query("guarded_merge", G("SELECT e1, e2, round(score, 9) AS score FROM same2", f"{FUN2_CTE}, {START_CTE}, {EVIDENCE_CTE}, {RULE_CTE}"))
def _(spark, d):
    a, now = _started(spark, d)
    return shown(a.round(now).same_as, "score")


@query("align_full")
def align_full(spark, d):
    return shown(result_rows(Aligner(graph(spark, d, 1), graph(spark, d, 2)).run()), "score")


# --- evaluation and formats

GOLD_SQL = "gold AS (SELECT 'a:c' || c_custkey AS e1, 'b:c' || c_custkey AS e2 FROM customer WHERE c_mktsegment <> 'MACHINERY')"
PRED_SQL = "pred AS (SELECT e1, e2, score FROM (SELECT *, row_number() OVER (PARTITION BY e1 ORDER BY score DESC, e2) AS r FROM a1 WHERE starts_with(e1, 'a:c')) WHERE r = 1)"


def _gold(spark, d):
    c = read(spark, d, "customer").where(F.col("c_mktsegment") != "MACHINERY")
    return c.select(F.concat(F.lit("a:c"), F.col("c_custkey").cast("string")).alias("e1"), F.concat(F.lit("b:c"), F.col("c_custkey").cast("string")).alias("e2"))


@query("eval_prf", G("""SELECT tp, fp, fn, round(tp::DOUBLE / (tp + fp), 9) AS "precision", round(tp::DOUBLE / (tp + fn), 9) AS recall, round(2.0 * tp / (2 * tp + fp + fn), 9) AS f1 FROM (
  SELECT (SELECT count(*) FROM pred SEMI JOIN gold USING (e1, e2))::BIGINT AS tp, (SELECT count(*) FROM pred ANTI JOIN gold USING (e1, e2))::BIGINT AS fp, (SELECT count(*) FROM gold ANTI JOIN pred USING (e1, e2))::BIGINT AS fn)""", f"{START_CTE}, {GOLD_SQL}, {PRED_SQL}"))
def _(spark, d):
    return shown(evaluate.openea(_started(spark, d)[1].assign, _gold(spark, d), "a:c"), "precision", "recall", "f1")


@query("eval_hits_mrr", G("""SELECT round(avg((coalesce(t, 0) = 1)::INT), 9) AS hit1, round(avg((coalesce(t, 0) = 1 OR coalesce(r, 99) <= 10)::INT), 9) AS hit10, round(avg(coalesce(1.0::DOUBLE / r, 0)), 9) AS mrr FROM gold LEFT JOIN (
  SELECT * FROM (SELECT e1, e2, row_number() OVER (PARTITION BY e1 ORDER BY score DESC, e2) AS r, rank() OVER (PARTITION BY e1 ORDER BY score DESC) AS t FROM same1) WHERE r <= 11) USING (e1, e2)""", f"{START_CTE}, {GOLD_SQL}"))
def _(spark, d):
    gold = _gold(spark, d)
    return shown(evaluate.hits_and_mrr(gold, _started(spark, d)[1].same_as_of(gold)), "hit1", "hit10", "mrr")


@query("eval_confidence_interval", """SELECT o_orderpriority AS k, round(greatest(0, p - h), 9) AS low, round(least(1, p + h), 9) AS high FROM (
  SELECT o_orderpriority, p, 1.959963984540054 * sqrt(p * (1 - p) / n) AS h FROM (SELECT o_orderpriority, avg((o_orderstatus = 'F')::INT) AS p, count(*) AS n FROM orders GROUP BY o_orderpriority))""")
def _(spark, d):
    o = read(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("k")).agg(F.avg((F.col("o_orderstatus") == "F").cast("int")).alias("p"), F.count("*").alias("n"))
    low, high = evaluate.confidence_interval(F.col("p"), F.col("n"))
    return shown(o.select("k", low.alias("low"), high.alias("high")), "low", "high")


KIND_PRED_SQL = """kp AS (SELECT c_mktsegment AS kind, 'a:c' || c_custkey AS e1, 'b:c' || CASE WHEN c_acctbal < 0 THEN c_custkey + 1 ELSE c_custkey END AS e2, c_acctbal / 10000 AS score FROM customer),
 kg AS (SELECT c_mktsegment AS kind, 'a:c' || c_custkey AS e1, 'b:c' || c_custkey AS e2 FROM customer)"""


def _kinds(spark, d):
    c = read(spark, d, "customer")
    name = lambda x, k: F.concat(F.lit(f"{x}:c"), k.cast("string"))
    key = F.col("c_custkey")
    gold = c.select(F.col("c_mktsegment").alias("kind"), name("a", key).alias("e1"), name("b", key).alias("e2"))
    pred = c.select(F.col("c_mktsegment").alias("kind"), name("a", key).alias("e1"), name("b", F.when(F.col("c_acctbal") < 0, key + 1).otherwise(key)).alias("e2"), (F.col("c_acctbal") / 10000).alias("score"))
    return pred, gold


@query("eval_by_kind", f"""WITH {KIND_PRED_SQL}, j AS (SELECT kg.kind, coalesce(p.e2 = kg.e2, false) AS ok, p.e2 IS NOT NULL AS found FROM kg LEFT JOIN (SELECT * FROM kp WHERE score > CASE kind WHEN 'BUILDING' THEN 0.1 ELSE -0.05 END) p ON p.kind = kg.kind AND p.e1 = kg.e1)
SELECT coalesce(kind, 'overall') AS kind, tp, fp, fn, round(tp / nullif(tp + fp, 0)::DOUBLE, 9) AS "precision", round(tp / nullif(tp + fn, 0)::DOUBLE, 9) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 9) AS f1
FROM (SELECT kind, count(*) FILTER (ok)::BIGINT AS tp, count(*) FILTER (found AND NOT ok)::BIGINT AS fp, count(*) FILTER (NOT ok)::BIGINT AS fn FROM j GROUP BY ROLLUP (kind))""")
def _(spark, d):
    pred, gold = _kinds(spark, d)
    limits = {k: (0.1 if k == "BUILDING" else -0.05) for k in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")}
    return shown(evaluate.by_kind(pred, gold, limits), "precision", "recall", "f1")


@query("eval_one_to_one", f"""WITH {KIND_PRED_SQL}, b AS (SELECT e1, e2, score FROM kp), r AS (SELECT *, row_number() OVER (PARTITION BY e2 ORDER BY score DESC, e1) AS r FROM b) SELECT e1, e2, round(score, 9) AS score FROM r WHERE r = 1""")
def _(spark, d):
    pred, _gold_rows = _kinds(spark, d)
    local = lambda c: F.substring_index(c, ":", -1)
    return shown(evaluate.one_to_one(pred.select("e1", "e2", "score"), local(F.col("e1")), local(F.col("e2"))), "score")


@query("eval_properties", f"""WITH {KIND_PRED_SQL}, f AS (SELECT e1, e2, score FROM kp WHERE score > 0.5), s AS (SELECT e1, e2, score FROM kp WHERE score > 0.1 AND score <= 0.5)
SELECT e1, e2, round(score, 9) AS score FROM f UNION ALL SELECT e1, e2, round(score, 9) FROM s WHERE e1 NOT IN (SELECT e1 FROM f) AND e2 NOT IN (SELECT e2 FROM f)""")
def _(spark, d):
    pred, _gold_rows = _kinds(spark, d)
    rows = pred.select("e1", "e2", "score")
    return shown(evaluate.best_properties(rows.where("score > 0.5"), rows.where("score <= 0.5"), "a:", "b:"), "score")


@query("dictionary_decode", "SELECT o_orderpriority || o_orderkey AS s, c_mktsegment AS p, c_name AS o FROM orders JOIN customer ON o_custkey = c_custkey")
def _(spark, d):
    o, c = read(spark, d, "orders"), read(spark, d, "customer")
    t = o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("s"), F.concat(F.lit("r"), F.col("c_mktsegment")).alias("p"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("o"))
    nodes = o.select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("id"), F.concat("o_orderpriority", F.col("o_orderkey").cast("string")).alias("iri")).unionByName(c.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"), F.col("c_name").alias("iri")))
    rels = c.select(F.concat(F.lit("r"), "c_mktsegment").alias("id"), F.col("c_mktsegment").alias("iri")).distinct()
    return loaders.dictionary_decode(t, nodes, rels)


@query("seed_load", "SELECT o_orderstatus AS e1, o_orderpriority AS e2, max(CASE WHEN o_totalprice < 1000 THEN 1.0::DOUBLE ELSE round(o_totalprice / 1e6, 6) END) AS score FROM orders GROUP BY ALL")
def _(spark, d):
    rows = read(spark, d, "orders").select(F.col("o_orderstatus").alias("e1"), F.col("o_orderpriority").alias("e2"), F.when(F.col("o_totalprice") >= 1000, F.round(F.col("o_totalprice") / 1e6, 6)).alias("score"))
    return loaders.seed_pairs(rows)


@query("result_rows", G("SELECT 'owl:sameAs' AS relation, e1 || chr(9) || 'owl:sameAs' || chr(9) || e2 || chr(9) || '.#' || chr(9) || '1.0' AS value FROM lits WHERE score = 1", MATCH_CTE))
def _(spark, d):
    same = literals.map_literals(graph(spark, d, 1), graph(spark, d, 2)).where("score = 1")
    lines = sinks.result_lines(same.select(F.col("e1").alias("left"), F.lit("owl:sameAs").alias("relation"), F.col("e2").alias("right"), "score"))
    return lines.select(F.lit("owl:sameAs").alias("relation"), "value")


@query("result_read", "SELECT 'a:c' || c_custkey AS e1, 'b:c' || c_custkey AS e2, round(c_acctbal / 10000, 9) AS score FROM customer WHERE c_acctbal / 10000 > 0.2")
def _(spark, d):
    pred = _kinds(spark, d)[0]
    rows = pred.select("e1", F.lit("owl:sameAs").alias("relation"), "e2", F.lit(".#").alias("dot"), F.col("score").cast("string").alias("score"))
    return shown(loaders.result_pairs(rows, "a:c", 0.2), "score")


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which customers of graph 1 are which of graph 2, after the whole alignment."""
    a = Aligner(graph(spark, sf_dir, 1), graph(spark, sf_dir, 2), Params()).run()
    return a.assign.where(F.col("e1").startswith("a:c")).select("e1", "e2", F.round("score", 9).alias("score"))
