"""Queries for sources, sinks, gold readers, text helpers and two rounds of the fixpoint.

A source's query writes a fixture from the star-schema tables in the source's own format to the shared folder, reads
it with the loader and is compared with SQL over the tables.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import terms, text
from ..operators import encode, literals
from ..operators.functionality import MOST_PAIRS
from ..operators.graph import KnowledgeGraph
from ..operators.rounds import cut, new_folder
from ..sources import loaders, sinks, turtle
from . import command
from .catalogue import BILATERAL, EVIDENCE_CTE, FUN2_CTE, INCLUSION, LIT, MATCH_CTE, QUERIES, RULE_CTE, START_CTE, G, query, shown  # noqa: F401
from .catalogue import _gold as gold_pairs
from .fixpoint import Aligner, Params, result_rows
from .tables import graph, read


def lines_to(df: DataFrame, value: Column, path: str) -> None:
    df.select(value.alias("value")).write.mode("overwrite").text(path)


def tabbed(*cols) -> Column:
    return F.concat_ws("\t", *cols)


def num(c: str) -> Column:
    return F.col(c).cast("string")


# --- sources


@query("turtle_read", G("SELECT s, p, o FROM t1_facts"))
def _(spark, d):
    """Graph 1 as Turtle text, through the tokenizer and the assembler, without its inverses."""
    path = new_folder(spark, "turtle") + "/t"
    sinks.write_graph(KnowledgeGraph(graph(spark, d, 1)), path)
    return turtle.read_turtle(spark, path)


@query("turtle_read_kb", G("SELECT s, p, o FROM t2"))
def _(spark, d):
    path = new_folder(spark, "turtle") + "/t"
    sinks.write_graph(KnowledgeGraph(graph(spark, d, 2)), path)
    return turtle.read_kb(spark, path)


@query("turtle_load", G("SELECT s, p, o FROM t1 UNION SELECT s, p, o FROM t2"))
def _(spark, d):
    """A file added to a graph that is already there."""
    path = new_folder(spark, "turtle") + "/t"
    sinks.write_graph(KnowledgeGraph(graph(spark, d, 2)), path)
    return KnowledgeGraph(graph(spark, d, 1)).load_turtle(path).triples


@query("turtle_blank_nodes", "SELECT 'n:' || n_nationkey AS s, 'x:name' AS p, '\"' || n_name || '\"' AS o FROM nation UNION ALL SELECT 'n:' || n_nationkey, 'x:code', '\"' || n_regionkey || '\"^^xsd:int' FROM nation")
def _(spark, d):
    """Facts behind blank nodes, joined back to the node that holds them."""
    path = new_folder(spark, "turtle") + "/t"
    body = F.concat(F.lit("n:"), num("n_nationkey"), F.lit(' x:has [ x:name "'), F.col("n_name"), F.lit('" ; x:code "'), num("n_regionkey"), F.lit('"^^xsd:int ] .'))
    lines_to(read(spark, d, "nation"), body, path)
    t = turtle.read_turtle(spark, path)
    held = t.where("p = 'x:has'").select("s", F.col("o").alias("blank"))
    return held.join(t.select(F.col("s").alias("blank"), "p", "o"), "blank").select("s", "p", "o")


XSD = "^^<http://www.w3.org/2001/XMLSchema#"


@query("openea_load", f"""SELECT 'http://e/c' || c_custkey AS s, 'http://e/nation' AS p, 'http://e/n' || c_nationkey AS o FROM customer
UNION SELECT 'http://e/c' || c_custkey, 'http://e/label', '"' || c_name || '"' FROM customer
UNION SELECT 'http://e/c' || c_custkey, 'http://e/segment', '"' || c_mktsegment || '"@en' FROM customer
UNION SELECT 'http://e/c' || c_custkey, 'http://e/key', '"' || c_custkey || '"^^xsd:integer' FROM customer""")
def _(spark, d):
    """Through the dispatcher, which picks the loader by the folder's name."""
    folder = new_folder(spark, "in") + "/OpenEA"
    c = read(spark, d, "customer")
    s = F.concat(F.lit("http://e/c"), num("c_custkey"))
    e = lambda x: F.lit("http://e/" + x)
    rows = lambda n: c.select(s.alias("s"), n[0].alias("p"), n[1].alias("o"))
    attr = rows((e("label"), F.col("c_name"))).unionByName(rows((e("segment"), F.concat(F.lit('"'), "c_mktsegment", F.lit('"@en'))))).unionByName(rows((e("key"), F.concat(F.lit('"'), num("c_custkey"), F.lit('"' + XSD + "integer>")))))
    for i in (1, 2):
        lines_to(c, tabbed(s, e("nation"), F.concat(F.lit("http://e/n"), num("c_nationkey"))), f"{folder}/rel_triples_{i}")
        lines_to(attr, tabbed("s", "p", "o"), f"{folder}/attr_triples_{i}")
    return loaders.load_dataset(spark, folder)[0]


def _dbp15k(spark: SparkSession, d: str) -> str:
    folder = new_folder(spark, "in") + "/DBP15k"
    n = read(spark, d, "nation")
    r = read(spark, d, "region")
    node = lambda k, c: F.concat(F.lit(f"http://e/{k}/Big_"), F.col(c))
    ids = n.select(num("n_nationkey").alias("id"), node("n", "n_name").alias("iri")).unionByName(r.select((F.col("r_regionkey") + 1000).cast("string").alias("id"), node("r", "r_name").alias("iri")))
    for i in (1, 2):
        lines_to(ids, tabbed("id", "iri"), f"{folder}/ent_ids_{i}")
        lines_to(spark.range(1), F.lit("7\thttp://e/in"), f"{folder}/rel_ids_{i}")
        lines_to(n, tabbed(num("n_nationkey"), F.lit("7"), (F.col("n_regionkey") + 1000).cast("string")), f"{folder}/triples_{i}")
        lines_to(n, F.concat(F.lit("<"), node("n", "n_name"), F.lit('> <http://e/key> "'), num("n_nationkey"), F.lit('"' + XSD + "int> .")), f"{folder}/att_triples_{i}")
    lines_to(n.where("n_nationkey % 3 = 0"), tabbed(num("n_nationkey"), num("n_nationkey")), f"{folder}/sup_pairs")
    lines_to(n.where("n_nationkey % 3 <> 0"), tabbed(num("n_nationkey"), num("n_nationkey")), f"{folder}/ref_pairs")
    return folder


@query("dbp15k_load", """WITH e AS (SELECT 'http://e/n/Big_' || n_name AS s, 'http://e/r/Big_' || r_name AS o, n_nationkey AS k, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT s, 'http://e/in' AS p, o FROM e UNION SELECT s, 'EA:label', '"Big ' || replace(n_name, '_', ' ') || '"' FROM e UNION SELECT 'http://e/r/Big_' || r_name, 'EA:label', '"Big ' || replace(r_name, '_', ' ') || '"' FROM region UNION SELECT s, 'http://e/key', '"' || k || '"^^xsd:int' FROM e""")
def _(spark, d):
    return loaders.load_dataset(spark, _dbp15k(spark, d))[0]


@query("dbp15k_gold", "SELECT CASE WHEN n_nationkey % 3 = 0 THEN 'train' ELSE 'test' END AS fold, 'http://e/n/Big_' || n_name AS e1, 'http://e/n/Big_' || n_name AS e2 FROM nation")
def _(spark, d):
    train, test = loaders.load_dbp15k_gold(spark, _dbp15k(spark, d))
    return train.select(F.lit("train").alias("fold"), "e1", "e2").unionByName(test.select(F.lit("test").alias("fold"), "e1", "e2"))


@query("openea_gold", "SELECT DISTINCT 'a:c' || c_custkey AS e1, 'b:c' || c_custkey AS e2 FROM customer WHERE c_mktsegment <> 'MACHINERY'")
def _(spark, d):
    path = new_folder(spark, "in") + "/ent_links"
    lines_to(gold_pairs(spark, d), tabbed("e1", "e2"), path)
    return loaders.load_openea_gold(spark, path)


@query("oaei_gold", "SELECT CASE n_regionkey % 3 WHEN 0 THEN 'class' WHEN 1 THEN 'property' ELSE 'instance' END AS kind, '<http://k/' || CASE n_regionkey % 3 WHEN 0 THEN 'class' WHEN 1 THEN 'property' ELSE 'resource' END || '/' || n_nationkey || '>' AS e1, '<http://l/' || n_nationkey || '>' AS e2 FROM nation")
def _(spark, d):
    path = new_folder(spark, "in") + "/reference.xml"
    kind = F.element_at(F.array(F.lit("class"), F.lit("property"), F.lit("resource")), (F.col("n_regionkey") % 3 + 1).cast("int"))
    cell = F.concat(F.lit('<map><Cell><entity1 rdf:resource="http://k/'), kind, F.lit("/"), num("n_nationkey"), F.lit('"/><entity2 rdf:resource="http://l/'), num("n_nationkey"), F.lit('"/></Cell></map>'))
    whole = read(spark, d, "nation").agg(F.concat(F.lit("<rdf>"), F.array_join(F.sort_array(F.collect_list(cell)), "\n"), F.lit("</rdf>")).alias("x"))
    lines_to(whole, F.col("x"), path)
    return loaders.load_oaei_gold(spark, path, "http://k/")


@query("rdf_xml_read", """SELECT '<http://k/n' || n_nationkey || '>' AS s, 'rdf:type' AS p, 'k:Nation' AS o FROM nation
UNION SELECT '<http://k/n' || n_nationkey || '>', 'k:name', '"' || n_name || ' & co"@en' FROM nation
UNION SELECT '<http://k/n' || n_nationkey || '>', 'k:region', '<http://k/r' || n_regionkey || '>' FROM nation
UNION SELECT '<http://k/r' || n_regionkey || '>', 'k:size', '"' || n_regionkey || '"^^xsd:int' FROM nation""")
def _(spark, d):
    """Typed nodes, languages, entities and nested descriptions."""
    path = new_folder(spark, "in") + "/x"
    head = '<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:k="http://k/">'
    body = F.concat(F.lit('<k:Nation rdf:about="http://k/n'), num("n_nationkey"), F.lit('"><k:name xml:lang="en">'), F.col("n_name"), F.lit(' &amp; co</k:name><k:region><rdf:Description rdf:about="http://k/r'), num("n_regionkey"), F.lit('"><k:size rdf:datatype="http://www.w3.org/2001/XMLSchema#int">'), num("n_regionkey"), F.lit("</k:size></rdf:Description></k:region></k:Nation>"))
    whole = read(spark, d, "nation").agg(F.concat(F.lit(head), F.array_join(F.sort_array(F.collect_list(body)), ""), F.lit("</rdf:RDF>")).alias("x"))
    lines_to(whole, F.col("x"), path)
    return loaders.read_rdf_xml(spark, path)


@query("seed_file", "SELECT o_orderstatus AS e1, o_orderpriority AS e2, max(CASE WHEN o_orderkey % 2 = 0 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END) AS score FROM orders GROUP BY ALL")
def _(spark, d):
    path = new_folder(spark, "in") + "/seeds"
    lines_to(read(spark, d, "orders"), tabbed("o_orderstatus", "o_orderpriority", F.when(F.col("o_orderkey") % 2 != 0, "0.5")), path)
    return loaders.load_seeds(spark, path)


# --- sinks


def _scored(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "customer")
    name = lambda x: F.concat(F.lit(f"{x}:c"), num("c_custkey"))
    return c.select(name("a").alias("left"), F.lit("owl:sameAs").alias("relation"), name("b").alias("right"), ((F.col("c_custkey") % 997) / F.lit(1000.0)).alias("score"))


@query("result_write", "SELECT 'a:c' || c_custkey AS e1, 'b:c' || c_custkey AS e2, ((c_custkey % 997) / 1000.0::DOUBLE) AS score FROM customer WHERE ((c_custkey % 997) / 1000.0::DOUBLE) > 0.1")
def _(spark, d):
    """Lines with their header, written and read back."""
    path = new_folder(spark, "out") + "/result"
    sinks.write_results(_scored(spark, d), path)
    return loaders.load_results(spark, path + "/lines", "a:c", 0.1)


@query("result_header", "SELECT 34::BIGINT AS n, 1::BIGINT AS schema_org")
def _(spark, d):
    path = new_folder(spark, "out") + "/result"
    sinks.write_results(_scored(spark, d).where("left = 'a:c1'"), path)
    head = spark.read.text(path + "/lines").where("value like '@prefix %'")
    return head.agg(F.count("*").alias("n"), F.count_if(F.col("value") == "@prefix schema: <http://schema.org/> .").alias("schema_org"))


@query("clean_write", "SELECT c_mktsegment AS kind, 'a:c' || c_custkey AS e1, 'b:c' || c_custkey AS e2, ((c_custkey % 997) / 1000.0::DOUBLE) AS score FROM customer")
def _(spark, d):
    path = new_folder(spark, "out") + "/clean"
    kinds = read(spark, d, "customer").select(F.concat(F.lit("a:c"), num("c_custkey")).alias("left"), F.col("c_mktsegment").alias("kind"))
    sinks.write_clean(_scored(spark, d).join(kinds, "left").select("kind", F.col("left").alias("e1"), F.col("right").alias("e2"), "score"), path)
    back = spark.read.schema("e1 string, e2 string, score double, kind string").option("sep", "\t").csv(path)
    return back.select("kind", "e1", "e2", "score")


@query("embedding_store", "SELECT vec_id::VARCHAR AS key, round(list_sum([x::DOUBLE * x FOR x IN embedding]), 6) AS square FROM embeddings")
def _(spark, d):
    path = new_folder(spark, "out") + "/vectors"
    sinks.write_embeddings(read(spark, d, "embeddings").select(num("vec_id").alias("key"), F.col("embedding").alias("vec")), path)
    square = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return loaders.load_embeddings(spark, path).select("key", F.round(square, 6).alias("square"))


@query("result_routes", """WITH k AS (SELECT n_nationkey AS i, CASE n_nationkey % 3 WHEN 0 THEN 'instance' WHEN 1 THEN 'class' ELSE 'property' END AS kind FROM nation),
 x AS (SELECT *, '<k/' || kind || '/' || i || '>' AS e1, '<l/' || i || '>' AS e2, round((i + 1) / 50.0::DOUBLE, 6) AS v FROM k)
SELECT kind, e1, e2, v AS score FROM x WHERE kind <> 'property' UNION ALL SELECT 'similar', e1, e2, least(v, round(v / 2, 6)) FROM x WHERE kind = 'property' UNION ALL SELECT 'similar', e2, e1, least(v, round(v / 2, 6)) FROM x WHERE kind = 'property'""")
def _(spark, d):
    kind = F.element_at(F.array(F.lit("instance"), F.lit("class"), F.lit("property")), (F.col("n_nationkey") % 3 + 1).cast("int"))
    x = read(spark, d, "nation").select(kind.alias("kind"), F.concat(F.lit("<k/"), kind, F.lit("/"), num("n_nationkey"), F.lit(">")).alias("e1"), F.concat(F.lit("<l/"), num("n_nationkey"), F.lit(">")).alias("e2"), F.round((F.col("n_nationkey") + 1) / 50.0, 6).alias("v"))
    relation = F.when(F.col("kind") == "property", "rdfs:subPropertyOf").otherwise("owl:sameAs").alias("relation")
    rows = x.select("e1", relation, "e2", F.col("v").alias("score")).unionByName(x.where("kind = 'property'").select(F.col("e2").alias("e1"), F.lit("rdfs:subPropertyOf").alias("relation"), F.col("e1").alias("e2"), F.round(F.col("v") / 2, 6).alias("score")))
    return loaders.route_results(rows, x.select("kind", "e1", "e2"), "k/")


# --- graph, text and vectors


@query("some_subject", "SELECT 1::BIGINT AS n")
def _(spark, d):
    """Any subject: that it is one is all that can be said."""
    g = KnowledgeGraph(graph(spark, d, 1))
    return g.some_subject().join(g.subjects(), "s", "left_semi").agg(F.count("*").alias("n"))


@query("string_form", G("SELECT s || ' ' || string_agg(p || ' ' || o, ' ; ' ORDER BY p || ' ' || o) || ' .' AS value FROM t2 WHERE p NOT LIKE '%-' AND s LIKE 'b:n%' GROUP BY s"))
def _(spark, d):
    g = KnowledgeGraph(graph(spark, d, 2))
    return KnowledgeGraph(g.triples.where("s like 'b:n%'")).to_text()


@query("readable_words", r"""SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\s]+')) > 1 OR coalesce(NOT starts_with(text, 'http') AND (length(text) - length(regexp_replace(text, '[^\p{L}]', '', 'g')))::DOUBLE / nullif(length(text), 0) < 0.5, false) AS readable FROM documents""")
def _(spark, d):
    return read(spark, d, "documents").select("doc_id", text.is_readable(F.coalesce("text", F.lit(""))).alias("readable"))


LISTS_SQL = "l AS (SELECT l_orderkey, list(l_suppkey % 4 ORDER BY l_linenumber, l_suppkey, l_quantity) AS a, list(l_returnflag ORDER BY l_linenumber, l_suppkey, l_quantity) AS b FROM lineitem GROUP BY l_orderkey)"


def _lists(spark: SparkSession, d: str) -> DataFrame:
    parts = F.sort_array(F.collect_list(F.struct("l_linenumber", "l_suppkey", "l_quantity", "l_returnflag")))
    rows = read(spark, d, "lineitem").groupBy("l_orderkey").agg(parts.alias("x"))
    return rows.select("l_orderkey", F.transform("x", lambda r: r["l_suppkey"] % 4).alias("a"), F.transform("x", lambda r: r["l_returnflag"]).alias("b"))


@query("pattern_violated", f"WITH {LISTS_SQL} SELECT l_orderkey, len([i FOR i IN range(2, len(a) + 1) IF a[i] = a[i - 1] AND b[i] <> b[i - 1]]) > 0 AS broken FROM l")
def _(spark, d):
    return _lists(spark, d).select("l_orderkey", text.violated(F.col("a"), F.col("b")).alias("broken"))


@query("pattern_choices", """WITH l AS (SELECT l_orderkey, l_suppkey % 4 AS k, count(*) AS n FROM lineitem GROUP BY ALL) SELECT l_orderkey, round(exp(sum(ln(n))))::BIGINT AS n_choices, count(*)::BIGINT AS n_kinds FROM l GROUP BY l_orderkey""")
def _(spark, d):
    choices = _lists(spark, d).select("l_orderkey", text.unique_pattern_choices(F.col("a")).alias("c"))
    return choices.select("l_orderkey", F.size(F.array_distinct("c")).cast("long").alias("n_choices"), F.size(F.get("c", 0)).cast("long").alias("n_kinds"))


@query("cosine_of_neighbours", "SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def _(spark, d):
    v = read(spark, d, "embeddings").select("vec_id", "embedding")
    near = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return v.join(near, "vec_id").select("vec_id", F.round(text.cosine(F.col("embedding"), F.col("other")), 6).alias("score"))


@query("mean_pool", "SELECT vec_id, round(list_sum([embedding[i]::DOUBLE FOR i IN range(1, len(embedding) + 1) IF ((i - 1) // 4) % 2 = 0]) / ((len(embedding) // 4 + 1) // 2), 6) AS total FROM embeddings")
def _(spark, d):
    """A vector as tokens of four places, every second one masked."""

    @F.pandas_udf("double")
    def pooled(x: pd.Series) -> pd.Series:
        import numpy as np

        if x.empty:
            return pd.Series([], dtype=float)
        tokens = np.stack(x.to_list()).astype(float).reshape(len(x), -1, 4)
        mask = np.broadcast_to(np.arange(tokens.shape[1]) % 2 == 0, tokens.shape[:2])
        return pd.Series(encode.mean_pool(tokens, mask).sum(axis=1))

    return read(spark, d, "embeddings").select("vec_id", F.round(pooled("embedding"), 6).alias("total"))


@query("local_names", "SELECT url, regexp_extract(url, '[^/]*$') AS local FROM pages")
def _(spark, d):
    return read(spark, d, "pages").select("url", terms.local_name(F.col("url")).alias("local"))


@query("sanitised", r"""SELECT doc_id, md5(replace(replace(replace(replace(replace(text, chr(10), '\n'), chr(9), '\t'), chr(13), ''), '\"', ''''), '\u0022', '''')) AS digest FROM documents""")
def _(spark, d):
    return read(spark, d, "documents").select("doc_id", F.md5(terms.sanitise_literal(F.col("text")).cast("binary")).alias("digest"))


@query("embedding_corpus", G(f"""SELECT DISTINCT key FROM (SELECT regexp_extract(s, '^"([^"]*)"', 1) AS key FROM t1 WHERE {LIT('s')} AND s NOT LIKE '%^^%') WHERE length(key) > 1
 AND (len(string_split(trim(key), ' ')) > 1 OR length(regexp_replace(key, '[^\\p{{L}}]', '', 'g')) > 0.5 * length(key))"""))
def _(spark, d):
    return encode.embedding_corpus(graph(spark, d, 1))


@query("encoded_nearest", "SELECT c_name AS key, c_name AS nearest FROM customer")
def _(spark, d):
    """Names through the encoder; each one's nearest among all names is itself. A row per customer, whose names may repeat."""
    names = read(spark, d, "customer").select(F.col("c_name").alias("key"))
    vectors = cut(encode.encode_texts(names.where("key is not null").distinct()))
    near = literals.match_embedding(vectors, vectors, 0.999)
    return names.join(near.select(F.col("key1").alias("key"), F.col("key2").alias("nearest")), "key", "left")


@query("literal_match_seeds", G("""SELECT e1, e2, round(score, 9) AS score FROM lits WHERE e1 NOT LIKE '"Customer%' UNION ALL SELECT DISTINCT '"' || c_name || '"', 'b:c' || c_custkey, 0.5::DOUBLE FROM customer""", MATCH_CTE))
def _(spark, d):
    """Seeds take the place of whatever the literals themselves give for their left side."""
    seeds = read(spark, d, "customer").select(F.concat(F.lit('"'), "c_name", F.lit('"')).alias("e1"), F.concat(F.lit("b:c"), num("c_custkey")).alias("e2"), F.lit(0.5).alias("score"))
    return shown(literals.map_literals(graph(spark, d, 1), graph(spark, d, 2), seeds.distinct()), "score")


# --- the loop


def _started(spark, d):
    a = Aligner(graph(spark, d, 1), graph(spark, d, 2), Params(most_pairs=MOST_PAIRS))  # as the SQL has it
    return a, a.start()


@query("score_sum", G("SELECT round(sum(score), 4) AS total FROM same1", START_CTE))
def _(spark, d):
    total = _started(spark, d)[1].begin.total()
    return spark.range(1).select(F.round(F.lit(total), 4).alias("total"))


@query("start_result", G("""SELECT p AS "left", 'rdfs:subPropertyOf' AS relation, q AS "right", round(max(score), 9) AS score FROM (SELECT * FROM sub12 UNION ALL SELECT * FROM sub21) WHERE score > 0.1 GROUP BY p, q
UNION ALL SELECT e1, 'owl:sameAs', e2, round(score, 9) FROM same1 WHERE score > 0""", START_CTE))
def _(spark, d):
    return shown(result_rows(_started(spark, d)[1]), "score")


def _again(sql: str, old: int) -> str:
    """A round's statement over the state that the round before left."""
    new = {"a1": f"a{old}", "quasi": f"quasi{old}", "same1": f"same{old}", "same2": f"same{old + 1}"}
    own = "best1 best2 qb ev1 ev2 ev3 ev open cnt chosen c20 c21 c22 n1 n2 rule fresh".split()
    return re.sub(r"(?<![:'.\w])([a-z]\w*)\b", lambda m: new.get(m[1]) or (f"{m[1]}_{old}" if m[1] in own else m[1]), sql)


TWO_ROUNDS = f"""{FUN2_CTE}, {START_CTE}, {EVIDENCE_CTE}, {RULE_CTE}, {BILATERAL('same2', 'a2')}, a2f AS (SELECT e2 AS e1, e1 AS e2, score FROM a2),
 sub12_2 AS (SELECT p, q, max(score) AS score FROM (SELECT * FROM sub12 UNION ALL SELECT * FROM ({INCLUSION('t1', 't2', 'a2')})) GROUP BY p, q),
 sub21_2 AS (SELECT p, q, max(score) AS score FROM (SELECT * FROM sub21 UNION ALL SELECT * FROM ({INCLUSION('t2', 't1', 'a2f')})) GROUP BY p, q),
 quasi2 AS (SELECT p, q, max(score) AS score FROM (SELECT * FROM sub12_2 UNION ALL SELECT q AS p, p AS q, score FROM sub21_2) GROUP BY p, q),
 {_again(EVIDENCE_CTE, 2)}, {_again(RULE_CTE, 2)}"""


@query("fixpoint_2rounds", G("SELECT e1, e2, round(score, 9) AS score FROM same3", TWO_ROUNDS))
def _(spark, d):
    """All pairs after the start and two rounds of entity and predicate rules."""
    a, now = _started(spark, d)
    return shown(a.round(a.round(now)).same_as, "score")


@query("progress_table", "SELECT 2::BIGINT AS n_rounds, 5::DOUBLE AS assigned")
def _(spark, d):
    """What the command line's progress file holds: a row per round."""
    rounds = [{"round": i, "total": 1.0 * i, "change": 0.5, "risen": 3, "assigned": 5, "seconds": 0.1} for i in (1, 2)]
    path = new_folder(spark, "out") + "/progress"
    command.progress_rows(spark, rounds).write.json(path)
    return spark.read.json(path).agg(F.count("*").alias("n_rounds"), F.avg("assigned").alias("assigned"))


@query("evaluate_folder", """SELECT 'x' AS name, tp, fp, fn, round(tp / nullif(tp + fp, 0)::DOUBLE, 9) AS "precision", round(tp / nullif(tp + fn, 0)::DOUBLE, 9) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 9) AS f1,
  round(greatest(0, r - h), 9) AS recall_low, round(least(1, r + h), 9) AS recall_high FROM (SELECT *, tp / (tp + fn)::DOUBLE AS r, 1.959963984540054 * sqrt(tp / (tp + fn)::DOUBLE * (1 - tp / (tp + fn)::DOUBLE) / (tp + fn)) AS h FROM (
  SELECT count(*) FILTER (((c_custkey % 997) / 1000.0::DOUBLE) > 0 AND c_mktsegment <> 'MACHINERY') AS tp, count(*) FILTER (((c_custkey % 997) / 1000.0::DOUBLE) > 0 AND c_mktsegment = 'MACHINERY') AS fp, count(*) FILTER (((c_custkey % 997) / 1000.0::DOUBLE) = 0 AND c_mktsegment <> 'MACHINERY') AS fn FROM customer))""")
def _(spark, d):
    folder = new_folder(spark, "out")
    sinks.write_results(_scored(spark, d), folder + "/result")
    lines_to(gold_pairs(spark, d), tabbed("e1", "e2"), folder + "/gold")
    return shown(command.evaluate_folder(spark, {"x": folder + "/result/lines"}, {"x": folder + "/gold"}, "a:c"), "precision", "recall", "f1", "recall_low", "recall_high")
