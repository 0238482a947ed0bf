"""Two knowledge graphs over the star-schema tables, and the same rows in SQL.

Graph 1 (``a:``) and graph 2 (``b:``) tell of the same customers, orders, nations and regions
with other identifiers. Labels share a predicate, the others don't. Graph 2 leaves out one
market segment, writes the names of customers in debt in capitals and cuts the dates of
finished orders to months, so that exact, lower-case and prefix matches all occur.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import inverse_closure


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _node(prefix: str, kind: str, key: str) -> Column:
    return F.concat(F.lit(f"{prefix}:{kind}"), F.col(key).cast("string"))


def _quoted(c: Column, dtype: str = "") -> Column:
    return F.concat(F.lit('"'), c, F.lit('"' + (f"^^{dtype}" if dtype else "")))


def _cents(c: str) -> Column:
    return F.round(F.col(c) * 100).cast("long").cast("string")


def facts(spark: SparkSession, sf_dir: str, kb: int) -> DataFrame:
    """(s, p, o) of one graph, forwards only."""
    return _rows(spark, sf_dir, kb).distinct()


def _rows(spark: SparkSession, sf_dir: str, kb: int) -> DataFrame:
    x = "ab"[kb - 1]
    c, n, r = read(spark, sf_dir, "customer"), read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    o = read(spark, sf_dir, "orders")
    name, date = F.col("c_name"), F.date_format("o_orderdate", "yyyy-MM-dd")
    balance, nation, region, price, day, buyer = ("a:balance", "a:nation", "a:region", "a:price", "a:date", "a:buyer") if kb == 1 else ("b:account", "b:country", "b:continent", "b:total", "b:day", "b:customer")
    if kb == 2:
        c = c.where(F.col("c_mktsegment") != "MACHINERY")
        name = F.when(F.col("c_acctbal") < 0, F.upper(name)).otherwise(name)
        date = F.when(F.col("o_orderstatus") == "F", F.substring(date, 1, 7)).otherwise(date)
    rows = [
        c.select(_node(x, "c", "c_custkey").alias("s"), F.lit("rdfs:label").alias("p"), _quoted(name).alias("o")),
        c.select(_node(x, "c", "c_custkey"), F.lit(balance), _quoted(_cents("c_acctbal"), "xsd:integer")),
        c.select(_node(x, "c", "c_custkey"), F.lit(nation), _node(x, "n", "c_nationkey")),
        n.select(_node(x, "n", "n_nationkey"), F.lit("rdfs:label"), _quoted(F.col("n_name"))),
        n.select(_node(x, "n", "n_nationkey"), F.lit(region), _node(x, "r", "n_regionkey")),
        r.select(_node(x, "r", "r_regionkey"), F.lit("rdfs:label"), _quoted(F.col("r_name"))),
        o.select(_node(x, "o", "o_orderkey"), F.lit(price), _quoted(_cents("o_totalprice"), "xsd:integer")),
        o.select(_node(x, "o", "o_orderkey"), F.lit(day), _quoted(date, "xsd:date" if kb == 1 else "xsd:gYearMonth")),
        o.select(_node(x, "o", "o_orderkey"), F.lit(buyer), _node(x, "c", "o_custkey")),
    ]
    out = rows[0]
    for other in rows[1:]:
        out = out.union(other)
    return out


def graph(spark: SparkSession, sf_dir: str, kb: int) -> DataFrame:
    return inverse_closure(_rows(spark, sf_dir, kb))  # the closure drops repeated facts itself


def _facts_sql(kb: int) -> str:
    x = "ab"[kb - 1]
    balance, nation, region, price, day, buyer = ("a:balance", "a:nation", "a:region", "a:price", "a:date", "a:buyer") if kb == 1 else ("b:account", "b:country", "b:continent", "b:total", "b:day", "b:customer")
    name = "c_name" if kb == 1 else "CASE WHEN c_acctbal < 0 THEN upper(c_name) ELSE c_name END"
    seg = "" if kb == 1 else " WHERE c_mktsegment <> 'MACHINERY'"
    date = "strftime(o_orderdate, '%Y-%m-%d')"
    if kb == 2:
        date = f"CASE WHEN o_orderstatus = 'F' THEN substr({date}, 1, 7) ELSE {date} END"
    cents = lambda c: f"CAST(CAST(round({c} * 100) AS BIGINT) AS VARCHAR)"
    parts = [
        f"SELECT '{x}:c' || c_custkey AS s, 'rdfs:label' AS p, '\"' || {name} || '\"' AS o FROM customer{seg}",
        f"SELECT '{x}:c' || c_custkey, '{balance}', '\"' || {cents('c_acctbal')} || '\"^^xsd:integer' FROM customer{seg}",
        f"SELECT '{x}:c' || c_custkey, '{nation}', '{x}:n' || c_nationkey FROM customer{seg}",
        f"SELECT '{x}:n' || n_nationkey, 'rdfs:label', '\"' || n_name || '\"' FROM nation",
        f"SELECT '{x}:n' || n_nationkey, '{region}', '{x}:r' || n_regionkey FROM nation",
        f"SELECT '{x}:r' || r_regionkey, 'rdfs:label', '\"' || r_name || '\"' FROM region",
        f"SELECT '{x}:o' || o_orderkey, '{price}', '\"' || {cents('o_totalprice')} || '\"^^xsd:integer' FROM orders",
        f"SELECT '{x}:o' || o_orderkey, '{day}', '\"' || {date} || '\"^^{'xsd:date' if kb == 1 else 'xsd:gYearMonth'}' FROM orders",
        f"SELECT '{x}:o' || o_orderkey, '{buyer}', '{x}:c' || o_custkey FROM orders",
    ]
    return " UNION ".join(parts)


def _closed(name: str, sql: str) -> str:
    flip = "CASE WHEN p LIKE '%-' THEN substr(p, 1, length(p) - 1) ELSE p || '-' END"
    return f"{name}_facts AS ({sql}), {name} AS (SELECT s, p, o FROM {name}_facts UNION SELECT o, {flip}, s FROM {name}_facts)"


#: Common table expressions t1 and t2: both graphs, closed.
GRAPHS_SQL = _closed("t1", _facts_sql(1)) + ", " + _closed("t2", _facts_sql(2))


def line_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as a graph: what each line's order, part and supplier are."""
    li = read(spark, sf_dir, "lineitem")
    line = F.concat(F.lit("l"), F.col("l_orderkey").cast("string"), F.lit("_"), F.col("l_linenumber").cast("string")).alias("s")
    out = None
    for p, k in (("order", "l_orderkey"), ("part", "l_partkey"), ("supplier", "l_suppkey")):
        d = li.select(line, F.lit(p).alias("p"), F.concat(F.lit(p[0]), F.col(k).cast("string")).alias("o"))
        out = d if out is None else out.union(d)
    return out.distinct()


LINES_SQL = "lines AS (" + " UNION ".join(f"SELECT 'l' || l_orderkey || '_' || l_linenumber AS s, '{p}' AS p, '{p[0]}' || {k} AS o FROM lineitem" for p, k in (("order", "l_orderkey"), ("part", "l_partkey"), ("supplier", "l_suppkey"))) + ")"
