"""Results out: tab-separated lines, Turtle-like text, Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The namespaces that a result's header names, in its order.
PREFIXES = {
    "yago": "http://yago-knowledge.org/resource/",
    "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#",
    "xsd": "http://www.w3.org/2001/XMLSchema#",
    "ontolex": "http://www.w3.org/ns/lemon/ontolex#",
    "dct": "http://purl.org/dc/terms/",
    "rdfs": "http://www.w3.org/2000/01/rdf-schema#",
    "owl": "http://www.w3.org/2002/07/owl#",
    "wikibase": "http://wikiba.se/ontology#",
    "skos": "http://www.w3.org/2004/02/skos/core#",
    "schema": "http://schema.org/",
    "cc": "http://creativecommons.org/ns#",
    "geo": "http://www.opengis.net/ont/geosparql#",
    "prov": "http://www.w3.org/ns/prov#",
    "wd": "http://www.wikidata.org/entity/",
    "data": "https://www.wikidata.org/wiki/Special:EntityData/",
    "sh": "http://www.w3.org/ns/shacl#",
    "s": "http://www.wikidata.org/entity/statement/",
    "ref": "http://www.wikidata.org/reference/",
    "v": "http://www.wikidata.org/value/",
    "wdt": "http://www.wikidata.org/prop/direct/",
    "wpq": "http://www.wikidata.org/prop/quant/",
    "wdtn": "http://www.wikidata.org/prop/direct-normalized/",
    "p": "http://www.wikidata.org/prop/",
    "ps": "http://www.wikidata.org/prop/statement/",
    "psv": "http://www.wikidata.org/prop/statement/value/",
    "psn": "http://www.wikidata.org/prop/statement/value-normalized/",
    "pq": "http://www.wikidata.org/prop/qualifier/",
    "pqv": "http://www.wikidata.org/prop/qualifier/value/",
    "pqn": "http://www.wikidata.org/prop/qualifier/value-normalized/",
    "pr": "http://www.wikidata.org/prop/reference/",
    "prv": "http://www.wikidata.org/prop/reference/value/",
    "prn": "http://www.wikidata.org/prop/reference/value-normalized/",
    "wdno": "http://www.wikidata.org/prop/novalue/",
    "ys": "http://yago-knowledge.org/schema#",
}


def header(spark) -> DataFrame:
    return spark.createDataFrame([(f"@prefix {k}: <{v}> .",) for k, v in PREFIXES.items()], "value string")


def result_lines(rows: DataFrame) -> DataFrame:
    """left, relation, right, ``.#`` and the score, by tabs."""
    return rows.select(F.concat_ws("\t", "left", "relation", "right", F.lit(".#"), F.col("score").cast("string")).alias("value"))


def write_results(rows: DataFrame, path: str) -> None:
    """A folder of text files, the header in its own, next to a Parquet copy for further queries."""
    header(rows.sparkSession).coalesce(1).write.mode("overwrite").text(path + "/lines")
    result_lines(rows).write.mode("append").text(path + "/lines")
    rows.write.mode("overwrite").parquet(path + "/table")


def write_clean(rows: DataFrame, path: str) -> None:
    """(kind, e1, e2, score), one folder per kind."""
    rows.select("kind", "e1", "e2", "score").write.mode("overwrite").partitionBy("kind").option("sep", "\t").csv(path)


def write_graph(graph, path: str) -> None:
    graph.to_text().write.mode("overwrite").text(path)


def write_embeddings(rows: DataFrame, path: str) -> None:
    rows.select("key", "vec").write.mode("overwrite").parquet(path)
