"""Datasets in tab-separated, id-encoded and XML form to triples, seeds and gold pairs.

Lines are split by tabs alone, as literals hold quotes and backslashes. Rows with
another number of fields are set apart, not raised on (``bad_rows``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.terms import local_name, sanitise_literal
from .rdfxml import read_rdf_xml
from .turtle import read_turtle

# Fixed value: how datatypes are written in full.
XML_SCHEMA = "http://www.w3.org/2001/XMLSchema#"


def fields(spark: SparkSession, path: str, names: list[str], optional: int = 0) -> DataFrame:
    """A column per tab-separated field; rows with another number of fields are left out."""
    parts = F.split(F.regexp_replace("value", r"\r$", ""), "\t")
    rows = spark.read.text(path).select(parts.alias("f")).where(F.size("f").between(len(names) - optional, len(names)))
    return rows.select(*[F.get("f", i).alias(n) for i, n in enumerate(names)])


def bad_rows(spark: SparkSession, path: str, n_fields: int) -> DataFrame:
    return spark.read.text(path).where(F.size(F.split("value", "\t")) != n_fields)


def as_literal(value: Column) -> Column:
    """Quoted and with short datatypes."""
    typed = value.rlike(r'\^\^')
    lex = F.regexp_replace(F.substring_index(value, "^^", 1), '^"|"$', "")
    kind = F.regexp_replace(F.regexp_replace(F.substring_index(value, "^^", -1), "[<>]", ""), "^" + XML_SCHEMA, "xsd:")
    quote = lambda x: F.concat(F.lit('"'), F.replace(sanitise_literal(x), F.lit('"'), F.lit("'")), F.lit('"'))
    plain = F.when(value.rlike('^".*"(@[a-z-]+)?$'), value).otherwise(quote(value))
    return F.when(typed, F.concat(quote(lex), F.lit("^^"), kind)).otherwise(plain)


def load_openea(spark: SparkSession, folder: str, attr: bool = True) -> tuple[DataFrame, DataFrame]:
    """Both graphs' facts from rel_triples_i and attr_triples_i."""

    def one(i: int) -> DataFrame:
        out = fields(spark, f"{folder}/rel_triples_{i}", ["s", "p", "o"])
        if attr:
            a = fields(spark, f"{folder}/attr_triples_{i}", ["s", "p", "o"])
            out = out.unionByName(a.select("s", "p", as_literal(F.col("o")).alias("o")))
        return out.distinct()

    return one(1), one(2)


def dictionary_decode(triples: DataFrame, nodes: DataFrame, relations: DataFrame) -> DataFrame:
    """Id triples (s, p, o) by two dictionaries (id, iri) to named ones."""
    n = lambda c: nodes.select(F.col("id").alias(c), F.col("iri").alias(f"{c}_iri"))
    r = relations.select(F.col("id").alias("p"), F.col("iri").alias("p_iri"))
    return triples.join(n("s"), "s").join(r, "p").join(n("o"), "o").select(F.col("s_iri").alias("s"), F.col("p_iri").alias("p"), F.col("o_iri").alias("o"))


def iri_labels(nodes: DataFrame) -> DataFrame:
    """A label fact per node: the last part of its IRI, with blanks for underscores."""
    label = F.concat(F.lit('"'), sanitise_literal(F.translate(local_name(F.col("iri")), "_", " ")), F.lit('"'))
    return nodes.select(F.col("iri").alias("s"), F.lit("EA:label").alias("p"), label.alias("o"))


def load_dbp15k(spark: SparkSession, folder: str, trans: bool = False, attr: bool = True, name: bool = True) -> tuple[DataFrame, DataFrame]:
    def one(i: int) -> DataFrame:
        nodes, relations = (fields(spark, f"{folder}/{k}_ids_{i}", ["id", "iri"]) for k in ("ent", "rel"))
        out = dictionary_decode(fields(spark, f"{folder}/triples_{i}", ["s", "p", "o"]), nodes, relations)
        if name and trans and i == 1:
            out = out.unionByName(translated_labels(spark, f"{folder}/ent_ids_1", f"{folder}/translated_google.txt"))
        elif name:
            out = out.unionByName(iri_labels(nodes))
        if attr:
            bare = lambda c: F.regexp_replace(c, "^<|>$", "")
            a = read_turtle(spark, f"{folder}/att_triples_{i}").select(bare("s").alias("s"), bare("p").alias("p"), as_literal(F.col("o")).alias("o"))
            out = out.unionByName(a)
        return out.distinct()

    return one(1), one(2)


def translated_labels(spark: SparkSession, ids_path: str, names_path: str) -> DataFrame:
    """Labels from a file whose n-th line names the n-th node. Both files are read whole, so that lines keep their numbers."""
    lines = lambda p: spark.read.text(p, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", "\n$", ""), "\n")).alias("n", "line"))
    ids = lines(ids_path).select("n", F.get(F.split("line", "\t"), 1).alias("s"))
    named = ids.join(lines(names_path), "n")
    return named.select("s", F.lit("EA:label").alias("p"), F.concat(F.lit('"'), sanitise_literal(F.col("line")), F.lit('"')).alias("o"))


def load_oaei(spark: SparkSession, folder: str, format: str = "ttl") -> tuple[DataFrame, DataFrame]:
    read = read_rdf_xml if format == "xml" else read_turtle
    return read(spark, f"{folder}/source.{format}"), read(spark, f"{folder}/target.{format}")


def load_small_test(spark: SparkSession, base: str) -> tuple[DataFrame, DataFrame]:
    return read_turtle(spark, f"{base}1.ttl"), read_turtle(spark, f"{base}2.ttl")


LOADERS = {"OpenEA": load_openea, "DBP15k": load_dbp15k, "OAEI": load_oaei, "small-test": load_small_test}


def load_dataset(spark: SparkSession, location: str) -> tuple[DataFrame, DataFrame]:
    """By the first loader whose name the location holds."""
    for name, load in LOADERS.items():
        if name in location:
            return load(spark, location)
    raise ValueError(f"no loader for {location}")


def load_seeds(spark: SparkSession, path: str) -> DataFrame:
    """(e1, e2, score): pairs with an optional score, 1 if left out; a pair that repeats takes its greatest score."""
    rows = fields(spark, path, ["e1", "e2", "score"], optional=1)
    return seed_pairs(rows)


def seed_pairs(rows: DataFrame) -> DataFrame:
    return rows.groupBy("e1", "e2").agg(F.max(F.coalesce(F.col("score").cast("double"), F.lit(1.0))).alias("score"))


def load_openea_gold(spark: SparkSession, path: str) -> DataFrame:
    return fields(spark, path, ["e1", "e2"]).distinct()


def load_dbp15k_gold(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Training and test pairs, decoded by the two dictionaries; of pairs that repeat a key the one with the greatest partner stays."""
    ids = [fields(spark, f"{folder}/ent_ids_{i}", [f"id{i}", f"e{i}"]) for i in (1, 2)]
    read = lambda f: fields(spark, f"{folder}/{f}", ["id1", "id2"]).join(ids[0], "id1").join(ids[1], "id2").groupBy("e1").agg(F.max("e2").alias("e2"))
    return read("sup_pairs"), read("ref_pairs")


def load_oaei_gold(spark: SparkSession, path: str, prefix: str) -> DataFrame:
    """(kind, e1, e2): kind by the IRI under ``prefix``."""
    cells = spark.read.format("xml").option("rowTag", "Cell").load(path)
    e1, e2 = F.col("entity1._rdf:resource"), F.col("entity2._rdf:resource")
    kind = lambda e: F.when(e.startswith(prefix + "class/"), "class").when(e.startswith(prefix + "property/"), "property").when(e.startswith(prefix + "resource/"), "instance").otherwise(F.raise_error(F.concat(F.lit("no kind for "), e)))
    wrap = lambda e: F.concat(F.lit("<"), e, F.lit(">"))
    return cells.select(kind(e1).alias("kind"), wrap(e1).alias("e1"), wrap(e2).alias("e2"))


def load_embeddings(spark: SparkSession, path: str) -> DataFrame:
    """(key, vec) from Parquet; pickled stores are not read."""
    return spark.read.parquet(path).select("key", "vec")


def load_results(spark: SparkSession, path: str, prefix: str, threshold: float = 0.0) -> DataFrame:
    """(e1, e2, score) of a result file's rows whose left side starts with ``prefix`` and whose score is above the threshold."""
    rows = fields(spark, path, ["e1", "relation", "e2", "dot", "score"])
    return result_pairs(rows, prefix, threshold)


def result_pairs(rows: DataFrame, prefix: str, threshold: float = 0.0) -> DataFrame:
    score = F.col("score").cast("double")
    return rows.where(F.col("e1").startswith(prefix) & (score > threshold)).groupBy("e1", "e2").agg(F.max(score).alias("score"))


def route_results(rows: DataFrame, gold: DataFrame, prefix: str) -> DataFrame:
    """(kind, e1, e2, score) of result rows (e1, relation, e2, score) whose side is in the gold pairs.

    kind: instance, class, property (same) or similar (from inclusions, the lower score of both directions, in both directions).
    """
    known = gold.select(F.col("e1").alias("g"), F.col("kind").alias("gold_kind")).distinct()
    rows = rows.select("e1", "relation", "e2", F.col("score").cast("double").alias("score"))
    left = rows.join(known, F.col("e1") == F.col("g"), "left").drop("g")
    direct = left.where("gold_kind in ('instance', 'class') or (gold_kind = 'property' and relation = 'owl:sameAs')").select(F.col("gold_kind").alias("kind"), "e1", "e2", "score")
    props = known.where("gold_kind = 'property'").select("g")
    sub = rows.where((F.col("relation") != "owl:sameAs") & (F.col("e1").startswith("<" + prefix + "property/") | F.col("e2").startswith("<" + prefix + "property/")))
    sub = sub.join(props, F.col("e1") == F.col("g"), "left_semi").unionByName(sub.join(props, F.col("e2") == F.col("g"), "left_semi")).distinct()
    back = sub.select(F.col("e1").alias("e2"), F.col("e2").alias("e1"), F.col("score").alias("back"))
    both = sub.join(back, ["e1", "e2"], "left").select("e1", "e2", F.least("score", F.coalesce("back", F.lit(1.0))).alias("score"))
    similar = both.unionByName(both.select(F.col("e2").alias("e1"), F.col("e1").alias("e2"), "score")).groupBy("e1", "e2").agg(F.min("score").alias("score"))
    return direct.unionByName(similar.select(F.lit("similar").alias("kind"), "e1", "e2", "score"))
