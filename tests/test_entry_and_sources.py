"""The registry without its optional part, and the loaders and sinks on small files."""

import shutil
import subprocess
import sys
from pathlib import Path

from twinegraph.sources import loaders, sinks

REPO = Path(__file__).resolve().parents[1]


def got(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_registry_without_the_optional_part(tmp_path):
    for name in ("twinegraph", "__spark_entry__.py"):
        source = REPO / name
        if source.is_dir():
            shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        else:
            shutil.copy(source, tmp_path / name)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and set(e.oracle_sql()) <= set(q); assert not any(k.startswith('op') for k in q)"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})


def test_openea(spark, tmp_path):
    for i in (1, 2):
        (tmp_path / f"rel_triples_{i}").write_text("http://e/a\thttp://e/p\thttp://e/b\nbad line\n")
        (tmp_path / f"attr_triples_{i}").write_text('http://e/a\thttp://e/n\t"4"^^<http://www.w3.org/2001/XMLSchema#integer>\nhttp://e/a\thttp://e/m\tplain "x"\nhttp://e/a\thttp://e/l\t"q"@en\n')
    t1, _ = loaders.load_openea(spark, str(tmp_path))
    assert got(t1, "p", "o") == [("http://e/l", '"q"@en'), ("http://e/m", "\"plain 'x'\""), ("http://e/n", '"4"^^xsd:integer'), ("http://e/p", "http://e/b")]
    assert loaders.bad_rows(spark, str(tmp_path / "rel_triples_1"), 3).count() == 1
    assert loaders.load_dataset.__name__ == "load_dataset"


def test_dbp15k(spark, tmp_path):
    for i in (1, 2):
        (tmp_path / f"ent_ids_{i}").write_text(f"1\thttp://e{i}/Big_Ben\n2\thttp://e{i}/London\n")
        (tmp_path / f"rel_ids_{i}").write_text(f"7\thttp://e{i}/in\n")
        (tmp_path / f"triples_{i}").write_text("1\t7\t2\n1\t9\t2\n")
        (tmp_path / f"att_triples_{i}").write_text(f'<http://e{i}/London> <http://e{i}/pop> "9"^^<http://www.w3.org/2001/XMLSchema#int> .\n')
    (tmp_path / "translated_google.txt").write_text("Grosse Ben\nLondres\n")
    (tmp_path / "sup_pairs").write_text("1\t1\n")
    (tmp_path / "ref_pairs").write_text("2\t2\n")
    t1, _ = loaders.load_dbp15k(spark, str(tmp_path))
    assert got(t1, "s", "p", "o") == [
        ("http://e1/Big_Ben", "EA:label", '"Big Ben"'), ("http://e1/Big_Ben", "http://e1/in", "http://e1/London"),
        ("http://e1/London", "EA:label", '"London"'), ("http://e1/London", "http://e1/pop", '"9"^^xsd:int')]
    t1, _ = loaders.load_dbp15k(spark, str(tmp_path), trans=True, attr=False)
    assert ("http://e1/London", '"Londres"') in got(t1, "s", "o")
    train, test = loaders.load_dbp15k_gold(spark, str(tmp_path))
    assert got(train, "e1", "e2") == [("http://e1/Big_Ben", "http://e2/Big_Ben")] and got(test, "e2") == [("http://e2/London",)]


def test_oaei_xml(spark, tmp_path):
    (tmp_path / "reference.xml").write_text("""<rdf><map><Cell><entity1 rdf:resource="http://k/class/A"/><entity2 rdf:resource="http://l/class/B"/></Cell></map>
<map><Cell><entity1 rdf:resource="http://k/resource/r"/><entity2 rdf:resource="http://l/resource/s"/></Cell></map></rdf>""")
    assert got(loaders.load_oaei_gold(spark, str(tmp_path / "reference.xml"), "http://k/"), "kind", "e1", "e2") == [
        ("class", "<http://k/class/A>", "<http://l/class/B>"), ("instance", "<http://k/resource/r>", "<http://l/resource/s>")]
    (tmp_path / "source.xml").write_text("""<!DOCTYPE r [<!ENTITY e "and">]><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:rdfs="http://www.w3.org/2000/01/rdf-schema#" xmlns:k="http://k/">
<rdf:Description rdf:about="http://k/x"><rdfs:label xml:lang="en">X "1" &e; 2</rdfs:label><k:of rdf:resource="http://k/y"/><k:n><![CDATA[<3]]></k:n></rdf:Description>
<k:City rdf:about="http://k/c" k:code="7"><k:mayor><k:Person rdf:about="http://k/p"><k:age rdf:datatype="http://www.w3.org/2001/XMLSchema#int">40</k:age></k:Person></k:mayor></k:City></rdf:RDF>""")
    assert got(loaders.read_rdf_xml(spark, str(tmp_path / "source.xml")), "s", "p", "o") == sorted([
        ("<http://k/x>", "k:of", "<http://k/y>"), ("<http://k/x>", "rdfs:label", "\"X '1' and 2\"@en"), ("<http://k/x>", "k:n", '"<3"'), ("<http://k/c>", "rdf:type", "k:City"), ("<http://k/c>", "k:code", '"7"'),
        ("<http://k/c>", "k:mayor", "<http://k/p>"), ("<http://k/p>", "rdf:type", "k:Person"), ("<http://k/p>", "k:age", '"40"^^xsd:int')])


def test_seeds_and_results(spark, tmp_path):
    (tmp_path / "seeds").write_text("a\tx\nb\ty\t0.4\nb\ty\t0.6\n")
    assert got(loaders.load_seeds(spark, str(tmp_path / "seeds")), "e1", "e2", "score") == [("a", "x", 1.0), ("b", "y", 0.6)]
    rows = spark.createDataFrame([("a", "owl:sameAs", "x", 0.9), ("p", "rdfs:subPropertyOf", "q", 0.2)], "left string, relation string, right string, score double")
    sinks.write_results(rows, str(tmp_path / "out"))
    assert got(loaders.load_results(spark, str(tmp_path / "out/lines"), "a"), "e1", "e2", "score") == [("a", "x", 0.9)]
    assert spark.read.parquet(str(tmp_path / "out/table")).count() == 2


def test_route_results(spark):
    gold = spark.createDataFrame([("property", "<k/property/p>", "<l/q>"), ("instance", "<k/r>", "<l/s>")], "kind string, e1 string, e2 string")
    rows = spark.createDataFrame([
        ("<k/r>", "owl:sameAs", "<l/s>", 0.9), ("<k/property/p>", "rdfs:subPropertyOf", "<l/q>", 0.8), ("<l/q>", "rdfs:subPropertyOf", "<k/property/p>", 0.5)], "e1 string, relation string, e2 string, score double")
    assert got(loaders.route_results(rows, gold, "k/"), "kind", "e1", "e2", "score") == [
        ("instance", "<k/r>", "<l/s>", 0.9), ("similar", "<k/property/p>", "<l/q>", 0.5), ("similar", "<l/q>", "<k/property/p>", 0.5)]
