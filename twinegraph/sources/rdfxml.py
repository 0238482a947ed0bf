"""RDF/XML to triples: node elements, typed nodes, property attributes, nesting, collections and blank nodes.

Names stay as the file's prefixes write them; IRIs from attributes stand in angle brackets. Entities and
CDATA are the XML parser's work. A file that is no XML raises an error that names it; nothing is left out silently.
"""

from __future__ import annotations

import io
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The namespaces that RDF/XML itself uses.
RDF = "{http://www.w3.org/1999/02/22-rdf-syntax-ns#}"
XML = "{http://www.w3.org/XML/1998/namespace}"
XML_SCHEMA = "http://www.w3.org/2001/XMLSchema#"


def _literal(text: str, lang: str | None, kind: str | None) -> str:
    text = text.replace("\n", "\\n").replace("\t", "\\t").replace("\r", "").replace('"', "'")
    if kind:
        return f'"{text}"^^' + ("xsd:" + kind[len(XML_SCHEMA) :] if kind.startswith(XML_SCHEMA) else kind)
    return f'"{text}"' + (f"@{lang}" if lang else "")


def parse(text: str, tag: str = "") -> Iterator[tuple[str, str, str]]:
    """The triples of a document. ``tag`` keeps the blank nodes of different files apart."""
    prefixes: dict[str, str] = {}
    root = None
    for event, x in ElementTree.iterparse(io.BytesIO(text.encode()), ("start-ns", "start")):
        if event == "start-ns":
            prefixes.setdefault(x[1], x[0])
        elif root is None:
            root = x
    if root is None:
        return
    count = 0

    def name(tag_: str) -> str:
        space, _, local = tag_[1:].rpartition("}") if tag_[0] == "{" else ("", "", tag_)
        if space in prefixes:
            return f"{prefixes[space]}:{local}" if prefixes[space] else local
        return f"<{space}{local}>"

    def blank(given: str | None = None) -> str:
        nonlocal count
        count += given is None
        return f"_:{tag}{given if given is not None else f'n{count}'}"

    # A stack instead of recursion: documents may nest deeper than Python does.
    todo: list[tuple] = [("node", x, None, root.get(XML + "lang")) for x in reversed(root)] if root.tag == RDF + "RDF" else [("node", root, None, None)]
    while todo:
        kind, x, subject, lang = todo.pop()
        lang = x.get(XML + "lang", lang)
        if kind == "node":
            if subject is None:
                subject = f"<{x.get(RDF + 'about')}>" if RDF + "about" in x.attrib else f"<#{x.get(RDF + 'ID')}>" if RDF + "ID" in x.attrib else blank(x.get(RDF + "nodeID"))
            if x.tag != RDF + "Description":
                yield subject, "rdf:type", name(x.tag)
            for k, v in x.attrib.items():
                if k == RDF + "type":
                    yield subject, "rdf:type", f"<{v}>"
                elif not k.startswith((RDF, XML)):
                    yield subject, name(k), _literal(v, lang, None)
            todo += [("property", y, subject, lang) for y in reversed(x)]
            continue
        p, how = name(x.tag), x.get(RDF + "parseType")
        inside = list(x)
        if how == "Collection":
            at = blank() if inside else "rdf:nil"
            yield subject, p, at
            for i, y in enumerate(inside):
                own = f"<{y.get(RDF + 'about')}>" if RDF + "about" in y.attrib else blank(y.get(RDF + "nodeID"))
                following = blank() if i + 1 < len(inside) else "rdf:nil"
                yield at, "rdf:first", own
                yield at, "rdf:rest", following
                todo.append(("node", y, own, lang))
                at = following
        elif how == "Resource":
            own = blank()
            yield subject, p, own
            todo += [("property", y, own, lang) for y in reversed(inside)]
        elif RDF + "resource" in x.attrib or RDF + "nodeID" in x.attrib:
            yield subject, p, f"<{x.get(RDF + 'resource')}>" if RDF + "resource" in x.attrib else blank(x.get(RDF + "nodeID"))
        elif how == "Literal":
            yield subject, p, _literal((x.text or "") + "".join(ElementTree.tostring(y, "unicode") for y in inside), None, None)
        elif inside:
            for y in inside:
                own = f"<{y.get(RDF + 'about')}>" if RDF + "about" in y.attrib else f"<#{y.get(RDF + 'ID')}>" if RDF + "ID" in y.attrib else blank(y.get(RDF + "nodeID"))
                yield subject, p, own
                todo.append(("node", y, own, lang))
        else:
            yield subject, p, _literal(x.text or "", lang, x.get(RDF + "datatype"))


def read_rdf_xml(spark: SparkSession, path: str) -> DataFrame:
    """(s, p, o) of all files under ``path``, distinct."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    rows = list(parse(text, f"{zlib.crc32(file.rsplit('/', 1)[-1].encode()):x}."))
                except ElementTree.ParseError as e:
                    raise ValueError(f"{file} is no XML: {e}") from e
                for lo in range(0, len(rows), 50_000):
                    cols = zip(*rows[lo : lo + 50_000], strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], ["s", "p", "o"])

    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    return files.mapInArrow(run, "s string, p string, o string").distinct()
