"""Turtle files to triples.

Prefixed names stay as written (prefixes are not expanded), literals keep their
quotes, language and datatype. A file is one unit of parsing, as long strings and lists make
lines depend on each other; files are read by Spark, so any store works, and spread over tasks.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_NAME = r"""(?:[^\s,;\[\]"'^@()<>.#]|\.(?=[^\s,;\[\]"'^@()<>.#]))+"""
_TOKEN = re.compile(
    r'''\s+|\#[^\n]*
    |(?P<directive>@(?:prefix|base)\b[^>\n]*<[^>]*>\s*\.|(?i:\b(?:prefix\s+[^\s:]*:|base)\s*<[^>]*>))
    |(?P<string>"""(?:[^"\\]|\\.|"(?!""))*"""|\'\'\'(?:[^'\\]|\\.|'(?!\'\'))*\'\'\'|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')
    |(?P<type>\^\^(?:<[^>]*>|''' + _NAME + r'''))
    |(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
    |(?P<iri><[^>]*>)
    |(?P<mark>[.,;\[\]()])
    |(?P<name>''' + _NAME + ''')
    |(?P<other>.)''',
    re.X | re.S,
)


def _plain(text: str) -> str:
    for quote in ('"""', "'" * 3, '"', "'"):
        if text.startswith(quote):
            text = text[len(quote) : -len(quote)]
            break
    for a, b in (('\\"', "'"), ("\\u0022", "'"), ('"', "'"), ("\r", ""), ("\n", "\\n"), ("\t", "\\t")):
        text = text.replace(a, b)
    return text


def tokens(text: str) -> Iterator[tuple[str, str]]:
    """(kind, value): kind is term or mark. A literal's language or datatype is part of the term."""
    held: str | None = None
    for m in _TOKEN.finditer(text):
        kind, value = m.lastgroup, m[0]
        if held is not None and kind in ("type", "lang"):
            yield "term", held + value
            held = None
            continue
        if held is not None:
            yield "term", held
            held = None
        if kind == "string":
            held = f'"{_plain(value)}"'
        elif kind in ("iri", "name"):
            yield "term", value
        elif kind == "mark":
            yield "mark", value
    if held is not None:
        yield "term", held


def parse(text: str, tag: str = "") -> Iterator[tuple[str, str, str]]:
    """The triples of a Turtle text. ``tag`` keeps the blank nodes of different files apart."""
    stream = tokens(text)
    out: list[tuple[str, str, str]] = []
    count = 0

    def fresh(s: str, p: str) -> str:
        nonlocal count
        count += 1
        last = lambda x: re.sub(r"\W+", "", re.split(r"[/#:]", x.strip("<>"))[-1])
        return f"ys:{last(s)}_{last(p)}_{tag}{count}"

    def node(kind: str, value: str, s: str, p: str) -> str:
        if kind == "term":
            return value
        if value == "[":
            b = fresh(s, p)
            facts(b, "]")
            return b
        items = []
        for k, v in stream:
            if (k, v) == ("mark", ")"):
                break
            items.append(node(k, v, s, p))
        cells = [fresh(s, p) for _ in items] + ["rdf:nil"]
        for cell, item, rest in zip(cells, items, cells[1:], strict=False):
            out.append((cell, "rdf:first", item))
            out.append((cell, "rdf:rest", rest))
        return cells[0]

    def facts(s: str, end: str) -> None:
        p: str | None = None
        for kind, value in stream:
            if kind == "mark" and value == end:
                return
            if kind == "mark" and value == ";":
                p = None
            elif kind == "mark" and value in ".])":
                return
            elif kind == "mark" and value == ",":
                continue
            elif p is None:
                p = "rdf:type" if value == "a" else value
            else:
                out.append((s, p, node(kind, value, s, p)))

    for kind, value in stream:
        if kind == "mark" and value not in "[(":
            continue
        facts(node(kind, value, "", ""), ".")
        yield from out
        out = []


def read_turtle(spark: SparkSession, path: str, predicates: list[str] | None = None) -> DataFrame:
    """(s, p, o) of all files under ``path``, distinct."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows = list(parse(text, f"{zlib.crc32(name.rsplit('/', 1)[-1].encode()):x}."))
                for lo in range(0, max(1, len(rows)), 50_000):
                    cols = list(zip(*rows[lo : lo + 50_000], strict=True)) or [(), (), ()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], ["s", "p", "o"])

    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    triples = files.mapInArrow(run, "s string, p string, o string")
    if predicates is not None:
        triples = triples.where(F.col("p").isin(predicates))
    return triples.distinct()


def read_kb(spark: SparkSession, path: str) -> DataFrame:
    """A Turtle graph, closed under inverse predicates."""
    from ..operators.graph import inverse_closure

    return inverse_closure(read_turtle(spark, path))
