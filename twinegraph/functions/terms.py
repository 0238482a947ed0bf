"""Terms of a knowledge graph as Column expressions: inverse predicates, literals and their parts.

A term is a string. An inverse predicate ends in ``-``. A literal is quoted, with an
optional language or datatype, or a bare number.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The shapes of literals and the datatypes that count as dates.
QUOTED = r'^"([^"]*)"(@([a-z-]+))?(\^\^([^\n]*))?'
BARE_NUMBER = r'^"?[+-]?[0-9.]+"?$'
INTEGER = r"^[+-]?[0-9]+$"
DECIMAL = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([Ee][+-]?[0-9]+)?$"
DIGITS_AND_SIGNS = r"(?U)^[\d\W]+$"
DATE_TYPES = ["xsd:date", "xsd:gYear", "xsd:gYearMonth", "xsd:datetime", "xsd:gMonthDay"]


def is_inverse(p: Column) -> Column:
    return F.endswith(p, F.lit("-"))


def invert(p: Column) -> Column:
    return F.when(is_inverse(p), p.substr(F.lit(1), F.length(p) - 1)).otherwise(F.concat(p, F.lit("-")))


def is_literal(term: Column) -> Column:
    return term.rlike('^"[^"]*"') | term.rlike(BARE_NUMBER)


def local_name(iri: Column) -> Column:
    """What follows the last slash."""
    return F.element_at(F.split(iri, "/"), -1)


def sanitise_literal(text: Column) -> Column:
    r"""Line ends and tabs to ``\n`` and ``\t``, returns dropped, double quotes to single ones."""
    for a, b in (("\n", "\\n"), ("\t", "\\t"), ("\r", ""), ('\\"', "'"), ("\\u0022", "'")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def decode_escapes(text: Column) -> Column:
    """``_uXXXX_`` and ``\\uXXXX`` to their characters, without leaving the JVM."""
    for pattern in (r"_u([0-9A-F]{4})_", r"\\u([0-9A-Fa-f]{4})"):
        codes = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
        joined = F.array_join(F.zip_with(F.split(text, pattern), codes, lambda gap, code: F.concat(gap, F.when(code.isNull(), "").otherwise(F.decode(F.unhex(code), "UTF-16BE")))), "")
        text = F.when(text.rlike(pattern), joined).otherwise(text)
    return text


def numeric_normalization(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out a single time, however often ``body`` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def split_literal(term: Column, dates: list[str] | None = None, least_digits: int = 0) -> Column:
    """struct(lex, kind, num, norm, lang, dtype) of a literal.

    kind: date, number, normalised (digits and signs only) or string, decided in
    that order; a language rules out numbers. A bare number is an untyped number. With
    ``least_digits`` only normalised numbers of so many digits count, others are strings
    (the variant for embeddings).
    """
    dates = DATE_TYPES if dates is None else dates
    quoted = term.startswith('"')
    group = lambda i: F.when(quoted, F.nullif(F.regexp_extract(term, QUOTED, i), F.lit("")))
    parts = F.struct(F.when(quoted, F.regexp_extract(term, QUOTED, 1)).otherwise(term).alias("lex"), group(3).alias("lang"), group(5).alias("dtype"))

    def with_number(x: Column) -> Column:
        lex = x["lex"]
        number = x["lang"].isNull() & (lex.rlike(r"^[+-]?[0-9.]+$") | lex.rlike(r"^[+-]?[0-9.]+[Ee][+-]?[0-9]+$"))
        # whole numbers must be written as they would be printed: no plus, no leading zero
        plain = lex.rlike(r"^-?(0|[1-9][0-9]*)$") & (lex != "-0")
        num = F.when(lex.rlike(INTEGER), F.when(plain, lex.cast("double"))).when(lex.rlike(DECIMAL), lex.try_cast("double"))
        return F.struct(lex.alias("lex"), x["lang"].alias("lang"), x["dtype"].alias("dtype"), number.alias("number"), F.when(number, num).alias("num"))

    def with_kind(x: Column) -> Column:
        signs = ~x["number"] & x["lex"].rlike(DIGITS_AND_SIGNS) & (F.length(numeric_normalization(x["lex"])) >= least_digits)
        kind = F.when(F.coalesce(x["dtype"].isin(dates), F.lit(False)), "date").when(x["num"].isNotNull(), "number").when(x["number"], "string").when(signs, "normalised").otherwise("string")
        return F.struct(x.alias("x"), kind.alias("kind"))

    def result(y: Column) -> Column:
        x, kind = y["x"], y["kind"]
        text = (kind == "string") & ~x["number"]
        return F.struct(
            F.when(text, decode_escapes(x["lex"])).otherwise(x["lex"]).alias("lex"),
            kind.alias("kind"),
            F.when(kind == "number", x["num"]).alias("num"),
            F.when(kind == "normalised", F.concat(F.lit("normalized_"), numeric_normalization(x["lex"]))).alias("norm"),
            x["lang"].alias("lang"),
            F.when(text, F.lit("xsd:string")).otherwise(x["dtype"]).alias("dtype"),
        )

    return once(once(once(parts, with_number), with_kind), result)


def is_close(a: Column, b: Column, rel: float = 1e-9) -> Column:
    return (a == b) | (F.abs(a - b) <= rel * F.greatest(F.abs(a), F.abs(b)))


def score_literals(a: Column, b: Column) -> Column:
    """1.0 or 0.0 for two results of ``split_literal``, by their kinds."""
    value = lambda s: s["num"].isNotNull() | s["norm"].isNotNull()
    typed = a["dtype"].isNotNull() & b["dtype"].isNotNull()
    numbers = F.when(typed, is_close(a["num"], b["num"])).otherwise(a["lex"] == b["lex"])
    same = (
        F.when(a["num"].isNotNull() & b["num"].isNotNull(), numbers)
        .when(value(a) & value(b), F.coalesce((a["norm"] == b["norm"]) & (a["norm"] != ""), F.lit(False)))
        .when(value(a) | value(b), F.lit(False))
        .otherwise(a["lex"] == b["lex"])
    )
    return F.when(same, 1.0).otherwise(0.0)


def date_prefixes(key: Column) -> Column:
    """The proper prefixes of a date at its dashes, the longest first."""
    n = F.size(F.split(key, "-")) - 1
    ladder = F.transform(F.sequence(n, F.lit(1), F.lit(-1)), lambda k: F.array_join(F.slice(F.split(key, "-"), F.lit(1), k), "-"))
    return F.when(n > 0, ladder).otherwise(F.array().cast("array<string>"))


def prefix_score(prefix: Column) -> Column:
    return F.size(F.split(prefix, "-")) / F.lit(3.0)
