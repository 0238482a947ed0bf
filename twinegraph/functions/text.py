"""Text and list functions as Column expressions; Arrow-batched Python only where no expression exists."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def unicode_encode(text: Column) -> Column:
    """Everything but letters, digits and ``_`` of ASCII to ``_uXXXX_``."""
    code = lambda c: F.upper(F.hex(F.encode(c, "UTF-16BE")))
    return F.array_join(F.transform(F.split(text, ""), lambda c: F.when(c.rlike("^[A-Za-z0-9_]?$"), c).otherwise(F.concat(F.lit("_u"), code(c), F.lit("_")))), "")


@F.pandas_udf(StringType())
def decode_unicode(text: pd.Series) -> pd.Series:
    r"""``_uXXXX_`` and then backslash escapes, with every escape form; for the common forms alone use ``terms.decode_escapes``."""

    def one(x: str | None) -> str | None:
        if x is None:
            return None
        x = re.sub("_u([0-9A-F]{4})_", lambda m: chr(int(m[1], 16)), x)
        if "\\u" not in x:
            return x
        try:
            return x.encode("latin-1", "backslashreplace").decode("unicode_escape").encode("utf-16", "surrogatepass").decode("utf-16")
        except UnicodeError:
            return x

    return text.map(one)


def reorder_brackets(text: Column) -> Column:
    """Words without their bracketed parts, distinct and sorted, then the bracketed parts."""
    outside = F.filter(F.split(F.regexp_replace(text, r"\(.*?\)", ""), r"\s+"), lambda w: w != "")
    words = F.array_join(F.sort_array(F.array_distinct(outside)), " ")
    inside = F.array_join(F.regexp_extract_all(text, F.lit(r"(\(.*?\))"), F.lit(1)), " ")
    return F.trim(F.concat(words, F.lit(" "), inside))


def other_share(text: Column) -> Column:
    """Share of characters that are no letters; null for an empty text."""
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    return F.try_divide(F.length(text) - letters, F.length(text))


def is_human_readable(text: Column) -> Column:
    return F.coalesce(~text.startswith("http:") & (other_share(text) < 0.5), F.lit(False))


def is_readable(text: Column) -> Column:
    """Several words, or one that is no link and mostly letters."""
    words = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    return (words > 1) | F.coalesce(~text.startswith("http") & (other_share(text) < 0.5), F.lit(False))


def word_set(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def jaccard_similarity(a: Column, b: Column) -> Column:
    x, y = word_set(a), word_set(b)
    return F.try_divide(F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y)))


def harmonic_mean(scores: Column) -> Column:
    total = F.aggregate(scores, F.lit(0.0), lambda s, x: s + F.try_divide(F.lit(1.0), x))
    return F.when(F.exists(scores, lambda x: x == 0), 0.0).otherwise(F.try_divide(F.size(scores), total))


def first_places(items: Column) -> Column:
    """For each item, where it first occurs: two lists repeat alike exactly when these are equal."""
    return F.transform(items, lambda x: F.array_position(items, x))


def pattern_equal(a: Column, b: Column) -> Column:
    return first_places(a) == first_places(b)


def violated(a: Column, b: Column) -> Column:
    """Whether two neighbours are equal in ``a`` but differ in ``b``."""
    steps = F.sequence(F.lit(2), F.size(a))
    hit = F.exists(steps, lambda i: (F.element_at(a, i) == F.element_at(a, i - 1)) & (F.element_at(b, i) != F.element_at(b, i - 1)))
    return F.when(F.size(a) < 2, F.lit(False)).otherwise(hit)


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u.cast("double") * v.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def unique_pattern_choices(items: Column) -> Column:
    """All choices of one place per distinct item, as arrays of places counted from 0, in order of the items' first places."""
    kinds = F.array_distinct(items)
    places = F.transform(kinds, lambda k: F.filter(F.transform(items, lambda x, i: F.when(x == k, i)), lambda i: i.isNotNull()))
    start = F.array(F.array().cast("array<int>"))
    return F.aggregate(places, start, lambda acc, ps: F.flatten(F.transform(acc, lambda a: F.transform(ps, lambda p: F.concat(a, F.array(p))))))
