"""Operator 6: secret scan with a battery of randomness tests, DataFrame functions only.

Base spans come from three fixed patterns (whole matches, leftmost and
non-overlapping per kind, too short ones dropped). The method adds spans of kind
``random``: runs of 20 or more token characters that hold a digit and a
letter and touch no base span are candidates. Each candidate's encoding is inferred from its
characters (hexadecimal, base 32, letters and digits, base 64), its
characters become symbol numbers of that alphabet, and three tests ask whether
the symbols are random:

* chi-squared of the symbol counts against a uniform alphabet;
* runs above and below the middle of the alphabet;
* serial correlation of neighbouring symbols.

Each test gives a p-value under the hypothesis that the symbols are uniform and independent, and Fisher's method
combines the three. Tests of short candidates have less power than tests of long ones, so within each
band of lengths the Benjamini-Hochberg rule over the p-values of the whole table says which candidates are
not random: of those it rules out, at most a share of ``MISSED_SHARE`` is random after all.
What is left is then held against the opposite case, a name or path, which short
tests can't rule out: there, classes of characters (digit, small, capital, sign) change at a rate of at most ``NAME_RATE``.
The chance of as many changes in so many characters (Chernoff's bound, so it falls with the length)
is a p-value too, and the same rule, by the same bands, holds the share of false spans under ``FALSE_SHARE``.
Both rules read a histogram of p-values (3 bands, 1201 bins each), so six numbers reach the driver whatever the input.

Defined results: a null text is empty and has no spans; rows that repeat are
each given their result; an empty table gives no rows; other columns are not
read by ``scan`` and are kept by ``redact``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, table, written

#: The base patterns, in the order of their kinds.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"
KINDS = ["assign", "access", "hex", "random"]
LEAST = {"assign": 12, "access": 18, "hex": 16}

CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: The alphabets by which characters are numbered.
HEXADECIMAL = "0123456789abcdef"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
BASE64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"

MISSED_SHARE = 0.01
NAME_RATE = 0.08
FALSE_SHARE = 0.01
BANDS = (20, 32, 64)
BINS = 20
MOST_BIN = 60 * BINS
CHUNK = 256


def running_sums(values: Column) -> Column:
    """Sums of the first 1, 2, ... values; chunked, so that the work stays near linear in the array's length."""
    empty = F.struct(F.lit(0).cast("long").alias("p"), F.array().cast("array<bigint>").alias("v"))

    def sums(a: Column) -> Column:
        return F.aggregate(a, empty, lambda acc, x: F.struct((acc["p"] + x).alias("p"), F.concat(acc["v"], F.array(acc["p"] + x)).alias("v")))["v"]

    def body(a: Column) -> Column:
        n = F.ceil(F.size(a) / F.lit(CHUNK)).cast("int")
        own = F.transform(F.sequence(F.lit(0), n - 1), lambda i: sums(F.slice(a, i * CHUNK + 1, CHUNK)))

        def join(chunks: Column) -> Column:
            return let(sums(F.transform(chunks, lambda c: F.element_at(c, -1))), lambda ends: F.flatten(F.transform(chunks, lambda c, i: F.transform(c, lambda x: x + F.when(i > 0, F.element_at(ends, i)).otherwise(F.lit(0))))))

        return F.when(F.size(a) == 0, F.array().cast("array<bigint>")).otherwise(let(own, join))

    return let(values, body)


SPANS = "array<struct<start:bigint,kind:int,end:bigint,said:string>>"


def matches(text: Column, pattern: str, kind: int, value_group: int = 0) -> Column:
    """Spans (start, kind, end, what they hold) of all matches in code points; the text between them gives the places."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group))
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def spans(m: Column, v: Column) -> Column:
        steps = F.zip_with(F.split(text, pattern), m, lambda gap, own: (F.length(gap) + F.coalesce(F.length(own), F.lit(0))).cast("long"))
        return let(running_sums(steps), lambda ends: F.transform(m, lambda x, i: F.struct(
            (F.get(ends, i) - F.length(x)).alias("start"), F.lit(kind).alias("kind"), F.get(ends, i).alias("end"), F.get(v, i).alias("said"))))

    return F.when(text.rlike(pattern), let(whole, lambda m: let(found, lambda v: spans(m, v)))).otherwise(F.array().cast(SPANS))


def base_spans(text: Column) -> Column:
    assign = F.filter(matches(text, ASSIGN, 0, 2), lambda s: F.length(s["said"]) >= LEAST["assign"])
    access = F.filter(matches(text, ACCESS, 1), lambda s: F.length(s["said"]) >= LEAST["access"])
    return F.sort_array(F.concat(assign, access, matches(text, HEX, 2)))


def candidates(text: Column, base: Column) -> Column:
    def free(s: Column) -> Column:
        clash = F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
        return s["said"].rlike("[0-9]") & s["said"].rlike("[A-Za-z]") & ~clash

    return F.filter(matches(text, CANDIDATE, 3), free)


#: A rational approximation of the complementary error function (Abramowitz and Stegun 7.1.26).
ERFC = (0.3275911, (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429))
LN10 = 2.302585092994046


def two_sided(z: Column) -> Column:
    """The chance that a normal deviate is at least that far from 0."""

    def erfc(x: Column) -> Column:
        t = 1 / (1 + ERFC[0] * x)
        poly = F.lit(0.0)
        for c in reversed(ERFC[1]):
            poly = (poly + c) * t
        return poly * F.exp(-x * x)

    return let(F.abs(z) / F.sqrt(F.lit(2.0)), erfc)


def above(z: Column) -> Column:
    """The chance that a normal deviate is at least so large."""
    return let(two_sided(z), lambda p: F.when(z >= 0, p / 2).otherwise(1 - p / 2))


def battery(x: Column, k: Column) -> Column:
    """-log10 of the combined p-value of the three tests over symbol numbers x of an alphabet of k."""
    n = F.size(x).cast("double")
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    counts = F.transform(F.array_distinct(x), lambda v: F.pow(F.size(F.filter(x, lambda u: u == v)).cast("double"), 2))
    # the cube root of chi-squared over its degrees is nearly normal (Wilson and Hilferty)
    spread = 2 / (9 * (k - 1))
    chi = (F.pow(F.greatest(k / n * total(counts) - n, F.lit(0.0)) / (k - 1), 1 / 3) - (1 - spread)) / F.sqrt(spread)
    pairs = F.sequence(F.lit(1), F.size(x) - 1)
    high = F.size(F.filter(x, lambda v: v >= k / 2)).cast("double")
    mean_runs = 2 * high * (n - high) / n + 1
    var_runs = (mean_runs - 1) * (mean_runs - 2) / (n - 1)
    runs = 1 + F.size(F.filter(pairs, lambda i: (F.get(x, i) >= k / 2) != (F.get(x, i - 1) >= k / 2)))
    run_dev = F.when(var_runs > 0, (runs - mean_runs) / F.sqrt(var_runs)).otherwise(F.lit(9.0))

    def serial(mean: Column) -> Column:
        top = total(F.transform(pairs, lambda i: (F.get(x, i) - mean) * (F.get(x, i - 1) - mean)))
        low = total(F.transform(x, lambda v: (v - mean) * (v - mean)))
        return F.when(low > 0, top / low * F.sqrt(n)).otherwise(F.lit(9.0))

    ser = let(total(F.transform(x, lambda v: v.cast("double"))) / n, serial)
    logs = lambda p: F.log(F.greatest(p, F.lit(1e-30)))
    # Fisher: minus twice the sum of logs is chi-squared with 6 degrees of freedom, whose tail has a closed form.
    half = -(logs(above(chi)) + logs(two_sided(run_dev)) + logs(two_sided(ser)))
    return let(half, lambda h: (h - F.log(1 + h + h * h / 2)) / LN10)


def evidence(token: Column) -> Column:
    """struct(odd, strength): -log10 of the p-values of a token being random and of its being a name."""

    def test(t: Column) -> Column:
        hexed, base32 = t.rlike("^([0-9a-f]+|[0-9A-F]+)$"), t.rlike("^[A-Z2-7]+$")
        alphabet = F.when(hexed, HEXADECIMAL).when(base32, BASE32).otherwise(BASE64)
        plain = F.when(hexed, F.lower(t)).otherwise(F.translate(F.regexp_replace(t, "=+$", ""), "-_=", "+/+"))
        k = F.when(hexed, 16.0).when(base32, 32.0).when(t.rlike("^[A-Za-z0-9]+$"), 62.0).otherwise(64.0)
        symbols = F.transform(F.split(plain, "(?<=.)(?=.)"), lambda c: F.instr(alphabet, c) - 1)
        kinds = F.translate(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", "A" * 26 + "a" * 26 + "0" * 10 + "-" * 5)
        changes = F.length(t) - F.length(F.regexp_replace(kinds, r"(.)\1*", "x"))
        n = (F.length(t) - 1).cast("double")
        rate = (n - changes) / n

        def bound(r: Column) -> Column:
            e = NAME_RATE
            kl = r * F.log(r / e) + F.when(r < 1, (1 - r) * F.log((1 - r) / (1 - e))).otherwise(F.lit(0.0))
            return F.when(r > e, n * kl / LN10).otherwise(F.lit(0.0))

        return F.struct(let(symbols, lambda x: battery(x, k)).alias("odd"), let(rate, bound).alias("strength"))

    return let(token, test)


def band(length: Column) -> Column:
    return F.when(length >= BANDS[2], 2).when(length >= BANDS[1], 1).otherwise(0)


def bin_of(strength: Column) -> Column:
    return F.least(F.floor(strength * BINS), F.lit(MOST_BIN)).cast("int")


def _least(counts: DataFrame, bin_: str, share: float) -> list[int]:
    """For each band, the lowest bin whose p-values the false-discovery rule rejects; counts: (band, bin, n)."""
    more = Window.partitionBy("band").orderBy(F.desc(bin_))
    counts = counts.groupBy("band", bin_).agg(F.sum("n").alias("n"))
    counts = counts.withColumn("passed", F.sum("n").over(more)).withColumn("all", F.sum("n").over(Window.partitionBy("band")))
    # A bin's p-values are at most 10^(-bin / BINS).
    fits = counts.where((F.col(bin_) > 0) & (F.pow(F.lit(10.0), -F.col(bin_) / BINS) * F.col("all") <= share * F.col("passed")))
    found = {r["band"]: r["least"] for r in fits.groupBy("band").agg(F.min(bin_).alias("least")).collect()}
    return [found.get(i, MOST_BIN + 1) for i in range(len(BANDS))]


def by_band(limits: list[int], band_: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in limits]), band_ + 1)


def least_bins(docs: DataFrame, false_share: float) -> tuple[list[int], list[int]]:
    """For each band, the lowest bin at which a candidate counts as not random, and the lowest at which it counts as no name."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # The base patterns need not be known where there is no candidate at all.
    rows = docs.select(text.alias("text")).where(F.col("text").rlike(CANDIDATE)).select("text", F.explode(F.array(base_spans(F.col("text")))).alias("base"))
    rows = rows.select(F.explode(candidates(F.col("text"), F.col("base"))).alias("s")).select(F.col("s.said").alias("said"), F.explode(F.array(evidence(F.col("s.said")))).alias("e"))
    counts = rows.groupBy(band(F.length("said")).alias("band"), bin_of(F.col("e.odd")).alias("odd"), bin_of(F.col("e.strength")).alias("strength")).agg(F.count("*").alias("n"))
    counts = written(counts, "p-values")
    odd = _least(counts, "odd", MISSED_SHARE)
    return odd, _least(counts.where(F.col("odd") < by_band(odd, F.col("band"))), "strength", false_share)


def spans_column(docs: DataFrame, false_share: float = FALSE_SHARE):
    """A function from (text, base spans) to all spans, its thresholds fitted on all of ``docs``."""
    odd, least = least_bins(docs, false_share)

    def secret(s: Column) -> Column:
        own = band(F.length(s["said"]))
        return let(evidence(s["said"]), lambda e: (bin_of(e["odd"]) < by_band(odd, own)) & (bin_of(e["strength"]) >= by_band(least, own)))

    def all_spans(text: Column, base: Column) -> Column:
        return F.sort_array(F.concat(base, F.filter(candidates(text, base), secret)))

    return all_spans


def scan(docs: DataFrame, false_share: float = FALSE_SHARE) -> DataFrame:
    """doc_id, base and spans: arrays of (start, kind, end, said) in order."""
    all_spans = spans_column(docs, false_share)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text")).select("doc_id", "text", F.explode(F.array(base_spans(F.col("text")))).alias("base"))
    return rows.select("doc_id", "base", all_spans(F.col("text"), F.col("base")).alias("spans"))


MASK = "[SECRET]"


def redact(docs: DataFrame, false_share: float = FALSE_SHARE) -> DataFrame:
    """The rows with every span of their text replaced by ``MASK``; ``n_chars`` follows where it exists."""
    from .common import with_text

    all_spans = spans_column(docs, false_share)
    rows = docs.select(F.struct("*").alias("doc"))
    text = F.coalesce(F.col("doc.text").cast("string"), F.lit(""))
    rows = rows.select("doc", F.explode(F.array(base_spans(text))).alias("base"))
    rows = rows.select("doc", F.explode(F.array(all_spans(text, F.col("base")))).alias("spans"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.concat(acc["out"], F.substring(F.col("doc.text"), (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit(MASK))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], gap).otherwise(acc["out"]).alias("out"))

    tail = lambda a: F.concat(a["out"], F.substring(F.col("doc.text"), (a["at"] + 1).cast("int"), F.length("doc.text")))
    masked = F.when(F.size("spans") == 0, F.col("doc.text")).otherwise(let(F.aggregate("spans", start, step), tail))
    return rows.select("doc", masked.alias("masked")).select(*with_text(docs.columns, F.col("masked")))


def said(spans: Column) -> Column:
    name = lambda s: F.element_at(F.array(*[F.lit(k) for k in KINDS]), s["kind"] + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s), s["start"], s["end"])), ",")


def op6_secret_scan(spark, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(said(F.col("base")).cast("binary"), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"),
    )
