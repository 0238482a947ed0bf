"""Operator 4: quality rules from word counts and cross-document line frequency, DataFrame functions only.

Base measures come from each text by itself. The method then looks across
documents: every line with a word is normalised (lower case, white space runs to
one space, digits to 0), hashed, and the distinct documents (doc_id) that hold it are
counted per host. Lines held by more than ``limit`` of a host's documents,
limit = max(least_documents, min(share * documents of the host, most_documents)), are
removed; a document with less than ``least_left`` of its words outside
removed lines is depleted and rejected. Copies under other ids are documents like any other.
``without_frequent_lines`` gives the texts that are left.

Counting is pre-aggregated before each exchange, no group is collected, and the
hot host only adds to partial counts. Rows are counted first: a line that too few rows
hold needs no count of documents. The others go back to the documents through a join on
(host, line), and the exact counts and the removed words come from what it finds.

Defined results: a null text has no words and is empty; a null host is a
host of its own; rows that repeat a document get the same row each; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, table, with_text, written

#: Fixed values of the base measures.
SPACE = r"[\x20\x09-\x0D]+"
NOT_SYMBOL = r"[^#*$%&|<>]+"
LEAST_WORDS = 50
MOST_REPEATED = 50

LEAST_DOCUMENTS = 20
SHARE = 0.02
MOST_DOCUMENTS = 10_000
LEAST_LEFT = 0.5


def words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def repeated_words(w: Column) -> Column:
    """Words inside three-word windows that the text holds twice or more.

    Window hashes are sorted; only where two are equal are they sorted again
    with their places, and the covered words summed from the gaps between places.
    """
    hashes = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - 2), lambda i: F.xxhash64(F.element_at(w, i), F.element_at(w, i + 1), F.element_at(w, i + 2)))
    twice = lambda h: F.size(F.array_distinct(h)) < F.size(h)

    def covered(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        same = lambda s: F.transform(s, lambda x, i: F.when(
            ((i > 0) & (F.get(s, i - 1)["h"] == x["h"])) | (F.get(s, i + 1)["h"] == x["h"]), x["i"]))
        places = let(placed, lambda s: F.sort_array(F.filter(same(s), lambda i: i.isNotNull())))
        return let(places, lambda p: F.aggregate(
            F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3)))), F.lit(0).cast("long"), lambda a, x: a + x))

    return F.when(F.size(w) < 4, F.lit(0).cast("long")).otherwise(let(hashes(w), lambda h: F.when(twice(h), covered(h)).otherwise(F.lit(0).cast("long"))))


def line_stats(text: Column) -> Column:
    """(line as it stands, its normal form's hash, its words) of each line with a word."""
    parts = F.transform(F.split(text, "\n"), lambda x: F.struct(x.alias("raw"), F.size(words(x)).alias("n")))
    return F.filter(parts, lambda x: x["n"] > 0)


def normal(line: Column) -> Column:
    return F.regexp_replace(F.trim(F.regexp_replace(F.lower(line), SPACE, " ")), r"[0-9]", "0")


def rule_rows(docs: DataFrame) -> DataFrame:
    """One row per document: key columns, base measures, and its lines' hashes with their words."""
    rows = docs.select(
        F.col("doc_id"), F.col("source").cast("string").alias("host"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    # The generator keeps the split words apart from their uses, so they are split once.
    rows = rows.select("doc_id", "host", F.xxhash64("text").alias("t1"), F.crc32(F.col("text").cast("binary")).alias("t2"), "text", F.explode(F.array(F.struct(words(F.col("text")).alias("w"), line_stats(F.col("text")).alias("l")))).alias("x"))
    w, lines = F.col("x.w"), F.col("x.l")
    return rows.select(
        "doc_id", "host", "t1", "t2",
        F.size(w).cast("long").alias("n_words"),
        F.aggregate(w, F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("word_chars"),
        F.length(F.regexp_replace("text", NOT_SYMBOL, "")).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(F.transform(lines, lambda x: x["raw"])))).cast("long").alias("n_dup_lines"),
        repeated_words(w).alias("n_repeat_words"),
    )


def line_hash(line: Column) -> Column:
    return F.xxhash64(normal(line))


def document_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, host, text hashes, line hash, words): a row for each line with a word."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = F.transform(line_stats(text), lambda x: F.struct(line_hash(x["raw"]).alias("line"), x["n"].alias("n")))
    return docs.select(
        "doc_id", F.col("source").cast("string").alias("host"), F.xxhash64(text).alias("t1"), F.crc32(text.cast("binary")).alias("t2"), F.explode(lines).alias("x"),
    ).select("doc_id", "host", "t1", "t2", "x.line", "x.n")


def on_line(a: str, b: str) -> Column:
    return F.col(f"{a}.host").eqNullSafe(F.col(f"{b}.host")) & (F.col(f"{a}.line") == F.col(f"{b}.line"))


def common_lines(docs: DataFrame, least_documents: int) -> DataFrame:
    """``document_lines``, alike ones counted as ``times``, of the lines that more than ``least_documents`` rows of their host hold.

    No fewer rows hold a line than documents, so all others are out of the question. They are most
    of the lines; only their partial counts per host cross an exchange, and what is left is written,
    so that its size is known and few lines are sent to the documents instead of the documents to the lines.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = F.array_distinct(F.transform(line_stats(text), lambda x: line_hash(x["raw"])))
    held = docs.select(F.col("source").cast("string").alias("host"), F.explode(lines).alias("line"))
    often = written(held.groupBy("host", "line").agg(F.count("*").alias("rows")).where(F.col("rows") > least_documents).select("host", "line"), "lines")
    rows = document_lines(docs).alias("d").join(often.alias("o"), on_line("d", "o"), "left_semi")
    return written(rows.groupBy("doc_id", "host", "t1", "t2", "line").agg(F.max("n").alias("n"), F.count("*").alias("times")), "held")


def frequent_lines(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS, share: float = SHARE, most_documents: int = MOST_DOCUMENTS, common: DataFrame | None = None) -> DataFrame:
    """(host, line) held by more distinct documents of the host than its limit. Rows without an id are one document of their host."""
    held = common_lines(docs, least_documents) if common is None else common
    held = held.groupBy("host", "line", "doc_id").agg(F.lit(1).alias("one")).groupBy("host", "line").agg(F.count("*").alias("documents")).where(F.col("documents") > least_documents)
    hosts = docs.select(F.col("source").cast("string").alias("host"), "doc_id").groupBy("host", "doc_id").agg(F.lit(1).alias("one")).groupBy("host").agg(F.count("*").alias("all_documents"))
    limit = F.least(F.col("all_documents") * share, F.lit(float(most_documents)))
    return held.alias("a").join(hosts.alias("b"), F.col("a.host").eqNullSafe(F.col("b.host"))).where(F.col("documents") > limit).select("a.host", "line")


def without_frequent_lines(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS, share: float = SHARE) -> DataFrame:
    """The rows, their texts without the lines above their host's limit; ``n_chars`` follows where it exists, a null text stays null."""
    frequent = frequent_lines(docs, least_documents, share).withColumnRenamed("host", "on")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.struct("*").alias("doc"), F.col("source").cast("string").alias("host"), F.xxhash64("source", text).alias("t1"), F.crc32(text.cast("binary")).alias("t2"), text.alias("text"))
    lines = rows.select("host", "t1", "t2", F.explode(F.array_distinct(F.transform(line_stats(F.col("text")), lambda x: line_hash(x["raw"])))).alias("line"))
    hit = lines.distinct().join(frequent, lines["host"].eqNullSafe(frequent["on"]) & (lines["line"] == frequent["line"]), "left_semi")
    gone = hit.groupBy("t1", "t2").agg(F.collect_set("line").alias("gone"))  # no more than the text has lines
    left = F.array_join(F.filter(F.split("text", "\n"), lambda x: ~F.array_contains("gone", line_hash(x))), "\n")
    out = rows.join(gone, ["t1", "t2"], "left").withColumn("left", F.when(F.col("gone").isNull(), F.col("doc.text")).otherwise(left))
    return out.select(*with_text(docs.columns, F.col("left")))


def apply_rules(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS, share: float = SHARE, least_left: float = LEAST_LEFT) -> DataFrame:
    """doc_id, base measures, base_failed, removed_words, kept."""
    base = rule_rows(docs)
    common = common_lines(docs, least_documents)
    hit = common.alias("d").join(frequent_lines(docs, least_documents, share, common=common).alias("f"), on_line("d", "f"), "left_semi")
    # A repeated row repeats its lines: a line's words count once per row, so the sum is divided by the rows.
    removed = hit.groupBy("doc_id", "host", "t1", "t2").agg(F.sum(F.col("n") * F.col("times")).alias("removed_words")).alias("r")
    rows = base.groupBy("doc_id", "host", "t1", "t2", *[c for c in base.columns if c[:2] in ("n_", "wo")]).agg(F.count("*").alias("copies")).alias("b")
    same = F.lit(True)
    for c in ("doc_id", "host", "t1", "t2"):
        same &= F.col(f"b.{c}").eqNullSafe(F.col(f"r.{c}"))
    out = rows.join(removed, same, "left").withColumn("removed_words", (F.coalesce("removed_words", F.lit(0)) / F.col("copies")).cast("long"))
    out = out.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")))
    out = out.withColumn("kept", ~F.col("base_failed") & (F.col("n_words") - F.col("removed_words") >= least_left * F.col("n_words")))
    return out.withColumn("copy", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).select(
        F.col("b.doc_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words",
    )


def op4_line_rules(spark, sf_dir: str) -> DataFrame:
    return apply_rules(table(spark, sf_dir, "documents"))


OP4_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id::VARCHAR, '') AS id, source AS host, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM d
), i AS (
  SELECT r, w, unnest(range(1, greatest(len(w) - 1, 1))) AS i FROM w
), g AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, w[i], w[i + 1], w[i + 2]) AS n FROM i
), p AS (
  SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM g WHERE n > 1) GROUP BY r
), l AS (
  SELECT r, host, id, unnest(string_split(text, chr(10))) AS raw FROM d
), m AS (
  SELECT *, len(regexp_extract_all(raw, '[^\x20\x09-\x0D]+')) AS n,
    regexp_replace(trim(regexp_replace(lower(raw), '[\x20\x09-\x0D]+', ' ', 'g')), '[0-9]', '0', 'g') AS line
  FROM l WHERE regexp_matches(raw, '[^\x20\x09-\x0D]')
), u AS (
  SELECT r, count(*) - count(DISTINCT raw) AS dup FROM m GROUP BY r
), f AS (
  SELECT m.host, line FROM m GROUP BY m.host, line
  HAVING count(DISTINCT id) > 20 AND count(DISTINCT id) > least(10000, 0.02 * (SELECT count(DISTINCT id) FROM d WHERE d.host IS NOT DISTINCT FROM m.host))
), x AS (
  SELECT r, sum(n) AS n FROM m SEMI JOIN f ON m.host IS NOT DISTINCT FROM f.host AND m.line = f.line GROUP BY r
), b AS (
  SELECT doc_id, len(w.w)::BIGINT AS n_words, coalesce(list_sum([length(z) for z in w.w]), 0)::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(dup, 0)::BIGINT AS n_dup_lines,
    coalesce(p.n, 0)::BIGINT AS n_repeat_words, coalesce(x.n, 0)::BIGINT AS removed_words
  FROM w LEFT JOIN p USING (r) LEFT JOIN u USING (r) LEFT JOIN x USING (r)
), c AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND n_words - removed_words >= 0.5 * n_words AS kept, removed_words
FROM c
"""
