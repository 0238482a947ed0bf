"""A corpus through five of the training-data operators, in order.

1. quality: documents that the byte-level classifier rejects go;
2. near_duplicates: one document of each group of linked documents stays;
3. repeated_strings: bytes inside strings of 400 bytes that occur twice or more are cut from the texts, and so are passages
   of more than 50 words, whatever their bytes;
4. secrets: spans of secrets are masked in the texts;
5. packing: the texts become pieces of windows of 4096 tokens.

A stage takes (spark, docs, sf_dir) and works on all rows its predecessor
left. All but the last return the columns they were given; ``n_chars``
follows a changed text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from twinegraph.llm import byteconv, jaccard, packing, secretscan, suffix
from twinegraph.llm.common import table, written

#: Words of the least passage that repeated_strings cuts.
PASSAGE = 51


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return byteconv.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.one_of_each(docs)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(docs, words=PASSAGE)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secretscan.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_strings", repeated_strings),
    ("secrets", secrets),
    ("packing", pack),
]

#: The classifier, the groups and the packing are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; every stage's result is written to the shared folder and read back."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
