"""What the operators of this subpackage share: tables, the shared folder, written stages."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows per Arrow batch: documents are long, and a batch stands in memory on both sides.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch of documents holds, unless the session asks for less."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, read by Spark alone so that any store works."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, with its scheme.

    A path without a scheme belongs to the cluster's default store, as everywhere in Spark.
    Where the session has none (tests, local mode) a temporary one is set.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if not named:
        have = sc._jsc.sc().getCheckpointDir()
        if not have.isDefined():
            sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="shared-"))
            have = sc._jsc.sc().getCheckpointDir()
        named = have.get()
    where = spark._jvm.org.apache.hadoop.fs.Path(named)
    return where.getFileSystem(sc._jsc.hadoopConfiguration()).makeQualified(where).toString().rstrip("/")


def new_folder(spark: SparkSession, tag: str) -> str:
    """A fresh path under the shared folder; removed when the session's JVM ends."""
    path = f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(where)
    fs.deleteOnExit(where)
    return path


def written(df: DataFrame, tag: str) -> DataFrame:
    """Write as Parquet to the shared folder and read back: the lineage ends there.

    The written files outlive any executor, so later stages never recompute
    what came before them.
    """
    spark = df.sparkSession
    small_batches(spark)
    path = new_folder(spark, tag) + "/t"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(*frames: DataFrame) -> None:
    """Remove the files behind frames that ``written`` gave, once nothing reads them any more, and let Spark drop the exchanges that led to them."""
    import gc

    for df in frames:
        spark = df.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            where = spark._jvm.org.apache.hadoop.fs.Path(folder)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    if frames:
        gc.collect()
        frames[0].sparkSession._jvm.System.gc()


def give_back() -> None:
    """Return freed memory of a Python worker to the system: workers are kept between tasks, and what one step held would stay with the next."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def let(value: Column, body) -> Column:
    """Bind ``value`` once: ``body`` gets it as a lambda variable, so it is evaluated a single time per row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def with_text(kept: list[str], new_text: Column, row: str = "doc") -> list[Column]:
    """The columns of a packed row with another text; ``n_chars``, where there is one, follows it."""
    out = []
    for c in kept:
        if c == "text":
            out.append(new_text.alias("text"))
        elif c == "n_chars":
            out.append(F.when(F.col(f"{row}.text").isNull(), F.col(f"{row}.n_chars")).otherwise(F.length(new_text).cast("long")).alias("n_chars"))
        else:
            out.append(F.col(f"{row}.`{c}`").alias(c))
    return out
