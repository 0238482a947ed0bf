"""State between rounds of an iterative operator, written to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` with its scheme; a temporary folder is set only where there is none.

    A path without a scheme belongs to the cluster's default store, as everywhere in Spark.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if not named:
        have = sc._jsc.sc().getCheckpointDir()
        if not have.isDefined():
            sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="alignment-"))
            have = sc._jsc.sc().getCheckpointDir()
        named = have.get()
    where = spark._jvm.org.apache.hadoop.fs.Path(named)
    return where.getFileSystem(sc._jsc.hadoopConfiguration()).makeQualified(where).toString().rstrip("/")


def new_folder(spark: SparkSession, tag: str) -> str:
    """A fresh folder under the shared one, removed with the session."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}")
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(where)
    fs.deleteOnExit(where)
    return where.toString()


def cut(df: DataFrame) -> DataFrame:
    """The same rows from Parquet files in the shared folder, so a plan ends there and later reads prune columns."""
    spark = df.sparkSession
    path = new_folder(spark, "cut") + "/t"
    df.write.option("compression", "lz4_raw").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Remove the files of a frame that ``cut`` gave, once nothing reads it any more."""
    jvm = df.sparkSession._jvm
    conf = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/cut-" in folder:
            where = jvm.org.apache.hadoop.fs.Path(folder)
            where.getFileSystem(conf).delete(where, True)
