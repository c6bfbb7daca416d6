"""Intermediate tables in storage that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; one of our own only where none is set."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="jadwal-")
        spark.sparkContext.setCheckpointDir(named)
    return named


def own_dir(spark: SparkSession) -> str:
    """The part of the shared folder that holds the tables of this application."""
    return f"{shared_dir(spark)}/jadwal-{spark.sparkContext.applicationId}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a compressed table in the shared folder and read it back.

    Later jobs read the files, so a lost executor costs a reread and not the whole lineage. The table stays until ``release``.
    """
    path = f"{own_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete all tables that this application has written; results that still read them cannot be used any more."""
    jvm, path = spark.sparkContext._jvm, own_dir(spark)
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
