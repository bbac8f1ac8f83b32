"""Intermediate tables in the folder that driver and executors share.

Tables lie in one folder an application, which the file system deletes when the driver's process ends; large ones that
no later step reads are discarded before.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: With it Spark deletes the shuffle files of a query when it ends; else they stay until the driver collects its garbage.
FREES_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_root(spark: SparkSession) -> str:
    """This application's folder under spark.checkpoint.dir. Only a session with a local master, whose executor is the
    driver's own process, may go without that setting; elsewhere a folder made here would be another one on each machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="stockweave-")
        spark.conf.set("spark.checkpoint.dir", root)
    folder = f"{root.rstrip('/')}/stockweave-{spark.sparkContext.applicationId}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        fs.mkdirs(path)
        fs.deleteOnExit(path)
    return folder


def spread(df: DataFrame) -> DataFrame:
    """df in at least as many partitions as there are cores; a file with one row group comes as one. Larger inputs have
    more than that already and aren't shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def staged(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet to the shared folder and read back: computed once, and safe from lost executors."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(FREES_SHUFFLES, "false")
    spark.conf.set(FREES_SHUFFLES, "true")  # of this query, whose result is read from its files from now on
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(FREES_SHUFFLES, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that staged() returned and that nothing reads any more."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.staged_path)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
