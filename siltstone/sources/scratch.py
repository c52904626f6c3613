"""The shared folder: intermediate tables that outlive any executor."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; where that is unset on one machine (tests), one temporary folder.

    On a cluster it must be set: a folder of one machine isn't seen by the others, so that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return _OWN.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="siltstone-"))


def materialize(df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """Writes ``df`` as a table in the shared folder and returns a reader of it.

    Later stages start from the files, so a lost executor costs at most its own running tasks, and several readers share
    one computation. The folder is removed when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)
