"""Readers of the parquet tables of a data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


_SCHEMAS: dict[str, tuple[tuple, StructType]] = {}


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """``<directory>/<name>.parquet``, a file or a folder of files; lazily, so pruning and pushdown reach the scan.

    Its schema is read from a footer by a job of its own, once: it is kept as long as the file or folder has the same time
    and length and the application is the same.
    """
    path = f"{directory}/{name}.parquet"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    status = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(target)
    state = (spark.sparkContext.applicationId, status.getModificationTime(), status.getLen())
    known = _SCHEMAS.get(path)
    if known is None or known[0] != state:
        known = _SCHEMAS[path] = state, spark.read.parquet(path).schema
    return spark.read.schema(known[1]).parquet(path)


def scan_splits(df: DataFrame) -> int | None:
    """The tasks that read ``df``, if it is one scan of files; None for anything else."""
    leaves = df._jdf.queryExecution().sparkPlan().collectLeaves()
    if leaves.size() != 1 or "FileSourceScan" not in leaves.head().getClass().getSimpleName():
        return None
    return leaves.head().inputRDD().getNumPartitions()


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least as many tasks as there are cores, for work that costs far more than moving the rows.

    Only a scan of fewer splits than cores is repartitioned (a small table, or one file of one row group); larger inputs
    stay as they are read, without a shuffle.
    """
    cores, splits = df.sparkSession.sparkContext.defaultParallelism, scan_splits(df)
    return df.repartition(cores) if splits is not None and splits < cores else df
