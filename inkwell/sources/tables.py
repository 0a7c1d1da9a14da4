"""Reading Parquet tables."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; a local master without one gets a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table; one that is too small to be split, and so would be one task's work, is dealt over all cores.

    Too small: fewer files than cores, and fewer bytes for each core than those for which Spark
    opens another file.  Larger tables have row groups for all cores and are read where they lie.
    """
    table = spark.read.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    if len(table.inputFiles()) >= cores:
        return table
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    size = at.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(at).getLength()
    least = spark._jsparkSession.sessionState().conf().filesOpenCostInBytes()
    return table.repartition(cores) if size < cores * least else table
