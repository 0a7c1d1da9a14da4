"""What the operators of this subpackage share: reading tables, scratch tables, batches."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.sources.tables import read_table

#: Rows of text in one Arrow batch.  Texts are large, so the default of 10,000
#: would put hundreds of megabytes into one batch.
ROWS_PER_BATCH = 400

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` below `sf_dir`, on any file system that Spark reads."""
    return read_table(spark, f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: spark.checkpoint.dir of the session.

    Where it is unset, a local master gets a temporary folder; a cluster has to
    name a folder that all executors share.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if found:
        return found
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    found = f"file://{tempfile.mkdtemp(prefix='spark-')}"
    sc.setCheckpointDir(found)
    return found


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared scratch folder and read it back; this cuts its lineage.

    Unlike cached blocks, the files survive the loss of executors.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def bucketed(df: DataFrame, key: str, name: str) -> DataFrame:
    """Write `df` to the shared scratch folder in buckets of `key` and read it back; joins on the key then shuffle the other side only."""
    spark = df.sparkSession
    path, view = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}", f"scratch_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(buckets, key).write.format("parquet").bucketBy(buckets, key).options(path=path, compression="zstd").saveAsTable(view)
    out = spark.table(view)
    spark.sql(f"DROP TABLE {view}")  # the entry of an external table only: its files stay, and the plan has what it needs
    out.scratch_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the files of a materialized table that nothing reads any more."""
    path = getattr(df, "scratch_path", None)
    if path:
        jvm = df.sparkSession._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


#: A key is hot if it holds more than one in so many rows; so there are fewer hot keys than this, whatever the input.
HOT_KEYS = 10_000


def join_hot(rows: DataFrame, lookup: DataFrame, keys: list[str], copies: str | None = None) -> DataFrame:
    """Inner join of `rows` with `lookup`, which has one row for each key; no task gets all rows of a hot key.

    The lookup's rows of hot keys, a bounded number, are broadcast, and the other rows are
    shuffled.  `copies` names the lookup's column with the number of a key's rows, if it has one, and is dropped.
    `rows` is read several times, so it should be a written table.
    """
    share = rows.count() // HOT_KEYS
    if copies is None:
        copies = "_copies"
        counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias(copies)).filter(F.col(copies) > share)
        hot = lookup.join(counts, keys, "left_semi").drop(copies)
        cold = lookup
    else:
        hot, cold = lookup.filter(F.col(copies) > share).drop(copies), lookup.filter(F.col(copies) <= share).drop(copies)
    found = rows.join(F.broadcast(hot), keys)
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys)
    return found.unionByName(rest)


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of whole texts small, unless the session chose a size itself."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(ROWS_PER_BATCH))


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else.  Pure ASCII texts take the faster built-in lower()."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, _UPPER, _UPPER.lower())
    )
