"""A folder as a stream: files are indexed as they arrive, each content once."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from inkwell.plans.index import index_files
from inkwell.sources.claims import Folder
from inkwell.sources.files import ALLOWED, MAX_BYTES, Strategies, scan_files, suffix
from inkwell.sources.store import ERRORS, PointStore

_FILE = "path string, modificationTime timestamp, length long, content binary"
#: Files of a batch at most; their paths pass through the driver, as they do in the listing of a file stream.
BATCH_FILES = 1000
#: How long a content is remembered by the state; after that the table of processed files answers for it.
REMEMBERED = 30 * 24 * 3600 * 1000
#: How much older than the newest file a file may be that still counts as new.
MAX_AGE = "36500d"
_ARRIVED = "path string, file_hash string, error string, first string"


class _FirstPaths(StatefulProcessor):
    """For each content the path that it was first seen at."""

    def __init__(self, remembered: int) -> None:
        self.remembered = remembered

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getValueState("first", "path string", self.remembered)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        least = error = None
        for x in rows:
            best = x.loc[x["path"].idxmin()]
            if least is None or best["path"] < least:
                least, error = best["path"], best["error"]
        known = None
        if error is None:
            known = self.first.get()[0] if self.first.exists() else None
            if known is None:
                self.first.update((least,))
        yield pd.DataFrame({"path": [least], "file_hash": [None if error else key[0]], "error": [error], "first": [known]}, dtype=object)

    def close(self) -> None:
        pass


def arrivals(spark: SparkSession, path: str, known: list[str], recursive: bool = True, batch_files: int = BATCH_FILES, remembered: int = REMEMBERED) -> DataFrame:
    """A stream of (path, file_hash, error, first): a row for each content of a batch, and for each file that is not read.

    `first` is the path at which an earlier batch had the content, null for a new one.  The state
    holds hashes and paths; contents are hashed where they are read and go no further.
    """
    reader = spark.readStream.format("binaryFile").schema(_FILE).option("recursiveFileLookup", str(recursive).lower())
    files = reader.option("maxFilesPerTrigger", batch_files).option("maxFileAge", MAX_AGE).load(path).withColumn("suffix", suffix(F.col("path")))
    read = F.col("suffix").isin(*known) & F.col("suffix").isin(*ALLOWED)
    null = F.lit(None).cast("string")
    good = files.filter((F.col("length") <= MAX_BYTES) & read).select("path", F.sha2("content", 256).alias("key"), null.alias("error"))
    error = F.when(~F.col("suffix").isin(*ALLOWED), "unsupported").when(F.col("length") > MAX_BYTES, "too_large").when(~read, "no_strategy")
    bad = files.select("path", F.col("path").alias("key"), error.alias("error")).filter("error is not null")
    grouped = good.unionByName(bad).groupBy("key")
    return grouped.transformWithStateInPandas(_FirstPaths(remembered), _ARRIVED, outputMode="Append", timeMode="ProcessingTime")


def index_folder_stream(
    spark: SparkSession,
    store: PointStore,
    path: str,
    checkpoint: str,
    collection: str = "documents",
    strategies: Strategies | None = None,
    recursive: bool = True,
    once: bool = True,
    batch_files: int = BATCH_FILES,
    remembered: int = REMEMBERED,
) -> StreamingQuery:
    """`index_folder` for files that arrive: with `once` all that are there, else until it is stopped.

    Of copies in a batch the first by path is read, of copies in several the first that arrived.  A
    copy is read again only if the earlier one is among `store.errors`, and contents that a run over the
    folder has processed are left out.  Files that cannot be read are rows of `store.errors`, as are
    those that are gone before they are read ('missing'; copies in the same batch are left to `index_folder`).  A batch that is delivered again adds
    nothing.  A file is delivered once: one that is changed in place is left to `index_folder`.
    """
    strategies = strategies or Strategies()
    known = list(strategies.by_suffix)
    own = spark.newSession()  # whose settings are changed here, and nobody else's
    own.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")  # expiry alone would ask for batches without end
    own.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

    def batch(arrived: DataFrame, _: int) -> None:
        rows = arrived.collect()  # of BATCH_FILES at most
        errors = store.errors(collection)
        tried = spark.createDataFrame([r for r in rows if r["error"] is None], _ARRIVED)
        again = tried.filter("first is not null").join(errors.read().select(F.col("path").alias("first")), "first", "left_semi")
        new = tried.filter("first is null").join(store.processed(collection).read().select("file_hash"), "file_hash", "left_anti")
        wanted = [r["path"] for r in again.select("path").union(new.select("path")).collect()]
        there = [p for p in wanted if Folder(spark, p).has("")]
        skipped = [(r["path"], r["error"]) for r in rows if r["error"]] + [(p, "missing") for p in set(wanted) - set(there)]
        if not there and not skipped:
            return
        if there:
            files = scan_files(spark, [re.sub(r"([\\{}\[\]*?])", r"\\\1", p) for p in there], known, recursive)
        else:
            files = spark.createDataFrame([], "path string, suffix string, length long, content binary, error string")
        fresh = files.filter("error is null").withColumn("file_hash", F.sha2("content", 256))
        index_files(store, fresh, spark.createDataFrame(skipped, ERRORS), collection, strategies, retried=spark.createDataFrame([(p,) for p in there], "path string"))

    writer = arrivals(own, path, known, recursive, batch_files, remembered).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
