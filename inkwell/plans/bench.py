"""Benchmarks of indexing and search over a store: build time, latencies of queries, quality of results."""

from __future__ import annotations

import time
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.operators import metrics
from inkwell.plans.index import index_folder, search_points
from inkwell.sources.store import PointStore


class Benchmark:
    """Runs over one collection of a store."""

    def __init__(self, spark: SparkSession, store: PointStore, collection: str = "documents") -> None:
        self.spark, self.store, self.collection = spark, store, collection

    def build(self, folder: str) -> dict[str, float]:
        """Index a folder: the number of chunks, seconds, and chunks a second."""
        began = time.perf_counter()
        found = index_folder(self.spark, self.store, folder, self.collection)
        return metrics.throughput(found["chunks"], time.perf_counter() - began)

    def latencies(self, queries: Sequence[str], top_k: int = 10, rerank_k: int = 5) -> DataFrame:
        """Statistics of the seconds that single queries take, one after the other: a row of latency_stats."""
        times = []
        for query in queries:
            one = self.spark.createDataFrame([(0, query)], "query_id long, query string")
            began = time.perf_counter()
            search_points(self.store, one, self.collection, top_k, rerank_k).collect()
            times.append((time.perf_counter() - began,))
        return metrics.latency_stats(self.spark.createDataFrame(times, "seconds double"), "seconds")

    def quality(self, queries: DataFrame, relevant: DataFrame, top_k: int = 20, ks: Sequence[int] = metrics.KS) -> DataFrame:
        """(metric, k, value) of the points found for `queries` (query_id, query), all at once, against `relevant` (query_id, id)."""
        found = search_points(self.store, queries, self.collection, top_k, top_k).filter("error is null")
        run = found.select("query_id", F.col("point").alias("id"), F.col("rerank_rank").alias("rank"))
        return metrics.evaluate(queries, run, relevant, ks)

    def run(self, folder: str | None = None, queries: DataFrame | None = None, relevant: DataFrame | None = None, timed: int = 20) -> dict[str, object]:
        """Each part for which there is input, None for the others; the first `timed` queries are timed."""
        texts = [r["query"] for r in queries.orderBy("query_id").limit(timed).collect()] if queries is not None else []
        return {
            "build": self.build(folder) if folder else None,
            "latencies": self.latencies(texts) if texts else None,
            "quality": self.quality(queries, relevant) if queries is not None and relevant is not None else None,
        }
