"""Retrieval metrics and latency statistics as grouped aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KS = (5, 10, 20)


def query_metrics(queries: DataFrame, run: DataFrame, qrels: DataFrame, ks: Sequence[int] = KS) -> DataFrame:
    """One row for each of `queries` (query_id): rr, hit, and ndcg, recall, precision at each k.

    `run` has query_id, id and rank (from 1), `qrels` query_id and id.  A document that a run repeats
    gains at every rank, but counts once for recall and precision; a query without relevant documents
    scores 0.
    """
    relevant = qrels.select("query_id", "id").distinct().withColumn("hit", F.lit(1))
    marked = run.select("query_id", "id", "rank").join(relevant, ["query_id", "id"], "left")
    hit = F.col("hit").isNotNull()

    def up_to(k: int, value: Column) -> Column:
        return F.when(hit & (F.col("rank") <= k), value)

    sums = [F.min(F.when(hit, F.col("rank"))).alias("first")]
    for k in ks:
        sums.append(F.sum(up_to(k, 1 / F.log2(F.col("rank") + 1.0))).alias(f"dcg_{k}"))
        sums.append(F.count_distinct(up_to(k, F.col("id"))).alias(f"found_{k}"))
    per_query = marked.groupBy("query_id").agg(*sums)
    counts = relevant.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_relevant"))
    joined = queries.select("query_id").distinct().join(per_query, "query_id", "left").join(counts, "query_id", "left")
    n = F.coalesce("n_relevant", F.lit(0))
    out = [F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("rr"), F.col("first").isNotNull().cast("double").alias("hit")]
    for k in ks:
        ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(n, F.lit(k)), F.lit(1)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
        found = F.coalesce(f"found_{k}", F.lit(0))
        out.append(F.when(n == 0, 0.0).otherwise(F.coalesce(f"dcg_{k}", F.lit(0.0)) / ideal).alias(f"ndcg_{k}"))
        out.append(F.when(n == 0, 0.0).otherwise(found / n).alias(f"recall_{k}"))
        out.append((found / F.lit(k) if k else F.lit(0.0)).alias(f"precision_{k}"))
    return joined.select("query_id", *out)


def evaluate(queries: DataFrame, run: DataFrame, qrels: DataFrame, ks: Sequence[int] = KS) -> DataFrame:
    """(metric, k, value): means over all queries; k is 0 where a metric has none."""
    each = query_metrics(queries, run, qrels, ks)
    names = [("mrr", 0, "rr"), ("hit_rate", 0, "hit"), *((m, k, f"{m}_{k}") for k in ks for m in ("ndcg", "recall", "precision"))]
    means = each.agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for _, _, c in names], F.count(F.lit(1)).cast("double").alias("n"))
    rows = [F.struct(F.lit(m).alias("metric"), F.lit(k).alias("k"), F.col(c).alias("value")) for m, k, c in [*names, ("num_queries", 0, "n")]]
    return means.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def latency_stats(times: DataFrame, value: str, *groups: str) -> DataFrame:
    """mean, p50, p95, p99, min, max and count of a column, exact with linear interpolation; 0 without rows."""
    p = F.percentile(F.col(value), F.array(*map(F.lit, (0.5, 0.95, 0.99))))
    zero = F.lit(0.0)
    stats = times.groupBy(*groups).agg(F.avg(value).alias("mean"), p.alias("_p"), F.min(value).alias("min"), F.max(value).alias("max"), F.count(value).alias("count"))
    return stats.select(
        *groups, F.coalesce("mean", zero).alias("mean"), *[F.coalesce(F.get("_p", F.lit(i)), zero).alias(n) for i, n in enumerate(("p50", "p95", "p99"))],
        F.coalesce("min", zero).alias("min"), F.coalesce("max", zero).alias("max"), "count",
    )


def throughput(count: int, seconds: float) -> dict[str, float]:
    return {"count": count, "seconds": round(seconds, 4), "per_second": round(count / seconds, 2) if seconds > 0 else 0.0}


def report(stats: dict[str, dict[str, float]], quality: dict[tuple[str, int], float]) -> str:
    """Latencies in milliseconds and metrics by ascending k, as text."""
    lines = []
    for name, s in stats.items():
        lines += [f"{name} latency", *(f"  {k}: {s[k] * 1000:.2f} ms" for k in ("mean", "p50", "p95", "p99"))]
    lines += [f"{m}@{k}: {v:.4f}" if k else f"{m}: {v:.4f}" for (m, k), v in sorted(quality.items(), key=lambda x: (x[0][1], x[0][0]))]
    return "\n".join(lines)
