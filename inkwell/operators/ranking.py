"""Reranking of results and compression of their texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.functions.text import bound, compress_sentences, word_tokens


def coverage(query: Column, content: Column) -> Column:
    """The default pair scorer: the share of the query's distinct words that the text has.

    It stands for a cross-encoder's place in the plan, not for its quality.
    """

    def share(x: Column) -> Column:
        return F.when(F.size(x["q"]) == 0, 0.0).otherwise(F.size(F.array_intersect(x["q"], x["d"])) / F.size(x["q"]))

    return bound(F.struct(F.array_distinct(word_tokens(query)).alias("q"), word_tokens(content).alias("d")), share)


def rerank(results: DataFrame, top_k: int = 5, scorer: Callable[[Column, Column], Column] = coverage, query_col: str = "query", content_col: str = "content") -> DataFrame:
    """The best `top_k` results of each query by a pair scorer, with rerank_score and rerank_rank; the retrieval score stays."""
    scored = results.withColumn("rerank_score", scorer(F.col(query_col), F.col(content_col)))
    order = Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), "rank", "id")
    return scored.withColumn("rerank_rank", F.row_number().over(order)).filter(F.col("rerank_rank") <= top_k)


def compress(query: Column, document: Column, min_relevance: float = 0.3, max_sentences: int = 20) -> Column:
    """The sentences of a document that bear on a query, in order.

    Relevance is the share of the query's distinct words that occur anywhere in the sentence.  Up to
    three sentences stay as they are, and if none is relevant the first three stay.
    """

    def relevance(s: Column, terms: Column) -> Column:
        return bound(F.lower(s), lambda low: F.when(F.size(terms) == 0, 0.0).otherwise(F.size(F.filter(terms, lambda t: F.contains(low, t))) / F.size(terms)))

    def relevant(x: Column) -> Column:
        scored = F.transform(x["sentences"], lambda s, i: F.struct((-relevance(s, x["terms"])).alias("r"), i.alias("i"), s.alias("s")))
        kept = F.filter(F.slice(F.array_sort(scored), 1, max_sentences), lambda y: -y["r"] >= min_relevance)
        in_order = F.transform(F.array_sort(F.transform(kept, lambda y: F.struct(y["i"].alias("i"), y["s"].alias("s")))), lambda y: y["s"])
        chosen = bound(in_order, lambda c: F.when(F.size(c) == 0, F.slice(x["sentences"], 1, 3)).otherwise(c))
        return F.when(F.size(x["sentences"]) <= 3, document).otherwise(F.array_join(chosen, " "))

    empty = (F.coalesce(document, F.lit("")) == "") | (F.coalesce(query, F.lit("")) == "")
    parts = F.struct(compress_sentences(document).alias("sentences"), F.array_distinct(word_tokens(query)).alias("terms"))
    return F.when(empty, document).otherwise(bound(parts, relevant))
