"""Searches by string identifiers, and the default vectors against plain Python."""

import math
import random
from collections import Counter

from pyspark.sql import functions as F

from inkwell.functions.text import occurrences, word_tokens
from inkwell.operators import search
from inkwell.plans.index import hashed_dense, word_sparse


def _rows(df):
    return [(r["query_id"], r["rank"], r["id"], round(r["score"], 9)) for r in df.orderBy("query_id", "rank").collect()]


def test_string_identifiers(spark):
    """The same as by number, ties by code point, and no number shared by two."""
    rng = random.Random(5)
    rows = [(i, f"p{i:04}", [rng.randint(-2, 2) * 1.0 for _ in range(4)], [rng.choice("abcdefg") for _ in range(6)]) for i in range(300)]
    points = spark.createDataFrame(rows, "n long, id string, embedding array<double>, terms array<string>").repartition(5)
    queries = spark.createDataFrame([(q, [rng.random() for _ in range(4)]) for q in range(3)], "query_id long, embedding array<double>")
    terms = spark.createDataFrame([(q, t, 1.0) for q, t in enumerate("abz")], "query_id long, term string, weight double")
    numbers = points.select(F.col("n").alias("id"), "embedding", "terms")
    for found, want in (
        (search.dense_topk(queries, points, 7), search.dense_topk(queries, numbers, 7)),
        (search.term_topk(terms, points.select("id", "terms"), 7, lambda tf, _: tf), search.term_topk(terms, numbers.select("id", "terms"), 7, lambda tf, _: tf)),
    ):
        assert dict(found.dtypes)["id"] == "string"
        assert _rows(found) == [(q, r, f"p{i:04}", s) for q, r, i, s in _rows(want)] and found.count() >= 14
    for empty in (points.limit(0), points.filter("false")):
        assert search.dense_topk(queries, empty, 3).count() == 0
    assert search.dense_topk(queries, points.withColumn("id", F.concat(F.lit("é𝒳"), "id")), 1).count() == 3


def test_default_vectors(spark):
    """Counts of words, one word thousands of times, none, and null."""
    texts = ["b a b c", "x " * 5_000 + " ".join(f"w{i}" for i in range(2_000)), "", None, "... !"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = df.select("i", word_tokens(F.col("t")).alias("w"), occurrences(word_tokens(F.col("t"))).alias("n"), word_sparse(F.col("t")).alias("s"), hashed_dense(F.col("t")).alias("d"))
    hashes = {r["x"]: r["h"] for r in got.select(F.explode("w").alias("x")).distinct().select("x", F.xxhash64("x").alias("h")).collect()}
    for r in got.collect():
        if r["w"] is None:
            assert r["n"] is None and r["s"] is None and r["d"] is None
            continue
        assert r["n"] == Counter(r["w"])
        assert {k: round(v, 9) for k, v in r["s"].items()} == {k: round(math.log1p(v), 9) for k, v in Counter(r["w"]).items()}
        sums = [0.0] * 64
        for w in r["w"]:
            sums[hashes[w] % 64] += -1.0 if hashes[w] >> 40 & 1 else 1.0
        size = math.sqrt(sum(x * x for x in sums))
        assert [round(x, 6) for x in r["d"]] == [round(x / size, 6) if size else 0.0 for x in sums]
