import pytest
from pyspark.sql import functions as F

from inkwell.functions import sizing
from inkwell.operators import models, ranking
from inkwell.plans.index import index_chunks
from inkwell.sources.store import PointStore


def test_batches_by_length_with_retries():
    sizes = []

    def call(batch):
        sizes.append(len(batch))
        if len(batch) > 3 or "bad" in batch:
            raise MemoryError("too many")
        return [len(x) for x in batch]

    items = ["xxxxx", "a", "bad", "yy", "", "zzzzzzz", "a", "b", "c"]
    out, errors = models.run_batches(items, [len(x) for x in items], call, (8, 2, 1))
    assert out == [None if x == "bad" else len(x) for x in items]
    assert [e for e in errors if e] == ["MemoryError: too many"] and errors[2]
    # Eight by length fail and go by twos, of which the pair with the bad one goes one by one; the ninth goes alone.
    assert sizes == [8, 2, 2, 2, 2, 1, 1, 1]
    assert models.run_batches([], [], call, (8, 2, 1)) == ([], [])
    out, errors = models.run_batches(["a", "b"], [1, 1], lambda batch: [0.0], (2, 1))
    assert out == [0.0, 0.0] and errors == [None, None]  # a result short: one by one


@pytest.mark.parametrize("used", [None, 0.1, 0.5, 0.6, 0.75, 0.9])
def test_batch_size_follows_the_column(spark, used):
    row = spark.createDataFrame([(12, used)], "n int, used double")
    assert row.select(sizing.batch_rows(F.col("n"), F.col("used"))).first()[0] == sizing.batch_size(12, used)


def _loader():
    """A model that fails for batches of more than three texts, and for some texts alone."""

    def embed(texts):
        if len(texts) > 3 or any("poison" in t for t in texts):
            raise RuntimeError("no memory")
        return [[float(len(t)), 1.0] for t in texts]

    return embed


def test_indexing_with_a_model_reports_what_failed(spark, tmp_path):
    store = PointStore(spark, f"file://{tmp_path}/store")
    texts = [f"text {'x' * (i % 17)} {i}" for i in range(40)] + ["poison one", "poison two"]
    chunks = spark.createDataFrame([(t, f"s{i}", "text") for i, t in enumerate(texts)], "content string, source string, chunk_type string")
    embed = models.embedder("test", _loader, used=lambda: 0.1)
    assert index_chunks(store, chunks, "c", model=embed) == {"chunks": 40, "points": 40, "failed": 2}
    found = store.points("c").read().select("content", "dense").collect()
    assert len(found) == 40 and all(list(r["dense"]) == [float(len(r["content"])), 1.0] for r in found)
    failed = store.failed("c").read().collect()
    assert sorted(r["source"] for r in failed) == ["s40", "s41"] and {r["error"] for r in failed} == {"RuntimeError: no memory"}
    assert store.size("c") == 40
    # The next run tries the failed ones again, and no other.
    mended = models.embedder("mended", lambda: lambda batch: [[0.0, 2.0] for _ in batch])
    assert index_chunks(store, chunks, "c", model=mended) == {"chunks": 2, "points": 2, "failed": 0}
    assert store.count("c") == 42


def test_reranking_with_a_model(spark):
    def load():
        def score(pairs):
            if len(pairs) > 16 or any("poison" in t for _, t in pairs):
                raise RuntimeError("no memory")
            return [len(set(q.split()) & set(t.split())) for q, t in pairs]

        return score

    rows = [(q, i, i, f"w{q} w{q + 1}", "poison" if i == 7 else f"w{q}" + (f" w{q + 1}" if i == 5 else "")) for q in range(3) for i in range(1, 20)] + [(9, 1, 1, None, None)]
    results = spark.createDataFrame(rows, "query_id long, id long, rank int, query string, content string")
    best = ranking.rerank(results, 19, models.pair_scorer("pairs", load)).orderBy("query_id", "rerank_rank").collect()
    for q in range(3):
        own = [r for r in best if r["query_id"] == q]
        assert [r["id"] for r in own] == [5, *(i for i in range(1, 20) if i not in (5, 7)), 7]
        assert own[0]["rerank_score"] == 2.0 and own[-1]["rerank_score"] is None
    assert [r["rerank_score"] for r in best if r["query_id"] == 9] == [0.0]
