import numpy as np
import pytest
from pyspark.sql import functions as F

from inkwell.operators import search
from inkwell.sources import centroids
from inkwell.sources.centroids import VectorIndex
from inkwell.sources.store import ConflictError


def _clusters(n=600, width=16, groups=12, seed=3):
    r = np.random.default_rng(seed)
    at = r.normal(size=(groups, width)) * 4
    return at[r.integers(groups, size=n)] + r.normal(size=(n, width)) * 0.4


def _frame(spark, rows, id_type="string", key="id"):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v]) for i, v in rows], f"{key} {id_type}, embedding array<double>")


def _best(rows, q, k):
    """Brute force: the k best (id, score) of a query."""
    def score(v):
        if len(v) != len(q) or not np.linalg.norm(v) or not np.linalg.norm(q):
            return 0.0
        return round(float(np.dot(v, q) / np.linalg.norm(v) / np.linalg.norm(q)), 9)

    usable = [(i, v) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    return sorted(((-score(v) + 0.0, i) for i, v in usable))[:k]


def _same(found, want):
    assert len(found) == len(want)
    for (s, i), (t, j) in zip(found, want, strict=True):
        assert i == j and abs(s - t) < 2e-9


def _by_query(results):
    out = {}
    for r in results.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((-r["score"], r["id"]))
    return out


def test_exact_search_equals_brute_force(spark, tmp_path):
    x = _clusters()
    rows = [(f"p{i:04}", v) for i, v in enumerate(x)]
    rows += [(f"copy{i:03}", x[5]) for i in range(200)]  # ties, and one list with a quarter of all
    rows += [("zero", np.zeros(16)), ("short", [1.0, 2.0]), ("none", None), ("hole", [None] + [1.0] * 15), ("nan", [float("nan")] * 16), ("inf", [float("inf")] * 16), (None, x[0]), ("empty", [])]
    asked = [(i, x[i * 7] + 0.01) for i in range(40)] + [(100, np.zeros(16)), (101, [2.0, 1.0]), (102, []), (103, -x[3])]
    index = VectorIndex(spark, f"file://{tmp_path}/index", entry="double")
    queries = _frame(spark, [*asked, (104, None), (None, x[0])], "long", "query_id")
    assert index.topk(queries, 3).count() == 0
    points = _frame(spark, rows).withColumn("list", F.lit("clash"))
    part = F.pmod(F.xxhash64("id"), F.lit(3))
    for n in (0, 1, 2):
        index.add(points.filter(F.coalesce(part, F.lit(0)) == n))
    assert index.lists().agg(F.sum("n")).first()[0] == 600 + 200 + 3
    for k in (1, 10, 900):
        found = _by_query(index.topk(queries, k, probes=2, exact=True))
        assert set(found) == {q for q, _ in asked}
        for q, v in asked:
            _same(found[q], _best(rows, v, k))
    before = {q: v for q, v in found.items()}
    index.rebuild()
    assert len(index._current()[2]) == 1 and len(index._versions.names()) == 1
    after = _by_query(index.topk(queries, 900, exact=True))
    for q, v in before.items():
        _same(after[q], v)


def test_probing_reads_few_lists_and_finds_most(spark, tmp_path):
    x = _clusters(1500)
    index = VectorIndex(spark, f"file://{tmp_path}/index", "long")
    index.add(_frame(spark, enumerate(x), "long"))
    one = _frame(spark, [(1, x[1])], "long", "query_id")
    found = index.topk(one, 10, exact=True)
    assert found.count() == 10 and index.lists_read < index.lists_met / 2  # bounds prune without loss
    queries = _frame(spark, [(i, x[i]) for i in range(0, 1500, 30)], "long", "query_id")
    want = {(r["query_id"], r["id"]) for r in search.dense_topk(queries, _frame(spark, enumerate(x), "long"), 10).collect()}
    probes = index.probes_for(_frame(spark, [(i, x[i]) for i in range(7, 1500, 30)], "long", "query_id"), 10)
    got = {(r["query_id"], r["id"]) for r in index.topk(queries, 10, probes).collect()}
    assert len(want & got) >= 0.9 * len(want) and probes < index.lists_met / 2
    plan = index._read("vectors", index._current()[2]).filter(F.col("list").isin([1, 2]))._jdf.queryExecution().toString()
    assert "PartitionFilters: [list" in plan


def test_queries_paired_by_shuffle_give_the_same(spark, tmp_path, monkeypatch):
    x = _clusters(400)
    index = VectorIndex(spark, f"file://{tmp_path}/index", "long")
    monkeypatch.setattr(centroids, "FILE_ROWS", 10)  # long lists are dealt over files and keys
    index.add(_frame(spark, enumerate(x), "long"))
    queries = _frame(spark, [(i, x[i]) for i in range(0, 400, 9)], "long", "query_id")
    want = _by_query(index.topk(queries, 7, exact=True))
    monkeypatch.setattr(centroids, "BROADCAST_BYTES", -1)
    found = _by_query(index.topk(queries, 7, exact=True))
    assert set(want) == set(found)
    for q, v in want.items():
        _same(found[q], v)


def test_empty_index_and_two_writers(spark, tmp_path, monkeypatch):
    index, other = (VectorIndex(spark, f"file://{tmp_path}/index", "long") for _ in range(2))
    none = _frame(spark, [], "long")
    index.add(none)
    assert index.topk(_frame(spark, [(1, [1.0])], "long", "query_id"), 3, exact=True).count() == 0
    write = index._write

    def slow(*args):
        other.add(_frame(spark, [(1, [1.0, 0.0])], "long"))
        return write(*args)

    monkeypatch.setattr(index, "_write", slow)
    with pytest.raises(ConflictError):
        index.add(none)
    found = other.topk(_frame(spark, [(1, [1.0, 0.0])], "long", "query_id"), 3, exact=True)
    assert [(r["id"], r["score"]) for r in found.collect()] == [(1, 1.0)]


def test_probes_suffice_for_single_queries(spark, tmp_path):
    """Vectors without clusters: the probes serve nearly each query by itself, not only all of them together."""
    x = np.random.default_rng(5).normal(size=(500, 8))
    index = VectorIndex(spark, f"file://{tmp_path}/index", "long")
    index.add(_frame(spark, enumerate(x), "long"))
    queries = _frame(spark, [(i, x[i]) for i in range(0, 500, 5)], "long", "query_id")
    probes = index.probes_for(queries, 10)
    want, found = (_by_query(index.topk(queries, 10, probes, exact=e)) for e in (True, False))
    whole = sum({i for _, i in found[q]} == {i for _, i in v} for q, v in want.items())
    assert len(want) == 100 and whole >= 95
