"""Whitening against exact fractions, by rows and by edges."""

import math
from fractions import Fraction

import numpy as np
import pytest

from inkwell.llm import queries, whitening
from tests.conftest import SMALL

SCHEMA = "vec_id long, embedding array<float>, label int, component string, n long"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "c", 3) for i, v in rows], SCHEMA)


def brute(rows):
    """n, x, S and the covariance as exact fractions, of the rows that stay."""
    kept = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v in kept]
    n, d = len(x), len(x[0])
    s = [sum(r[k] for r in x) for k in range(d)]
    cov = np.array([[float(sum((Fraction(r[i]) - Fraction(s[i], n)) * (Fraction(r[j]) - Fraction(s[j], n)) for r in x) / n) for j in range(d)] for i in range(d)])
    return [i for i, _ in kept], x, n, s, cov


def hold(found, rows, components=32, tolerance=1e-9):
    ids, x, n, s, cov = brute(rows)
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1], axes[:, ::-1]
    k = min(components, int((values > 1e-12 * values[0]).sum()))
    assert len(found) == len(ids) * k and {r["component"] for r in found} == set(range(1, k + 1))
    by = {}
    for r in found:
        by.setdefault((r["vec_id"], r["deviation"]), {}).setdefault(r["component"], []).append(r)
    want = (np.array([[float(Fraction(a) - Fraction(b, n)) for a, b in zip(r, s, strict=True)] for r in x]) @ axes[:, :k]) / np.sqrt(values[:k])
    signs = None
    for i, r, w in zip(ids, x, want, strict=True):
        deviation = sum((n * a - b) ** 2 for a, b in zip(r, s, strict=True))
        mine = by[i, deviation if deviation < 2**63 else None]
        got = np.array([mine[c][0]["whitened"] for c in range(1, k + 1)])
        if signs is None and np.all(np.abs(w) > 1e-6):
            signs = np.sign(w * got)
        assert np.allclose(np.abs(got), np.abs(w), atol=1e-7), (i, got, w)
        if signs is not None:
            assert np.allclose(got * signs, w, atol=1e-7)
        assert all(v["n"] == n and v["identity_error"] < 1e-4 for c in mine for v in mine[c])
        assert np.allclose([mine[c][0]["explained"] for c in range(1, k + 1)], values[:k] / np.trace(cov), rtol=1e-6)


def test_against_fractions(spark):
    random = np.random.default_rng(3)
    spread = random.normal(size=(7, 7))
    rows = [(i, (random.normal(size=7) @ spread).tolist()) for i in range(120)]
    rows += [(7, None), (8, []), (9, [1.0] * 6 + [None]), (10, [float("nan")] + [0.0] * 6), (11, [float("inf")] + [0.0] * 6), (None, [0.5] * 7), (5, rows[5][1]), (5, rows[5][1])]
    hold(whitening.whiten(vectors(spark, rows)).collect(), rows)
    hold(whitening.whiten(vectors(spark, rows), components=3).collect(), rows, 3)


def test_large_entries_stay_exact(spark):
    """Entries beyond 2**53 take more primes; the deviation leaves the range of a long and is null."""
    random = np.random.default_rng(4)
    rows = [(i, (random.normal(size=3) * 1e17).astype(np.float32).tolist()) for i in range(40)]
    found = whitening.whiten(vectors(spark, rows)).collect()
    assert all(r["deviation"] is None for r in found)
    hold(found, rows)


def test_few_directions_and_empty_tables(spark):
    """Directions without spread have no component."""
    assert whitening.whiten(vectors(spark, [])).collect() == []
    assert whitening.whiten(vectors(spark, [(1, None)])).collect() == []
    assert whitening.whiten(vectors(spark, [(1, [0.5, 0.5]), (2, [0.5, 0.5])])).collect() == []
    line = [(i, [float(i), float(2 * i), 1.0]) for i in range(9)]
    found = whitening.whiten(vectors(spark, line)).collect()
    assert {r["component"] for r in found} == {1} and len(found) == 9
    # The most frequent length stays.
    other = whitening.whiten(vectors(spark, [*line, (99, [1.0]), (98, [1.0, 2.0])])).collect()
    assert len(other) == 9 and {r["n"] for r in other} == {9}


@pytest.mark.parametrize("p", whitening.primes(2**60))
def test_modular_scatter(p):
    random = np.random.default_rng(p)
    x = random.integers(-(2**52), 2**52, size=(whitening.GEMM_ROWS + 5, 3)).astype(np.float64)
    x[: whitening.GEMM_ROWS, 0] = p // 2  # the largest residue, in every row of a product
    want = [[sum(int(a) * int(b) for a, b in zip(x[:, i], x[:, j], strict=True)) % p for j in range(3)] for i in range(3)]
    assert whitening.modular_scatter(x, p).tolist() == want


@pytest.mark.parametrize("number", [0, 1, -1, 10**30, -(10**30)])
def test_remaindering(number):
    moduli = whitening.primes(2 * abs(number) + 1)
    assert whitening.remaindered([number % p for p in moduli], moduli) == number
    assert len(set(moduli)) == len(moduli) and math.prod(moduli) > 2 * abs(number)


def test_query(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    found = queries.QUERIES["op13_whitening"](spark, SMALL)
    assert found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    got = found.collect()
    assert len(got) == 32 * len(rows) and max(r["identity_error"] for r in got) < 1e-8
    x = np.array([[math.floor(64 * float(c)) + 1_000_000 for c in v] for _, v in rows])
    at = {i: k for k, (i, _) in enumerate(rows)}
    w = np.zeros((len(rows), 32))
    for r in got:
        w[at[r["vec_id"]], r["component"] - 1] = r["whitened"]
        assert r["component"] > 1 or r["deviation"] == int(((len(rows) * x[at[r["vec_id"]]] - x.sum(0)) ** 2).sum())
    cov = w.T @ w / len(rows) - np.outer(w.mean(0), w.mean(0))
    assert np.abs(cov - np.eye(32)).max() < 1e-8
