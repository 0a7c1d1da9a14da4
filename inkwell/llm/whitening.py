"""Whitening of vectors by an exact scatter matrix in a residue number system.

Entries become integers.  Each task multiplies its block of integers with itself modulo several
primes: residues lie within 2**20 of zero, so a float64 product of 8,192 rows is exact.  Spark adds
the residues of all tasks, and Chinese remaindering gives every sum over the corpus exactly, however
far the entries lie from zero beside their spread.  The covariance is rounded once, from the exact
fraction, and its eigenvectors come from a symmetric eigensolver in double precision.

What reaches the driver has the size of the scatter matrix, whatever the number of vectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: An entry c becomes floor(SCALE * c) + SHIFT.
SCALE = 64
SHIFT = 1_000_000
#: Components of a vector that are returned.
COMPONENTS = 32
#: Residues are below this; so a product of GEMM_ROWS rows of balanced residues stays below 2**53.
PRIME_LIMIT = 1 << 21
GEMM_ROWS = 8_192
#: Rows of the pieces in which tasks work.
ROWS = 4 * GEMM_ROWS
LONG = 2**63 - 1


@dataclass
class Whitening:
    """A fitted whitening: what a task needs to project a vector.

    `total` has the exact sums of the entries, `axes` the unit eigenvectors as columns, by falling eigenvalue.
    """

    n: int
    total: list[int]
    trace: float
    values: np.ndarray
    axes: np.ndarray

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - total / n.  The whole part of the mean leaves first, which is exact, so that nothing cancels."""
        whole = np.array([s // self.n for s in self.total], dtype=np.float64)
        rest = np.array([s % self.n / self.n for s in self.total], dtype=np.float64)
        return (x - whole) - rest

    def project(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ (self.axes / np.sqrt(self.values))

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Exact sums of (n * x - total)**2; None where no long holds one."""
        most = max((abs(self.n * int(v) - s) for e in (x.min(0), x.max(0)) for v, s in zip(e, self.total, strict=True)), default=0)
        if most * most * x.shape[1] <= LONG and self.n * np.abs(x).max(initial=0) <= LONG and max(map(abs, self.total), default=0) <= LONG:
            apart = x.astype(np.int64) * self.n - np.array(self.total, dtype=np.int64)
            return np.einsum("ij,ij->i", apart, apart).tolist()
        found = [sum((self.n * int(v) - s) ** 2 for v, s in zip(row, self.total, strict=True)) for row in x]
        return [v if v <= LONG else None for v in found]


def primes(bound: int) -> list[int]:
    """The largest primes below PRIME_LIMIT whose product exceeds `bound`."""
    found, product, p = [], 1, PRIME_LIMIT - 1
    while product <= bound:
        if all(p % q for q in range(3, math.isqrt(p) + 1, 2)):
            found.append(p)
            product *= p
        p -= 2
    return found


def residues(x: np.ndarray, p: int) -> np.ndarray:
    """Balanced residues of whole doubles, which is exact for doubles of any size."""
    r = np.fmod(x, p)
    return r - p * np.rint(r / p)


def modular_scatter(x: np.ndarray, p: int) -> np.ndarray:
    """x.T @ x modulo p, from 0 to p - 1, as long."""
    out = np.zeros((x.shape[1], x.shape[1]), np.int64)
    for at in range(0, len(x), GEMM_ROWS):
        r = residues(x[at : at + GEMM_ROWS], p)
        out = (out + np.rint(r.T @ r).astype(np.int64)) % p
    return out


def remaindered(rest: list[int], moduli: list[int]) -> int:
    """The number of least absolute value with these residues."""
    product, out = math.prod(moduli), 0
    for r, p in zip(rest, moduli, strict=True):
        part = product // p
        out += r * part * pow(part, -1, p)
    out %= product
    return out - product if 2 * out > product else out


def _pieces(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.Series, np.ndarray]]:
    """Identifiers and scaled entries, as whole doubles, of at most ROWS rows."""
    for batch in batches:
        for at in range(0, len(batch), ROWS):
            part = batch.iloc[at : at + ROWS]
            c = np.stack(part["vector"].to_list()).astype(np.float64)
            yield part["vec_id"], np.floor(SCALE * c) + SHIFT


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, vector) of the rows whose vector is neither null nor empty and has finite entries only, as doubles."""

    def bad(x: Column) -> Column:
        return x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))

    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vector"))
    return rows.filter((F.size("vector") > 0) & ~F.exists("vector", bad))


def fit(rows: DataFrame, dimension: int, n: int, largest: float, components: int = COMPONENTS) -> Whitening:
    """Fit on `rows` (vec_id, vector), `n` vectors of one dimension whose scaled entries lie within `largest` of zero."""
    moduli = primes(2 * n * (int(largest) + 1) ** 2)

    def multiply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = {p: np.zeros((dimension + 1, dimension + 1), np.int64) for p in moduli}
        for _, x in _pieces(batches):
            with_one = np.column_stack([x, np.ones(len(x))])  # the last row of the scatter has the sums
            for p in moduli:
                sums[p] = (sums[p] + modular_scatter(with_one, p)) % p
        for k, p in enumerate(moduli):
            yield pd.DataFrame({"prime": k, "i": range(dimension + 1), "row": [sums[p][i, : i + 1] for i in range(dimension + 1)]})

    # The lower triangle; a sum of residues below 2**21 is far from the end of a long.
    each = rows.mapInPandas(multiply, "prime int, i int, row array<long>").select("prime", "i", F.posexplode("row").alias("j", "rest"))
    found = each.groupBy("i", "j", "prime").agg(F.sum("rest").alias("rest")).toPandas()
    scatter = [[0] * (dimension + 1) for _ in range(dimension + 1)]
    for (i, j), part in found.sort_values("prime").groupby(["i", "j"]):
        rest = [int(r) % p for r, p in zip(part["rest"], moduli, strict=True)]
        scatter[i][j] = scatter[j][i] = remaindered(rest, moduli)
    total = scatter[dimension][:dimension]
    count = scatter[dimension][dimension]
    # n * n * V is a whole number, so each entry is rounded once.
    cov = np.array([[float(Fraction(count * scatter[i][j] - total[i] * total[j], count * count)) for j in range(dimension)] for i in range(dimension)])
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1], axes[:, ::-1]
    # Directions without spread cannot be brought to a spread of one.
    there = int((values > dimension * np.finfo(float).eps * max(values[0], 0)).sum())
    keep = min(components, there)
    return Whitening(count, total, float(np.trace(cov)), values[:keep].copy(), axes[:, :keep].copy())


def identity_error(rows: DataFrame, fitted: Whitening) -> float:
    """Largest absolute entry of the whitened vectors' covariance minus the identity, measured on all rows."""
    k = len(fitted.values)

    def multiply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = np.zeros((k + 1, k + 1))
        for _, x in _pieces(batches):
            w = np.column_stack([fitted.project(x), np.ones(len(x))])
            out += w.T @ w
        yield pd.DataFrame({"i": range(k + 1), "row": [out[i, : i + 1] for i in range(k + 1)]})

    each = rows.mapInPandas(multiply, "i int, row array<double>").select("i", F.posexplode("row").alias("j", "v"))
    found = each.groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
    sums = np.zeros((k + 1, k + 1))
    sums[found["i"], found["j"]] = found["v"]
    # The vectors were centred before; their mean is rounding alone, and leaves here.
    mean = sums[k, :k] / fitted.n
    low = sums[:k, :k] / fitted.n - np.outer(mean, mean)
    return float(np.abs(np.tril(low) - np.eye(k)).max(initial=0.0))


def whiten(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for each usable vector and component.

    Vectors that are null or empty or have an entry that is null or not finite are dropped, as are
    those of another length than the most frequent one (of equally frequent lengths, the least).
    Rows count as often as they occur, whatever their identifier, which may be null; other columns
    are ignored.  Components are numbered from 1 by falling eigenvalue, up to `components`; those
    whose eigenvalue is rounding error alone (equal vectors, fewer vectors than dimensions) have no
    row, so a table of equal vectors, like an empty one, gives none.  A deviation that no long holds is null.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vec_col)
    scaled = F.aggregate("vector", F.lit(0.0), lambda m, c: F.greatest(m, F.abs(c))) * SCALE + (SHIFT + 1)
    sizes = rows.groupBy(F.size("vector").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.max(scaled).alias("largest"))
    most = sizes.orderBy(F.desc("n"), "d").first()
    id_type = rows.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {id_type}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if most is None:
        return spark.createDataFrame([], schema)
    rows = rows.filter(F.size("vector") == most["d"])
    fitted = fit(rows, most["d"], most["n"], most["largest"], components)
    if not len(fitted.values):
        return spark.createDataFrame([], schema)
    error = identity_error(rows, fitted)

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for ids, x in _pieces(batches):
            yield pd.DataFrame({"vec_id": ids, "deviation": pd.array(fitted.deviations(x), dtype="Int64"), "w": list(fitted.project(x))})

    found = rows.mapInPandas(project, f"vec_id {id_type}, deviation long, w array<double>")
    explained = F.array(*[F.lit(float(e / fitted.trace)) for e in fitted.values])
    return found.select("vec_id", "deviation", F.posexplode("w").alias("i", "whitened")).select(
        "vec_id", (F.col("i") + 1).alias("component"), F.lit(fitted.n).cast("long").alias("n"), "deviation", "whitened",
        F.element_at(explained, F.col("i") + 1).alias("explained"), F.lit(error).alias("identity_error"),
    )
