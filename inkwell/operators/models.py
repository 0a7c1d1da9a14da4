"""Models in a plan: batches of texts of like length, smaller batches after a failure, and failed rows as results.

A model is given by a function that loads it; a Python worker loads it once and keeps it from task to task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from inkwell.functions.sizing import batch_size

#: Texts of a batch that are asked for, and pairs of a first and a second try.
TEXTS = 12
PAIRS = (32, 16)

Texts = Callable[[list[str]], Sequence[Sequence[float]]]
Pairs = Callable[[list[tuple[str, str]]], Sequence[float]]

_loaded: dict[str, object] = {}


def _model(name: str, load: Callable[[], object]) -> object:
    """The model of this worker."""
    if name not in _loaded:
        _loaded[name] = load()
    return _loaded[name]


def run_batches(items: list, lengths: list[int], call: Callable[[list], Sequence], sizes: Sequence[int]) -> tuple[list, list[str | None]]:
    """Results of a model for `items`, in their order, and the error of each that has none.

    Items go in batches of sizes[0], by length.  A batch that fails is tried again in batches of the next
    size, and so on; an item that fails in a batch of the last size, of one, is the only one without a result.
    """
    out: list = [None] * len(items)
    errors: list[str | None] = [None] * len(items)

    def work(places: list[int], level: int) -> None:
        for at in range(0, len(places), sizes[level]):
            part = places[at : at + sizes[level]]
            try:
                found = list(call([items[p] for p in part]))
                if len(found) != len(part):
                    raise ValueError(f"{len(found)} results of {len(part)} items")
            except Exception as e:  # whatever a model raises is this batch's result
                if level + 1 < len(sizes) and len(part) > 1:
                    work(part, level + 1)
                else:
                    for p in part:
                        errors[p] = f"{type(e).__name__}: {e}"
            else:
                for p, x in zip(part, found, strict=True):
                    out[p] = x

    work(sorted(range(len(items)), key=lambda p: lengths[p]), 0)
    return out, errors


def embedder(name: str, load: Callable[[], Texts], used: Callable[[], float | None] = lambda: None, most: int = TEXTS) -> Callable[[Column], Column]:
    """Column of texts to struct<vector array<float>, error string>; a null text counts as an empty one.

    Batches have `batch_size` texts by the share of the device's memory that is in use, a failed one is tried again by quarters, then one by one.
    """

    @F.pandas_udf("vector array<float>, error string")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = _model(name, load)
        for texts in batches:
            given = [t or "" for t in texts]
            n = batch_size(most, used())
            vectors, errors = run_batches(given, [len(t) for t in given], model, (n, max(1, n // 4), 1))
            yield pd.DataFrame({"vector": pd.Series([None if v is None else [float(x) for x in v] for v in vectors], dtype=object), "error": pd.Series(errors, dtype=object)})

    return embed


def pair_scorer(name: str, load: Callable[[], Pairs]) -> Callable[[Column, Column], Column]:
    """Columns of queries and texts to scores, for `ranking.rerank`; null, which ranks last, where the model fails for the pair alone."""

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = _model(name, load)
        for queries, texts in batches:
            given = [(q or "", t or "") for q, t in zip(queries, texts, strict=True)]
            scores, _ = run_batches(given, [len(q) + len(t) for q, t in given], model, (*PAIRS, 1))
            yield pd.Series([None if s is None else float(s) for s in scores], dtype="float64")

    return score
