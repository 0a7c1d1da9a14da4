"""What a task of a search holds at once, whatever its batches are."""

import numpy as np
import pyarrow as pa

from inkwell.operators import search
from inkwell.sources import postings
from inkwell.sources.postings import Postings


def test_first_scores_are_cut():
    r = np.random.default_rng(1)
    scores = np.round(r.normal(size=(6, 5_000)), 2)  # with ties
    scores[0, :10] = np.nan
    wanted = r.random(scores.shape) < 0.9
    wanted[5, 3:] = False
    ids = r.permutation(5_000)
    best = search._Best(6, 20)
    best.add(scores, ids, wanted)
    assert best.size < 6 * 200
    q, i, s = best.cut()
    for row in range(6):
        good = np.flatnonzero(wanted[row] & ~np.isnan(scores[row]))
        want = sorted((-scores[row, x], ids[x]) for x in good)[:20]
        assert [(-b, a) for a, b in zip(i[q == row], s[q == row], strict=True)] == want


def test_pieces_are_bounded():
    words = [["word"] * (n % 50) for n in range(1_000)] + [["long"] * 10_000, []]
    batch = pa.record_batch({"id": pa.array(range(len(words))), "terms": pa.array(words)})
    found = list(search.pieces(iter([batch]), 10_000))
    assert sum((p.column("terms").to_pylist() for p in found), []) == words
    assert all(p.nbytes <= 10_000 or p.num_rows == 1 for p in found)


def test_small_blocks_and_tasks_give_the_same(spark, tmp_path, monkeypatch):
    r = np.random.default_rng(2)
    docs = spark.createDataFrame([(i, " ".join(f"w{x}" for x in r.zipf(1.5, size=20) % 60)) for i in range(400)], "id long, content string")
    queries = spark.createDataFrame([(1, "w1 w2 w9"), (2, "w7 w7 w30")], "query_id long, query string")

    def rows(df):
        return sorted((x["query_id"], x["id"], round(x["score"], 6)) for x in df.collect())

    want = rows(search.Bm25(docs).topk(queries, 9))
    monkeypatch.setattr(search, "TERM_BYTES", 2_000)
    monkeypatch.setattr(search, "CELLS", 64)
    assert rows(search.Bm25(docs).topk(queries, 9)) == want
    monkeypatch.setattr(postings, "TASK_POSTINGS", 50)
    monkeypatch.setattr(postings, "PIECE_BYTES", 500)
    index = Postings(spark, f"file://{tmp_path}/index", "long")
    index.add(docs)
    assert rows(index.bm25(queries, 9)) == want
