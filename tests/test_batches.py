import pyarrow as pa

from inkwell.functions import batches


def test_slices_are_bounded(monkeypatch):
    monkeypatch.setattr(batches, "SLICE_BYTES", 10)
    monkeypatch.setattr(batches, "SLICE_ROWS", 4)
    values = ["abc", None, "é" * 9, "", "", "", "", "", "abcdefgh", "ab", "c", None]
    for kind in (pa.string(), pa.large_string()):
        for first in (0, 1, 5):
            own = values[first:]
            parts = [p.to_pylist() for p in batches.slices(pa.array(values, kind).slice(first))]
            assert sum(parts, []) == own
            assert all(len(p) <= 4 and (len(p) == 1 or sum(len((x or "").encode()) for x in p) <= 10) for p in parts)
    assert not list(batches.slices(pa.array([], pa.string())))


def test_results_leave_slice_by_slice(spark, tmp_path):
    """One batch of Spark, whose results were held as a whole before."""

    def size(text):
        return None if text is None else f"{len(text)}"

    texts = [None if i % 7 == 0 else "x" * (i * 100) for i in range(2_000)]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string").coalesce(1)
    found = df.select("i", batches.by_slice("string", size)("t").alias("n")).collect()
    assert [r["n"] for r in sorted(found)] == [size(t) for t in texts]
    parts = list(batches.slices(pa.array(texts)))
    assert len(parts) > 100 and max(p.nbytes for p in parts) < 2 * batches.SLICE_BYTES
