"""Functions of texts that run in Python over a bounded amount of text at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

#: Bytes of text whose results are held at once; a longer text is a slice of its own.
SLICE_BYTES = 1 << 20
#: Values of a slice, however short they are.
SLICE_ROWS = 1_000


def slices(values: pa.Array) -> Iterator[pa.Array]:
    """A column of texts or bytes cut into slices of at most SLICE_BYTES and SLICE_ROWS, in order."""
    width = "q" if pa.types.is_large_string(values.type) or pa.types.is_large_binary(values.type) else "i"
    ends = np.frombuffer(values.buffers()[1], width)[values.offset : values.offset + len(values) + 1] if len(values) else np.zeros(1)
    at = 0
    while at < len(values):
        end = max(at + 1, min(at + SLICE_ROWS, int(np.searchsorted(ends, ends[at] + SLICE_BYTES, "right")) - 1))
        yield values.slice(at, end - at)
        at = end


def by_slice(kind: str, one: Callable[[str | None], object]) -> Callable[..., Column]:
    """A function of a text column with results of type `kind`: `one` of each text, null included.

    A batch of Spark has thousands of texts, whatever their length; their results leave slice by slice, so a worker holds those of one slice.
    """
    made = to_arrow_type(DataType.fromDDL(kind))

    @F.arrow_udf(kind)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for part in slices(batch):
                yield pa.array([one(x.as_py()) for x in part], made)

    return run
