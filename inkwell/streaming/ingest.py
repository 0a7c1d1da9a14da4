"""Indexing as a stream: each batch of new chunks goes through the same anti-join as a batch run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from inkwell.plans.index import index_chunks
from inkwell.sources.store import PointStore


def index_stream(chunks: DataFrame, store: PointStore, collection: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Index a stream of chunks (content, source, chunk_type).

    A batch that is delivered again finds its hashes indexed and adds nothing.
    """

    def batch(df: DataFrame, _: int) -> None:
        index_chunks(store, df, collection)

    writer = chunks.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
