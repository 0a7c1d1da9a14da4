"""Indexing and search as whole plans."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.functions.hashing import chunk_hash, point_id
from inkwell.functions.routing import route
from inkwell.functions.text import bound as _bound
from inkwell.functions.text import occurrences, sanitized_query, word_tokens
from inkwell.operators import governance, ranking, search
from inkwell.sources.claims import Folder
from inkwell.sources.files import Strategies, new_files, read_chunks, scan_files, valid_chunks
from inkwell.sources.store import PointStore, payload

#: Numbers of a default dense vector.
WIDTH = 64


def hashed_dense(content: Column, width: int = WIDTH) -> Column:
    """The default dense vector: signed feature hashing of words, normalised.  It has a model's shape, not its quality."""
    # A place and its sign in one number.
    codes = F.transform(word_tokens(content), lambda t: _code(F.xxhash64(t), width))

    def vector(n: Column) -> Column:
        sums = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: (_count(n, 2 * i + 1) - _count(n, 2 * i)).cast("double"))
        return _bound(sums, lambda x: _bound(F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, y: a + y * y)), lambda size: F.transform(x, lambda y: F.when(size > 0, y / size).otherwise(0.0))))

    return _bound(occurrences(codes), vector).cast("array<float>")


def _code(h: Column, width: int) -> Column:
    return (F.pmod(h, F.lit(width)) * 2 + F.when(h.bitwiseAND(1 << 40) == 0, 1).otherwise(0)).cast("int")


def _count(n: Column, key: Column) -> Column:
    return F.coalesce(F.try_element_at(n, key.cast("int")), F.lit(0))


def word_sparse(content: Column) -> Column:
    """The default sparse vector: log(1 + tf) by word."""
    return F.transform_values(occurrences(word_tokens(content)), lambda _, n: F.log1p(n.cast("double")))


def to_points(chunks: DataFrame, dense: Callable[[Column], Column] = hashed_dense, sparse: Callable[[Column], Column] = word_sparse, redact_content: bool = False) -> DataFrame:
    """Points of chunks that have a chunk_hash: one for each hash, with vectors, metadata, copyright columns and the number of copies.

    Of copies the one whose source, place and metadata come first gives the metadata.  Metadata is redacted, and content too if asked for.  A license is that of the metadata
    (`license`, `copyright_license`), or else one that the source names.
    """
    more = {"doc_hash": "string", "chunk_index": "int", "total_chunks": "int", "metadata": "map<string,string>"}
    full = chunks.select(*chunks.columns, *[F.lit(None).cast(t).alias(c) for c, t in more.items() if c not in chunks.columns])
    fields = ["content", "source", "chunk_type", *more]
    once = full.groupBy("chunk_hash").agg(F.min_by(F.struct(*fields), F.struct("source", "chunk_index", "doc_hash", F.to_json("metadata"))).alias("x"), F.count(F.lit(1)).alias("copies")).select("chunk_hash", "copies", "x.*")
    content = governance.redact(F.col("content")) if redact_content else F.col("content")
    metadata = F.coalesce("metadata", F.create_map().cast("map<string,string>"))
    named = [F.try_element_at(metadata, F.lit(k)) for k in ("license", "copyright_license")]
    return once.select(
        point_id(F.col("chunk_hash")).alias("id"), dense(F.col("content")).alias("dense"), sparse(F.col("content")).alias("sparse"), content.alias("content"),
        "source", "chunk_type", "chunk_hash", "doc_hash", "chunk_index", "total_chunks", governance.redact_map(metadata).alias("metadata"),
        *governance.copyright_columns(F.col("source"), *named), "copies",
    )


def index_chunks(
    store: PointStore, chunks: DataFrame, collection: str = "documents", incremental: bool = True, model: Callable[[Column], Column] | None = None, **options: object
) -> dict[str, int]:
    """Index chunks that the collection has not seen; the numbers of chunks and of new points.

    model: an embedder of `operators.models` in place of the default vectors.  Points that it fails for are the rows of
    `store.failed`; they are not indexed, and the next run tries them again.
    """
    hashed = valid_chunks(chunks).withColumn("chunk_hash", chunk_hash(F.col("content"), F.col("source"), F.col("chunk_type")))
    fresh = store.unseen(collection, hashed) if incremental else hashed
    if model is None:
        n, points = store.add(collection, to_points(fresh, **options), fresh=incremental)
        return {"chunks": n, "points": points}
    # Vectors are computed once: points and failures both come from what is written here.
    run = f"{store.path}/{collection}/runs/{uuid.uuid4().hex}"
    computed = to_points(fresh, dense=model, **options)
    computed.write.parquet(run)
    made = store.spark.read.schema(computed.schema).parquet(run)
    failed = store.failed(collection)
    failed.replace(made.filter("dense.error is not null").select("id", "source", F.col("dense.error").alias("error")))
    n, points = store.add(collection, made.filter("dense.error is null").withColumn("dense", F.col("dense.vector")), fresh=incremental)
    Folder(store.spark, run).delete()
    return {"chunks": n, "points": points, "failed": failed.read().count()}


def index_folder(
    spark: SparkSession, store: PointStore, path: str, collection: str = "documents", strategies: Strategies | None = None, recursive: bool = True, incremental: bool = True
) -> dict[str, int]:
    """Scan a folder, parse, chunk and index its files.

    A file whose content an earlier run has read is not parsed again, and a content that occurs
    twice is read once.  Files that cannot be read, or that no strategy reads, are the rows of
    `store.errors`; they are tried again by the next run.
    """
    strategies = strategies or Strategies()
    known = list(strategies.by_suffix)
    processed = store.processed(collection)
    seen = processed.read() if incremental else processed.read().limit(0)
    fresh = new_files(scan_files(spark, path, known, recursive), seen)
    skipped = scan_files(spark, path, None, recursive).select("path", F.coalesce("error", F.when(~F.col("suffix").isin(*known), "no_strategy")).alias("error"))
    return index_files(store, fresh, skipped, collection, strategies, incremental)


def index_files(
    store: PointStore, fresh: DataFrame, skipped: DataFrame, collection: str = "documents", strategies: Strategies | None = None, incremental: bool = True, retried: DataFrame | None = None
) -> dict[str, int]:
    """Parse, chunk and index files (path, suffix, content, file_hash), and record them as processed.

    `skipped` has the files that are not read (path, error; a null error is none).  They and those that fail become
    the rows of `store.errors`; with `retried`, the paths of all that is read here, errors of other files stay.
    """
    spark = store.spark
    processed = store.processed(collection)
    # Parsed once: errors and points both come from what is written here.
    run = f"{store.path}/{collection}/runs/{uuid.uuid4().hex}"
    parsed = read_chunks(fresh, strategies)
    parsed.write.parquet(run)
    chunks = spark.read.schema(parsed.schema).parquet(run)
    failed = skipped.unionByName(chunks.select(F.col("source").alias("path"), "error")).filter("error is not null").distinct()
    errors = store.errors(collection)
    if retried is None:
        errors.replace(failed)
    else:
        errors.remove(retried)
        errors.upsert(failed)
    # Before the index is written: what is in the folder now is what this run reads.
    part = processed.write_part(fresh.join(errors.read().select("path"), "path", "left_anti").select("file_hash").distinct().withColumn("ts", F.current_timestamp()))
    found = index_chunks(store, chunks, collection, incremental)
    if incremental:
        processed.append_part(part)
    else:
        processed.upsert_part(part)
    Folder(spark, run).delete()
    return found


def search_points(store: PointStore, queries: DataFrame, collection: str = "documents", top_k: int = 20, rerank_k: int = 5, conditions: dict[str, object] | None = None) -> DataFrame:
    """Validate, route, search, rerank and compress: one row for each result of each query (query_id, query).

    An invalid query is one row with an error.
    """
    checked = queries.withColumn("_q", sanitized_query(F.col("query"))).select("query_id", "_q.query", "_q.error")
    good = checked.filter("error is null").withColumn("strategy", route(F.col("query")))
    points = store.points(collection).read()
    for field, value in (conditions or {}).items():
        points = points.filter(payload(field, points.columns) == F.lit(value))
    fetch = search.OVERFETCH * top_k
    wants = {b: good.filter(F.col(f"strategy.{b}") > 0) for b in ("dense", "sparse")}
    dense = search.dense_topk(wants["dense"].select("query_id", hashed_dense(F.col("query")).alias("embedding")), points.select("id", F.col("dense").alias("embedding")), fetch)
    terms = wants["sparse"].select("query_id", F.explode(word_sparse(F.col("query"))).alias("term", "weight"))
    sparse = search.sparse_topk(terms, points.select("id", "sparse"), fetch)
    fused = search.fuse([(dense, 1.0), (sparse, 1.0)], top_k, 2.0, first=0)
    # Payloads are fetched for the results only.
    full = fused.join(points.select("id", F.col("id").alias("point"), "content", "source"), "id")
    best = ranking.rerank(full.join(good.select("query_id", "query"), "query_id"), rerank_k)
    found = best.select("query_id", "query", "point", "source", "score", "rerank_score", "rerank_rank", ranking.compress(F.col("query"), F.col("content")).alias("text"), F.lit(None).cast("string").alias("error"))
    null = {c: F.lit(None).cast(t).alias(c) for c, t in found.dtypes}
    failed = checked.filter("error is not null").select("query_id", *[null[c] for c in found.columns[1:-1]], "error")
    return found.unionByName(failed)
