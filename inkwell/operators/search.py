"""Scored retrieval: dense and sparse top-k, BM25, rank fusion.

Both sides of a search are packed into blocks, a row for each; Spark pairs the
blocks, and a task multiplies those of a pair and hands on no more than each
query's best of it.  So what is shuffled is k rows for a query and block, however
many points share a word with the query.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.functions.text import word_tokens

#: Numbers of one score matrix in a task.
CELLS = 1 << 19
#: Points and bytes of one block, about.
BLOCK_POINTS = 10_000
BLOCK_BYTES = 64 << 20
#: Bytes of one block of words: what a task holds of it besides is several times as much.
TERM_BYTES = 8 << 20
#: Queries of one block.
BLOCK = 512
#: Queries up to which their blocks are sent to all executors; of more, blocks are paired by shuffle.
BROADCAST_QUERIES = 4_096
#: Digits of a summed score: sums in another order agree, so that texts that are copies tie.
DIGITS = 9
#: Each branch of a hybrid search fetches so many times the limit.
OVERFETCH = 3
#: Rows up to which a table of query terms is sent to all executors; a larger one is joined by shuffle.
BROADCAST_ROWS = 200_000
#: Rows of results up to which the driver holds them between two steps of a search.
HELD_ROWS = 50_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """`df` marked for broadcast if it has at most so many rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def held(df: DataFrame, rows: int = HELD_ROWS) -> DataFrame:
    """`df` evaluated once and broadcast if it has at most so many rows, which the driver then holds; else as it is."""
    found = df.limit(rows + 1).collect()
    return F.broadcast(df.sparkSession.createDataFrame(found, df.schema)) if len(found) <= rows else df


def ranked(scores: DataFrame, k: int, query: str = "query_id", doc: str = "id", score: str = "score") -> DataFrame:
    """The best k of each query with their rank from 1; ties go to the smaller identifier."""
    order = Window.partitionBy(query).orderBy(F.desc(score), doc)
    return scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


class _Best:
    """The best k scores of each query so far; ties go to the smaller identifier."""

    def __init__(self, queries: int, k: int) -> None:
        self.k, self.least = k, np.full(queries, -np.inf)
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size, self.most = 0, max(4 * k * queries, 1 << 16)

    def add(self, scores: np.ndarray, ids: np.ndarray, wanted: np.ndarray | None = None) -> None:
        """Scores by query and point; `wanted` marks those that count."""
        out = np.isnan(scores) if wanted is None else np.isnan(scores) | ~wanted
        scores, least = np.where(out, -np.inf, scores), self.least
        if scores.shape[1] > self.k:  # so the first scores of a query are not all held
            least = np.maximum(least, np.partition(scores, -self.k, axis=1)[:, -self.k])
        q, at = np.nonzero((scores >= least[:, None]) & ~out)
        self.held.append((q, ids[at], scores[q, at]))
        self.size += len(q)
        if self.size > self.most:
            self.cut()

    def cut(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.held:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        q, i, s = (np.concatenate(x) for x in zip(*self.held, strict=True))
        order = np.lexsort((i, -s, q))
        q, i, s = q[order], i[order], s[order]
        starts = np.searchsorted(q, np.arange(len(self.least)))
        nth = np.arange(len(q)) - starts[q]
        last = nth == self.k - 1
        self.least[q[last]] = s[last]
        keep = nth < self.k
        self.held = [(q[keep], i[keep], s[keep])]
        self.size = int(keep.sum())
        return self.held[0]


def _id_type(rows: DataFrame, column: str) -> str:
    """The type under which identifiers are searched: strings stay strings, others are numbers."""
    return "string" if dict(rows.dtypes)[column] == "string" else "long"


def _found_type(id_type: str) -> str:
    return f"query_id long, id {id_type}, score double"


def _sortable(ids: pa.Array) -> np.ndarray:
    """Identifiers as numbers, or as strings that numpy orders by code point."""
    plain = ids.to_numpy(zero_copy_only=False)
    return plain.astype(str) if pa.types.is_string(ids.type) or pa.types.is_large_string(ids.type) else plain


def _found(best: _Best, query_ids: np.ndarray, id_type: pa.DataType) -> pa.RecordBatch:
    q, i, s = best.cut()
    return pa.RecordBatch.from_arrays([pa.array(query_ids[q]), pa.array(i.tolist(), id_type), pa.array(s)], names=["query_id", "id", "score"])


def _paired(points: DataFrame, queries: DataFrame, few: bool) -> DataFrame:
    """Every block of points with every block of queries."""
    return points.crossJoin(F.broadcast(queries)) if few else points.crossJoin(queries.repartition(queries.sparkSession.sparkContext.defaultParallelism))


def _few(queries: DataFrame) -> bool:
    return queries.limit(BROADCAST_QUERIES + 1).count() <= BROADCAST_QUERIES


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches put together to blocks of BLOCK_POINTS rows or BLOCK_BYTES, whatever size of batch the session has."""
    found: list[pa.RecordBatch] = []
    for batch in batches:
        found.append(batch)
        if sum(b.num_rows for b in found) >= BLOCK_POINTS or sum(b.nbytes for b in found) >= BLOCK_BYTES:
            yield from pa.Table.from_batches(found).combine_chunks().to_batches()
            found = []
    if found:
        yield from pa.Table.from_batches(found).combine_chunks().to_batches()


def pieces(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Batches cut into rows of about so many bytes together; a row of more stays whole."""
    for batch in batches:
        if batch.nbytes <= most or batch.num_rows < 2:
            yield batch
        else:
            half = batch.num_rows // 2
            yield from pieces(iter((batch.slice(0, half), batch.slice(half))), most)


def _vector_blocks(rows: DataFrame, name: str, most: int | None = None) -> DataFrame:
    """(name_ids, name_width, name_vectors): vectors of one length in a row, unit vectors but for those of norm zero."""
    id_type = _id_type(rows, "id")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _gathered(batches):
            ids, vectors = batch.column(0), batch.column(1)
            sizes = np.diff(vectors.offsets.to_numpy())
            flat, starts = vectors.flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes) - sizes
            for width in np.unique(sizes):
                own = np.flatnonzero(sizes == width)
                for at in range(0, len(own), most or len(own)):
                    part = own[at : at + (most or len(own))]
                    x = flat[starts[part][:, None] + np.arange(width)]
                    n = np.linalg.norm(x, axis=1)
                    x = x / np.where(n > 0, n, 1)[:, None]
                    own_ids = pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), ids.take(pa.array(part)))
                    yield pa.RecordBatch.from_arrays([own_ids, pa.array([int(width)]), pa.array([x.tobytes()], pa.binary())], names=["i", "w", "v"])

    return rows.mapInArrow(pack, f"i array<{id_type}>, w long, v binary").toDF(f"{name}_ids", f"{name}_width", f"{name}_vectors")


def dense_topk(queries: DataFrame, points: DataFrame, k: int, vector: str = "embedding") -> DataFrame:
    """(query_id, id, score, rank): the k points of the largest cosine similarity to each query.

    `queries` has query_id and a vector, `points` id and a vector.  A vector of norm zero or of
    another length than the query's scores 0; a null vector is left out.  Identifiers of points are
    strings or else numbers, those of queries numbers; none is null.
    """
    id_type = _id_type(points, "id")

    def clean(rows: DataFrame, key: str, key_type: str = "long") -> DataFrame:
        return rows.filter(F.col(vector).isNotNull()).select(F.col(key).cast(key_type).alias("id"), F.col(vector).cast("array<double>").alias("v"))

    wanted = clean(queries, "query_id")
    pairs = _paired(_vector_blocks(clean(points, "id", id_type), "point"), _vector_blocks(wanted, "query", BLOCK), _few(wanted))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                x = {n: batch.column(n)[at] for n in batch.schema.names}
                ids, query_ids = _sortable(x["point_ids"].values), _sortable(x["query_ids"].values)
                x = {n: v.as_py() for n, v in x.items() if not n.endswith("_ids")}
                p = np.frombuffer(x["point_vectors"]).reshape(len(ids), -1)
                q = np.frombuffer(x["query_vectors"]).reshape(len(query_ids), -1)
                best = _Best(len(query_ids), k)
                step = max(1, CELLS // len(query_ids))
                for first in range(0, len(ids), step):
                    own = p[first : first + step]
                    best.add(q @ own.T if x["point_width"] == x["query_width"] else np.zeros((len(q), len(own))), ids[first : first + step])
                yield _found(best, query_ids, batch.column("point_ids").type.value_type)

    return ranked(pairs.mapInArrow(score, _found_type(id_type)), k)


def term_topk(queries: DataFrame, points: DataFrame, k: int, weigh: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """(query_id, id, score, rank): the k points of the largest dot product over shared terms.

    `queries` has query_id, term, weight.  `points` has id, terms and weights (arrays), or with `weigh`
    id and terms with repetitions: a term's weight is then weigh(its count, all terms of the point).
    Only points that share a term with a query are ranked.  Identifiers are those of `dense_topk`.
    """
    id_type = _id_type(points, "id")
    count = queries.select("query_id").distinct().count()
    blocks = F.pmod(F.xxhash64("query_id"), F.lit(max(1, -(-count // BLOCK))))
    entry = F.struct("query_id", "term", "weight")
    packed = queries.select(F.col("query_id").cast("long"), "term", F.col("weight").cast("double")).groupBy(blocks.alias("block")).agg(F.collect_list(entry).alias("entries")).select("entries")
    names = ["id", "terms"] if weigh else ["id", "terms", "weights"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(_gathered(batches), TERM_BYTES):
            terms = batch.column("terms")
            offsets = terms.offsets.to_numpy()
            coded = pa.ListArray.from_arrays(pa.array(offsets - offsets[:1]), terms.flatten().dictionary_encode())  # each word once
            own = pa.RecordBatch.from_arrays([coded if n == "terms" else batch.column(n) for n in names], names=names)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, own.schema) as writer:
                writer.write_batch(own)
            yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["points"])

    own = points.filter(F.size("terms") > 0).select(F.col("id").cast(id_type), *names[1:])
    together = own.mapInArrow(pack, "points binary")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                yield _scored(batch.slice(at, 1), k, weigh)

    return ranked(_paired(together, packed, count <= BROADCAST_QUERIES).mapInArrow(score, _found_type(id_type)), k)


def _scored(pair: pa.RecordBatch, k: int, weigh: Callable[[np.ndarray, np.ndarray], np.ndarray] | None) -> pa.RecordBatch:
    """Best k of each query for one block of points and one of queries."""
    entries = pair.column("entries").flatten()
    query_ids, q = np.unique(entries.field("query_id").to_numpy(zero_copy_only=False), return_inverse=True)
    terms = entries.field("term").dictionary_encode()
    table = np.zeros((len(terms.dictionary), len(query_ids)))
    np.add.at(table, (terms.indices.to_numpy(zero_copy_only=False), q), entries.field("weight").to_numpy(zero_copy_only=False))
    points = pa.ipc.open_stream(pair.column("points")[0].as_py()).read_next_batch()
    ids, lists = _sortable(points.column("id")), points.column("terms")
    sizes, coded = np.diff(lists.offsets.to_numpy()), lists.flatten()
    own = pc.fill_null(pc.index_in(coded.dictionary, value_set=terms.dictionary), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    code = own[coded.indices.to_numpy(zero_copy_only=False)]
    known = np.flatnonzero(code >= 0)
    row, code = np.repeat(np.arange(len(ids)), sizes)[known], code[known]
    if weigh:
        key, n = np.unique(row * len(table) + code, return_counts=True)
        row, code = key // len(table), key % len(table)
        weight = weigh(n.astype(float), sizes[row].astype(float))
    else:
        weight = points.column("weights").flatten().to_numpy(zero_copy_only=False)[known]
    best = _Best(len(query_ids), k)
    shared = None if (table >= 0).all() and (weight > 0).all() else (table != 0).astype(float)
    starts = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else np.zeros(0, np.int64)
    ends, step = np.append(starts[1:], len(row)), max(1, CELLS // len(query_ids))
    first = 0
    while first < len(starts):  # as many points as fit a matrix, and one at least
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + step, "right")))
        part = slice(starts[first], ends[last - 1])
        at = starts[first:last] - starts[first]
        scores = np.round(np.add.reduceat(table[code[part]] * weight[part, None], at, axis=0).T, DIGITS)
        met = scores > 0 if shared is None else np.add.reduceat(shared[code[part]], at, axis=0).T > 0
        best.add(scores, ids[row[starts[first:last]]], met)
        first = last
    return _found(best, query_ids, points.column("id").type)


def term_weights(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, term, tf): how often each word occurs in each text."""
    each = docs.select(F.col(id_col).alias("id"), F.explode(word_tokens(F.col(text_col))).alias("term"))
    return each.groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"))


def sparse_vectors(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, term, weight): lexical weights log(1 + tf), the default of the sparse branch."""
    return term_weights(docs, id_col, text_col).select("id", "term", F.log1p("tf").alias("weight"))


def sparse_topk(queries: DataFrame, points: DataFrame, k: int) -> DataFrame:
    """`term_topk` of points whose sparse vector is a map: id, sparse."""
    given = points.filter(F.col("sparse").isNotNull())
    return term_topk(queries, given.select("id", F.map_keys("sparse").alias("terms"), F.map_values("sparse").alias("weights")), k)


def lexical_topk(queries: DataFrame, docs: DataFrame, k: int, id_col: str = "id", text_col: str = "content") -> DataFrame:
    """`term_topk` by the default lexical weights of texts."""
    return term_topk(queries, docs.select(F.col(id_col).alias("id"), word_tokens(F.col(text_col)).alias("terms")), k, lambda tf, _: np.log1p(tf))


class Bm25:
    """Corpus statistics of Okapi BM25: lengths, document frequencies and their weights.

    A weight below zero becomes epsilon times the mean weight of all terms.
    """

    def __init__(self, docs: DataFrame, id_col: str = "id", text_col: str = "content", k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25) -> None:
        self.k1, self.b = k1, b
        self.tokens = docs.select(F.col(id_col).alias("id"), word_tokens(F.col(text_col)).alias("terms"))
        # One pass over the texts: a row for each word of the vocabulary, and one, for no word, with the number and length of all texts.
        words = F.concat(F.array_distinct("terms"), F.array(F.lit(None).cast("string")))
        each = self.tokens.select(F.size("terms").alias("length"), F.explode(words).alias("term"))
        self._counts = each.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum(F.when(F.col("term").isNull(), F.col("length"))).alias("length")).persist(StorageLevel.MEMORY_AND_DISK)
        total = self._counts.filter("term is null").first()
        self.n, self.average = (total["df"], total["length"] / total["df"] or 1.0) if total else (0, 1.0)
        raw = F.log(F.lit(float(self.n)) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
        found = self._counts.filter("term is not null").select("term", raw.alias("idf"))
        mean = found.agg(F.avg("idf")).first()[0] or 0.0
        self.weights = found.withColumn("idf", F.when(F.col("idf") < 0, epsilon * mean).otherwise(F.col("idf")))

    def close(self) -> None:
        """Let go of the statistics that are held."""
        self._counts.unpersist()

    def topk(self, queries: DataFrame, k: int, id_col: str = "query_id", text_col: str = "query") -> DataFrame:
        """(query_id, id, score, rank) of the k best texts with a score above 0; repeated words of a query count again."""
        terms = queries.select(F.col(id_col).alias("query_id"), F.explode(word_tokens(F.col(text_col))).alias("term"))
        counted = small(terms.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf")))
        wanted = self.weights.join(counted, "term").select("query_id", "term", (F.col("qtf") * F.col("idf")).alias("weight"))
        k1, b, average = self.k1, self.b, self.average
        return term_topk(wanted, self.tokens, k, lambda tf, length: tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / average))).filter("score > 0")


def fuse(lists: list[tuple[DataFrame, float]], limit: int, k: float = 60.0, first: int = 1) -> DataFrame:
    """(query_id, id, score, rank): reciprocal-rank fusion of ranked lists (query_id, id, rank from 1).

    A list adds weight / (k + rank), with ranks from `first` on.
    """
    if not lists:
        raise ValueError("fuse needs a list")
    parts = [x.select("query_id", "id", (F.lit(w) / (F.lit(k) + F.col("rank") + (first - 1))).alias("part")) for x, w in lists]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return ranked(every.groupBy("query_id", "id").agg(F.sum("part").alias("score")), limit)


def hybrid(
    dense: DataFrame | None, sparse: DataFrame | None, bm25: DataFrame | None, weights: dict[str, float], limit: int, store_k: float = 2.0, list_k: float = 60.0
) -> DataFrame | None:
    """Fusion of the branches whose weight is above 0; `dense` and `sparse` are lists of OVERFETCH * limit.

    Dense and sparse are fused first, by rank alone; BM25 is fused with their result by weight.
    None if no branch has weight.
    """
    vector = [(x, 1.0) for x, name in ((dense, "dense"), (sparse, "sparse")) if x is not None and weights.get(name, 0) > 0]
    fused = fuse(vector, limit, store_k, first=0) if vector else None
    if bm25 is not None and weights.get("bm25", 0) > 0:
        share = weights.get("dense", 0.5) + weights.get("sparse", 0.5)
        lists = [(bm25, weights["bm25"])] if fused is None else [(fused, share), (bm25, weights["bm25"])]
        return fuse(lists, limit, list_k)
    return fused


def payload_filter(conditions: dict[str, object]) -> Column:
    """All of `field = value`; it reaches the scan when it is applied before the scoring."""
    out = F.lit(True)
    for field, value in conditions.items():
        out = out & (F.col(field) == F.lit(value))
    return out


def above(results: DataFrame, threshold: float) -> DataFrame:
    """Results of at least a score, out of those that the limit left."""
    return results.filter(F.col("score") >= threshold)
