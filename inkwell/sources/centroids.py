"""A stored index of dense vectors: inverted lists around centroids, that grows by increments.

Centroids are fitted on a bounded sample; every vector is stored, in the list of
its nearest centroid, with its angle to it.  A list is a partition of the files, so a
search reads only the lists that it probes.  A version is a small file that names
the centroids and the increments, so a reader sees all of an increment or nothing of it.

A search of `probes` lists is approximate.  An exact one goes on from there: a list whose
angles are from `low` to `high` has no vector nearer to a query at angle t of its
centroid than max(low - t, t - high, 0), so only lists that may beat the k-th score are read besides.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.operators.search import BLOCK, CELLS, DIGITS, _Best, _gathered, held, ranked
from inkwell.sources.claims import Folder
from inkwell.sources.store import ConflictError

#: Lists of an index, and sampled vectors for each on which they are fitted; so the sample has at most about their product.
MOST_LISTS = 2_048
SAMPLE = 32
ROUNDS = 8
#: Vectors of one file; a list with more has several, written by several tasks.
FILE_ROWS = 200_000
#: Bytes of packed queries up to which they are sent to all executors; more are paired by shuffle.
BROADCAST_BYTES = 32 << 20
#: Rounding of angles and scores; a bound is taken for lower than a score only by more than this.
SLACK = 1e-6
#: The list of vectors of norm zero or of another length than the index's: they score 0 with every query of its length.
ODD = -1
#: Identifiers and unit vectors of the queries that read a list.
PROBED = "list int, query_ids binary, queries binary"


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)


def _units(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1)
    return x / np.where(n > 0, n, 1)[:, None]


def _angles(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ centroids.T, -1, 1))


def fit_centroids(sample: np.ndarray, lists: int) -> np.ndarray:
    """Unit centroids by spherical k-means from the first rows of `sample` that differ; fewer than `lists` if fewer differ."""
    x = _units(sample)
    _, first = np.unique(np.round(x, 6), axis=0, return_index=True)
    centroids = x[np.sort(first)[:lists]]
    for _ in range(ROUNDS):
        own = np.concatenate([np.argmax(x[at : at + 4_096] @ centroids.T, axis=1) for at in range(0, len(x), 4_096)])
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, x)
        moved = np.linalg.norm(sums, axis=1) > 0  # a centroid that has lost its vectors stays
        centroids = np.where(moved[:, None], _units(sums), centroids)
    return centroids


class VectorIndex:
    """An index in a folder.  Identifiers are of one type: string, long or int.

    Vectors that are null or have null or non-finite entries, and those whose identifier is null, are not indexed; one that is
    added twice is found twice.  Its length of vectors is the most frequent one of what is indexed first.
    """

    def __init__(self, spark: SparkSession, path: str, id_type: str = "string", entry: str = "float") -> None:
        self.spark, self.path, self.id_type, self.entry = spark, path.rstrip("/"), id_type, entry
        self._versions = Folder(spark, f"{self.path}/versions")
        self._data = Folder(spark, f"{self.path}/data")
        self.schemas = {
            "vectors": f"id {id_type}, vector array<{entry}>, angle double, list int",
            "lists": "list int, n long, low double, high double",
            "centroids": "list int, centroid array<double>, width int",
        }
        #: Lists of the index that have vectors, and those that the last search read; one that some queries probe and others go on to counts twice.
        self.lists_met = self.lists_read = 0

    def _current(self) -> tuple[int, str | None, list[str]]:
        """Number, centroids and increments of the last version."""
        names = self._versions.names()
        if not names:
            return 0, None, []
        found = self._versions.content(names[-1])
        return int(names[-1]), found["centroids"], found["parts"]

    def _at(self, table: str, part: str) -> str:
        return f"{self.path}/data/{table}/part={part}"

    def _read(self, table: str, parts: list[str]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], self.schemas[table])
        at = f"{self.path}/data/{table}"
        return self.spark.read.schema(self.schemas[table]).option("basePath", at).parquet(*[f"{at}/part={p}" for p in parts]).drop("part")

    def _delete(self, part: str) -> None:
        for table in self.schemas:
            self._data.delete(f"{table}/part={part}")

    def _clean(self, rows: DataFrame, id_col: str, vector: str, id_type: str, entry: str) -> DataFrame:
        """(id, vector) of the rows that can be ranked."""
        given = rows.select(F.col(id_col).cast(id_type).alias("id"), F.col(vector).cast(f"array<{entry}>").alias("vector"))
        bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        return given.filter(F.col("id").isNotNull() & F.col("vector").isNotNull() & ~bad)

    def _fit(self, rows: DataFrame) -> str:
        """Fit centroids on a sample of rows (id, vector), chosen by hashes of their identifiers, and write them."""
        sizes = rows.filter(F.exists("vector", lambda x: x != 0)).groupBy(F.size("vector").alias("width")).count()
        usual = sizes.orderBy(F.desc("count"), "width").limit(1).collect()
        width, n = usual[0] if usual else (0, 0)
        lists = min(MOST_LISTS, max(1, int(n**0.5)))
        most = lists * SAMPLE
        ring = 1 << 30
        share = F.pmod(F.xxhash64("id"), F.lit(ring)) < int(min(1.0, most / max(n, 1)) * ring)
        of_width = rows.filter((F.size("vector") == width) & F.exists("vector", lambda x: x != 0))
        # Repeats of one identifier share a hash: the limit bounds what they can add.
        sample = [r["vector"] for r in of_width.filter(share).orderBy(F.xxhash64("id"), "id").limit(2 * most).collect()]
        sample = sample or [r[0] for r in of_width.select("vector").limit(1).collect()]
        found = fit_centroids(np.array(sample, float), lists) if sample else np.zeros((0, 0))
        name = uuid.uuid4().hex
        made = [(i, c.tolist(), int(width)) for i, c in enumerate(found)]
        self.spark.createDataFrame(made, self.schemas["centroids"]).coalesce(1).write.parquet(self._at("centroids", name))
        return name

    def _centroids(self, name: str) -> np.ndarray:
        rows = sorted(self._read("centroids", [name]).select("list", "centroid").collect())
        return np.array([c for _, c in rows]) if rows else np.zeros((0, 0))

    def _write(self, rows: DataFrame, centroids: np.ndarray) -> str:
        """Write rows (id, vector) as an increment that no version has yet."""
        shared = self.spark.sparkContext.broadcast(centroids)
        kind = self.schemas["vectors"]

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            c = shared.value
            for batch in batches:
                vectors = batch.column("vector")
                sizes = np.diff(vectors.offsets.to_numpy())
                own, angle = np.full(batch.num_rows, ODD, np.int32), np.zeros(batch.num_rows)
                fits = np.flatnonzero(sizes == c.shape[1]) if len(c) else np.zeros(0, int)
                x = _matrix(vectors.take(pa.array(fits)), c.shape[1]) if len(fits) else np.zeros((0, 1))
                fits, x = fits[x.any(axis=1)], _units(x[x.any(axis=1)])
                step = max(1, CELLS // max(1, len(c)))
                for at in range(0, len(fits), step):
                    found = _angles(x[at : at + step], c)
                    own[fits[at : at + step]], angle[fits[at : at + step]] = found.argmin(axis=1), found.min(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column("id"), vectors, pa.array(angle), pa.array(own)], names=["id", "vector", "angle", "list"])

        name = uuid.uuid4().hex
        assigned = rows.mapInArrow(assign, kind)
        # A list of many vectors, such as copies of one, is dealt over files; there are MOST_LISTS + 1 lists at most.
        files = assigned.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / FILE_ROWS).alias("files"))
        dealt = assigned.join(F.broadcast(files), "list").withColumn("file", F.pmod(F.xxhash64("id", "angle"), F.col("files")))
        dealt.repartition("list", "file").drop("file", "files").write.partitionBy("list").parquet(self._at("vectors", name))
        stats = self._read("vectors", [name]).groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.min("angle").alias("low"), F.max("angle").alias("high"))
        stats.coalesce(1).write.parquet(self._at("lists", name))
        return name

    def _claim(self, number: int, centroids: str, parts: list[str], own: list[str]) -> None:
        if not self._versions.claim(f"{number + 1:012d}", {"centroids": centroids, "parts": parts}):
            for part in own:
                self._delete(part)
            raise ConflictError(self.path)

    def add(self, points: DataFrame, id_col: str = "id", vector: str = "embedding") -> None:
        """Index vectors as an increment of their own; the first increment fits the centroids."""
        number, centroids, parts = self._current()
        rows = self._clean(points, id_col, vector, self.id_type, self.entry)
        own = [] if centroids else [self._fit(rows)]
        centroids = centroids or own[0]
        part = self._write(rows, self._centroids(centroids))
        self._claim(number, centroids, [*parts, part], [*own, part])

    def rebuild(self) -> None:
        """Fit the centroids again on all that is indexed and fold the increments into one, as after much growth."""
        number, old, parts = self._current()
        if old is None:
            return
        rows = self._read("vectors", parts).select("id", "vector")
        centroids = self._fit(rows)
        part = self._write(rows, self._centroids(centroids))
        self._claim(number, centroids, [part], [centroids, part])
        for name in self._versions.names()[:-1]:
            self._versions.delete(name)
        for name in [old, *parts]:
            self._delete(name)

    def lists(self) -> DataFrame:
        """(list, n, low, high): the vectors of each list, and their least and greatest angle to its centroid."""
        return self._read("lists", self._current()[2]).groupBy("list").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))

    def topk(self, queries: DataFrame, k: int, probes: int = 8, exact: bool = False, vector: str = "embedding") -> DataFrame:
        """(query_id, id, score, rank): of the vectors in each query's nearest `probes` lists, or exactly of all, the k of the largest cosine.

        A query of norm zero or of another length than the index's is compared with all vectors.
        Queries that cannot be ranked (see the class) give no row.
        """
        _, name, parts = self._current()
        stats = {r["list"]: r for r in self.lists().collect()}  # MOST_LISTS + 1 rows at most
        self.lists_met, self.lists_read = len(stats), 0
        centroids = self._centroids(name) if name else np.zeros((0, 0))
        width = centroids.shape[1] if len(centroids) else 0
        given = self._clean(queries, "query_id", vector, "long", "double")
        usual = (F.size("vector") == width) & F.exists("vector", lambda x: x != 0)
        odd = given.filter(~usual)
        if not parts:
            return ranked(self.spark.createDataFrame([], f"query_id long, id {self.id_type}, score double"), k)
        vectors = self._read("vectors", parts)
        good = given.filter(usual)
        found = ranked(self._scores(vectors, self._probed(good, centroids, stats, probes), stats, k), k)
        if exact:
            found = held(found)
            beat = found.filter(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("beat"))
            more = good.join(beat, "id", "left").withColumn("beat", F.coalesce("beat", F.lit(float("-inf"))))
            rest = self._scores(vectors, self._probed(more, centroids, stats, probes, True), stats, k)
            found = ranked(found.drop("rank").unionByName(rest), k)
        if odd.limit(1).count():
            found = found.unionByName(ranked(self._scores(vectors, self._everywhere(odd, stats), stats, k), k))
        return found

    def probes_for(self, queries: DataFrame, k: int, recall: float = 0.95, most: int = 256, sure: float = 0.95, vector: str = "embedding") -> int:
        """The least number of probes with which a share `sure` of a sample of `most` queries (query_id and a vector) each find the wanted share of their exact results.

        A share of all results together would leave other queries, when they are few, below it as often as above it.
        Where vectors have no clusters this is most of the lists: then only an exact search is worth its name.
        """
        _, name, parts = self._current()
        clean = self._clean(queries, "query_id", vector, "long", "double")
        asked = held(clean.orderBy(F.xxhash64("id"), "id").limit(most))
        best = held(self.topk(asked.select(F.col("id").alias("query_id"), F.col("vector").alias("embedding")), k, exact=True))
        hits = best.join(self._read("vectors", parts).select("id", "list"), "id").filter(F.col("list") != ODD).select("query_id", "list").collect()  # k * most rows
        if not hits:
            return 1
        centroids, full = self._centroids(name), [r["list"] for r in self.lists().filter(F.col("list") != ODD).orderBy("list").collect()]
        places: dict[int, list[int]] = {}
        ranks = {}
        for r in asked.filter(F.size("vector") == centroids.shape[1]).collect():
            order = np.argsort(_angles(_units(np.array([r["vector"]])), centroids[full])[0], kind="stable")
            ranks[r["id"]] = {full[x]: nth for nth, x in enumerate(order, 1)}
        for h in hits:
            if h["query_id"] in ranks:
                places.setdefault(h["query_id"], []).append(ranks[h["query_id"]][h["list"]])
        needed = sorted(sorted(x)[max(0, int(np.ceil(recall * len(x))) - 1)] for x in places.values())
        return needed[max(0, int(np.ceil(sure * len(needed))) - 1)] if needed else 1

    def _everywhere(self, queries: DataFrame, stats: dict) -> DataFrame:
        """(list, query_ids, queries): queries packed for every list, those of one length together."""
        every = sorted(stats)

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for start in range(0, whole.num_rows, BLOCK):
                    batch = whole.slice(start, BLOCK)
                    ids, rows = batch.column("id").to_numpy(zero_copy_only=False), batch.column("vector")
                    widths = np.array([len(x) for x in rows])
                    for width in np.unique(widths):
                        at = np.flatnonzero(widths == width)
                        x = _units(_matrix(rows.take(pa.array(at)), width)) if width else np.zeros((len(at), 0))
                        names, blocks = [ids[at].tobytes()] * len(every), [x.tobytes()] * len(every)
                        yield pa.RecordBatch.from_arrays([pa.array(every, pa.int32()), pa.array(names, pa.binary()), pa.array(blocks, pa.binary())], names=["list", "query_ids", "queries"])

        return queries.mapInArrow(pack, PROBED)

    def _probed(self, queries: DataFrame, centroids: np.ndarray, stats: dict, probes: int, rest: bool = False) -> DataFrame:
        """(list, query_ids, queries): queries packed for each list that they probe.

        Those are the nearest `probes` lists that have vectors, or with `rest` the others that may beat `beat`.
        """
        full = sorted(x for x in stats if x != ODD)
        low, high = (np.array([stats[x][f] for x in full], float) for f in ("low", "high"))
        shared = self.spark.sparkContext.broadcast(centroids[full] if full else centroids)
        numbers, has_odd = np.array(full, np.int32), ODD in stats
        width = centroids.shape[1] if len(centroids) else 1

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for start in range(0, whole.num_rows, BLOCK):
                    batch = whole.slice(start, BLOCK)
                    ids, x = batch.column("id").to_numpy(zero_copy_only=False), _units(_matrix(batch.column("vector"), width))
                    t = _angles(x, shared.value)
                    order = np.argsort(t, axis=1, kind="stable")[:, :probes]
                    chosen = np.zeros(t.shape, bool)
                    np.put_along_axis(chosen, order, True, axis=1)
                    odd = np.zeros(len(ids), bool)
                    if rest:
                        beat = batch.column("beat").to_numpy(zero_copy_only=False) - SLACK
                        nearest = np.cos(np.maximum(0, np.maximum(low - t, t - high)))
                        chosen, odd = ~chosen & (nearest >= beat[:, None]), beat <= 0
                    out: list[tuple[int, bytes, bytes]] = []
                    for at in np.flatnonzero(chosen.any(axis=0)):
                        own = chosen[:, at]
                        out.append((int(numbers[at]), ids[own].tobytes(), x[own].tobytes()))
                    if has_odd and odd.any():
                        out.append((ODD, ids[odd].tobytes(), x[odd].tobytes()))
                    lists, names, blocks = zip(*out, strict=True) if out else ((), (), ())
                    yield pa.RecordBatch.from_arrays([pa.array(lists, pa.int32()), pa.array(names, pa.binary()), pa.array(blocks, pa.binary())], names=["list", "query_ids", "queries"])

        return queries.mapInArrow(pack, PROBED)

    def _scores(self, vectors: DataFrame, probed: DataFrame, stats: dict, k: int) -> DataFrame:
        """(query_id, id, score): the best k of each pair of blocks of one list."""
        sizes = {r["list"]: r["bytes"] for r in probed.groupBy("list").agg(F.sum(F.length("queries")).alias("bytes")).collect()}  # a row for each list
        self.lists_read += len(sizes)
        points = vectors.filter(F.col("list").isin(list(sizes))).select("list", "id", "vector")  # prunes partitions
        id_type = {"long": pa.int64(), "int": pa.int32()}.get(self.id_type, pa.string())

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in _gathered(batches):
                lists, ids, rows = batch.column("list").to_numpy(zero_copy_only=False), batch.column("id"), batch.column("vector")
                widths = np.diff(rows.offsets.to_numpy())
                for one, width in np.unique(np.stack([lists, widths]), axis=1).T:
                    at = np.flatnonzero((lists == one) & (widths == width))
                    x = _units(_matrix(rows.take(pa.array(at)), width)) if width else np.zeros((len(at), 0))
                    own = pa.ListArray.from_arrays(pa.array([0, len(at)], pa.int32()), ids.take(pa.array(at)).cast(id_type))
                    yield pa.RecordBatch.from_arrays([pa.array([one], pa.int32()), own, pa.array([int(width)], pa.int32()), pa.array([x.tobytes()], pa.binary())], names=["list", "ids", "width", "points"])

        packed = points.mapInArrow(pack, f"list int, ids array<{self.id_type}>, width int, points binary")
        if sum(sizes.values()) <= BROADCAST_BYTES:
            pairs = packed.join(F.broadcast(probed), "list")
        else:
            # Blocks of a long list are dealt over several keys, so that none is one task's work; its queries go to each.
            deals = self.spark.createDataFrame([(x, int(-(-stats[x]["n"] // FILE_ROWS))) for x in sizes], "list int, deals int")
            dealt = packed.join(F.broadcast(deals), "list").withColumn("deal", F.pmod(F.hash(F.col("ids")[0]), F.col("deals")).cast("int"))
            spread = probed.join(F.broadcast(deals), "list").withColumn("deal", F.explode(F.sequence(F.lit(0), F.col("deals") - 1)))
            pairs = dealt.drop("deals").join(spread.drop("deals"), ["list", "deal"])

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(batch.num_rows):
                    ids = batch.column("ids").slice(at, 1).flatten()
                    order = np.argsort(np.array(ids.to_pylist()), kind="stable")  # places in order: ties go to the smaller identifier
                    query_ids = np.frombuffer(batch.column("query_ids")[at].as_py(), np.int64)
                    p = np.frombuffer(batch.column("points")[at].as_py()).reshape(len(ids), -1)[order]
                    q = np.frombuffer(batch.column("queries")[at].as_py()).reshape(len(query_ids), -1)
                    best, step = _Best(len(query_ids), k), max(1, CELLS // len(query_ids))
                    for start in range(0, len(p), step):
                        own = p[start : start + step]
                        scores = q @ own.T if p.shape[1] == q.shape[1] else np.zeros((len(q), len(own)))
                        best.add(np.round(scores, DIGITS), np.arange(start, start + len(own)))
                    found, places, values = best.cut()
                    yield pa.RecordBatch.from_arrays([pa.array(query_ids[found]), ids.take(pa.array(order[places])), pa.array(values)], names=["query_id", "id", "score"])

        return pairs.select("ids", "points", "query_ids", "queries").mapInArrow(score, f"query_id long, id {self.id_type}, score double")
