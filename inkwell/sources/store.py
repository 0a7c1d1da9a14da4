"""A store of points and its index status, as versioned Parquet folders.

A version is a small file that lists the parts of a table.  A change writes a
part aside and then claims the next version, so a reader sees the old or the
new version, a failed write leaves the old one, and of two writers that began
at one version only one succeeds.

A change by key rewrites nothing.  The parts of a version have an order: a part is of new rows, of rows that
replace earlier ones of their keys ('+'), or of keys whose earlier rows are gone ('-'), and what
counts is settled by the reader.  When there are many parts, the last ones are folded together, and of earlier
ones those that are not much larger than what is folded already; so a row is written again
only a few times, however often the table changes.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from inkwell.operators.search import small
from inkwell.sources.claims import Folder

POINTS = (
    "id string, dense array<float>, sparse map<string,double>, content string, source string, chunk_type string, chunk_hash string, doc_hash string, chunk_index int, total_chunks int, "
    "metadata map<string,string>, copyright_source string, copyright_license string"
)
STATUS = "chunk_hash string, ts timestamp"
PROCESSED = "file_hash string, ts timestamp"
VERSIONS = "chunk_hash string, indexed boolean, collection string, ts timestamp"
ERRORS = "path string, error string"
FAILED = "id string, source string, error string"
#: Parts of a table from which on the next change folds the last half of them, and those before of at most FOLD times the bytes folded so far.
MOST_PARTS = 64
FOLD = 4
#: Versions that stay readable.
KEPT_VERSIONS = 2


class ConflictError(RuntimeError):
    """Another writer made the next version first; the change may be made again."""


def _name(entry: str) -> str:
    """The folder of a part, without the sign of its kind."""
    return entry.lstrip("+-")


class Table:
    """One versioned table in a folder; its key is the first column unless another is named."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str | None = None) -> None:
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self.key = key or schema.split()[0]
        self._versions = Folder(spark, f"{self.path}/versions")
        self._data = Folder(spark, f"{self.path}/data")

    def _current(self) -> tuple[int, list[str]]:
        """Number and parts of the last version."""
        names = self._versions.names()
        return (int(names[-1]), self._versions.content(names[-1])) if names else (0, [])

    def exists(self) -> bool:
        return bool(self._versions.names())

    def _of(self, parts: list[str], schema: str | None = None) -> DataFrame:
        """The rows that count of parts in this order."""
        holders = [p for p in parts if not p.startswith("-")]
        if not holders:
            return self.spark.createDataFrame([], schema or self.schema)
        rows = self.spark.read.schema(schema or self.schema).parquet(*[f"{self.path}/data/{_name(p)}" for p in holders])
        # Parts before the first that has rows have nothing to take away from.
        if not any(p[0] in "+-" for p in parts[parts.index(holders[0]) + 1 :]):
            return rows
        names = rows.columns
        numbered = rows.select(*names, self._place(parts).alias("_place"))
        gone = small(self._keys(parts).withColumnRenamed(self.key, "_gone"))
        kept = numbered.join(gone, F.col(self.key) == F.col("_gone"), "left").filter(F.col("_since").isNull() | (F.col("_since") <= F.col("_place")))
        return kept.select(*names)

    def _place(self, parts: list[str]) -> Column:
        """A row's part, as its place among `parts`."""
        places = F.create_map(*[F.lit(x) for at, p in enumerate(parts) for x in (_name(p), at)])
        return places[F.regexp_extract("_metadata.file_path", "/data/([0-9a-f]+)/[^/]*$", 1)]

    def _keys(self, parts: list[str]) -> DataFrame:
        """(key, _since): keys that parts replace or take away, with the place of the last such part."""
        telling = [p for p in parts if p[0] in "+-"]
        kind = self.spark.createDataFrame([], self.schema).schema[self.key].dataType
        keys = self.spark.read.schema(StructType([StructField(self.key, kind)])).parquet(*[f"{self.path}/data/{_name(p)}" for p in telling])
        return keys.select(self.key, self._place(parts).alias("_since")).groupBy(self.key).agg(F.max("_since").alias("_since")).filter(F.col(self.key).isNotNull())

    def read(self) -> DataFrame:
        return self._of(self._current()[1])

    def write_part(self, rows: DataFrame) -> str:
        """Write rows that no version has yet."""
        name = uuid.uuid4().hex
        rows.write.parquet(f"{self.path}/data/{name}")
        return name

    def part(self, name: str, schema: str | None = None) -> DataFrame:
        return self._of([name], schema)

    def drop_part(self, name: str) -> None:
        self._data.delete(_name(name))

    def _claim(self, number: int, parts: list[str], *own: str) -> None:
        if not self._versions.claim(f"{number + 1:012d}", parts):
            for p in own:
                self.drop_part(p)
            raise ConflictError(self.path)
        old = [n for n in self._versions.names() if int(n) <= number + 1 - KEPT_VERSIONS]
        if old:  # parts that only versions before the kept ones have
            kept = {p for n in self._versions.names() if n not in old for p in self._versions.content(n)}
            for n in old:
                for p in self._versions.content(n):
                    if p not in kept:
                        self.drop_part(p)
                self._versions.delete(n)

    def append_part(self, name: str) -> None:
        """Make the next version: the current one and a written part, folded if there are many parts."""
        number, parts = self._current()
        every = [*parts, name]
        if len(parts) < MOST_PARTS:
            self._claim(number, every, name)
            return
        first = self._fold_from(every)
        made = self._folded(every[first:], whole=first == 0)
        self._claim(number, [*every[:first], *made], *made, name)
        self.drop_part(name)

    def _fold_from(self, parts: list[str]) -> int:
        """Place of the first of the last parts that are folded."""
        sizes = [self._data.size(_name(p)) for p in parts]  # MOST_PARTS of them
        first = len(parts) // 2
        while first and sizes[first - 1] <= FOLD * sum(sizes[first:]):
            first -= 1
        return first

    def _folded(self, parts: list[str], whole: bool) -> list[str]:
        """Write what the last parts come to: the keys that they take from earlier ones, and their rows."""
        made = []
        if not whole and any(p[0] in "+-" for p in parts):
            made.append("-" + self.write_part(self._keys(parts).select(self.key)))
        return [*made, self.write_part(self._of(parts))]

    def upsert(self, rows: DataFrame, order: str | None = None) -> None:
        """Rows replace those of their keys; of several of one key the one of the greatest `order` counts.  Only these rows are written."""
        self.append_part("+" + self.write_part(_last(rows, self.key, order)))

    def upsert_part(self, name: str) -> None:
        """`upsert` of a written part, whose keys differ."""
        self.append_part("+" + name)

    def remove(self, keys: DataFrame) -> None:
        """Take away the rows of these keys.  Only the keys are written."""
        self.append_part("-" + self.write_part(keys.select(self.key).filter(F.col(self.key).isNotNull()).distinct()))

    def compact(self) -> None:
        """Fold all parts into one."""
        self.change(lambda old: old)

    def append(self, rows: DataFrame) -> None:
        self.append_part(self.write_part(rows))

    def change(self, step: Callable[[DataFrame], DataFrame]) -> None:
        """Make `step` of the current version the next one."""
        number, parts = self._current()
        name = self.write_part(step(self._of(parts)))
        self._claim(number, [name], name)

    def replace(self, rows: DataFrame) -> None:
        """Make `rows` the next version."""
        self.change(lambda _: rows)

    def drop(self) -> None:
        Folder(self.spark, self.path).delete()


def _last(rows: DataFrame, key: str, order: str | None) -> DataFrame:
    """One row of each key: any, or the one of the greatest `order`."""
    if order is None:
        return rows.dropDuplicates([key])
    nth = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    return rows.withColumn("_nth", nth).filter("_nth = 1").drop("_nth")


def upsert(old: DataFrame, new: DataFrame, key: str = "id", order: str | None = None) -> DataFrame:
    """Old rows whose key does not come again, and the last of the new rows of each key."""
    last = _last(new, key, order)
    return old.join(last.select(key), key, "left_anti").unionByName(last)


def without(old: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose key is not among `keys`."""
    return old.join(keys.select(key).distinct(), key, "left_anti")


class PointStore:
    """Collections of points, each with the status of what it has indexed and of the files it has read."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def points(self, collection: str) -> Table:
        return Table(self.spark, f"{self.path}/{collection}/points", POINTS)

    def status(self, collection: str) -> Table:
        """The hashes of the chunks that the collection has indexed."""
        return Table(self.spark, f"{self.path}/{collection}/status", STATUS)

    def processed(self, collection: str) -> Table:
        """The hashes of the files that runs over folders have read without an error."""
        return Table(self.spark, f"{self.path}/{collection}/processed", PROCESSED)

    def errors(self, collection: str) -> Table:
        """The files that the last run over a folder could not index."""
        return Table(self.spark, f"{self.path}/{collection}/errors", ERRORS)

    def failed(self, collection: str) -> Table:
        """The points that the model of the last run failed for."""
        return Table(self.spark, f"{self.path}/{collection}/failed", FAILED)

    def versions(self, collection: str) -> DataFrame:
        """When each chunk was indexed: chunk_hash, indexed, collection, ts."""
        return self.status(collection).read().select("chunk_hash", F.lit(True).alias("indexed"), F.lit(collection).alias("collection"), "ts")

    def collections(self) -> list[str]:
        return [n for n in Folder(self.spark, self.path).names() if self.points(n).exists()]

    def info(self) -> DataFrame:
        """collection, points, vectors, indexed, files: a row for each collection."""
        rows = []
        for c in self.collections():
            n, v = self.points(c).read().agg(F.count(F.lit(1)), F.count("dense")).first()
            rows.append((c, n, v, self.size(c), self.processed(c).read().count()))
        return self.spark.createDataFrame(rows, "collection string, points long, vectors long, indexed long, files long")

    def contains(self, collection: str, chunks: DataFrame) -> DataFrame:
        """Chunks whose hash the collection has indexed."""
        return chunks.join(self.status(collection).read().select("chunk_hash").distinct(), "chunk_hash", "left_semi")

    def unseen(self, collection: str, chunks: DataFrame) -> DataFrame:
        """Chunks whose hash the collection has not indexed."""
        return chunks.join(self.status(collection).read().select("chunk_hash"), "chunk_hash", "left_anti")

    def put(self, collection: str, hashes: DataFrame) -> None:
        """Record hashes (chunk_hash) as indexed; those that are recorded stay as they are."""
        fresh = self.unseen(collection, hashes.select("chunk_hash").distinct())
        self.status(collection).append(fresh.withColumn("ts", F.current_timestamp()))

    def invalidate(self, collection: str, hashes: DataFrame) -> None:
        """Forget hashes (chunk_hash), so that their chunks are indexed again."""
        self.status(collection).remove(hashes)

    def clear_status(self, collection: str) -> None:
        self.status(collection).change(lambda old: old.limit(0))

    def size(self, collection: str) -> int:
        """How many hashes are recorded as indexed."""
        return self.status(collection).read().count()

    def add(self, collection: str, points: DataFrame, fresh: bool = False) -> tuple[int, int]:
        """Store points, then record their hashes: a failure between the two makes the next run index them again.

        fresh: the collection has none of the points, so no reader looks for earlier ones;
        else they replace the points of the same id.  The points are computed once.  Returns the
        sum of their `copies`, or their number if they have none, and their number.
        """
        table = self.points(collection)
        counted = points if "copies" in points.columns else points.withColumn("copies", F.lit(1))
        part = table.write_part(counted)
        copies, n = table.part(part, "copies long").agg(F.coalesce(F.sum("copies"), F.lit(0)), F.count(F.lit(1))).first()
        if not n:
            table.drop_part(part)
            return 0, 0
        hashes = table.part(part).select("chunk_hash").distinct().withColumn("ts", F.current_timestamp())
        status = self.status(collection)
        recorded = status.write_part(hashes if fresh else self.unseen(collection, hashes))
        if fresh:
            table.append_part(part)
        else:
            table.upsert_part(part)
        status.append_part(recorded)
        return copies, n

    def delete(self, collection: str, ids: DataFrame) -> None:
        """Remove points and forget that they were indexed."""
        gone = self.points(collection).read().join(ids.select("id").distinct(), "id", "left_semi").select("chunk_hash")
        self.invalidate(collection, gone)
        self.points(collection).remove(ids)

    def drop(self, collection: str) -> None:
        """Remove a collection with all that is remembered of it."""
        Folder(self.spark, f"{self.path}/{collection}").delete()

    def count(self, collection: str) -> int:
        return self.points(collection).read().count()


def load_hashes(spark: SparkSession, path: str) -> DataFrame:
    """file_hash from a JSON list, or an object's `hashes`; a file that is missing or broken gives none."""
    none = spark.createDataFrame([], "file_hash string")
    try:
        rows = spark.read.text(path, wholetext=True)
        whole = F.try_parse_json("value")
        found = F.coalesce(F.try_variant_get(whole, "$", "array<string>"), F.try_variant_get(whole, "$.hashes", "array<string>"))
        return none.union(rows.select(F.explode(found).alias("file_hash")).distinct())
    except AnalysisException:
        return none


def load_status(spark: SparkSession, path: str) -> DataFrame:
    """chunk_hash from lines of JSON objects with `hash`; blank and broken lines are skipped."""
    lines = spark.read.text(path)
    return lines.select(F.try_variant_get(F.try_parse_json("value"), "$.hash", "string").alias("chunk_hash")).filter("chunk_hash is not null").distinct()


def payload(field: str, columns: list[str]) -> Column:
    """A field of a point: a column, or else an entry of its metadata."""
    return F.col(field) if field in columns else F.col("metadata").getItem(field)
