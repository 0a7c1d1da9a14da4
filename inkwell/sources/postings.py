"""A stored inverted index for BM25 and sparse search, that grows by increments.

An increment is a part of three tables.  `forward` has a row for each text with its words and their
counts; `blocks` has the postings of a word, those of the greatest impact first, in blocks with the greatest count
and the least length among them; `stats` has document frequencies and lengths as
numbers that are added over increments.  A version is a small file that lists increments, so a
reader sees all of an increment or nothing of it, and adding one rewrites nothing.

A search reads the headers of the blocks of its words, finds a score that k texts reach from the
rarest words, and then leaves out words that cannot lift a text to it by themselves, and blocks none of
whose texts can reach it.  What remains is scored exactly, so results equal those of a search over all texts.
Where the bounds leave out less than half of the blocks, as for long queries of common words, all of them are read.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkwell.functions.text import word_tokens
from inkwell.operators.search import DIGITS, HELD_ROWS, held, pieces, ranked, small
from inkwell.sources.claims import Folder
from inkwell.sources.store import ConflictError

#: Folders into which blocks are dealt by word; a search reads those of its words.
BUCKETS = 16
#: Postings of one block, and of one sorted slice of a word's postings; a word with more has several slices.
BLOCK = 256
SLICE = 65_536
#: Postings of one task, about, when an increment is written; of more, there are more tasks.
TASK_POSTINGS = 2_000_000
#: Bytes of words that Python counts at once.
PIECE_BYTES = 2 << 20
#: Words of a query, those of the greatest possible score, that give the first texts.
SEEDS = 4
#: Rounding of sums; a bound is taken for lower than a score only by more than this.
SLACK = 1e-6

Contribution = Callable[[Column, Column], Column]


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


class Postings:
    """An index in a folder.  Identifiers are of one type; a text whose identifier is null is not indexed, and a null text counts as an empty one."""

    def __init__(self, spark: SparkSession, path: str, id_type: str = "string") -> None:
        self.spark, self.path, self.id_type = spark, path.rstrip("/"), id_type
        self._versions = Folder(spark, f"{self.path}/versions")
        self._data = Folder(spark, f"{self.path}/data")
        self.schemas = {
            "forward": f"id {id_type}, length int, terms array<string>, tfs array<int>",
            "blocks": f"term string, n int, max_tf int, min_length int, ids array<{id_type}>, tfs array<int>, lengths array<int>, bucket int",
            "stats": "term string, df long, docs long, length long",
        }
        #: Blocks of the words of the last search, and how many of them it read in its second round.
        self.blocks_met = self.blocks_read = 0

    def _current(self) -> tuple[int, list[str]]:
        names = self._versions.names()
        return (int(names[-1]), self._versions.content(names[-1])) if names else (0, [])

    def _read(self, table: str, parts: list[str] | None = None) -> DataFrame:
        parts = self._current()[1] if parts is None else parts
        if not parts:
            return self.spark.createDataFrame([], self.schemas[table])
        at = f"{self.path}/data/{table}"
        return self.spark.read.schema(self.schemas[table]).option("basePath", at).parquet(*[f"{at}/part={p}" for p in parts]).drop("part")

    def _at(self, table: str, part: str) -> str:
        return f"{self.path}/data/{table}/part={part}"

    def _delete(self, part: str) -> None:
        for table in self.schemas:
            self._data.delete(f"{table}/part={part}")

    def _forward(self, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
        """Words of each text with their counts, and its length in words."""

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in pieces(batches, PIECE_BYTES):
                tokens = batch.column("tokens").to_pylist()
                counts = [Counter(t) for t in tokens]
                lengths, terms = pa.array([len(t) for t in tokens], pa.int32()), pa.array([list(c) for c in counts], pa.list_(pa.string()))
                tfs = pa.array([list(c.values()) for c in counts], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column("id"), lengths, terms, tfs], names=["id", "length", "terms", "tfs"])

        tokens = docs.select(F.col(id_col).cast(self.id_type).alias("id"), word_tokens(F.col(text_col)).alias("tokens"))
        return tokens.filter("id is not null").mapInArrow(count, self.schemas["forward"])

    def _write(self, forward: DataFrame) -> str:
        """Write an increment that no version has yet."""
        name = uuid.uuid4().hex
        forward.write.parquet(self._at("forward", name))
        forward = self._read("forward", [name])
        each = forward.select("id", "length", F.inline(F.arrays_zip("terms", "tfs")).alias("term", "tf"))
        df = each.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        none = F.lit(None).cast("long")
        totals = forward.agg(F.lit(None).cast("string").alias("term"), none.alias("df"), F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("length"), F.lit(0)).alias("length"))
        df.select("term", "df", none.alias("docs"), none.alias("length")).unionByName(totals).write.parquet(self._at("stats", name))
        # Postings of frequent words are dealt over slices, so that none is one task's work.
        postings = self._read("stats", [name]).agg(F.sum("df")).first()[0] or 0
        tasks = max(self.spark.sparkContext.defaultParallelism, -(-postings // TASK_POSTINGS))
        many = self._read("stats", [name]).filter(F.col("df") > SLICE).select("term", F.ceil(F.col("df") / SLICE).alias("slices"))
        dealt = each.join(small(many), "term", "left").withColumn("slice", F.when(F.col("slices").isNull(), 0).otherwise(F.pmod(F.xxhash64("id"), F.col("slices"))))
        # The greatest count first, and of equal counts the shortest text.
        grouped = dealt.repartition(tasks, "term", "slice").groupBy("term", "slice").agg(F.sort_array(F.collect_list(F.struct((-F.col("tf")).alias("less"), "length", "id"))).alias("all"))
        starts = F.sequence(F.lit(1), F.size("all"), F.lit(BLOCK))
        cut = grouped.select("term", "slice", F.explode(F.transform(starts, lambda s: F.slice("all", s, BLOCK))).alias("b"))
        blocks = cut.select(
            "term", F.size("b").alias("n"), (-F.element_at("b", 1)["less"]).alias("max_tf"), F.array_min("b.length").alias("min_length"), F.col("b.id").alias("ids"),
            F.transform("b.less", lambda x: -x).alias("tfs"), F.col("b.length").alias("lengths"), _bucket(F.col("term")).alias("bucket"), "slice",
        )
        deal = F.pmod(F.xxhash64("term", F.lit(BUCKETS)), F.lit(-(-postings // (BUCKETS * TASK_POSTINGS)) or 1))
        dealt = blocks.withColumn("deal", deal).repartition(max(BUCKETS, tasks), "bucket", "deal", "slice")
        dealt.sortWithinPartitions("bucket", "term").drop("slice", "deal").write.partitionBy("bucket").parquet(self._at("blocks", name))
        return name

    def _claim(self, number: int, parts: list[str], own: str) -> None:
        if not self._versions.claim(f"{number + 1:012d}", parts):
            self._delete(own)
            raise ConflictError(self.path)

    def add(self, docs: DataFrame, id_col: str = "id", text_col: str = "content") -> None:
        """Index texts that are not indexed yet, as an increment of their own."""
        number, parts = self._current()
        name = self._write(self._forward(docs, id_col, text_col))
        self._claim(number, [*parts, name], name)

    def compact(self) -> None:
        """Fold all increments into one; those that only older versions list are deleted."""
        number, parts = self._current()
        if len(parts) < 2:
            return
        name = self._write(self._read("forward", parts))
        self._claim(number, [name], name)
        for old in self._versions.names()[:-1]:
            self._versions.delete(old)
        for part in parts:
            self._delete(part)

    def statistics(self) -> tuple[int, float, DataFrame]:
        """Texts, their mean length, and (term, df)."""
        stats = self._read("stats")
        total = stats.agg(F.sum("docs"), F.sum("length")).first()
        n = total[0] or 0
        return n, (total[1] / n or 1.0) if n else 1.0, stats.filter("term is not null").groupBy("term").agg(F.sum("df").alias("df"))

    def bm25(self, queries: DataFrame, k: int, id_col: str = "query_id", text_col: str = "query", k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25) -> DataFrame:
        """(query_id, id, score, rank) of the k best texts with a score above 0, as `search.Bm25.topk`."""
        n, average, df = self.statistics()
        found = df.select("term", (F.log(F.lit(float(n)) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("idf"))
        mean = found.agg(F.avg("idf")).first()[0] or 0.0
        terms = queries.select(F.col(id_col).alias("query_id"), F.explode(word_tokens(F.col(text_col))).alias("term"))
        counted = small(terms.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf")))
        idf = F.when(F.col("idf") < 0, epsilon * mean).otherwise(F.col("idf"))
        wanted = found.join(counted, "term").select("query_id", "term", (F.col("qtf") * idf).alias("weight"))
        return self.topk(wanted, k, lambda tf, length: tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / average))).filter("score > 0")

    def sparse(self, queries: DataFrame, k: int) -> DataFrame:
        """(query_id, id, score, rank) by lexical weights log(1 + tf), as `search.lexical_topk`; `queries` has query_id, term, weight."""
        return self.topk(queries.select("query_id", "term", "weight"), k, lambda tf, _: F.log1p(tf))

    def topk(self, wanted: DataFrame, k: int, contribution: Contribution) -> DataFrame:
        """The k texts of the largest sums of weight * contribution(tf, length) over the words they share with a query.

        `wanted` has query_id, term, weight; a contribution grows with the count and not with the length.
        """
        wanted = held(wanted)
        buckets = [r[0] for r in wanted.select(_bucket(F.col("term"))).distinct().collect()]  # BUCKETS at most
        blocks = self._read("blocks").filter(F.col("bucket").isin(buckets))
        wanted = small(wanted)
        # Words that no text has are gone from here on.  A negative weight adds 0 at most.
        headers = blocks.select("term", "max_tf", "min_length").join(wanted, "term").withColumn("most", F.greatest(F.lit(0.0), F.col("weight") * contribution(F.col("max_tf"), F.col("min_length"))))
        terms = headers.groupBy("query_id", "term", "weight").agg(F.max("most").alias("most"), F.count(F.lit(1)).alias("blocks"))
        terms = held(terms)
        by_bound = Window.partitionBy("query_id").orderBy(F.desc("most"), "term")
        # First round: texts that have the strongest words, scored exactly; the k-th of them is a score to beat.
        seeds = terms.withColumn("nth", F.row_number().over(by_bound)).filter(F.col("nth") <= SEEDS)
        first = held(ranked(self._sums(blocks, seeds, contribution), k))
        known = held(ranked(self._exact(first, wanted, contribution), k))
        beat = known.filter(F.col("rank") == k).select("query_id", F.col("score").alias("beat"))
        # Second round: words that together stay below that score need not be read.
        up = Window.partitionBy("query_id").orderBy("most", F.desc("term")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        bounds = terms.join(beat, "query_id", "left").withColumn("beat", F.coalesce(F.col("beat") - SLACK, F.lit(float("-inf"))))
        bounds = bounds.withColumn("below", F.sum("most").over(up)).withColumn("all", F.sum("most").over(Window.partitionBy("query_id")))
        bounds = bounds.withColumn("left_out", F.col("below") < F.col("beat"))
        rest = F.sum(F.when(F.col("left_out"), F.col("most")).otherwise(0.0)).over(Window.partitionBy("query_id"))
        bounds = bounds.withColumn("rest", rest)
        bounds = held(bounds)
        read = bounds.filter(~F.col("left_out"))
        bound = F.col("weight") * contribution(F.col("max_tf"), F.col("min_length"))
        met = F.greatest(F.lit(0.0), bound) + F.col("all") - F.col("most") >= F.col("beat")
        chosen = blocks.select("term", "max_tf", "min_length").join(read, "term").filter(met)
        self.blocks_met, self.blocks_read = terms.agg(F.sum("blocks")).first()[0] or 0, chosen.count()
        if 2 * self.blocks_read <= self.blocks_met:
            sums = self._sums(blocks, read, contribution, met)
            limits = bounds.select("query_id", "beat", "rest").distinct()
            likely = sums.join(small(limits), "query_id").filter(F.col("score") + F.col("rest") >= F.col("beat")).select("query_id", "id")
            rows = likely.limit(HELD_ROWS + 1).collect()
            if len(rows) <= HELD_ROWS:
                return ranked(self._exact(self.spark.createDataFrame(rows, likely.schema), wanted, contribution), k)
        # Bounds that leave out little: every posting of the words is read.
        self.blocks_read = self.blocks_met
        return ranked(self._sums(blocks, wanted, contribution).withColumn("score", F.round("score", DIGITS)), k)

    def _sums(self, blocks: DataFrame, terms: DataFrame, contribution: Contribution, chosen: Column | None = None) -> DataFrame:
        """(query_id, id, score): sums over `terms` (query_id, term, weight) by their blocks."""
        joined = blocks.join(small(terms), "term")
        joined = joined if chosen is None else joined.filter(chosen)
        each = joined.select("query_id", "weight", F.inline(F.arrays_zip("ids", "tfs", "lengths")).alias("id", "tf", "length"))
        return each.groupBy("query_id", "id").agg(F.sum(F.col("weight") * contribution(F.col("tf"), F.col("length"))).alias("score"))

    def _exact(self, found: DataFrame, wanted: DataFrame, contribution: Contribution) -> DataFrame:
        """The whole scores of texts that are few, from their own rows."""
        texts = self._read("forward").join(found.select("query_id", "id"), "id")
        each = texts.select("query_id", "id", "length", F.inline(F.arrays_zip("terms", "tfs")).alias("term", "tf")).join(wanted, ["query_id", "term"])
        sums = each.groupBy("query_id", "id").agg(F.sum(F.col("weight") * contribution(F.col("tf"), F.col("length"))).alias("score"))
        return sums.withColumn("score", F.round("score", DIGITS))
