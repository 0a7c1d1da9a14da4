"""Token counts as delta-maintained rollups.

Batches of changes (inserts, deletes, revised counts) become signed numbers by
source, language and tokenizer version.  A batch's delta is written aside, and
the batch is committed by moving one small file, which names the delta, to the
batch's place.  Totals are the sum of the committed deltas; compaction folds
them into a snapshot and remembers which batches it holds.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm.bpe import Bpe
from inkwell.llm.common import small_batches
from inkwell.llm.packing import WordTokenizer
from inkwell.sources.claims import Folder

KEYS = ["source", "lang", "tokenizer_version"]
DELTA = "source string, lang string, tokenizer_version string, n_docs long, n_tokens long"


def count_tokens(docs: DataFrame, ranks: dict[bytes, int], pattern: str, tokenizer_json: str, text_col: str = "text") -> DataFrame:
    """`docs` without the text, with byte_tokens and word_tokens: its tokens by two tokenizers, without special ones.

    The first is byte-level BPE of `ranks` and `pattern`, the second a tokenizer file.  A null or
    empty text has none.  Columns of those names are replaced.
    """
    keep = [c for c in docs.columns if c not in (text_col, "byte_tokens", "word_tokens")]
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((Bpe(ranks, pattern), WordTokenizer(tokenizer_json)))  # as large as the vocabularies

    @F.pandas_udf("byte_tokens long, word_tokens long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        bpe, words = shared.value
        for x in batches:
            texts = ["" if t is None else t for t in x]
            yield pd.DataFrame({"byte_tokens": [len(i) // 4 for i in bpe.encode(texts)], "word_tokens": words.count(pa.array(texts, pa.string()))}, dtype="int64")

    return docs.select(*keep, count(F.col(text_col).cast("string")).alias("_n")).select(*keep, "_n.*")


def signed(changes: DataFrame) -> DataFrame:
    """Changes as signed rows (KEYS, n_docs, n_tokens).

    `changes` has op ('insert', 'delete' or 'revise'), KEYS and n_tokens; a revision also has
    old_source, old_lang, old_tokenizer_version and old_n_tokens, which it takes back.  Other
    values of op, and null ones, change nothing.
    """
    sign = F.when(F.col("op") == "delete", -1).otherwise(1).cast("long")
    count = F.coalesce(F.col("n_tokens").cast("long"), F.lit(0))
    new = F.struct(*[F.col(k).cast("string").alias(k) for k in KEYS], sign.alias("n_docs"), (sign * count).alias("n_tokens"))
    if not {f"old_{c}" for c in [*KEYS, "n_tokens"]} <= set(changes.columns):
        return changes.filter("op in ('insert', 'delete')").select(new.alias("x")).select("x.*")
    old_count = F.coalesce(F.col("old_n_tokens").cast("long"), F.lit(0))
    old = F.struct(*[F.col(f"old_{k}").cast("string").alias(k) for k in KEYS], F.lit(-1).cast("long").alias("n_docs"), (-old_count).alias("n_tokens"))
    both = F.when(F.col("op") == "revise", F.array(old, new)).otherwise(F.array(new))
    return changes.filter("op in ('insert', 'delete', 'revise')").select(F.explode(both).alias("x")).select("x.*")


class Rollup:
    """Totals by source, language and tokenizer version in a folder that all executors share.

    A null source, language or version is a key of its own.  Repeated changes count as often as they
    come; a repeated batch counts once.  Any number of writers may apply and compact at once.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._committed, self._snapshots, self._data = (Folder(spark, f"{self.path}/{x}") for x in ("committed", "snapshots", "data"))

    def has(self, batch: str) -> bool:
        return self._committed.has(batch)

    def apply(self, batch: str, changes: DataFrame) -> bool:
        """Commit the changes under the batch's name; False, and nothing done, if it is committed already.

        The delta is aggregated on the map side first, so a source with a third of all rows is a few
        partial sums.  A job that fails leaves the totals as they were: its files are aside, and the
        same call may be made again.  Of two writers of one batch, one move succeeds; the other
        deletes its delta and returns False.
        """
        if not batch or not all(c.isalnum() or c in "-_." for c in batch) or batch.startswith((".", "_")):
            raise ValueError("a batch's name has letters, digits, - and _ only")
        if self.has(batch):
            return False
        delta = signed(changes).groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        name = f"delta-{uuid.uuid4().hex}"
        delta.filter("n_docs <> 0 or n_tokens <> 0").write.parquet(f"{self._data.path}/{name}")
        if self._committed.claim(batch, name):
            return True
        self._data.delete(name)
        return False

    def _state(self) -> tuple[int, str | None, dict[str, str]]:
        """Number and folder of the last snapshot, and the deltas of committed batches that it does not hold."""
        committed = self._committed.contents()
        names = self._snapshots.names()
        if not names:
            return 0, None, committed
        folder = self._snapshots.content(names[-1])
        held = {r["batch"] for r in self.spark.read.schema("batch string").parquet(f"{self._data.path}/{folder}/batches").collect()}
        return int(names[-1]), folder, {b: d for b, d in committed.items() if b not in held}

    def _sums(self, folder: str | None, deltas: dict[str, str]) -> DataFrame:
        paths = [f"{self._data.path}/{d}" for d in sorted(deltas.values())] + ([f"{self._data.path}/{folder}/totals"] if folder else [])
        rows = self.spark.read.schema(DELTA).parquet(*paths) if paths else self.spark.createDataFrame([], DELTA)
        sums = rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return sums.filter("n_docs <> 0 or n_tokens <> 0")

    def totals(self) -> DataFrame:
        """KEYS, n_docs, n_tokens over all committed batches; keys without documents and tokens are left out."""
        _, folder, deltas = self._state()
        return self._sums(folder, deltas)

    def compact(self) -> bool:
        """Fold committed deltas into a new snapshot, so that totals read it and later deltas only.

        False, and nothing done, if there is none to fold or another writer made the next snapshot
        first.  Folded deltas and older snapshots stay for their readers; see `vacuum`.
        """
        number, folder, deltas = self._state()
        if not deltas:
            return False
        name = f"snapshot-{uuid.uuid4().hex}"
        at = f"{self._data.path}/{name}"
        self._sums(folder, deltas).write.parquet(f"{at}/totals")
        none = self.spark.createDataFrame([], "batch string")
        held = self.spark.read.schema("batch string").parquet(f"{self._data.path}/{folder}/batches") if folder else none
        held.union(self.spark.createDataFrame([(b,) for b in sorted(deltas)], "batch string")).coalesce(1).write.parquet(f"{at}/batches")
        if self._snapshots.claim(f"{number + 1:012d}", name):
            return True
        self._data.delete(name)
        return False

    def vacuum(self) -> None:
        """Delete what the last snapshot replaced.  To be called when no reader is older than that snapshot and no writer is at work."""
        number, folder, deltas = self._state()
        for n in self._snapshots.names():
            if int(n) < number:
                self._snapshots.delete(n)
        for n in self._data.names():
            if n not in {*deltas.values(), folder}:
                self._data.delete(n)


def change(op: str, counts: DataFrame, version: str, column: str, old_version: str | None = None, old_column: str | None = None) -> DataFrame:
    """Changes of one kind from a table with source, lang and counts; a revision names the old version and count."""
    out = [F.lit(op).alias("op"), "source", "lang", F.lit(version).alias("tokenizer_version"), F.col(column).alias("n_tokens")]
    if old_column:
        out += [F.col("source").alias("old_source"), F.col("lang").alias("old_lang"), F.lit(old_version).alias("old_tokenizer_version"), F.col(old_column).alias("old_n_tokens")]
    return counts.select(*out)
