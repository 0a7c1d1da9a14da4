"""The corpus pipeline: quality rules, line dedup, SimHash near-dedup, removal of personal data, packing."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm import line_dedup, packing, pii, quality, simhash
from inkwell.llm.common import discard, materialize, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _counted(docs: DataFrame) -> DataFrame:
    """The columns of documents, n_chars after a change of the text."""
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep.  A rule sees one text, so equal rows have equal verdicts."""
    return quality.keep_good(docs).select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the later copies of repeated line runs."""
    return _counted(line_dedup.line_dedup(docs))


def keep_one_of_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest identifier, nulls last, then the first row."""
    # Identifiers may repeat, so each row gets a key of its own; it is written, so that it stays the same.
    keyed = materialize(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("_row")), "keyed")
    groups = simhash.simhash_components(keyed, "_row").select(F.col("doc_id").alias("_row"), "component_id")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "_row")
    first = keyed.select("_row", "doc_id").join(groups, "_row").groupBy("component_id").agg(F.min_by("_row", order).alias("_row"))
    return keyed.join(first.select("_row"), "_row", "left_semi").select(*COLUMNS)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind."""
    return _counted(pii.redact(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in training sequences."""
    return packing.pack(docs, packing.read_text(spark, public_tokenizers.path("word_bpe_49k.json")))


STAGES: list[tuple[str, Stage]] = [
    ("quality", keep_quality),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", keep_one_of_near),
    ("personal_data", redact_personal_data),
    ("packing", pack_sequences),
]

#: Suffix arrays, fingerprints and tokenizers have no SQL form; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written as Parquet and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        kept = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(docs)  # the table of the stage before; the documents themselves are no scratch table
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
