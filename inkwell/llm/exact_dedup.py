"""Exact dedup by content sort.

Sampled splitters range-partition the normalised texts, Spark's external sort
places equal texts side by side, and each run of full-text equals keeps one row.
DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkwell.llm.common import lower_ascii, materialize

#: Characters of a text that a splitter holds.  Splitters travel through the driver, so they
#: must be short; a hash of the text orders those that share this prefix.
SPLITTER_CHARS = 48
#: A text with more copies than this, and than one millionth of the rows, is split over salts.
COPIES_PER_RUN = 256


def content_sort_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """One row per row of `docs`: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical after lower-casing A-Z.  `keep` says whether the
    "max" or the "min" identifier of equal texts stays.

    A null text counts as empty; empty texts are equal to each other.  Rows that repeat an
    identifier with an equal text are copies too: exactly one of them is kept.  A null identifier
    sorts after all others and is kept only where its text has no other.  Other columns of `docs`
    are ignored, so their names cannot clash.  An empty table gives an empty result.

    A text with very many copies is salted by the hash of its identifier, so that its copies
    spread over sub-runs that sort next to each other; the one row that each sub-run keeps is
    merged with the others' by its whole text.  The list of such texts has at most a million
    entries whatever the input, so it is broadcast.
    """
    if keep not in ("max", "min"):
        raise ValueError("keep is 'max' or 'min'")
    pick = F.max if keep == "max" else F.min
    text = F.coalesce(F.col(text_col), F.lit(""))
    # Equal normalised texts have equal lower-cased texts, so this hash may stand for them when
    # work is dealt out; it decides nothing about equality.
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(F.lower(text)).alias("h"))
    threshold = max(COPIES_PER_RUN, docs.count() // 1_000_000)
    hot = (
        rows.groupBy("h")
        .agg(F.count(F.lit(1)).alias("copies"))
        .filter(F.col("copies") > threshold)
        .select("h", F.ceil(F.col("copies") / threshold).alias("salts"))
    )
    salt = F.coalesce(F.pmod(F.xxhash64("doc_id"), F.col("salts")), F.lit(0))
    norm = lower_ascii(F.col("text"))
    dealt = (
        rows.join(F.broadcast(hot), "h", "left")
        .select("doc_id", "h", norm.alias("norm"), salt.alias("salt"), F.col("salts").isNotNull().alias("salted"))
        .withColumn("splitter", F.substring("norm", 1, SPLITTER_CHARS))
        .repartitionByRange("splitter", "h", "salt")
    )
    # The range partitioning already clusters these keys: the windows add a sort and no shuffle.
    run = Window.partitionBy("splitter", "h", "salt", "norm")
    order = F.col("doc_id").desc_nulls_last() if keep == "max" else F.col("doc_id").asc_nulls_last()
    runs = materialize(
        dealt.select(
            "doc_id",
            "salted",
            F.sha2("norm", 256).alias("text_sha256"),
            pick("doc_id").over(run).alias("run_keep"),
            F.count(F.lit(1)).over(run).alias("run_size"),
            F.row_number().over(run.orderBy(order)).alias("nth"),
            "norm",
        ).withColumn("norm", F.when(F.col("salted") & (F.col("nth") == 1), F.col("norm"))),  # one text for each sub-run
        "content-sort",
    )
    merged = (
        runs.filter("salted and nth = 1")
        .groupBy("norm")
        .agg(F.first("text_sha256").alias("text_sha256"), pick("run_keep").alias("all_keep"), F.sum("run_size").alias("all_size"))
        .drop("norm")
    )
    joined = runs.join(F.broadcast(merged), "text_sha256", "left")
    keep_id = F.when(F.col("all_size").isNull(), F.col("run_keep")).otherwise(F.col("all_keep"))
    # Where no copy of a salted text has an identifier, every sub-run keeps a null: one salt of
    # null identifiers exists, hence one sub-run.
    return joined.select(
        "doc_id",
        keep_id.alias("keep_id"),
        F.coalesce("all_size", "run_size").alias("group_size"),
        ((F.col("nth") == 1) & F.col("doc_id").eqNullSafe(keep_id)).alias("kept"),
        "text_sha256",
    )
