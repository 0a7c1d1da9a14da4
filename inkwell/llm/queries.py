"""One query for each operator of this subpackage, over its whole table, and SQL twins."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm import bpe, exact_dedup, licenses, line_dedup, packing, passages, pii, quality, simhash, token_counts, toxicity, variants, whitening
from inkwell.llm.common import materialize, scratch_root, table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents")).drop("longest_repeat")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.content_sort_dedup(table(spark, sf_dir, "documents"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = bpe.load_ranks(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return bpe.bpe_round_trip(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_deleted")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), packing.read_text(spark, public_tokenizers.path("word_bpe_49k.json")))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after all documents came in, those of bad quality went, and the rest moved to a new tokenizer version.

    Version byte-1 is the byte-level BPE of op7_bpe, word-2 the tokenizer of op9_packing.  The last
    batch is delivered twice and counts once; the first two are folded into a snapshot.
    """
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    ranks = bpe.load_ranks(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    words = packing.read_text(spark, public_tokenizers.path("word_bpe_49k.json"))
    # The change feed carries counts, as that of a corpus store does; the texts are counted once.
    counts = materialize(token_counts.count_tokens(docs.select("doc_id", "source", "lang", "text"), ranks, public_tokenizers.PATTERN, words), "counts")
    bad = labels.filter("quality = 0").select("doc_id").distinct()
    arrived = token_counts.change("insert", counts, "byte-1", "byte_tokens")
    left = token_counts.change("delete", counts.join(bad, "doc_id", "left_semi"), "byte-1", "byte_tokens")
    revised = token_counts.change("revise", counts.join(bad, "doc_id", "left_anti"), "word-2", "word_tokens", "byte-1", "byte_tokens")
    rollup = token_counts.Rollup(spark, f"{scratch_root(spark)}/rollup-{uuid.uuid4().hex}")
    rollup.apply("arrived", arrived)
    rollup.apply("left", left)
    rollup.compact()
    for _ in range(2):
        rollup.apply("revised", revised)
    return rollup.totals()


def op11_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.spelling_variants(table(spark, sf_dir, "documents"))


def op12_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = passages.remove_repeated(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_pii": op2_pii,
    "op3_licenses": op3_licenses,
    "op4_simhash": op4_simhash,
    "op5_quality": op5_quality,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_bpe": op7_bpe,
    "op8_line_dedup": op8_line_dedup,
    "op9_packing": op9_packing,
    "op10_token_counts": op10_token_counts,
    "op11_variants": op11_variants,
    "op12_passages": op12_passages,
    "op13_whitening": op13_whitening,
}

ORACLE_SQL = {
    "op5_quality": r"""
        WITH d AS (
            SELECT doc_id, coalesce(text, '') AS text FROM documents
        ), w AS (
            SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d
        ), p AS (
            SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS i FROM w WHERE len(words) > 0
        ), g AS (
            SELECT doc_id, i, array_to_string(list_slice(words, i, i + 4), ' ') AS five, len(words) AS n FROM p WHERE i + 4 <= len(words)
        ), twice AS (
            SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, five) AS c FROM g) AS q WHERE c > 1
        ), covered AS (
            SELECT doc_id, count(DISTINCT pos) AS n_repeat
            FROM (SELECT doc_id, i + unnest(range(0, 5)) AS pos FROM twice) AS q GROUP BY doc_id
        ), runs AS (
            SELECT doc_id, i, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS island FROM twice
        ), suspects AS (
            SELECT DISTINCT doc_id FROM (SELECT doc_id, island, count(*) AS c FROM runs GROUP BY doc_id, island) AS q WHERE c + 4 > 100
        ), long_windows AS (
            SELECT doc_id, array_to_string(list_slice(words, i, i + 100), ' ') AS x FROM p JOIN suspects USING (doc_id) WHERE i + 100 <= len(words)
        ), too_long AS (
            SELECT DISTINCT doc_id FROM (SELECT doc_id, x FROM long_windows GROUP BY doc_id, x HAVING count(*) > 1) AS q
        ), lines AS (
            SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d
        ), dup AS (
            SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
        ), m AS (
            SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words,
                CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
                CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
                CAST(coalesce(n_dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat, 0) AS BIGINT) AS n_repeat_words,
                too_long.doc_id IS NOT NULL AS is_long
            FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN covered USING (doc_id) LEFT JOIN too_long USING (doc_id)
        )
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
            (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
            NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND NOT is_long AS kept
        FROM m
    """,
    "op12_passages": r"""
        WITH w AS (
            SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
        ), p AS (
            SELECT r, words, unnest(range(1, len(words) - 33)) AS i FROM w WHERE len(words) >= 35
        ), g AS (
            SELECT r, i, count(*) OVER (PARTITION BY md5(array_to_string(list_slice(words, i, i + 34), ' '))) AS c FROM p
        ), gone AS (
            SELECT DISTINCT r, i + unnest(range(0, 35)) AS pos FROM g WHERE c > 1
        ), each AS (
            SELECT r, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS pos FROM w
        ), k AS (
            SELECT r, count(*) AS n_kept, string_agg(word, ' ' ORDER BY pos) AS kept FROM each ANTI JOIN gone USING (r, pos) GROUP BY r
        )
        SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n_kept, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM w LEFT JOIN k USING (r)
    """,
    "op6_exact_dedup": """
        WITH d AS (
            SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents
        ), g AS (
            SELECT doc_id, norm, max(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size FROM d
        )
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g
    """,
    "op8_line_dedup": r"""
        WITH s AS (
            SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents
        ), l AS (
            SELECT doc_id, i AS pos, parts[i + 1] AS line FROM (SELECT doc_id, parts, unnest(range(0, len(parts))) AS i FROM s) AS q
        ), n AS (
            SELECT doc_id, pos, line, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS nth
            FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
        ), p AS (
            SELECT doc_id, pos, nth, line, lead(line) OVER w AS line2, lead(pos) OVER w AS pos2 FROM n WINDOW w AS (PARTITION BY doc_id ORDER BY pos)
        ), c AS (
            SELECT *, row_number() OVER (PARTITION BY line ORDER BY doc_id, pos) AS copy1,
                row_number() OVER (PARTITION BY line, line2 ORDER BY doc_id, pos) AS copy2 FROM p
        ), later AS (
            SELECT doc_id, nth, pos FROM c WHERE copy1 > 1 AND len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) >= 5
            UNION SELECT doc_id, nth, pos FROM c WHERE copy2 > 1 AND line2 IS NOT NULL
            UNION SELECT doc_id, nth + 1, pos2 FROM c WHERE copy2 > 1 AND line2 IS NOT NULL
        ), gap AS (
            SELECT doc_id, pos, lag(pos) OVER w AS pos0, lag(nth) OVER w = nth - 1 AS next_to FROM later WINDOW w AS (PARTITION BY doc_id ORDER BY nth)
        ), gone AS (
            SELECT doc_id, pos FROM later
            UNION SELECT l.doc_id, l.pos FROM l JOIN gap ON l.doc_id = gap.doc_id AND gap.next_to AND l.pos > gap.pos0 AND l.pos < gap.pos
        ), kept AS (
            SELECT l.doc_id, l.pos, l.line FROM l LEFT JOIN gone ON l.doc_id = gone.doc_id AND l.pos = gone.pos WHERE gone.pos IS NULL
        ), texts AS (
            SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS text, count(*) AS n_kept FROM kept GROUP BY doc_id
        )
        SELECT s.doc_id, CASE WHEN parts IS NULL THEN NULL ELSE coalesce(texts.text, '') END AS text,
            CAST(coalesce(len(parts), 0) AS BIGINT) AS n_lines,
            CAST(coalesce(len(parts), 0) - coalesce(n_kept, 0) AS BIGINT) AS n_deleted
        FROM s LEFT JOIN texts ON s.doc_id = texts.doc_id
    """,
}
