"""Quality rules from suffix-array repetition.

For each document the word sequence gets a suffix array by prefix doubling, the
longest common prefixes of neighbours in it give the maximal repeated word
strings, and the union of their spans says how much of the text is repetition.
Many documents share one array computation, so that the work is numpy's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import small_batches

#: Words of the shortest repeated string that counts.
MIN_REPEAT = 5
#: Most of the words, in percent, that repeated strings may cover.
MAX_COVERED_PERCENT = 20
#: Most words that a single repeated string may have.
MAX_LONGEST = 100
#: Fewest words of a document.
MIN_WORDS = 10
#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
_SPACE = " \t\n\x0b\x0c\r"
#: Words in one array computation; a longer document is computed by itself.
WORDS_AT_ONCE = 400_000

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, longest_repeat long"
)


def suffix_ranks(first: np.ndarray) -> list[np.ndarray]:
    """Ranks of all suffixes by their first 1, 2, 4, ... items; the last entry tells all suffixes apart.

    `first` must rank the items so that the sequence's last item is unique.  A rank is the place
    in the suffix array where the suffixes with this prefix begin; rounds sort the tied ones only.
    There is a level for each doubling up to the longest repeated string, of four bytes an item.
    """
    counts = np.bincount(first)
    starts = np.concatenate(([0], np.cumsum(counts)[:-1]))
    levels = [starts[first].astype(np.int32 if len(first) < 1 << 31 else np.int64)]
    tied, width = np.flatnonzero(counts[first] > 1), 1
    while len(tied):
        rank = levels[-1]
        own, after = rank[tied], rank[tied + width]
        order = np.lexsort((after, own))
        own, after, tied = own[order], after[order], tied[order]
        opens = np.ones(len(tied), bool)
        opens[1:] = own[1:] != own[:-1]
        splits = opens.copy()
        splits[1:] |= after[1:] != after[:-1]
        at = np.arange(len(tied))
        group = at[opens][np.cumsum(opens) - 1]
        part = at[splits][np.cumsum(splits) - 1]
        finer = rank.copy()
        finer[tied] = (own + part - group).astype(rank.dtype)
        levels.append(finer)
        size = np.diff(np.append(at[splits], len(tied)))
        tied, width = np.sort(tied[size[np.cumsum(splits) - 1] > 1]), width * 2
    return levels


def longest_repeats(first: np.ndarray) -> np.ndarray:
    """For each position the length of the longest string that starts there and occurs again."""
    levels = suffix_ranks(first)
    array = np.empty(len(first), np.int64)
    array[levels[-1]] = np.arange(len(first))
    longest = np.zeros(len(first), np.int64)
    near = np.flatnonzero(levels[0][array[1:]] == levels[0][array[:-1]]) + 1
    one, other = array[near - 1], array[near]
    shared = np.zeros(len(near), np.int64)
    for t in range(len(levels) - 1, -1, -1):
        same = levels[t][one + shared] == levels[t][other + shared]
        shared[same] += 1 << t
        del levels[t]  # needed no more
    np.maximum.at(longest, one, shared)
    np.maximum.at(longest, other, shared)
    return longest


def repetition(words_of: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """For each word list: the words covered by repeated strings, and the longest such string."""
    lengths = np.array([len(x) + 1 for x in words_of])
    doc = np.repeat(np.arange(len(words_of)), lengths)
    ends = np.cumsum(lengths) - 1
    flat = np.zeros(len(doc), np.int64)
    is_word = np.ones(len(doc), bool)
    is_word[ends] = False
    codes, uniques = pd.factorize(np.array([w for x in words_of for w in x], dtype=object))
    flat[is_word] = codes
    # A document's words get ranks of their own, and each end is a unique item.
    key = doc * np.int64(len(uniques) + 1) + flat
    key[ends] += len(uniques) - flat[ends]
    _, first = np.unique(key, return_inverse=True)
    longest = longest_repeats(first)
    at = np.flatnonzero(longest >= MIN_REPEAT)
    change = np.bincount(at, minlength=len(doc) + 1) - np.bincount(at + longest[at], minlength=len(doc) + 1)
    covered = np.bincount(doc[np.cumsum(change)[:-1] > 0], minlength=len(words_of))
    most = np.zeros(len(words_of), np.int64)
    np.maximum.at(most, doc, longest)
    return covered, most


def _measure(texts: list[str]) -> dict[str, np.ndarray]:
    n = len(texts)
    out = {k: np.zeros(n, np.int64) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "longest_repeat")}
    batch, size = [], 0

    def flush() -> None:
        nonlocal batch, size
        if batch:
            at = [i for i, _ in batch]
            out["n_repeat_words"][at], out["longest_repeat"][at] = repetition([w for _, w in batch])
        batch, size = [], 0

    for i, text in enumerate(texts):
        words = text.encode("utf-8", "surrogatepass").split()  # bytes split at ASCII white space only
        out["n_words"][i] = len(words)
        out["word_chars"][i] = len(text) - sum(map(text.count, _SPACE))
        out["n_symbols"][i] = sum(map(text.count, SYMBOLS))
        lines = [x for x in text.split("\n") if x.strip(_SPACE)]
        out["n_dup_lines"][i] = len(lines) - len(set(lines))
        if len(words) > MIN_REPEAT:
            if size and size + len(words) > WORDS_AT_ONCE:
                flush()
            batch.append((i, words))
            size += len(words)
    flush()
    return out


def _verdict(m: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Which texts fail the base rule, and which pass all rules."""
    failed = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_COVERED_PERCENT * m["n_words"])
    return failed, ~failed & (m["longest_repeat"] <= MAX_LONGEST)


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and verdict for each row: doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept, longest_repeat.

    base_failed: under MIN_WORDS words, or words in repeated strings over MAX_COVERED_PERCENT of
    all.  kept: not base_failed, and no repeated string has over MAX_LONGEST words.  (The union of
    the maximal repeated strings of MIN_REPEAT words and more covers just the words of windows of
    MIN_REPEAT words found twice, so the covered share is the base rule's.)

    A null or empty text has no words: all counts are 0 and it fails.  Each row is measured by
    itself, so repeated rows and identifiers, null identifiers and ties change nothing; other
    columns are ignored; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            m = _measure(["" if t is None else t for t in x["text"]])
            failed, kept = _verdict(m)
            yield pd.DataFrame({"doc_id": x["doc_id"]} | m | {"base_failed": failed, "kept": kept})[[c.split()[0] for c in SCHEMA.split(", ")]]

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(rows, SCHEMA)


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that the rules keep, with all their columns.

    A verdict depends on the text alone, so a filter over the text column does; no row is moved.
    """
    small_batches(docs.sparkSession)

    @F.pandas_udf("boolean")
    def good(texts: pd.Series) -> pd.Series:
        return pd.Series(_verdict(_measure(["" if t is None else t for t in texts]))[1])

    return docs.filter(good(F.col(text_col)))
