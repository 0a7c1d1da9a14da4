"""Spelling variant grouping by a rare-first q-gram prefix filter.

Bigrams are ordered over the whole vocabulary, the rarest first.  One edit destroys two bigrams of a
word at most, so of its three rarest one survives in every near word, moved by one place at most.
A survivor lies wholly before or wholly after the edit, so the two words share all up to its end (at
the same place) or all from its start on (at the same place from the end).  What is left is halved
until the edit lies in a gap of GAP letters: the join is on the words' length and all but the gap.  So
what meets in a join differs in a gap alone and is bounded by the alphabet, not by the vocabulary;
gaps are compared in the join, and words verified after it.

Where the third bigram occurs again in a word, its first OCCURRENCES occurrences are taken: the
edit can take or make two of them before a survivor, which is among the first three of one word and
so among the first five of the other.  A word's rows are so bounded, however long it is.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import discard, materialize, small_batches

#: Letters of words.
LETTERS = r"[A-Za-zÀ-ÿ]+"
#: Fewest code points and fewest occurrences of a word.
MIN_LENGTH = 7
MIN_COUNT = 2
#: A form occurs at least so many times as often as its variant.
RATIO = 10
#: One in so many runs of a document loses a letter.
NOISE = 31
#: Bigrams of the prefix: one more than an edit destroys.
PREFIX = 3
OCCURRENCES = PREFIX + 2
#: Letters of the gap in which the edit lies, at most; the longer word has one more.
GAP = 2
#: A word of more than GAP * GAPS letters has wider gaps, so that it has no more of them.
GAPS = 32
#: Words that a task counts before it hands its counts on.
COUNTED = 200_000
#: Words that a task indexes.
TASK_WORDS = 50_000


def noisy(doc_id: int | None, run: str) -> str:
    """The run, or in one of NOISE cases without one letter, by a checksum of the document and the run."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    if h % NOISE:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of all words of MIN_LENGTH code points and MIN_COUNT occurrences.

    A run's letters A-Z are lower-cased, and it may lose a letter (`noisy`).  A task counts before
    Spark does, so a frequent word is few rows.
    """
    small_batches(docs.sparkSession)
    letters = re.compile(LETTERS)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words: Counter[str] = Counter()
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                if not text:
                    continue
                # bytes.lower() leaves all but A-Z.
                for run, n in Counter(letters.findall(text.encode().lower().decode())).items():
                    if len(run) >= MIN_LENGTH and len(word := noisy(doc_id, run)) >= MIN_LENGTH:
                        words[word] += n
                if len(words) > COUNTED:
                    yield pd.DataFrame({"word": list(words), "n": list(words.values())})
                    words = Counter()
        if words:
            yield pd.DataFrame({"word": list(words), "n": list(words.values())})

    rows = docs.select(F.col(id_col).cast("long").cast("string").alias("doc_id"), F.col(text_col).alias("text"))
    counts = rows.mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.filter(F.col("n") >= MIN_COUNT)


def bigram_counts(words: DataFrame) -> dict[str, int]:
    """How many words' places have a bigram; there are as many bigrams as pairs of letters, however many words."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: Counter[str] = Counter()
        for batch in batches:
            for word in batch["word"]:
                found.update(map("".join, zip(word, word[1:], strict=False)))
        if found:
            yield pd.DataFrame({"bigram": list(found), "n": list(found.values())})

    counts = words.select("word").mapInPandas(count, "bigram string, n long").groupBy("bigram").agg(F.sum("n").alias("n"))
    return {r["bigram"]: r["n"] for r in counts.collect()}


def prefix(word: str, order: dict[str, int]) -> list[int]:
    """Places of the PREFIX rarest bigrams of a word, and of more occurrences of the last one."""
    ranked = sorted((order[word[i : i + 2]], i) for i in range(len(word) - 1))
    last = ranked[min(PREFIX, len(ranked)) - 1][0]
    rarer = [i for r, i in ranked[:PREFIX] if r < last]
    return rarer + [i for r, i in ranked if r == last][:OCCURRENCES]


def edit_of_one(a: str, b: str) -> bool:
    """Whether exactly one inserted, deleted or replaced code point makes `b` of `a`."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    low, high = 0, min(len(a), len(b))  # the length of the common start, by halves
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return a[low + (len(a) >= len(b)) :] == b[low + (len(b) >= len(a)) :]


def gaps(places: list[int], length: int, shared: int) -> set[tuple[int, int]]:
    """(front, back): letters at both ends of a word outside of a gap, for the surviving bigrams at `places`.

    `length` is the word's, `shared` that of the shorter word of the pair, from which gaps are measured.
    """
    open_gaps = {(at + 2, 0) for at in places if at + 2 <= shared} | {(0, length - at) for at in places if length - at <= shared}
    found = set()
    while open_gaps:
        front, back = open_gaps.pop()
        gap = shared - front - back
        if gap <= max(GAP, shared // GAPS):
            found.add((front, back))
        else:
            open_gaps |= {(front + gap // 2, back), (front, back + gap - gap // 2)}
    return found


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, n, other, other_n) for all pairs of words of one edit, in both directions, each once.

    `words` (word, n) has distinct words of at least PREFIX + 1 code points; it is read several times.
    """
    counts = bigram_counts(words)
    order = {g: k for k, (_, g) in enumerate(sorted((n, g) for g, n in counts.items()))}
    # Numbers stand for words where they meet; written, so that they stay the same.
    numbered = materialize(words.withColumn("id", F.monotonically_increasing_id()), "numbered-words")
    # Words are few bytes but much work, so they are dealt by number and not as they lie in files.
    tasks = max(words.sparkSession.sparkContext.defaultParallelism, -(-numbered.count() // TASK_WORDS))

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for i, word in zip(batch["id"], batch["word"], strict=True):
                places, n = prefix(word, order), len(word)
                # As the shorter word of a pair, or one of two of equal length, and as the longer one.
                for longer in (0, 1):
                    for front, back in gaps(places, n, n - longer):
                        around = xxhash.xxh3_64_intdigest(f"{n - longer} {front} {word[:front]}{word[n - back :]}") - 2**63
                        rows.append((around, i, word[front : n - back], longer))
            yield pd.DataFrame(rows, columns=["around", "id", "gap", "longer"])

    parts = materialize(numbered.repartition(tasks).mapInPandas(index, "around long, id long, gap string, longer int"), "parts")
    one, two = parts.filter("longer = 0").drop("longer").alias("one"), parts.alias("two")
    meets = one.join(two, "around").filter("two.longer = 1 or one.id < two.id").filter((F.length("one.gap") > GAPS) | (F.levenshtein("one.gap", "two.gap") == 1))
    pairs = meets.select(F.col("one.id").alias("id"), F.col("two.id").alias("other_id")).distinct()
    other = numbered.select(F.col("id").alias("other_id"), F.col("word").alias("other"), F.col("n").alias("other_n"))
    pairs = pairs.join(numbered, "id").join(other, "other_id").select("word", "n", "other", "other_n")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [r for r in batch.itertuples(index=False, name=None) if edit_of_one(r[0], r[2])]
            yield pd.DataFrame(rows, columns=batch.columns)

    near = materialize(pairs.mapInPandas(verify, pairs.schema), "near")
    discard(parts)
    discard(numbered)
    return near.unionByName(near.select(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n")))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for `forms` (word, form): the end of the chain of forms, by pointer doubling.

    A form occurs RATIO times as often as its word, so no chain is longer than the digits of a
    count, and few rounds suffice.  A word is the form of no more words than are near to it.
    """
    up = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        above = up.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if up.join(above, "root", "left_semi").isEmpty():
            return up
        longer = materialize(up.join(above, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
        discard(up)
        up = longer


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of `docs`.

    A word's form is the near word of largest n (ties: the smallest in code-point order) if that is
    at least RATIO times the word's; its root is where its chain of forms ends, itself if it has none.
    A null text has no words, and a null identifier counts as an empty one; rows that repeat count each time,
    other columns are ignored, and a table without words gives an empty result.
    """
    words = materialize(count_words(docs, id_col, text_col), "words")
    near = near_pairs(words)
    best = F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form")))
    around = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    found = words.join(around, "word", "left")
    often = -F.col("best.less") >= RATIO * F.col("n")
    found = found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(often, F.col("best.form")).alias("form"), F.when(often, -F.col("best.less")).alias("form_n"))
    found = materialize(found, "forms")
    discard(words)
    out = found.join(roots(found.filter("form is not null")), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
