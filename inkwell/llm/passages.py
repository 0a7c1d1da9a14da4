"""Substring dedup: passages whose words also stand elsewhere, found by backward search in sharded FM-indexes.

A shard cannot be a range of documents here, since every document would have to be streamed through
every shard.  Shards are made by content instead: a window's smallest hash of `gram` consecutive words
names its shard, so equal windows meet in one shard and each is looked up once.  Neighbouring windows
with one smallest hash are a segment.  Segments whose hash occurs once hold nothing repeated and go no
further, of equal segments one is indexed, with its copies as weight.  Each shard builds an index of
its segments and streams them through it: the matching statistics say which windows occur twice.

A hash with more words than a shard holds, say of a passage that a third of all documents share with
different words around it, is dealt by whole windows instead, and equal windows are added up first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import bucketed, discard, join_hot, materialize, small_batches
from inkwell.llm.fm_index import FMIndex

#: Words of a window.
WORDS = 35
#: Windows of a segment at most; they are the bits of a long.
WINDOWS = 28
#: Words of a shard, about.
SHARD_WORDS = 500_000
#: Bytes of texts that are hashed together, if no single text is longer.
BYTES_AT_ONCE = 4_000_000

_MIX = np.uint64(0x9E3779B97F4A7C15)
_SOLID = np.ones(256, bool)
_SOLID[[9, 10, 11, 12, 13, 32]] = False


def words_of(text: str | None) -> list[bytes]:
    """Maximal runs without ASCII white space, which is what bytes.split() splits at."""
    return text.encode().split() if text else []


def gram_of(words: int) -> int:
    """Words of the sequences that are hashed: a window holds WINDOWS of them at most."""
    return max(words - WINDOWS + 1, (words + 3) // 4)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(29))


_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """The first `n` powers of a base, from the first on, modulo 2**64; a worker keeps the longest table up to BYTES_AT_ONCE."""
    if n > BYTES_AT_ONCE:
        return np.cumprod(np.full(n, base, np.uint64))
    if len(_powers.get(base, ())) < n:
        _powers[base] = np.cumprod(np.full(min(2 * n, BYTES_AT_ONCE), base, np.uint64))
    return _powers[base][:n]


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the runs values[start:end]: a polynomial in _MIX, from running sums, divided by the power at its start."""
    base = int(_MIX)
    sums = np.append(np.uint64(0), np.cumsum(values * powers(base, len(values))))
    return mixed((sums[ends] - sums[starts]) * powers(pow(base, -1, 2**64), len(values))[starts])


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word of a buffer, and where the words begin."""
    each = np.frombuffer(data, np.uint8)
    edges = np.flatnonzero(np.diff(_SOLID[each].view(np.int8), prepend=0, append=0))
    starts, ends = edges[::2], edges[1::2]
    return run_hashes(each.astype(np.uint64) + np.uint64(1), starts, ends), starts


def leftmost_least(h: np.ndarray, width: int) -> np.ndarray:
    """For each `width` consecutive values, the place of the least, the leftmost of equal ones."""
    at, covered = np.arange(len(h)), 1
    while covered < width:
        step = min(covered, width - covered)
        left, right = at[:-step], at[step:]
        at = np.where(h[left] <= h[right], left, right)
        covered += step
    return at


def segments(hashes: np.ndarray, text: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, number of windows and smallest hash of each segment of texts that lie one after another.

    `text` has the number of each word's text; windows across texts are left out.
    """
    if len(hashes) < words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    gram = gram_of(words)
    n = len(hashes) - gram + 1
    h = np.zeros(n, np.uint64)
    for k in range(gram):
        h = mixed(h ^ hashes[k : k + n])
    at = leftmost_least(h, words - gram + 1)
    inside = np.flatnonzero(text[: len(at)] == text[words - 1 :])
    at = at[inside]
    opens = np.ones(len(at), bool)
    # A gram belongs to one text, but one window across texts can lie between two of a text; so places are compared too.
    opens[1:] = (at[1:] != at[:-1]) | (inside[1:] != inside[:-1] + 1)
    first = np.flatnonzero(opens)
    return inside[first], np.diff(np.append(first, len(at))), h[at[first]]


def text_segments(texts: DataFrame, words: int) -> DataFrame:
    """(row, start, windows, h, digest) for the segments of `texts` (row, text); the digest tells segments of one hash apart."""

    def pieces(batch: pd.DataFrame) -> Iterator[tuple[np.ndarray, list[bytes]]]:
        data = [(x or "").encode() for x in batch["text"]]
        rows, sizes = batch["row"].to_numpy(), np.cumsum([len(x) for x in data])
        edges = [0, *np.flatnonzero(np.diff(sizes // BYTES_AT_ONCE)) + 1, len(data)]
        for a, b in zip(edges, edges[1:], strict=False):
            yield rows[a:b], data[a:b]

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for rows, data in pieces(batch):
                hashes, starts = word_hashes(b"\n".join(data))
                ends = np.cumsum([len(x) + 1 for x in data])
                text = np.searchsorted(ends, starts, side="right")
                first, windows, h = segments(hashes, text, words)
                digest = run_hashes(hashes, first, first + windows + words - 1)
                start = first - np.searchsorted(text, text[first])  # counted from the text's first word
                yield pd.DataFrame({"row": rows[text[first]], "start": start, "windows": windows, "h": h.view(np.int64), "digest": digest.view(np.int64)})

    return texts.select("row", "text").mapInPandas(find, "row long, start int, windows int, h long, digest long")


def cut(texts: DataFrame, chosen: DataFrame, words: int) -> DataFrame:
    """The words of segments: (k1, k2, copies, body) and, of segments dealt by window, h, digest and offset of each window."""
    each = F.struct("start", "windows", "h", "digest", "copies", "apart")
    joined = texts.select("row", "text").join(chosen.groupBy("row").agg(F.collect_list(each).alias("parts")), "row")

    def bodies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text, parts in zip(batch["text"], batch["parts"], strict=True):
                found = words_of(text)
                for p in parts:
                    start, n, h, digest = p["start"], p["windows"], p["h"], p["digest"]
                    if not p["apart"]:
                        rows.append((h, digest, p["copies"], b" ".join(found[start : start + n + words - 1]), None, None, None))
                        continue
                    for at in range(n):
                        body = b" ".join(found[start + at : start + at + words])
                        k = xxhash.xxh3_128_digest(body)
                        k1, k2 = (int.from_bytes(x, "little", signed=True) for x in (k[:8], k[8:]))
                        rows.append((k1, k2, p["copies"], body, h, digest, at))
            out = pd.DataFrame(rows, columns=["k1", "k2", "copies", "body", "h", "digest", "at"], dtype=object)
            yield out.astype({c: "Int64" for c in out.columns if c != "body"})  # which holds nulls beside whole longs

    return joined.mapInPandas(bodies, "k1 long, k2 long, copies long, body binary, h long, digest long, at int")


def repeated_windows(bodies: list[bytes], copies: np.ndarray, words: int) -> np.ndarray:
    """For each sequence of a shard, the windows of `words` words that occur twice or more in the shard, as bits of a long.

    A backward search from a segment's end marks all windows from where it failed on.  Those before
    are searched from the left: a search that fails rules out all windows up to where it failed; after
    one that succeeds, halving finds how far on from its first word the words are repeated together.
    """
    names: dict[bytes, int] = {}
    each = [[names.setdefault(w, len(names) + 1) for w in body.split(b" ")] for body in bodies]
    lengths = np.array([len(x) for x in each])
    begin = np.cumsum(lengths + 1) - lengths - 1
    symbols = np.zeros(int(lengths.sum()) + len(each), np.int64)
    symbols[np.delete(np.arange(len(symbols)), begin + lengths)] = np.fromiter((w for x in each for w in x), np.int64, int(lengths.sum()))
    weights = np.repeat(copies, lengths + 1)
    # A word that occurs once is in no repeated window: it ends sequences, and the others are numbered again.
    often = np.bincount(symbols, weights=weights, minlength=len(names) + 1) > 1
    often[0] = False
    symbols = np.where(often, np.cumsum(often), 0)[symbols]
    index = FMIndex(symbols, weights)

    def marks(first: np.ndarray, end: np.ndarray) -> np.ndarray:
        return np.left_shift(np.int64(1), end) - np.left_shift(np.int64(1), first)

    n = lengths - words + 1
    found = index.matched(begin + lengths - 1, lengths, 2)
    whole = found >= words
    end = np.where(whole, lengths - found, n - 1)  # windows from here on are decided
    out = np.where(whole, marks(end, n), 0)
    at = np.zeros(len(each), np.int64)
    # Words at..low are repeated together, if low holds a window; words at..high + 1 are not, or not asked for.
    low, high = at + words - 2, at + words - 1
    going = np.flatnonzero(at < end)
    while len(going):
        a, e, lo, hi = at[going], end[going], low[going], high[going]
        middle = (lo + hi + 1) // 2
        found = index.matched(begin[going] + middle, middle - a + 1, 2)
        hit = found > middle - a
        opens = lo < a + words - 1  # the first search from this place
        lo, hi = np.where(hit, middle, lo), np.where(opens & hit, e + words - 2, np.where(hit, hi, middle - 1))
        done = lo >= hi
        held = lo >= a + words - 1
        out[going] |= np.where(done & held, marks(a, np.maximum(lo - words + 2, a)), 0)
        step = np.where(held, lo - words + 2 - a, words - found)
        a = np.where(done, a + step, a)
        at[going], low[going], high[going] = a, np.where(done, a + words - 2, lo), np.where(done, a + words - 1, hi)
        going = going[at[going] < end[going]]
    return out


def window_marks(units: DataFrame, shards: int, words: int) -> DataFrame:
    """(k1, k2, apart, marks) of the sequences `units` (k1, k2, copies, body, apart) that have a repeated window."""

    def search(shard: pd.DataFrame) -> pd.DataFrame:
        marks = repeated_windows(shard["body"].to_list(), shard["copies"].to_numpy(), words)
        return pd.DataFrame({"k1": shard["k1"], "k2": shard["k2"], "apart": shard["apart"], "marks": marks})[marks != 0]

    dealt = units.select("k1", "k2", "copies", "body", "apart", F.pmod(F.xxhash64("k1"), F.lit(shards)).alias("shard"))
    return dealt.groupBy("shard").applyInPandas(search, "k1 long, k2 long, apart boolean, marks long")


def repeated(texts: DataFrame, words: int = WORDS, shard_words: int = SHARD_WORDS) -> DataFrame | None:
    """(row, found) with found a list of (start, marks) for the rows of `texts` (row, text) with repeated windows; None if there are none.

    Bit k of the marks stands for the window from word start + k on.
    """
    spark = texts.sparkSession
    all_segments = materialize(text_segments(texts, words), "segments")
    often = materialize(all_segments.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "hashes")
    shared = materialize(join_hot(all_segments, often, ["h"], "n"), "shared-segments")
    discard(all_segments)
    discard(often)
    one = shared.groupBy("h", "digest").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("row", "start", "windows")).alias("at"))
    distinct = materialize(one.select("h", "digest", "copies", "at.*"), "distinct-segments")
    sizes = distinct.groupBy("h").agg(F.sum(F.col("windows") + words - 1).alias("words"), F.count(F.lit(1)).alias("rows"))
    total, most = sizes.agg(F.sum("words"), F.max("words")).first()
    if not total:
        return None
    shards = max(spark.sparkContext.defaultParallelism, -(-total // shard_words))
    if most <= shard_words:
        units = cut(texts, distinct.withColumn("apart", F.lit(False)), words)
        marks = window_marks(units.withColumn("apart", F.lit(False)), shards, words)
        marks = marks.select(F.col("k1").alias("h"), F.col("k2").alias("digest"), "marks")
    else:
        flagged_sizes = materialize(sizes, "sizes")
        flagged = join_hot(distinct, flagged_sizes, ["h"], "rows").withColumn("apart", F.col("words") > shard_words)
        units = materialize(cut(texts, flagged, words), "units")
        windows = units.filter("at is not null")
        added = windows.groupBy("k1", "k2").agg(F.sum("copies").alias("copies"), F.first("body").alias("body"), F.lit(True).alias("apart"))
        whole = units.filter("at is null").select("k1", "k2", "copies", "body", F.lit(False).alias("apart"))
        found = materialize(window_marks(whole.unionByName(added), shards, words), "marks")
        discard(flagged_sizes)
        apart = join_hot(windows.select("k1", "k2", "h", "digest", "at"), found.filter("apart").select("k1", "k2"), ["k1", "k2"])
        apart = apart.groupBy("h", "digest").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("at"))).alias("marks"))
        marks = found.filter("not apart").select(F.col("k1").alias("h"), F.col("k2").alias("digest"), "marks").unionByName(apart)
    marks = materialize(marks, "segment-marks")
    found = join_hot(shared, marks, ["h", "digest"])
    return found.groupBy("row").agg(F.collect_list(F.struct("start", "marks")).alias("found"))


def remove_repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(doc_id, n_words, n_removed, text, removed) for every row of `docs`.

    A word is removed if it lies in a window of `words` consecutive words of its document whose word
    sequence also starts anywhere else, in the same document or another one; so all copies of a
    passage go, and windows are judged on the input.  `text` has the words that stay, joined by a
    space, `removed` the spans of words (from, to; end exclusive) that go.  Words are runs without ASCII white
    space, unchanged.  A null text has no words; a row that repeats another is a copy of it, whatever
    their identifiers, which may be null; other columns are ignored, and an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    texts = bucketed(rows, "row", "texts")
    found = repeated(texts, words, shard_words)
    joined = texts.withColumn("found", F.lit(None).cast("array<struct<start:int,marks:long>>")) if found is None else texts.join(found, "row", "left")

    def remove(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = np.arange(WINDOWS)
        for batch in batches:
            out = []
            for doc_id, text, parts in zip(batch["doc_id"], batch["text"], batch["found"], strict=True):
                each, spans = words_of(text), []
                kept = each
                if parts is not None:
                    starts, marks = (np.array([p[k] for p in parts], np.int64)[:, None] for k in ("start", "marks"))
                    edge = np.zeros(len(each) + 1, np.int64)
                    at = (starts + bits)[(marks >> bits) & 1 == 1]
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + words, -1)
                    gone = np.cumsum(edge) > 0
                    turns = np.flatnonzero(np.diff(gone, prepend=False))
                    spans = turns.reshape(-1, 2).tolist()
                    kept = [w for w, g in zip(each, gone.tolist(), strict=False) if not g]
                out.append((doc_id, len(each), len(each) - len(kept), b" ".join(kept).decode(), [{"from": a, "to": b} for a, b in spans]))
            frame = pd.DataFrame(out, columns=["doc_id", "n_words", "n_removed", "text", "removed"], dtype=object)
            yield frame.astype(dict.fromkeys(("doc_id", "n_words", "n_removed"), "Int64"))

    return joined.select("doc_id", "text", "found").mapInPandas(remove, "doc_id long, n_words long, n_removed long, text string, removed array<struct<from:int,to:int>>")
