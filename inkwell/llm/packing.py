"""Packing of tokenised documents into training sequences by non-negative least squares.

Whole windows of a document are sequences of their own.  The tails are put into
length classes; shallow combinations of classes that fill a window are the
columns of a matrix, and non-negative least squares finds how often to repeat
each so that the histogram of the tails is used up.  Repeat counts are rounded
down.  The tails left over form a stream, which greedily fills what the planned
windows have free, is cut where a window is full, and then packs windows of its own.

The histogram and the plan have a fixed size whatever the input.  Everything
that is as long as the input stays in Spark tables.
"""

from __future__ import annotations

import json
import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkwell.llm.common import materialize, small_batches

#: Tokens of a sequence.
WINDOW = 4096
#: Tokens of a length class; a tail counts as the next multiple of it.
GRID = 64
#: Most tails in a planned window.
DEPTH = 4
#: The id that ends every document.
END_ID = 2
#: Share of the plan that is carried out, so that the stream can fill what is left free.
MARGIN = 0.995
#: Entries of each of a worker's caches, about 50 MB; a full cache starts anew.
CACHE = 250_000
#: Tokens of a stretch of the stream that is merged with the free places by itself.
STRETCH = 1 << 14
#: Planned windows whose free places are added up together.
GROUP = 1 << 12

#: How a file has to prepare texts for the shorter way of `WordTokenizer`; texts for another one all go through the tokenizer as a whole.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": _SPLIT}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
#: Chunks on which lower-casing and the pieces come out the same in Arrow's functions: ASCII and the letters of Latin-1.
_PLAIN = "^[!-~À-ÖØ-öø-ÿ]*$"


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b if b in own else next(rest)) for b in range(256)]


def _expand(values: np.ndarray, size: np.ndarray, code: np.ndarray) -> np.ndarray:
    """The values of the entries `code` in a row; entry i has the next size[i] of `values`."""
    long = size[code]
    to = np.cumsum(long)
    at = np.arange(to[-1] if len(to) else 0) + np.repeat((np.cumsum(size) - size)[code] - (to - long), long)
    return values[at]


class WordTokenizer:
    """Ids of white-space separated chunks, which Arrow finds and cuts into pieces, each different one once a batch.

    Only the different pieces of plain letters and signs come to Python, for the BPE model or a
    cache; all other chunks go through the tokenizer as a whole.  That holds for files that prepare
    texts as _NORMALIZER and _PRE_TOKENIZER say; with another file, whole texts go through the tokenizer.
    """

    def __init__(self, content: str) -> None:
        self.content = content
        self._open()

    def _open(self) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(self.content)
        self.model = self.tokenizer.model
        said = json.loads(self.content)
        self.by_chunks = said.get("normalizer") == _NORMALIZER and said.get("pre_tokenizer") == _PRE_TOKENIZER
        #: The ids of each other chunk and of each piece as uint32, in bytes, which take a third of an array's memory.
        self.chunks: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {"": b""}
        self.letter = _byte_letters()

    def __getstate__(self) -> dict:
        return {"content": self.content}

    def __setstate__(self, state: dict) -> None:
        self.content = state["content"]
        self._open()

    def _piece(self, piece: str) -> bytes:
        # The signs and letters of ASCII stand for themselves.
        mapped = piece if piece.isascii() else "".join([self.letter[b] for b in piece.encode()])
        found = array("I", [x.id for x in self.model.tokenize(mapped)]).tobytes()
        self.pieces[piece] = found
        return found

    def _chunk(self, chunk: str) -> bytes:
        found = array("I", self.tokenizer.encode(chunk, add_special_tokens=False).ids).tobytes()
        self.chunks[chunk] = found
        return found

    def _coded(self, texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids of each different unit, the units of all different chunks in a row, how many each has, the chunks of
        all texts in a row, end of each text's chunks).  A unit is a piece, or a chunk that is not plain."""
        cut = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        ends = cut.offsets.to_numpy()[1:] - cut.offsets[0].as_py()
        coded = cut.flatten().dictionary_encode()
        chunks = coded.dictionary
        plain = pc.and_(pc.match_substring_regex(chunks, _PLAIN), pc.invert(pc.match_substring(chunks, "<|")))
        spaced = pc.replace_substring_regex(pc.utf8_lower(chunks.filter(plain)), _SPLIT, r"\0 ")
        cut = pc.ascii_split_whitespace(pc.ascii_rtrim_whitespace(spaced))
        pieces = cut.flatten().dictionary_encode()
        for cache in (self.chunks, self.pieces):
            if len(cache) > CACHE:
                cache.clear()
        each = [self._piece(p) if (x := self.pieces.get(p)) is None else x for p in pieces.dictionary.to_pylist()]
        n, plain_ = len(each), plain.to_numpy(zero_copy_only=False)
        each += [self._chunk(c) if (x := self.chunks.get(c)) is None else x for c in chunks.filter(pc.invert(plain)).to_pylist()]
        many = np.ones(len(chunks), np.int64)
        many[plain_] = np.diff(cut.offsets.to_numpy())
        unit, of_piece = np.empty(many.sum(), np.int64), np.repeat(plain_, many)
        unit[of_piece], unit[~of_piece] = pieces.indices.to_numpy(zero_copy_only=False), np.arange(n, len(each))
        return each, unit, many, coded.indices.to_numpy(zero_copy_only=False), ends

    def _whole(self, texts: pa.Array) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch(pc.fill_null(texts, "").to_pylist(), add_special_tokens=False)]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, end of each text's ids)."""
        if not self.by_chunks:
            found = self._whole(texts)
            return np.array([i for x in found for i in x], np.uint32), np.cumsum([len(x) for x in found], dtype=np.int64)
        each, unit, many, code, ends = self._coded(texts)
        length, size = self._sizes(each, unit, many)
        chunks = _expand(np.frombuffer(b"".join(each), np.uint32), length, unit)
        return _expand(chunks, size, code), np.concatenate(([0], np.cumsum(size[code])))[ends]

    @staticmethod
    def _sizes(each: list[bytes], unit: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each different unit has, and each different chunk."""
        length = np.fromiter(map(len, each), np.int64, len(each)) // 4
        return length, np.diff(np.concatenate(([0], np.cumsum(length[unit])))[np.cumsum(many)], prepend=0)

    def count(self, texts: pa.Array) -> np.ndarray:
        """How many ids each text has."""
        if not self.by_chunks:
            return np.array([len(x) for x in self._whole(texts)], np.int64)
        each, unit, many, code, ends = self._coded(texts)
        _, size = self._sizes(each, unit, many)
        return np.diff(np.concatenate(([0], np.cumsum(size[code])))[ends], prepend=0)


TOKENS = pa.schema(
    [
        ("pid", pa.int32()), ("row", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("first_full", pa.int64()),
        ("full_crcs", pa.list_(pa.int64())), ("class", pa.int32()), ("nth", pa.int64()), ("tail", pa.int64()), ("tail_crc", pa.int64()),
        ("tail_ids", pa.binary()),
    ]
)
TOKENS_DDL = (
    "pid int, row long, doc_id long, n_tokens long, first_full long, full_crcs array<long>, class int, nth long, tail long, "
    "tail_crc long, tail_ids binary"
)


def _tokenized(docs: DataFrame, content: str, id_col: str, text_col: str) -> DataFrame:
    """A row for each document; (pid, row) identifies it, nth numbers the tails of a class in a task."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(WordTokenizer(content))  # as large as the vocabulary

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, pid = shared.value, TaskContext.get().partitionId()
        row, full, nth = 0, 0, [0] * (WINDOW // GRID + 1)
        crc = zlib.crc32
        for batch in batches:
            ids, ends = tokenizer.encode(batch.column("text"))
            begin, out = 0, {c: [] for c in TOKENS.names}
            for end in ends.tolist():
                own = np.append(ids[begin:end], np.uint32(END_ID)).astype("<u4")
                begin, n = end, len(own)
                cut = n // WINDOW * WINDOW
                tail = own[cut:]
                klass = -(-len(tail) // GRID)
                for c, v in (
                    ("row", row), ("n_tokens", n), ("first_full", full), ("full_crcs", [crc(own[i : i + WINDOW]) for i in range(0, cut, WINDOW)]),
                    ("class", klass), ("nth", nth[klass]), ("tail", n - cut), ("tail_crc", crc(tail)), ("tail_ids", tail.astype("<u2").tobytes() if own.max() < 1 << 16 else tail.tobytes()),
                ):
                    out[c].append(v)
                row, full = row + 1, full + cut // WINDOW
                nth[klass] += 1
            out["pid"], out["doc_id"] = [pid] * len(out["row"]), batch.column("doc_id")
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) if f.name != "doc_id" else out["doc_id"] for f in TOKENS], schema=TOKENS)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(rows, TOKENS_DDL)


def combinations(width: int, depth: int) -> np.ndarray:
    """How often each class 1..width occurs in every multiset of at most `depth` classes with sum `width`."""
    found: list[list[int]] = []

    def extend(chosen: list[int], left: int) -> None:
        if left == 0:
            found.append(chosen)
        elif len(chosen) < depth:
            for c in range(chosen[-1] if chosen else 1, left + 1):
                extend([*chosen, c], left - c)

    extend([], width)
    return np.array([np.bincount(x, minlength=width + 1)[1:] for x in found]).T


def nnls(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """x >= 0 that minimises |a x - b|, by the active-set method."""
    x, active = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    scale = 1e-9 * max(1.0, float(np.abs(a.T @ b).max(initial=0)))
    for _ in range(6 * len(b)):
        slope = a.T @ (b - a @ x)
        slope[active] = -np.inf
        best = int(slope.argmax())
        if slope[best] <= scale:
            break
        active[best] = True
        while True:
            s = np.zeros(len(x))
            s[active] = np.linalg.lstsq(a[:, active], b, rcond=None)[0]
            low = active & (s <= 0)
            if not low.any():
                x = s
                break
            step = (x[low] / np.maximum(x[low] - s[low], 1e-300)).min()
            x = np.maximum(x + step * (s - x), 0)
            active &= x > 1e-9
            x[~active] = 0
    return x


def window_plan(counts: np.ndarray, tokens: np.ndarray) -> list[tuple[int, int, int, int, int, int]]:
    """Places of tails in planned windows: (class, from, to, first window, tails a window, first slot).

    counts and tokens: of the tails of class 1, 2, ...  The tails of a class numbered from..to-1
    lie in the windows from `first window` on, so many in each.
    """
    a = combinations(len(counts), DEPTH)
    x = nnls(a.astype(float), counts.astype(float))
    mean = np.divide(tokens, counts, out=np.zeros(len(counts)), where=counts > 0)
    capacity = float(x.sum()) * len(counts) * GRID
    if capacity <= 0:
        return []
    free = capacity - float(x @ (a.T @ mean))
    planned = capacity - free
    x = np.floor(x * min(1.0, MARGIN * tokens.sum() / (planned + free)) + 1e-9).astype(np.int64)
    for c in range(len(counts)):  # rounding aside, least squares may use a class up twice
        for j in np.flatnonzero((a[c] > 0) & (x > 0)):
            over = int(a[c] @ x) - int(counts[c])
            if over <= 0:
                break
            x[j] -= min(int(x[j]), -(-over // int(a[c, j])))
    used, window, out = np.zeros(len(counts), np.int64), 0, []
    for j in np.flatnonzero(x):
        slot = 0
        for c in np.flatnonzero(a[:, j]):
            n = int(a[c, j])
            out.append((int(c) + 1, int(used[c]), int(used[c]) + n * int(x[j]), window, n, slot))
            used[c] += n * int(x[j])
            slot += n
        window += int(x[j])
    return out


def _running(df: DataFrame, group: str, order: str, value: str, out: str) -> DataFrame:
    """`df` with `out`, the sum of `value` over all rows before in order of (group, order).

    The sums run within groups, those of groups within GROUP of them, and one task adds up only
    what those come to: a row for GROUP groups.
    """
    earlier = (Window.unboundedPreceding, -1)
    totals = df.groupBy(group).agg(F.sum(value).alias("_total")).withColumn("_upper", F.floor(F.col(group) / GROUP))
    upper = totals.groupBy("_upper").agg(F.sum("_total").alias("_sum"))
    upper = upper.select("_upper", F.coalesce(F.sum("_sum").over(Window.orderBy("_upper").rowsBetween(*earlier)), F.lit(0)).alias("_below"))
    within = F.coalesce(F.sum("_total").over(Window.partitionBy("_upper").orderBy(group).rowsBetween(*earlier)), F.lit(0))
    bases = totals.withColumn("_within", within).join(upper, "_upper").select(F.col(group).alias("_group"), (F.col("_within") + F.col("_below")).alias("_base"))
    own = Window.partitionBy(group).orderBy(order).rowsBetween(*earlier)
    inner = df.withColumn("_own", F.coalesce(F.sum(value).over(own), F.lit(0)))
    return inner.join(bases, F.col(group) == F.col("_group")).withColumn(out, F.col("_base") + F.col("_own")).drop("_group", "_base", "_own")


def _stretches(df: DataFrame, kind: int, begin: str, size: str, end: int, *columns: str) -> DataFrame:
    """The start of each interval, and again the start of each later stretch that it reaches, up to `end`."""
    to = F.least(F.col(begin) + F.col(size), F.lit(end))
    each = F.sequence(F.floor(F.col(begin) / STRETCH), F.floor((to - 1) / STRETCH))
    item = F.struct(*[F.col(c) for c in columns])
    return (
        df.filter((F.col(size) > 0) & (F.col(begin) < end))
        .select(F.explode(each).alias("stretch"), F.col(begin).cast("long").alias("_b"), item.alias("item"))
        .select("stretch", F.greatest("_b", F.col("stretch") * STRETCH).alias("at"), F.lit(kind).alias("kind"), "item")
    )


def pack(docs: DataFrame, tokenizer_json: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of documents in sequences of WINDOW tokens: doc_id, start, length, ids_crc32,
    doc_tokens, sequence_id, offset.

    tokenizer_json is the content of a tokenizer file.  Every document is its ids and END_ID; each
    id lies in just one piece.  The pieces of a sequence lie in it without gaps.  All sequences are
    full but for the end of the stream, which is cut into powers of two, and planned windows that
    the stream was too short to fill.

    A null or empty text is END_ID alone.  Rows are packed by themselves, so repeated rows and
    identifiers are kept, each with pieces of its own; a null identifier stays null.  Other columns
    are ignored.  An empty table gives an empty result.
    """
    spark = docs.sparkSession
    tokens = materialize(_tokenized(docs, tokenizer_json, id_col, text_col), "tokens")
    tails = tokens.filter("tail > 0")
    # The histogram has at most WINDOW / GRID rows.
    found = {r["class"]: r for r in tails.groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.sum("tail").alias("t")).collect()}
    classes = range(1, WINDOW // GRID + 1)
    counts = np.array([found[c]["n"] if c in found else 0 for c in classes], np.int64)
    plan = window_plan(counts, np.array([found[c]["t"] if c in found else 0 for c in classes], np.int64))
    windows = max((first + (to - at) // n for _, at, to, first, n, _ in plan), default=0)
    # The number of a tail within its class: those of earlier tasks, and its number in its task.
    per_task = tails.groupBy("pid", "class").count()
    earlier = Window.partitionBy("class").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    base = materialize(per_task.select("pid", "class", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("base")), "class-numbers")
    slots = spark.createDataFrame(plan, "class int, at long, to long, first long, each long, slot long")
    # The plan has at most a few hundred rows: as many columns of the solution as classes, DEPTH each.
    numbered = tails.join(base, ["pid", "class"]).withColumn("k", F.col("base") + F.col("nth"))
    k = F.col("k") - F.col("at")
    planned = numbered.join(F.broadcast(slots), (numbered["class"] == slots["class"]) & (F.col("k") >= F.col("at")) & (F.col("k") < F.col("to"))).select(
        "doc_id", "n_tokens", "tail", "tail_crc", (F.col("first") + F.floor(k / F.col("each"))).alias("sequence_id"), (F.col("slot") + k % F.col("each")).alias("slot")
    )
    in_window = Window.partitionBy("sequence_id").orderBy("slot")
    before = in_window.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("sequence_id")
    planned = materialize(
        planned.withColumn("offset", F.coalesce(F.sum("tail").over(before), F.lit(0))).withColumn("filled", F.sum("tail").over(whole)), "planned"
    )
    limit = {c: 0 for c in classes}
    for c, _, to, *_ in plan:
        limit[c] = max(limit[c], to)
    # numbers beyond the plan: their limit by class is an array of WINDOW / GRID numbers
    beyond = F.col("k") >= F.element_at(F.array(*[F.lit(limit[c]).cast("long") for c in classes]), F.col("class"))
    stream = materialize(_running(numbered.filter(beyond).select("pid", "row", "tail"), "pid", "row", "tail", "begin"), "stream")
    free = planned.filter("slot = 0").select("sequence_id", "filled", (WINDOW - F.col("filled")).alias("free"), F.floor(F.col("sequence_id") / GROUP).alias("group"))
    free = materialize(_running(free, "group", "sequence_id", "free", "begin"), "free-places")
    n_stream = stream.agg(F.sum("tail")).first()[0] or 0
    n_free = free.agg(F.sum("free")).first()[0] or 0
    shared = min(n_stream, n_free)
    # Merge the stream's documents with the free places, stretch by stretch.
    none_doc, none_place = F.lit(None).cast("struct<pid:int,row:long,begin:long>"), F.lit(None).cast("struct<sequence_id:long,filled:long,begin:long>")
    events = (
        _stretches(stream, 0, "begin", "tail", shared, "pid", "row", "begin").select("stretch", "at", "kind", F.col("item").alias("doc"), none_place.alias("place"))
    ).union(_stretches(free, 1, "begin", "free", shared, "sequence_id", "filled", "begin").select("stretch", "at", "kind", none_doc.alias("doc"), F.col("item").alias("place")))
    along = Window.partitionBy("stretch").orderBy("at", "kind")
    merged = events.select(
        "at",
        F.last("doc", ignorenulls=True).over(along).alias("doc"),
        F.last("place", ignorenulls=True).over(along).alias("place"),
        F.coalesce(F.lead("at").over(along), F.least((F.col("stretch") + 1) * STRETCH, F.lit(shared))).alias("end"),
    ).filter("end > at")
    filling = merged.select(
        "doc.pid", "doc.row", (F.col("at") - F.col("doc.begin")).alias("from"), (F.col("end") - F.col("at")).alias("length"),
        F.col("place.sequence_id").alias("sequence_id"), (F.col("place.filled") + F.col("at") - F.col("place.begin")).alias("offset"),
    )
    # What is left of the stream fills windows of its own, and its end powers of two.
    rest = n_stream - shared
    last, breaks = rest // WINDOW * WINDOW, []
    for bit in reversed(range(WINDOW.bit_length() - 1)):
        if rest & 1 << bit:
            breaks.append(last + sum(1 << b for b in range(bit + 1, WINDOW.bit_length() - 1) if rest & 1 << b))
    cuts = F.array(*[F.lit(b) for b in breaks]).cast("array<long>")
    a, b = F.greatest(F.col("begin") - shared, F.lit(0)), F.col("begin") + F.col("tail") - shared
    inside = F.filter(F.concat(F.array("a", F.floor((F.col("b") - 1) / WINDOW) * WINDOW), cuts), lambda x: (x >= F.col("a")) & (x < F.col("b")))
    own = stream.filter(F.col("begin") + F.col("tail") > shared).select("pid", "row", "begin", a.alias("a"), b.alias("b"))
    own = own.select("pid", "row", "begin", "b", F.sort_array(F.array_distinct(inside)).alias("cuts"))
    ends = F.concat(F.slice("cuts", 2, F.size("cuts")), F.array("b"))
    own = own.select("pid", "row", "begin", F.explode(F.arrays_zip(F.col("cuts").alias("a"), ends.alias("b"))).alias("x")).select("pid", "row", "begin", "x.a", "x.b")
    at_break = F.filter(cuts, lambda x: x <= F.col("a"))
    opened = F.when(F.col("a") < last, F.floor(F.col("a") / WINDOW)).otherwise(F.lit(last // WINDOW) + F.size(at_break) - 1)
    opens_at = F.when(F.col("a") < last, F.floor(F.col("a") / WINDOW) * WINDOW).otherwise(F.array_max(at_break)) if breaks else F.floor(F.col("a") / WINDOW) * WINDOW
    fresh = own.select(
        "pid", "row", (F.col("a") + shared - F.col("begin")).alias("from"), (F.col("b") - F.col("a")).alias("length"),
        (F.lit(windows) + opened).alias("sequence_id"), (F.col("a") - opens_at).alias("offset"),
    )
    streamed = _with_ids(filling.union(fresh), numbered.filter(beyond), "streamed")
    whole_tail = planned.select(
        "doc_id", (F.col("n_tokens") - F.col("tail")).alias("start"), F.col("tail").alias("length"), F.col("tail_crc").alias("ids_crc32"),
        F.col("n_tokens").alias("doc_tokens"), "sequence_id", "offset",
    )
    # Whole windows are numbered after all others: by task, then in the task.
    after = windows + rest // WINDOW + len(breaks)
    full = tokens.filter("n_tokens >= " + str(WINDOW)).select("doc_id", "n_tokens", "pid", "first_full", F.posexplode("full_crcs").alias("i", "crc"))
    full = full.select(
        "doc_id", (F.col("i") * WINDOW).cast("long").alias("start"), F.lit(WINDOW).cast("long").alias("length"), F.col("crc").alias("ids_crc32"),
        F.col("n_tokens").alias("doc_tokens"), (after + F.col("pid") * F.lit(1 << 36) + F.col("first_full") + F.col("i")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
    )
    return whole_tail.union(streamed).union(full)


def _with_ids(pieces: DataFrame, rows: DataFrame, name: str) -> DataFrame:
    """Pieces (pid, row, from, length, sequence_id, offset) of tails with the checksum of their ids."""
    listed = pieces.groupBy("pid", "row").agg(F.sort_array(F.collect_list(F.struct("from", "length", "sequence_id", "offset"))).alias("pieces"))
    joined = rows.select("pid", "row", "doc_id", "n_tokens", "tail", "tail_ids").join(listed, ["pid", "row"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x in batch.to_pylist():
                ids = np.frombuffer(x["tail_ids"], "<u2" if len(x["tail_ids"]) == 2 * x["tail"] else "<u4").astype("<u4")
                for p in x["pieces"]:
                    own = ids[p["from"] : p["from"] + p["length"]]
                    out.append((x["doc_id"], x["n_tokens"] - x["tail"] + p["from"], p["length"], zlib.crc32(own), x["n_tokens"], p["sequence_id"], p["offset"]))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)] if out else [pa.array([], pa.int64())] * 7, names=NAMES)

    return joined.mapInArrow(cut, ", ".join(f"{c} long" for c in NAMES))


NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def read_text(spark: SparkSession, path: str) -> str:
    """The content of one small file, through Spark."""
    local = path if "://" in path else f"file://{os.path.abspath(path)}"
    return spark.read.text(local, wholetext=True).first()[0]
