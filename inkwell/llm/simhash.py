"""SimHash near-dedup by a binary-trie self-join.

Fingerprints are sorted into a binary trie.  The self-join walks pairs of trie
nodes together, adds up the bits in which they differ and drops a pair as soon
as the sum exceeds the budget.  Four rotations of the bits let the walk start 16
bits deep: fingerprints that differ in at most three bits agree on one of four
16-bit blocks, so Spark can deal the walk out by (rotation, block).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import discard, materialize, small_batches
from inkwell.llm.components import connected_components

BUDGET = 3
SHINGLE = 3
BITS = 64
BLOCKS = BUDGET + 1
BLOCK_BITS = BITS // BLOCKS
#: A start node of more fingerprints than this is split into pairs of nodes SPLIT_BITS deeper.
NODE_SIZE = 20_000
SPLIT_BITS = 6
#: Fingerprints of one task of the walk, about.
TASK_SIZE = 200_000
#: Node pairs that one step of the walk expands.
FRONTIER = 100_000
#: A node pair of at most this many fingerprint pairs is compared outright.
LEAF = 48

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Shingles whose bits are added at once.
_CHUNK = 1 << 16


def fingerprint(text: str | None) -> int:
    """64-bit SimHash of the 3-word shingles: a bit is set if it is set in over half the hashes.

    Words are runs of anything but ASCII white space, after lower-casing A-Z.  Fewer than three
    words make one shingle; no words (or a null) give zero.
    """
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    if len(words) <= SHINGLE:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(b"%b %b %b" % x, 42) for x in zip(words, words[1:], words[2:], strict=False)), np.uint64, len(words) - 2
    )
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), _CHUNK):
        bits = np.unpackbits(hashes[at : at + _CHUNK].byteswap().view(np.uint8)).reshape(-1, BITS)
        counts += bits.sum(axis=0, dtype=np.int64)
    over = np.packbits(2 * counts > len(hashes))
    return int.from_bytes(over.tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint of each row's text as a signed 64-bit number."""
    small_batches(docs.sparkSession)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            fp = np.array([fingerprint(t) for t in x["text"]], np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": x["doc_id"], "fp": fp})

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(rows, "doc_id long, fp long")


class _Forest:
    """Union of links among positions 0..n-1, many at a time."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)

    def add(self, one: np.ndarray, other: np.ndarray) -> None:
        while len(one):
            one, other = self.root[one], self.root[other]
            apart = one != other
            one, other = one[apart], other[apart]
            np.minimum.at(self.root, np.maximum(one, other), np.minimum(one, other))
            while True:
                up = self.root[self.root]
                if (up == self.root).all():
                    break
                self.root = up


def _walk(sides: list[tuple[int, int, int, int, int, int]], values: np.ndarray, forest: _Forest) -> None:
    """Walk the tries of `values` from the node pairs (lo, hi, lo, hi, bits used, bits that differ).

    Nodes are ranges of positions; `values` ascends within each.  Links go to `forest`.
    """
    stack = [np.array(sides, np.int64).reshape(-1, 6)]
    while stack:
        pairs = stack.pop()
        if len(pairs) > FRONTIER:
            stack += [pairs[FRONTIER:], pairs[:FRONTIER]]
            continue
        al, ah, bl, bh, used, differ = pairs.T
        same = al == bl
        # All below is within the budget: one link to each is enough.
        whole = BITS - used + differ <= BUDGET
        for l, h, to in ((al, ah, al), (bl, bh, al)):
            size = (h - l)[whole]
            at = np.repeat(l[whole], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            forest.add(np.repeat(to[whole], size), at)
        n, m = ah - al, bh - bl
        leaf = ~whole & (n * m <= LEAF)
        if leaf.any():
            count = (n * m)[leaf]
            k = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            width = np.repeat(m[leaf], count)
            i, j = np.repeat(al[leaf], count) + k // width, np.repeat(bl[leaf], count) + k % width
            near = np.bitwise_count(values[i] ^ values[j]) <= BUDGET
            near &= (i < j) | ~np.repeat(same[leaf], count)
            forest.add(i[near], j[near])
        rest = ~whole & ~leaf
        if not rest.any():
            continue
        al, ah, bl, bh, used, differ = pairs[rest].T
        bit = np.uint64(1) << (BITS - 1 - used).astype(np.uint64)

        def cut(lo: np.ndarray, hi: np.ndarray, bit: np.ndarray = bit) -> np.ndarray:
            """Where the bit turns to one in each range, by bisection."""
            lo, hi = lo.copy(), hi.copy()
            while (open_ := lo < hi).any():
                mid = (lo + hi) >> 1
                one = np.zeros(len(lo), bool)
                one[open_] = values[mid[open_]] & bit[open_] != 0
                hi = np.where(open_ & one, mid, hi)
                lo = np.where(open_ & ~one, mid + 1, lo)
            return lo

        am, bm, same = cut(al, ah), cut(bl, bh), al == bl
        children = [
            (al, am, bl, bm, 0, True),
            (am, ah, bm, bh, 0, True),
            (al, am, bm, bh, 1, True),
            (am, ah, bl, bm, 1, ~same),  # of a node with itself, one of the mixed pairs
        ]
        below = []
        for a, b, c, d, more, wanted in children:
            keep = (a < b) & (c < d) & (differ + more <= BUDGET) & wanted
            below.append(np.stack([a, b, c, d, used + 1, differ + more], axis=1)[keep])
        # All pairs of a depth stay together: apart, they would soon be many arrays of few pairs.
        stack.append(np.concatenate(below))


def _rotated(fp: Column, block: Column) -> Column:
    """The bits turned left so that the block comes first."""
    by = (block * BLOCK_BITS).cast("int")
    return F.when(block == 0, fp).otherwise(
        F.call_function("shiftleft", fp, by).bitwiseOR(F.call_function("shiftrightunsigned", fp, F.lit(BITS) - by))
    )


def fingerprint_links(fps: DataFrame) -> DataFrame:
    """Links (a, b) between fingerprints of at most BUDGET differing bits.

    `fps` has one column, fp, of distinct values.  The links span the components: within a task,
    fingerprints found together link to one of them, so a dense family gives no square of links.
    """
    spark = fps.sparkSession
    rotated = fps.select("fp", F.explode(F.array(*map(F.lit, range(BLOCKS)))).alias("block"))
    rotated = rotated.withColumn("value", _rotated(F.col("fp"), F.col("block"))).drop("fp")
    rotated = rotated.withColumn("node", F.shiftrightunsigned("value", BITS - BLOCK_BITS))
    # A start node that holds too many is replaced by the pairs of its descendants SPLIT_BITS
    # deeper whose bits differ within the budget.
    sizes = materialize(rotated.groupBy("block", "node").count(), "node-sizes")
    copies = sum(1 for m in range(2**SPLIT_BITS) if m.bit_count() <= BUDGET)
    dealt_rows = sizes.agg(F.sum(F.col("count") * F.when(F.col("count") > NODE_SIZE, copies).otherwise(1))).first()[0] or 0
    if sizes.filter(F.col("count") > NODE_SIZE).isEmpty():
        dealt = rotated.withColumn("pair", F.lit(-1))
    else:
        split = rotated.join(sizes, ["block", "node"])
        deep = F.shiftrightunsigned("value", BITS - BLOCK_BITS - SPLIT_BITS).bitwiseAND(2**SPLIT_BITS - 1).cast("int")
        masks = [m for m in range(2**SPLIT_BITS) if m.bit_count() <= BUDGET]
        others = F.transform(F.array(*map(F.lit, masks)), lambda m: deep.bitwiseXOR(m))
        pair = F.transform(others, lambda o: F.least(deep, o) * 2**SPLIT_BITS + F.greatest(deep, o))
        dealt = split.select("block", "node", "value", F.explode(F.when(F.col("count") > NODE_SIZE, pair).otherwise(F.array(F.lit(-1)))).alias("pair"))

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [x for x in batches if len(x)]
        if not parts:
            return
        x = pd.concat(parts, ignore_index=True)
        value = x["value"].to_numpy().view(np.uint64)
        pair = x["pair"].to_numpy().astype(np.int64)
        group = x["block"].to_numpy().astype(np.int64) << 32 | x["node"].to_numpy().astype(np.int64) << 13 | (pair + 1)
        order = np.lexsort((value, group))
        value, pair, group, block = value[order], pair[order], group[order], x["block"].to_numpy()[order]
        starts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        ends = np.append(starts[1:], len(value))
        sides = []
        one, two = pair >> SPLIT_BITS, pair & (2**SPLIT_BITS - 1)
        whole = (pair[starts] < 0) | (one[starts] == two[starts])
        used = np.where(pair[starts] < 0, BLOCK_BITS, BLOCK_BITS + SPLIT_BITS)
        zero = np.zeros(len(starts), np.int64)
        sides.append(np.stack([starts, ends, starts, ends, used, zero], axis=1)[whole & (ends - starts > 1)])
        deep = (value >> np.uint64(BITS - BLOCK_BITS - SPLIT_BITS) & np.uint64(2**SPLIT_BITS - 1)).astype(np.int64)
        for s, e in zip(starts[~whole], ends[~whole], strict=True):
            middle = s + int((deep[s:e] == one[s]).sum())
            if s < middle < e:
                sides.append(np.array([[s, middle, middle, e, BLOCK_BITS + SPLIT_BITS, int(one[s] ^ two[s]).bit_count()]]))
        forest = _Forest(len(value))
        _walk(np.concatenate(sides), value, forest)
        found = np.flatnonzero(forest.root != np.arange(len(value)))
        turn = (block * BLOCK_BITS).astype(np.uint64)

        def back(at: np.ndarray) -> np.ndarray:
            v, by = value[at], turn[at]
            return np.where(by == 0, v, v >> by | v << (np.uint64(BITS) - by) % np.uint64(BITS)).view(np.int64)

        yield pd.DataFrame({"a": back(found), "b": back(forest.root[found])})

    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")), dealt_rows // TASK_SIZE)
    dealt = dealt.select("block", "node", "pair", "value").repartition(tasks, "block", "node", "pair")
    return dealt.mapInPandas(walk, "a long, b long")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of `docs`.

    component_id is the smallest identifier reachable over links of at most BUDGET differing bits.
    A null text counts as empty; texts without a word have fingerprint zero and link like any other.
    Repeated rows share a component; null identifiers are never a component_id unless the whole
    component has none.  Other columns are ignored.  An empty table gives an empty result.

    Rows with equal fingerprints are reduced to one before the join, so copies make no links.
    """
    fps = materialize(fingerprints(docs, id_col, text_col), "fingerprints")
    distinct = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    links = materialize(fingerprint_links(distinct.select("fp")), "fingerprint-links")
    parts = connected_components(links)
    discard(links)
    # Components are named by a fingerprint; their smallest identifier is a plain aggregate.
    named = distinct.join(parts.select(F.col("node").alias("fp"), "component"), "fp", "left")
    named = named.withColumn("component", F.coalesce("component", "fp"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    classes = materialize(named.join(least, "component").select("fp", "component_id"), "classes")
    out = fps.join(classes, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
    discard(distinct)
    return out
