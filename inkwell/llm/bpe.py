"""Byte-level BPE encoding and decoding with numpy merge rounds.

Texts split into pieces by the tokenizer's pattern.  Unseen pieces are put into
matrices by length, padded to a common width.  In each round every row finds
its leftmost pair of minimum rank by hashed lookup, merges it, and the row is
compacted; rows without a known pair leave the matrix.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.llm.common import small_batches

#: White space as the tokenizer's own regex engine defines it, which has no \x1c-\x1f.
WHITE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_NONE = np.int64(1) << 40
#: Cells of one merge matrix.
CELLS = 1 << 21
#: Bytes from which on a piece is merged by itself.
LONG = 1 << 11
#: Entries of each of a worker's caches, about 50 MB; a full cache starts anew.
CACHE = 250_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


def load_ranks(spark: SparkSession, path: str) -> dict[bytes, int]:
    """Read a rank file (a base64 token and its rank a line).  It is a vocabulary, so it is small."""
    lines = spark.read.text(path if "://" in path else f"file://{path}").collect()
    return {base64.b64decode(a): int(b) for a, b in (r.value.split() for r in lines if r.value)}


class Bpe:
    """A vocabulary, its pair table and the merge rounds."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.pattern = pattern
        size = max(ranks.values()) + 1
        self.token = [b""] * size
        for word, rank in ranks.items():
            self.token[rank] = word
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        # Two ids merge if their bytes together are a token; the token's rank is the merge's rank.
        pairs = {}
        for word, rank in ranks.items():
            for cut in range(1, len(word)):
                left, right = ranks.get(word[:cut]), ranks.get(word[cut:])
                if left is not None and right is not None:
                    pairs[left << 20 | right] = rank
        bits = max(4, len(pairs).bit_length() + 1)
        self.shift = np.uint64(64 - bits)
        keys, merged = np.full(1 << bits, -1, np.int64), np.full(1 << bits, _NONE, np.int64)
        # Open addressing, all keys at once: those that find their slot taken try the next one.
        left = np.fromiter(pairs, np.int64, len(pairs))
        rank, slot = np.fromiter(pairs.values(), np.int64, len(pairs)), self._slot(left)
        self.probes = 0
        while len(left):
            free = keys[slot] == -1
            keys[slot[free]] = left[free]
            placed = keys[slot] == left
            merged[slot[placed]] = rank[placed]
            left, rank, slot = left[~placed], rank[~placed], slot[~placed] + 1 & len(keys) - 1
            self.probes += 1
        self.keys, self.merged = keys, merged
        self.split = None
        self.chunks: dict[str, bytes] = {}
        self.firsts: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def __getstate__(self) -> dict:
        return {**self.__dict__, "split": None, "chunks": {}, "firsts": {}, "pieces": {}}

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * _MIX >> self.shift).astype(np.int64)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merge rank of each pair of ids, or _NONE; -1 is padding."""
        key = left << 20 | right
        rank, slot = np.full(len(key), _NONE), self._slot(key)
        open_ = np.flatnonzero(right >= 0)
        for _ in range(self.probes):
            found = self.keys[slot[open_]]
            hit = found == key[open_]
            rank[open_[hit]] = self.merged[slot[open_[hit]]]
            open_ = open_[~hit & (found != -1)]
            if not len(open_):
                break
            slot[open_] = slot[open_] + 1 & len(self.keys) - 1
        return rank

    def _merge(self, pieces: list[bytes], width: int) -> list[bytes]:
        """Encode pieces of at most `width` bytes; the ids of each as little-endian uint32."""
        n = len(pieces)
        ids = np.full((n, width), -1, np.int64)
        lengths = np.fromiter(map(len, pieces), np.int64, n)
        cell = np.arange(width) < lengths[:, None]
        ids[cell] = self.of_byte[np.frombuffer(b"".join(pieces), np.uint8)]
        out, row = [b""] * n, np.arange(n)
        rank = np.full((n, width), _NONE)
        if width > 1:
            rank[:, :-1] = self._ranks(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, width - 1)
        while len(row):
            at = rank.argmin(axis=1)  # the leftmost of the minima
            best = rank[np.arange(len(row)), at]
            done = best == _NONE
            if done.any():
                for r, x, k in zip(row[done], ids[done].astype("<u4"), lengths[done], strict=True):
                    out[r] = x[:k].tobytes()
                row, ids, rank, lengths, at, best = (x[~done] for x in (row, ids, rank, lengths, at, best))
                if not len(row):
                    break
                wide = int(lengths.max())
                ids, rank = ids[:, :wide], rank[:, :wide]
            each = np.arange(len(row))
            # Compact: what stands right of the merged pair moves one place to the left.
            column = np.arange(ids.shape[1])
            source = np.minimum(column + (column > at[:, None]), ids.shape[1] - 1)
            ids, rank = np.take_along_axis(ids, source, 1), np.take_along_axis(rank, source, 1)
            ids[each, at] = best
            lengths = lengths - 1
            column = column[:, None] >= lengths
            ids[column.T], rank[column.T] = -1, _NONE
            # Only the pairs around the merged id are new.
            after = np.where(at + 1 < ids.shape[1], ids[each, np.minimum(at + 1, ids.shape[1] - 1)], -1)
            rank[each, at] = self._ranks(best, after)
            has = at > 0
            rank[each[has], at[has] - 1] = self._ranks(ids[each[has], at[has] - 1], best[has])
        return out

    def _merge_long(self, piece: bytes) -> bytes:
        """Encode one long piece; a round takes all pairs that rounds of `_merge` would take in a row.

        These are the pairs of the minimum rank, of overlapping ones every second from the left, as
        long as no pair that comes up on the way has that rank or a smaller one.  Else it is one pair.
        """
        ids = self.of_byte[np.frombuffer(piece, np.uint8)].astype(np.int64)
        rank = np.append(self._ranks(ids[:-1], ids[1:]), _NONE)
        while (best := rank.min()) != _NONE:
            at = np.flatnonzero(rank == best)
            if len(at) > 1:
                opens = np.append(True, np.diff(at) > 1)
                at = at[(at - at[opens][np.cumsum(opens) - 1]) % 2 == 0]
                token = np.full(len(at), best)
                follows = np.append(False, np.diff(at) == 2)
                before = np.where(follows, best, ids[np.maximum(at - 1, 0)])
                after = np.where(at + 2 < len(ids), ids[np.minimum(at + 2, len(ids) - 1)], -1)
                left = np.where(at > 0, self._ranks(before, token), _NONE)
                if min(left.min(), self._ranks(token, after).min()) <= best:
                    at = at[:1]
            ids[at] = best
            stays = np.ones(len(ids), bool)
            stays[at + 1] = False
            ids, rank = ids[stays], rank[stays]
            at = at - np.arange(len(at))
            near = np.concatenate((at, at[at > 0] - 1))
            rank[near] = self._ranks(ids[near], np.where(near + 1 < len(ids), ids[np.minimum(near + 1, len(ids) - 1)], -1))
        return ids.astype("<u4").tobytes()

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece as little-endian uint32, by matrices of pieces of like length."""
        order = sorted(range(len(pieces)), key=lambda i: len(pieces[i]))
        out, at = [b""] * len(pieces), 0
        while at < len(order):
            low = len(pieces[order[at]])
            if low > LONG:
                out[order[at]] = self._merge_long(pieces[order[at]])
                at += 1
                continue
            end = at
            width = low
            while end < len(order) and (k := len(pieces[order[end]])) <= max(low + low // 4, 4) and (end - at + 1) * k <= max(CELLS, k):
                end, width = end + 1, k
            for i, x in zip(order[at:end], self._merge([pieces[i] for i in order[at:end]], max(width, 1)), strict=True):
                out[i] = x
            at = end
        return out

    def _learn(self, chunks: list[str], into: dict[str, bytes], prefix: str) -> None:
        """Encode unseen chunks into the cache `into`; `prefix` stands before each in its text."""
        if self.split is None:
            pattern = self.pattern.replace(r"[^\s", f"[^{WHITE}").replace(r"\s", f"[{WHITE}]").replace(r"\S", f"[^{WHITE}]")
            self.split = regex.compile(pattern)
        parts = [self.split.findall(prefix + c) for c in chunks]
        if len(self.pieces) > CACHE:
            self.pieces.clear()
        new = list({p for x in parts for p in x if p not in self.pieces})
        for p, x in zip(new, self.encode_pieces([p.encode() for p in new]), strict=True):
            self.pieces[p] = x
        get = self.pieces.__getitem__
        for c, x in zip(chunks, parts, strict=True):
            into[c] = b"".join(map(get, x))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian uint32.

        A piece begins wherever a single space stands before something other than white space, so
        texts may be cut there, and equal chunks have equal ids wherever they occur.
        """
        cut = []
        for t in texts:
            parts = t.split(" ")
            if any(not p or p[0].isspace() for p in parts[1:]):
                starts = [0, *(i for i, p in enumerate(parts) if i and p and not p[0].isspace()), len(parts)]
                parts = [" ".join(parts[a:b]) for a, b in zip(starts, starts[1:], strict=False)]
            cut.append(parts)
        for into, prefix, each in ((self.firsts, "", ((x[0],) for x in cut)), (self.chunks, " ", (x[1:] for x in cut))):
            if len(into) > CACHE:
                into.clear()
            new = set()
            for x in each:
                new.update(x)
            new = [c for c in new if c not in into]
            if new:
                self._learn(new, into, prefix)
        get = self.chunks.__getitem__
        return [b"".join([self.firsts[x[0]], *map(get, x[1:])]) for x in cut]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def bpe_round_trip(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for each row, and ids (binary) if asked for.

    The ids are those of byte-level BPE without special tokens; decoded_sha256 is of the bytes that
    the ids decode to.  A null text counts as empty: 0 tokens and the digest of no bytes.  Rows are
    encoded by themselves, so repeated rows and identifiers change nothing; other columns are
    ignored; an empty table gives an empty result.  A piece of over LONG bytes is
    a matrix by itself, and its rounds merge more than one pair where that comes to the same.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(Bpe(ranks, pattern))  # as large as the vocabulary
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = shared.value
        sha = hashlib.sha256
        for x in batches:
            ids = bpe.encode(["" if t is None else t for t in x["text"]])
            out = {
                "doc_id": x["doc_id"],
                "n_tokens": [len(i) // 4 for i in ids],
                "ids_sha256": [sha(i).hexdigest() for i in ids],
                "decoded_sha256": [sha(bpe.decode(i)).hexdigest() for i in ids],
            }
            yield pd.DataFrame(out | ({"ids": ids} if with_ids else {}))

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(rows, schema)
