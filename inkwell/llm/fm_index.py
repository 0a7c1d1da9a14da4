"""A compressed full-text index over word sequences: suffix order, Burrows-Wheeler transform, wavelet tree.

The wavelet tree has the shape of the transform's Huffman code, so it takes about its entropy of
order zero, plus a count for each 64 bits.  All searches of a call advance together, a symbol at a
time, as numpy arrays.
"""

from __future__ import annotations

import numpy as np

from inkwell.llm.quality import suffix_ranks

_ONE = np.uint64(1)


def code_lengths(counts: np.ndarray) -> np.ndarray:
    """Bits of each symbol's Huffman code; a symbol alone gets one bit.  Sums of two nodes rise, so a queue holds them."""
    n = len(counts)
    if n == 1:
        return np.ones(1, np.int64)
    order = np.argsort(counts, kind="stable")
    weight, above = counts[order].tolist(), [0] * (2 * n - 1)
    leaf, inner = 0, n
    for new in range(n, 2 * n - 1):
        total = 0
        for _ in range(2):
            if leaf < n and (inner >= new or weight[leaf] <= weight[inner]):
                child, leaf = leaf, leaf + 1
            else:
                child, inner = inner, inner + 1
            above[child] = new
            total += weight[child]
        weight.append(total)
    depth = [0] * (2 * n - 1)
    for k in range(2 * n - 3, -1, -1):  # a node's number is above those of its children
        depth[k] = depth[above[k]] + 1
    out = np.empty(n, np.int64)
    out[order] = depth[:n]
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes of these lengths, in the order of length and symbol."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    of_length = np.bincount(lengths)
    first = np.zeros(len(of_length), np.int64)
    for k in range(1, len(first)):
        first[k] = (first[k - 1] + of_length[k - 1]) << 1
    codes = np.empty(len(lengths), np.int64)
    sorted_lengths = lengths[order]
    codes[order] = first[sorted_lengths] + np.arange(len(lengths)) - (np.cumsum(of_length) - of_length)[sorted_lengths]
    return codes


class WaveletTree:
    """rank(symbols, places): how often each symbol stands before each place."""

    def __init__(self, items: np.ndarray, n_symbols: int) -> None:
        counts = np.bincount(items, minlength=n_symbols)
        there = np.flatnonzero(counts)
        self.bits_of = np.zeros(n_symbols, np.int64)
        self.bits_of[there] = code_lengths(counts[there])
        codes = np.zeros(n_symbols, np.int64)
        codes[there] = canonical(self.bits_of[there])
        # The path of a symbol: for each bit of its code, where the node's bits begin, and the bit.
        self.path = np.cumsum(self.bits_of) - self.bits_of
        self.begin = np.zeros(int(self.bits_of.sum()), np.int64)
        self.turn = np.zeros(len(self.begin), bool)
        levels, base, depth, now = [], 0, 0, items
        starts = np.zeros(1, np.int64)
        while len(now):
            bits = (codes[now] >> (self.bits_of[now] - depth - 1)) & 1
            sizes = np.diff(np.append(starts, len(now)))
            ones = np.append(0, np.cumsum(bits))
            node_ones = ones[starts + sizes] - ones[starts]
            from_start = ones[:-1] - np.repeat(ones[starts], sizes)
            first = np.repeat(starts, sizes)
            to = np.where(bits == 1, np.repeat(starts + sizes - node_ones, sizes) + from_start, np.arange(len(now)) - from_start)
            self.begin[self.path[now] + depth] = base + first
            self.turn[self.path[now] + depth] = bits == 1
            levels.append(bits.astype(bool))
            base += len(now)
            after = np.empty_like(now)
            after[to] = now
            # Children of nodes that hold more than one symbol go on; a code that ends leaves.
            edges = np.zeros(len(now), bool)
            edges[starts] = True
            middle = starts + sizes - node_ones
            edges[middle[node_ones > 0]] = True
            goes_on = self.bits_of[after] > depth + 1
            node = np.cumsum(edges)[goes_on]
            now = after[goes_on]
            starts = np.flatnonzero(np.append(True, node[1:] != node[:-1])) if len(now) else starts
            depth += 1
        flat = np.concatenate([*levels, np.zeros(64 + -base % 64, bool)])
        self.words = np.packbits(flat, bitorder="little").view(np.uint64)
        self.before = np.append(0, np.cumsum(np.bitwise_count(self.words))).astype(np.int64)
        self.begin_ones = self._ones(self.begin)

    def _ones(self, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        below = (_ONE << (at & 63).astype(np.uint64)) - _ONE
        return self.before[word] + np.bitwise_count(self.words[word] & below)

    def rank(self, symbols: np.ndarray, places: np.ndarray) -> np.ndarray:
        """`places` has two rows, the two ends of each symbol's interval."""
        bits, path, depth = self.bits_of[symbols], self.path[symbols], 0
        # By falling length of code: those that go on are the first ones.
        order = np.argsort(-bits, kind="stable")
        bits, path, here = bits[order], path[order], places[:, order]
        going = len(bits)
        while going:
            at = path[:going] + depth
            part = here[:, :going]
            found = self._ones(self.begin[at] + part) - self.begin_ones[at]
            here[:, :going] = np.where(self.turn[at], found, part - found)
            depth += 1
            going = int(np.searchsorted(-bits, -depth, side="left"))
        out = np.empty_like(here)
        out[:, order] = here
        return out


class FMIndex:
    """Index over sequences of whole numbers of at least 1; zeros end sequences and match nothing.

    `symbols` has the sequences with a zero after each, `weights` a weight for each place of it.
    """

    def __init__(self, symbols: np.ndarray, weights: np.ndarray) -> None:
        self.symbols = symbols
        n, ends = len(symbols), symbols == 0
        n_symbols = int(symbols.max(initial=0)) + 1
        counts = np.bincount(symbols, minlength=n_symbols)
        # Each end is a symbol of its own, below all others, so that all suffixes differ.
        first = np.where(ends, np.cumsum(ends) - 1, symbols + counts[0] - 1)
        order = np.empty(n, np.int64)
        order[suffix_ranks(first)[-1]] = np.arange(n)
        self.tree = WaveletTree(symbols[order - 1], n_symbols)
        self.first = np.append(0, np.cumsum(counts))
        self.weight = np.append(0, np.cumsum(weights[order]))

    def matched(self, last: np.ndarray, most: np.ndarray, least_weight: int) -> np.ndarray:
        """Backward search from each place `last`: how many symbols up to it, `most` at most, occur together with a weight of `least_weight` or more."""
        length = np.zeros(len(last), np.int64)
        places = np.zeros((2, len(last)), np.int64)
        places[1] = len(self.symbols)
        going = np.flatnonzero(most > 0)
        while len(going):
            symbol = self.symbols[last[going] - length[going]]
            going, symbol = going[symbol > 0], symbol[symbol > 0]
            wider = self.tree.rank(symbol, places[:, going]) + self.first[symbol]
            found = self.weight[wider[1]] - self.weight[wider[0]] >= least_weight
            going = going[found]
            places[:, going] = wider[:, found]
            length[going] += 1
            going = going[length[going] < most[going]]
        return length
