"""A full-text index over whole numbers: Burrows-Wheeler transform, wavelet-tree ranks, sampled suffix positions."""

from __future__ import annotations

import numpy as np


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Start positions of all suffixes in sorted order, by doubling the compared length."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    order = np.argsort(rank, kind="stable")
    length = 1
    while True:
        second = np.zeros(n, np.int64)
        second[:max(n - length, 0)] = rank[length:] + 1
        key = rank * (n + 1) + second
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        new = np.empty(n, np.int64)
        new[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        rank, length = new, 2 * length
        if n == 0 or rank.max(initial=0) == n - 1 or length > n:
            return order


class WaveletTree:
    """Rank and access of symbols 0 .. 2^bits - 1, one bit row per level (the levels' zeros stand before their ones)."""

    def __init__(self, symbols: np.ndarray):
        self.bits = max(int(symbols.max(initial=0)).bit_length(), 1)
        self.ones, self.zeros = [], []
        row = symbols
        for level in range(self.bits - 1, -1, -1):
            bit = (row >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]).astype(np.int32))
            self.zeros.append(int(len(row) - bit.sum()))
            row = np.concatenate([row[bit == 0], row[bit == 1]])

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How often each symbol stands before its place."""
        begin, end = np.zeros_like(place), place
        for depth in range(self.bits):
            bit = (symbol >> (self.bits - 1 - depth)) & 1
            ones, zeros = self.ones[depth], self.zeros[depth]
            begin = np.where(bit, zeros + ones[begin], begin - ones[begin])
            end = np.where(bit, zeros + ones[end], end - ones[end])
        return end - begin

    def access(self, place: np.ndarray) -> np.ndarray:
        symbol = np.zeros_like(place)
        for depth in range(self.bits):
            ones, zeros = self.ones[depth], self.zeros[depth]
            bit = ones[place + 1] - ones[place]
            symbol = (symbol << 1) | bit
            place = np.where(bit, zeros + ones[place], place - ones[place])
        return symbol


class FMIndex:
    """Counts and finds phrases in a text of numbers >= 1; 0 may stand in the text as a divider."""

    def __init__(self, text: np.ndarray, sample: int = 8):
        # one smallest symbol closes the text; all others move up by one
        body = np.concatenate([text.astype(np.int64) + 1, [0]])
        order = suffix_order(body)
        last = body[order - 1]
        self.size, self.sample = len(body), sample
        self.tree = WaveletTree(last)
        self.below = np.concatenate([[0], np.cumsum(np.bincount(body, minlength=1 << self.tree.bits))])
        self.sampled = np.concatenate([[0], np.cumsum(order % sample == 0)]).astype(np.int64)
        self.positions = order[order % sample == 0]

    def ranges(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffixes that begin with each row of `phrases`, searched backward, all rows at once."""
        low = np.zeros(len(phrases), np.int64)
        high = np.full(len(phrases), self.size, np.int64)
        alive = np.arange(len(phrases))
        for column in phrases.T[::-1]:
            symbol = column[alive].astype(np.int64) + 1
            known = symbol < len(self.below) - 1
            high[alive[~known]] = low[alive[~known]]
            alive, symbol = alive[known], symbol[known]
            low[alive] = self.below[symbol] + self.tree.rank(symbol, low[alive])
            high[alive] = self.below[symbol] + self.tree.rank(symbol, high[alive])
            alive = alive[high[alive] > low[alive]]
        return low, np.maximum(high, low)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes: step back through the text to the nearest sampled one."""
        rows, steps = rows.astype(np.int64), np.zeros(len(rows), np.int64)
        found = np.empty(len(rows), np.int64)
        open_rows = np.arange(len(rows))
        while len(open_rows):
            at = rows[open_rows]
            hit = self.sampled[at + 1] > self.sampled[at]
            done = open_rows[hit]
            found[done] = self.positions[self.sampled[rows[done]]] + steps[done]
            open_rows = open_rows[~hit]
            at = rows[open_rows]
            symbol = self.tree.access(at)
            rows[open_rows] = self.below[symbol] + self.tree.rank(symbol, at)
            steps[open_rows] += 1
        return found

    def find(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(phrase, position) of every occurrence."""
        low, high = self.ranges(phrases)
        count = high - low
        which = np.repeat(np.arange(len(phrases)), count)
        rows = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        return which, self.locate(rows)
