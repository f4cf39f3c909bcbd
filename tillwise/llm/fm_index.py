"""An FM-index over whole numbers: search backwards, count and locate, many phrases at once."""

from __future__ import annotations

import numpy as np


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Suffix array by doubling. 0 separates runs; each 0 differs from all others."""
    n = len(symbols)
    ends = symbols == 0
    n_ends = int(ends.sum())
    rank = np.where(ends, np.cumsum(ends) - 1, symbols.astype(np.int64) + n_ends)
    step = 1
    while True:
        after = np.zeros(n, np.int64)
        after[: n - step] = rank[step:] + 1
        key = rank * (int(rank.max()) + 2 + n) + after
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        fresh = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = fresh
        step *= 2
        if fresh[-1] == n - 1 or step >= n:
            return order


class WaveletTree:
    """Counts of a symbol before a place. One bit vector per level, zeros before ones."""

    def __init__(self, symbols: np.ndarray, n_bits: int):
        self.n_bits, self.ones, self.zeros = n_bits, [], []
        current = symbols.astype(np.int64)
        for level in range(n_bits - 1, -1, -1):
            bits = (current >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bits)]).astype(np.int32))
            self.zeros.append(len(bits) - int(bits.sum()))
            current = np.concatenate([current[bits == 0], current[bits == 1]])

    def rank(self, symbols: np.ndarray, places: np.ndarray) -> np.ndarray:
        start, end = np.zeros_like(places), places
        for k, level in enumerate(range(self.n_bits - 1, -1, -1)):
            ones, bit = self.ones[k], ((symbols >> level) & 1) == 1
            ones_start, ones_end = ones[start], ones[end]
            start = np.where(bit, self.zeros[k] + ones_start, start - ones_start)
            end = np.where(bit, self.zeros[k] + ones_end, end - ones_end)
        return end - start


class FmIndex:
    """Over ``symbols``: runs of numbers from 1, each run closed by a 0."""

    def __init__(self, symbols: np.ndarray, n_symbols: int, sample: int = 16):
        order = suffix_order(symbols)
        self.last = symbols[order - 1].astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=n_symbols))])
        self.tree = WaveletTree(self.last, max(1, int(n_symbols - 1).bit_length()))
        # Starts of runs are kept too, so that no walk has to cross a separator.
        self.kept = (order % sample == 0) | (self.last == 0)
        self.kept_rank = np.cumsum(self.kept) - 1
        self.kept_place = order[self.kept]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix rows [low, high) of each phrase; ``phrases`` has one per row."""
        low = self.first[phrases[:, -1]]
        high = self.first[phrases[:, -1] + 1]
        alive = np.flatnonzero(low < high)
        for k in range(phrases.shape[1] - 2, -1, -1):
            if not len(alive):
                break
            symbol = phrases[alive, k]
            both = self.tree.rank(
                np.concatenate([symbol, symbol]), np.concatenate([low[alive], high[alive]])
            )
            low[alive] = self.first[symbol] + both[: len(alive)]
            high[alive] = self.first[symbol] + both[len(alive) :]
            alive = alive[low[alive] < high[alive]]
        gone = np.ones(len(phrases), bool)
        gone[alive] = False
        high[gone] = low[gone]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text places of suffix rows: walk back to a sampled one and add the steps."""
        rows, places = rows.copy(), np.zeros(len(rows), np.int64)
        steps, open_ = 0, np.arange(len(rows))
        while len(open_):
            at = rows[open_]
            found = self.kept[at]
            places[open_[found]] = self.kept_place[self.kept_rank[at[found]]] + steps
            open_, at = open_[~found], at[~found]
            symbol = self.last[at]
            rows[open_] = self.first[symbol] + self.tree.rank(symbol, at)
            steps += 1
        return places
