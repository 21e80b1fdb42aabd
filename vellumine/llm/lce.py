"""Longest common extensions in integer words from a difference cover.

Every two positions reach, at one distance below COVER, two positions whose residues are in
RESIDUES. So only the suffixes at such positions are sorted: by blocks of COVER words, doubled
until all ranks differ. An extension compares fewer than COVER words to reach sampled
suffixes, asks a sparse table for the least of the common prefixes between their ranks, in
blocks, and compares fewer than COVER words behind them.
"""

from __future__ import annotations

import numpy as np

#: A perfect difference set: every residue but zero is one difference of two of these.
COVER, RESIDUES = 13, (0, 1, 3, 9)


def _meeting() -> np.ndarray:
    """meeting[x, y]: the least d so that x + d and y + d both have residues of the set."""
    table = np.empty((COVER, COVER), np.int64)
    for x in range(COVER):
        for y in range(COVER):
            table[x, y] = next(d for d in range(COVER) if {(x + d) % COVER, (y + d) % COVER} <= set(RESIDUES))
    return table


_MEETING = _meeting()


def _paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dense ranks of the pairs (a, b), in their order."""
    return np.unique(a * (int(b.max(initial=0)) + 1) + b, return_inverse=True)[1]


class Extensions:
    """Common extensions in `words`, a text of non-negative numbers.

    The text must hold no two equal suffixes' parts up to its end: callers close it, and each
    document in it, with numbers that occur once.
    """

    def __init__(self, words: np.ndarray):
        self.n = n = len(words)
        # behind the end come numbers that occur once, so every comparison ends
        top = int(words.max(initial=0)) + 1
        self.words = np.concatenate([words.astype(np.int64), top + np.arange(3 * COVER)])
        blocks = -(-n // COVER) + 1
        at = (np.arange(blocks)[:, None] * COVER + np.array(RESIDUES)).ravel()
        self.slot = np.full(blocks * COVER, -1, np.int64)  # position -> number of the sample
        self.slot[at] = np.arange(len(at))
        self._sort(at)

    def _sort(self, at: np.ndarray) -> None:
        rank = np.zeros(len(at), np.int64)
        for k in range(COVER):
            rank = _paired(rank, self.words[np.minimum(at + k, len(self.words) - 1)])
        # the sample one block on is len(RESIDUES) slots on
        m, step, levels = len(at), len(RESIDUES), [rank]
        while rank.max(initial=-1) + 1 < m:
            after = np.zeros(m, np.int64)
            after[: m - step] = rank[step:] + 1
            rank = _paired(rank, after)
            levels.append(rank)
            step *= 2
        self.rank = rank
        order = np.empty(m, np.int64)
        order[rank] = np.arange(m)
        common = self._common_blocks(order[:-1], order[1:], levels)
        self.least = [common]
        width = 1
        while 2 * width <= len(common):
            last = self.least[-1]
            self.least.append(np.minimum(last[:-width], last[width:]))
            width *= 2

    @staticmethod
    def _common_blocks(a: np.ndarray, b: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
        """Common blocks of the sampled suffixes a and b, from the ranks of 1, 2, 4 ... blocks."""
        m, found = len(levels[0]), np.zeros(len(a), np.int64)
        for k in range(len(levels) - 1, -1, -1):
            x, y = a + found * len(RESIDUES), b + found * len(RESIDUES)
            inside = (x < m) & (y < m)
            x, y = np.minimum(x, m - 1), np.minimum(y, m - 1)
            found += np.where(inside & (levels[k][x] == levels[k][y]), 1 << k, 0)
        return found.astype(np.int32)

    def _blocks(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Common blocks of the suffixes at sampled positions i != j."""
        a, b = self.rank[self.slot[i]], self.rank[self.slot[j]]
        low, high = np.minimum(a, b), np.maximum(a, b)
        level = np.frexp((high - low).astype(float))[1] - 1
        out = np.empty(len(i), np.int64)
        for k in np.unique(level).tolist():
            at = level == k
            t = self.least[k]
            out[at] = np.minimum(t[low[at]], t[high[at] - (1 << k)])
        return out

    def _compared(self, i: np.ndarray, j: np.ndarray, most: np.ndarray | int) -> np.ndarray:
        """Common words from i and j on, found by comparing at most `most` of them."""
        out = np.zeros(len(i), np.int64)
        most = np.broadcast_to(np.asarray(most), i.shape)
        open_ = np.arange(len(i))
        for k in range(COVER):
            open_ = open_[k < most[open_]]
            open_ = open_[self.words[i[open_] + k] == self.words[j[open_] + k]]
            if not len(open_):
                break
            out[open_] += 1
        return out

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Number of common words of the text from i on and from j on (i != j, both in 0 .. n)."""
        to = _MEETING[i % COVER, j % COVER]
        out = self._compared(i, j, to)
        far = np.flatnonzero(out == to)
        if len(far):
            x, y = i[far] + to[far], j[far] + to[far]
            inside = np.maximum(x, y) < self.n
            far, x, y = far[inside], x[inside], y[inside]
            words = self._blocks(x, y) * COVER
            out[far] += words + self._compared(x + words, y + words, COVER)
        return out
