"""A compressed FM-index over number sequences: suffix order, Burrows-Wheeler transform, wavelet matrix, and document
minima over suffix ranges. Searches run for many patterns at once, one numpy step per symbol."""

from __future__ import annotations

import numpy as np


def suffix_order(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, shared): suffixes by their first ``depth`` symbols at least, by prefix doubling, and how many symbols each
    shares with the one before it, as far as the order goes. Suffixes that agree so far keep the order of their
    positions, which is enough to search for patterns shorter than ``depth``."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    order, known = np.argsort(rank, kind="stable"), 1
    levels = [(1, rank.astype(np.int32))]
    while known < depth:
        second = np.zeros(n, dtype=np.int64)
        second[: max(n - known, 0)] = rank[known:] + 1
        key = rank * (n + 1) + second
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        steps = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
        rank = np.empty(n, dtype=np.int64)
        rank[order] = steps
        known *= 2
        levels.append((known, rank.astype(np.int32)))
        if n and steps[-1] == n - 1:
            break
    shared = np.zeros(n + 1, dtype=np.int64)
    a, b = order[:-1].copy(), order[1:].copy()
    for length, ranks in reversed(levels):
        inside = np.maximum(a, b) < n
        same = inside & (ranks[np.where(inside, a, 0)] == ranks[np.where(inside, b, 0)])
        shared[1:n][same] += length
        a[same] += length
        b[same] += length
    return order, shared


class RankedBits:
    """A bit vector with counts of ones before any position: one bit and a count per 64 bits."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, dtype=np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)[:-1]]).astype(np.int32)
        self.zeros = len(bits) - int(bits.sum())

    def ones(self, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & below)


class WaveletMatrix:
    """Counts of a symbol before a position, in one step per bit of the alphabet."""

    def __init__(self, symbols: np.ndarray, alphabet: int):
        self.levels = []
        self.bits = max(1, int(alphabet - 1).bit_length())
        for level in range(self.bits - 1, -1, -1):
            bits = (symbols >> level & 1).astype(np.uint8)
            self.levels.append(RankedBits(bits))
            symbols = np.concatenate([symbols[bits == 0], symbols[bits == 1]])

        every = np.arange(alphabet)
        self.block = self._path(every, np.zeros(alphabet, dtype=np.int64))

    def before(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each ``symbol`` occurs before each position."""
        return self._path(symbol, at) - self.block[symbol]

    def _path(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where a position ends up, going down the levels with a symbol's bits."""
        for level, bits in zip(range(self.bits - 1, -1, -1), self.levels):
            ones = bits.ones(at)
            at = np.where(symbol >> level & 1, bits.zeros + ones, at - ones)
        return at


class RangeMinimum:
    """Least value of any range, from minima of ranges of powers of two."""

    def __init__(self, values: np.ndarray):
        self.size = len(values)
        rows, width = [values], 1
        while 2 * width <= len(values):
            last = rows[-1]
            rows.append(np.minimum(last[:-width], last[width:]))
            width *= 2
        self.table = np.zeros((len(rows), len(values)), dtype=values.dtype)
        for row, own in zip(self.table, rows):
            row[: len(own)] = own

    def least(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        return np.minimum(self.table[level, low], self.table[level, high - (1 << level)])

    def reach(self, at: np.ndarray, bound: np.ndarray, step: int) -> np.ndarray:
        """How far from ``at``, going right (step 1) or left (-1), all values are at least ``bound``: the first position
        that is not."""
        at = at.copy()
        for level in range(len(self.table) - 1, -1, -1):
            width = 1 << level
            first = at if step > 0 else at - width + 1
            fits = (first >= 0) & (first + width <= self.size)
            fits &= self.table[level, np.where(fits, first, 0)] >= bound
            at += np.where(fits, step * width, 0)
        return at


class FMIndex:
    """``text`` holds symbols from 1, with 0 between documents; ``owner`` gives each position's document number.

    Patterns must be shorter than ``depth`` and free of 0.
    """

    def __init__(self, text: np.ndarray, owner: np.ndarray, depth: int):
        order, shared = suffix_order(text, depth)
        alphabet = int(text.max()) + 1 if len(text) else 1
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=alphabet))]).astype(np.int64)
        self.transform = WaveletMatrix(text[order - 1], alphabet)
        self.owners = RangeMinimum(owner[order])
        self.shared = RangeMinimum(np.minimum(shared, 255).astype(np.uint8))
        self.size = len(text)

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffix ranges of each pattern with ``symbol`` put before it."""
        n = len(symbol)
        both = self.transform.before(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
        return self.first[symbol] + both[:n], self.first[symbol] + both[n:]

    def shorten(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(length, low, high): each pattern cut from the right until it has a larger suffix range."""
        length = np.maximum(self.shared.table[0, low], self.shared.table[0, high])
        return length.astype(np.int64), self.shared.reach(low, length, -1), self.shared.reach(high, length, 1)


def matched_stretches(index: FMIndex, text: np.ndarray, start: np.ndarray, end: np.ndarray, owner: np.ndarray, least: int):
    """(sequence, first, end) of the longest stretches of at least ``least`` symbols that also occur in a document with
    a smaller number than the sequence's own, for the sequences text[start:end].

    Matching statistics by backward search: a match grows to the left while its suffix range holds a smaller document,
    and where it stops it is cut from the right until its range is larger. A symbol that no smaller document has is
    passed over. A sequence takes at most some two steps per symbol; all sequences step together.
    """
    at, length = end.copy(), np.zeros(len(start), dtype=np.int64)
    low, high = np.zeros(len(start), dtype=np.int64), np.full(len(start), index.size, dtype=np.int64)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def stretch(q: np.ndarray) -> None:
        q = q[length[q] >= least]
        found.append((q, at[q].copy(), at[q] + length[q]))

    going = np.flatnonzero(end - start >= least)
    while len(going):
        new_low, new_high = index.extend(text[at[going] - 1], low[going], high[going])
        match = new_high > new_low
        match[match] = index.owners.least(new_low[match], new_high[match]) < owner[going[match]]
        on, off = going[match], going[~match]
        at[on] -= 1
        length[on] += 1
        low[on], high[on] = new_low[match], new_high[match]
        stretch(on[at[on] == start[on]])
        # What is stopped was as long as it gets, unless it was cut just before: then it lies inside what was found.
        stretch(off)
        empty = off[length[off] == 0]
        at[empty] -= 1
        cut = off[length[off] > 0]
        length[cut], low[cut], high[cut] = index.shorten(low[cut], high[cut])
        low[cut[length[cut] == 0]], high[cut[length[cut] == 0]] = 0, index.size
        # No window is left once the match and all symbols before it are too few.
        going = going[(at[going] > start[going]) & (length[going] + at[going] - start[going] >= least)]
    none = np.empty(0, dtype=np.int64)
    return tuple(np.concatenate([none, *x]) for x in zip(*found)) if found else (none,) * 3
