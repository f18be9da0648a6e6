"""FM-index over a sequence of word symbols, in numpy.

Symbols are 1..top; 0 separates stretches of the sequence that no phrase may
cross. Suffixes are ordered as if every separator were a letter of its own, so
the order is complete and no comparison looks past a separator. Counting goes
backwards through the phrase with ranks on a wavelet matrix of the transformed
sequence. Suffix positions are kept only for every SAMPLE-th symbol of a
stretch (its first included); other rows walk back to one of these.
"""

from __future__ import annotations

import numpy as np

SAMPLE = 16
_ONE = np.uint64(1)


class Bits:
    """Bit vector with constant-time rank: packed words and a running count."""

    def __init__(self, bits: np.ndarray):
        self.n = len(bits)
        packed = np.packbits(bits.astype(np.uint8), bitorder="little")
        self.words = np.zeros(self.n // 64 + 1, np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])[:-1].astype(np.int32)

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before position i."""
        w = i >> 6
        low = (_ONE << (i & 63).astype(np.uint64)) - _ONE
        return self.before[w] + np.bitwise_count(self.words[w] & low).astype(np.int64)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64) & _ONE).astype(np.int64)


class Wavelet:
    """Wavelet matrix: ranks of, and access to, symbols below ``2**levels``."""

    def __init__(self, symbols: np.ndarray, top: int):
        self.levels, self.zeros = [], []
        self.shifts = range(max(1, int(top).bit_length()) - 1, -1, -1)
        s = symbols
        for shift in self.shifts:
            b = (s >> shift & 1).astype(bool)
            self.levels.append(Bits(b))
            self.zeros.append(int(len(b) - b.sum()))
            s = np.concatenate([s[~b], s[b]])
        self.start = self._down(np.arange(top + 1), np.zeros(top + 1, np.int64))

    def _down(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for shift, level, zeros in zip(self.shifts, self.levels, self.zeros):
            ones = level.rank(i)
            i = np.where(c >> shift & 1, zeros + ones, i - ones)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of c before position i."""
        return self._down(c, i) - self.start[c]

    def access(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at i, and its occurrences before i."""
        c = np.zeros(len(i), np.int64)
        for level, zeros in zip(self.levels, self.zeros):
            b, ones = level.get(i), level.rank(i)
            c = c << 1 | b
            i = np.where(b, zeros + ones, i - ones)
        return c, i - self.start[c]


def suffix_order(text: np.ndarray, top: int) -> np.ndarray:
    """Positions in the order of their suffixes; separators are distinct, in order of position. The last symbol is one."""
    n = len(text)
    width = max(1, int(top).bit_length())
    packed = max(1, 62 // width)
    sep = text == 0
    key, alive, padded = np.zeros(n, np.int64), np.ones(n, bool), np.concatenate([text, np.zeros(packed, text.dtype)])
    for k in range(packed):  # the first symbols up to the first separator
        s = padded[k : k + n]
        alive &= s != 0
        key = key << width | np.where(alive, s, 0)
    order = np.argsort(key, kind="stable")
    k = key[order]
    head = np.concatenate([[True], k[1:] != k[:-1]])
    place = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = place
    where = np.flatnonzero(sep)  # separators come first, each with a rank of its own
    order[: len(where)], rank[where] = where, np.arange(len(where))
    head[: len(where)] = True
    following = np.minimum.accumulate(np.where(sep, np.arange(n), n)[::-1])[::-1]
    depth = packed
    open_ = ~head | np.concatenate([~head[1:], [False]])
    while open_.any():
        rows = np.flatnonzero(open_)
        at = order[rows]
        # Suffixes tied so far agree on ``depth`` symbols, or up to the same distance of a separator.
        second = rank[np.minimum(following[at], at + depth)]
        by = np.lexsort((second, rank[at]))
        at, second = at[by], second[by]
        first = rank[at]
        order[rows] = at
        new = np.concatenate([[True], (first[1:] != first[:-1]) | (second[1:] != second[:-1])])
        value = rows[np.maximum.accumulate(np.where(new, np.arange(len(rows)), 0))]
        rank[at] = value
        same_next = np.concatenate([~new[1:], [False]])
        open_ = np.zeros(n, bool)
        open_[rows[~new | same_next]] = True
        depth *= 2
    return order


class FMIndex:
    def __init__(self, text: np.ndarray, top: int):
        """``text``: int64 symbols 0..top; a last separator is added where it lacks."""
        if not len(text) or text[-1] != 0:
            text = np.concatenate([text, np.zeros(1, np.int64)])
        self.n, self.top = len(text), top
        order = suffix_order(text, top)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=top + 1))])
        self.wavelet = Wavelet(text[order - 1], top)  # before position 0 comes the last separator, which no phrase has
        sep = np.flatnonzero(text == 0)
        began = np.zeros(self.n, np.int64)
        began[sep[sep + 1 < self.n] + 1] = sep[sep + 1 < self.n] + 1
        offset = np.arange(self.n) - np.maximum.accumulate(began)
        kept = (offset % SAMPLE == 0)[order]
        self.marked, self.positions = Bits(kept), order[kept]

    def find(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [from, to) of each phrase; phrases are rows of symbols, padded with 0 on the right. Phrases with a symbol above ``top`` do not occur."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        alive = np.arange(len(phrases))
        for column in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[alive, column]
            use = c != 0
            a, c = alive[use], c[use]
            low[a] = self.first[c] + self.wavelet.rank(c, low[a])
            high[a] = self.first[c] + self.wavelet.rank(c, high[a])
            alive = alive[low[alive] < high[alive]]
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows."""
        out, steps = np.empty(len(rows), np.int64), 0
        left, rows = np.arange(len(rows)), rows.astype(np.int64)
        while len(left):
            here = self.marked.get(rows).astype(bool)
            out[left[here]] = self.positions[self.marked.rank(rows[here])] + steps
            left, rows = left[~here], rows[~here]
            if len(left):
                c, before = self.wavelet.access(rows)
                rows = self.first[c] + before
            steps += 1
        return out
