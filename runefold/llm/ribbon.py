"""Ribbon filters: approximate sets from banded linear systems over GF(2).

A key gives a start row and a 64-bit coefficient word (lowest bit set); its
fingerprint must equal the XOR of the solution words at start + i over the set
bits i. The keys of a sealed batch are spread over blocks of equal height. All
blocks are eliminated together in rounds (any order of insertions gives a
solution of the same system) and solved together by back substitution, so the
work is in numpy whatever the number of keys. The solution is kept bit by bit
(plane j holds bit j of every row), so a probe takes the window of 64 rows of one
plane, and most absent keys are told apart after a few planes.

A key of the batch is always found. An absent key is found with probability
2**-bits; memory is ``bits`` times about 1.1 to 1.2 per key.
"""

from __future__ import annotations

import numpy as np

WIDTH = 64
_ONE = np.uint64(1)


def mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser (multiply, xor-shift), seeded."""
    x = x.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x1234567) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _trailing_zeros(c: np.ndarray) -> np.ndarray:
    low = c & (~c + _ONE)
    return np.log2(low.astype(np.float64)).astype(np.uint64)  # powers of two are exact


class Ribbon:
    """Filter over 64-bit key hashes. Build it once from a sealed batch of distinct hashes."""

    def __init__(self, hashes: np.ndarray, bits: int = 32, block_keys: int = 2048, overhead: float = 1.08):
        if not 1 <= bits <= 32:
            raise ValueError("bits must be between 1 and 32")
        hashes = np.unique(np.asarray(hashes).view(np.uint64) if len(hashes) else np.zeros(0, np.uint64))
        self.bits, self.n = bits, len(hashes)
        self.blocks = max(1, round(len(hashes) / block_keys))
        for attempt in range(64):
            self.seed = 1 + attempt
            biggest = int(np.bincount(self._block(hashes), minlength=self.blocks).max(initial=0))
            self.rows = int(biggest * (overhead + 0.02 * attempt)) + WIDTH
            if self._solve(hashes):
                return
        raise RuntimeError("no solvable system was found")

    def _block(self, h: np.ndarray) -> np.ndarray:
        return ((mix(h, self.seed) >> np.uint64(32)) * np.uint64(self.blocks) >> np.uint64(32)).astype(np.int64)

    def _equation(self, h: np.ndarray):
        a, b, c = (mix(h, self.seed + 100 * k) for k in (1, 2, 3))
        start = ((a >> np.uint64(32)) * np.uint64(self.rows - WIDTH + 1) >> np.uint64(32)).astype(np.int64)
        return self._block(h) * self.rows + start, b | _ONE, (c & np.uint64((1 << self.bits) - 1)).astype(np.uint32)

    def _solve(self, h: np.ndarray) -> bool:
        at, c, r = self._equation(h)
        size = self.blocks * self.rows
        coeff, right = np.zeros(size, np.uint64), np.zeros(size, np.uint32)
        while len(at):
            free = coeff[at] == 0
            place, first = np.unique(at[free], return_index=True)
            mine = np.flatnonzero(free)[first]
            coeff[place], right[place] = c[mine], r[mine]
            rest = np.ones(len(at), bool)
            rest[mine] = False
            at, c, r = at[rest], c[rest], r[rest]
            c, r = c ^ coeff[at], r ^ right[at]
            empty = c == 0
            if (r[empty] != 0).any():
                return False  # contradiction: another seed
            at, c, r = at[~empty], c[~empty], r[~empty]
            if len(at):
                z = _trailing_zeros(c)
                at, c = at + z.astype(np.int64), c >> z
        coeff, right = coeff.reshape(self.blocks, self.rows), right.reshape(self.blocks, self.rows)
        out = np.zeros((self.blocks, self.rows + WIDTH), np.uint32)
        shifts = np.arange(1, WIDTH, dtype=np.uint64)
        for i in range(self.rows - 1, -1, -1):
            on = (coeff[:, i, None] >> shifts & _ONE).astype(np.uint32)
            out[:, i] = right[:, i] ^ np.bitwise_xor.reduce(out[:, i + 1 : i + WIDTH] * on, axis=1)
        solution = np.ascontiguousarray(out[:, : self.rows]).reshape(-1)
        self.planes = np.zeros((self.bits, size // 64 + 2), np.uint64)
        packed = np.packbits((solution[None, :] >> np.arange(self.bits, dtype=np.uint32)[:, None] & np.uint32(1)).astype(np.uint8), axis=1, bitorder="little")
        self.planes.view(np.uint8)[:, : packed.shape[1]] = packed
        return True

    def contains(self, hashes: np.ndarray) -> np.ndarray:
        h = np.asarray(hashes).view(np.uint64)
        found = np.zeros(len(h), bool)
        if not self.n:
            return found
        for i in range(0, len(h), 1 << 16):
            at, c, r = self._equation(h[i : i + (1 << 16)])
            alive, word, shift = np.arange(i, i + len(at)), at >> 6, (at & 63).astype(np.uint64)
            for j in range(self.bits):
                window = self.planes[j, word] >> shift | self.planes[j, word + 1] << _ONE << (np.uint64(63) - shift)
                same = (np.bitwise_count(window & c) & 1).astype(bool) == (r >> np.uint32(j) & np.uint32(1)).astype(bool)
                if not same.all():
                    alive, word, shift, c, r = alive[same], word[same], shift[same], c[same], r[same]
            found[alive] = True
        return found

    @property
    def nbytes(self) -> int:
        """Bytes that the solution takes in memory."""
        return self.planes.nbytes
