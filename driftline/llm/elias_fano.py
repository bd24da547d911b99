"""Monotone sequences in Elias-Fano form over flat arrays, so that a mapped file is the structure itself."""

from __future__ import annotations

import numpy as np

_ONE = np.uint64(1)
#: One and the top bit in every byte of a word.
_EACH, _TOP = np.uint64(0x0101010101010101), np.uint64(0x8080808080808080)


def _places() -> np.ndarray:
    """Place of the r-th set bit of every byte, at 8 * byte + r."""
    bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
    return np.argsort(1 - bits, axis=1, kind="stable").astype(np.int64).ravel()


_IN_BYTE = _places()


def _select_in_word(x: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Place of the r-th (from 0) set bit of each word, which has more than r of them."""
    r = r.astype(np.uint64)
    s = x - ((x >> _ONE) & np.uint64(0x5555555555555555))
    s = (s & np.uint64(0x3333333333333333)) + ((s >> np.uint64(2)) & np.uint64(0x3333333333333333))
    # set bits up to and with each byte
    s = ((s + (s >> np.uint64(4))) & np.uint64(0x0F0F0F0F0F0F0F0F)) * _EACH
    full = np.bitwise_count((((r * _EACH) | _TOP) - s) & _TOP)
    shift = np.minimum(full, 7).astype(np.uint64) << np.uint64(3)
    before = ((s << np.uint64(8)) >> shift) & np.uint64(255)
    byte = (x >> shift) & np.uint64(255)
    return shift.astype(np.int64) + _IN_BYTE[((byte << np.uint64(3)) + ((r - before) & np.uint64(7))).astype(np.int64)]


def _next_in_word(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Place of the first set bit of each word after bit ``at`` (0 to 63), or 64."""
    x = x & ~((np.uint64(2) << at.astype(np.uint64)) - _ONE)
    return np.bitwise_count((x & (~x + _ONE)) - _ONE).astype(np.int64)


class EliasFano:
    """n values under a universe: about log2(universe / n) + 2 bits each, with access by place and successor search.

    A value's low bits are packed as they are. Its high part is unary: one bit per
    value, one zero per possible high part. ``ones`` counts the set bits before
    each word, for select.
    """

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.ones = n, low_bits, low, high, ones
        self.zeros = None

    @classmethod
    def build(cls, values: np.ndarray, universe: int) -> EliasFano:
        """From non-decreasing ``values`` (uint64) below ``universe``."""
        n = len(values)
        l = max(0, (int(universe) // max(n, 1)).bit_length() - 1)
        values = values.astype(np.uint64)
        parts = []
        for i in range(0, n, 1 << 15):
            v = values[i : i + (1 << 15)]
            parts.append(np.packbits(np.stack([(v >> np.uint64(b)) & _ONE for b in range(l)], axis=1).astype(np.uint8).ravel(), bitorder="little") if l else np.zeros(0, np.uint8))
        low = np.concatenate([*parts, np.zeros(16, np.uint8)])
        low = np.concatenate([low, np.zeros(-len(low) % 8, np.uint8)]).view(np.uint64)
        top = (values >> np.uint64(l)).astype(np.int64)
        bits = np.zeros((n + (int(top[-1]) if n else 0) + 2 + 63) // 64 * 64, dtype=np.uint8)
        bits[top + np.arange(n)] = 1
        high = np.packbits(bits, bitorder="little").view(np.uint64)
        return cls(n, l, low, high, np.concatenate([[0], np.cumsum(np.bitwise_count(high), dtype=np.int64)]).astype(np.uint32 if n < 1 << 32 else np.int64))

    def arrays(self) -> list[np.ndarray]:
        return [np.array([self.n, self.low_bits], dtype=np.int64), self.low, self.high, self.ones]

    @classmethod
    def of(cls, arrays: list[np.ndarray]) -> EliasFano:
        return cls(int(arrays[0][0]), int(arrays[0][1]), *arrays[1:4])

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), dtype=np.uint64)
        bit = i * self.low_bits
        word, shift = bit >> 6, (bit & 63).astype(np.uint64)
        got = self.low[word] >> shift
        over = shift > np.uint64(64 - self.low_bits)
        got = np.where(over, got | (self.low[word + 1] << (np.uint64(64) - np.where(over, shift, _ONE))), got)
        return got & np.uint64((1 << self.low_bits) - 1)

    def _one(self, i: np.ndarray) -> np.ndarray:
        """Where the high part has its i-th one."""
        word = np.searchsorted(self.ones, i.astype(self.ones.dtype), side="right") - 1
        return word * 64 + _select_in_word(self.high[word], i - self.ones[word])

    def access(self, i: np.ndarray) -> np.ndarray:
        """Values at places ``i`` (0 to n - 1)."""
        i = np.asarray(i, dtype=np.int64)
        return ((self._one(i) - i).astype(np.uint64) << np.uint64(self.low_bits)) | self._low(i)

    def range(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values at places ``i`` and ``i + 1`` (0 to n - 2)."""
        at = self._one(i)
        word = at >> 6
        after = word * 64 + _next_in_word(self.high[word], at & 63)
        far = np.flatnonzero(after == word * 64 + 64)
        after[far] = self._one(i[far] + 1)
        shift = np.uint64(self.low_bits)
        return ((at - i).astype(np.uint64) << shift) | self._low(i), ((after - i - 1).astype(np.uint64) << shift) | self._low(i + 1)

    def _zero(self, k: np.ndarray) -> np.ndarray:
        """Where the high part has its k-th zero; past its end, if it has fewer."""
        if self.zeros is None:
            self.zeros = np.arange(len(self.ones), dtype=np.int64) * 64 - self.ones
        known = k < self.zeros[-1]
        k = np.where(known, k, 0)
        word = np.minimum(np.searchsorted(self.zeros, k, side="right") - 1, len(self.high) - 1)
        return np.where(known, word * 64 + _select_in_word(~self.high[word], k - self.zeros[word]), len(self.high) * 64 + self.n + 1)

    def _bucket(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Range of the places whose values have the high part ``h``; n to n beyond the last."""
        # the zero before h's ones, and the first one after it, which ends them
        start = np.where(h > 0, self._zero(np.maximum(h - 1, 0)), -1)
        lo = np.where(h > 0, start - h + 1, 0)
        word = np.clip(start, 0, len(self.high) * 64 - 1) >> 6
        end = word * 64 + _next_in_word(~self.high[word], np.clip(start, 0, len(self.high) * 64 - 1) & 63)
        far = np.flatnonzero((end == word * 64 + 64) | (h == 0))
        end[far] = self._zero(h[far])
        return np.minimum(lo, self.n), np.minimum(end - h, self.n)

    def _search(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place of the first value >= x among those with x's high part, the end of those, and x's low part."""
        h = np.minimum(x >> np.uint64(self.low_bits), np.uint64(1 << 62)).astype(np.int64)
        lo, end = self._bucket(h)
        hi = end.copy()
        low = x & np.uint64((1 << self.low_bits) - 1)
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                return lo, end, low
            mid = (lo[open_] + hi[open_]) // 2
            less = self._low(mid) < low[open_]
            lo[open_] = np.where(less, mid + 1, lo[open_])
            hi[open_] = np.where(less, hi[open_], mid)

    def successor(self, x: np.ndarray) -> np.ndarray:
        """Place of the first value >= x (n if none)."""
        return self._search(np.asarray(x, dtype=np.uint64))[0]

    def find(self, x: np.ndarray) -> np.ndarray:
        """Place of each value equal to x, or -1."""
        at, end, low = self._search(np.asarray(x, dtype=np.uint64))
        some = np.flatnonzero(at < end)
        out = np.full(len(at), -1, dtype=np.int64)
        same = some[self._low(at[some]) == low[some]]
        out[same] = at[same]
        return out
