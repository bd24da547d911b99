"""Vectorised words and word hashes over batches of whole texts (numpy on bytes, no loop over words).

Words are maximal runs of bytes outside a separator class. A word's hash is a
polynomial over its bytes modulo 2**64, taken from prefix sums, then mixed; equal
words have equal hashes anywhere, which is all that joins and counts need.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Bytes hashed at once; a batch is cut at separators.
BLOCK = 1 << 19

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Separators of ``[^\x20\x09-\x0D]+``.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Separators of loose words: everything in ASCII but letters and digits.
LOOSE = np.zeros(256, dtype=bool)
LOOSE[:128] = True
for _c in b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789":
    LOOSE[_c] = False

_powers: dict[int, np.ndarray] = {}


def _geometric(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, BLOCK + 4096)
        seq = np.full(size, np.uint64(base), dtype=np.uint64)
        seq[0] = 1
        have = np.multiply.accumulate(seq)
        if size <= 2 * BLOCK:
            _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Words:
    """Words of a batch: ``hash[offset[d]:offset[d+1]]`` are those of text d, at bytes ``start`` to ``end`` of ``raw``."""

    __slots__ = ("end", "hash", "offset", "raw", "start", "text_start")

    def __init__(self, texts: Sequence[str | None], separators: np.ndarray = SPACE, lower: bool = True):
        blobs = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        sizes = np.fromiter((len(b) + 1 for b in blobs), dtype=np.int64, count=len(blobs))
        self.text_start = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.raw = np.frombuffer(b" ".join(blobs) + b" ", dtype=np.uint8) if blobs else np.zeros(0, np.uint8)
        sep = separators[self.raw]
        word = np.concatenate([[False], ~sep]).astype(np.int8)
        step = np.diff(word)
        self.start, self.end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        self.offset = np.searchsorted(self.start, self.text_start)
        self.hash = self._hashes(_LOWER[self.raw] if lower else self.raw)

    def _hashes(self, data: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.start), dtype=np.uint64)
        i = 0
        while i < len(out):
            j = max(i + 1, int(np.searchsorted(self.end, self.start[i] + BLOCK, side="right")))
            lo, hi = int(self.start[i]), int(self.end[j - 1])
            sums = np.zeros(hi - lo + 1, dtype=np.uint64)
            np.cumsum((data[lo:hi].astype(np.uint64) + np.uint64(1)) * _geometric(_BASE, hi - lo), out=sums[1:])
            s, e = self.start[i:j] - lo, self.end[i:j] - lo
            out[i:j] = mix((sums[e] - sums[s]) * _geometric(_INVERSE, hi - lo)[s] + (e - s).astype(np.uint64))
            i = j
        return out

    @property
    def doc(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.offset) - 1), np.diff(self.offset))


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` consecutive words, whatever text they lie in; empty if there are fewer words."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    total = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        total += hashes[j : j + n] * np.uint64(pow(_BASE, 2 * j + 3, 1 << 64))
    return mix(total)


def by_bytes(texts: Sequence[str | None], limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` characters in all, one text at least: bounds a worker's memory."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end] or "") <= limit):
            size += len(texts[end] or "")
            end += 1
        yield at, end
        at = end
