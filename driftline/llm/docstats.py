"""Statistics of whole documents, vectorised over batches."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

from .words import SPACE, Words, mix, shingles

#: Characters counted as symbols.
SYMBOLS = "#*$%&|<>"
WINDOW = 8

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in SYMBOLS]] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True
_ALPHA = np.zeros(256, dtype=bool)
_ALPHA[65:91] = _ALPHA[97:123] = _ALPHA[128:] = True
_MARK = np.zeros(256, dtype=bool)
_MARK[33:127] = True
_MARK &= ~(_ALPHA | _DIGIT | _SYMBOL)
_FULL_STOP = np.zeros(256, dtype=bool)
_FULL_STOP[[ord("."), ord("!"), ord("?")]] = True

#: Exact counts, in the order of ``statistics``.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: What a model sees: name, and +1 / -1 where a larger value may only speak for / against quality, 0 where it is free.
FEATURES = (
    ("log_words", 0), ("mean_word", 0), ("longest_word", -1), ("symbol_share", -1), ("dup_line_share", -1), ("repeat_share", -1), ("upper_share", -1),
    ("digit_share", 0), ("mark_share", 0), ("shout_share", -1), ("high_byte_share", 0), ("distinct_share", 0), ("words_a_line", 0), ("stops_a_word", 0),
)


def _per_text(flags: np.ndarray, edges: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[edges[1:]] - total[edges[:-1]]


def repeated(hashes: np.ndarray, offset: np.ndarray, width: int) -> np.ndarray:
    """Which words lie in a window of ``width`` words that its own text holds at least twice."""
    covered = np.zeros(len(hashes), dtype=bool)
    windows = shingles(hashes, width)
    if not len(windows):
        return covered
    doc = np.repeat(np.arange(len(offset) - 1), np.diff(offset))
    inside = np.flatnonzero(doc[: len(windows)] == doc[width - 1 :])
    keys = mix(windows[inside] + doc[inside].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    twice = np.zeros(len(keys), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(hashes) + 1, dtype=np.int64)
    np.add.at(edge, inside[twice], 1)
    np.add.at(edge, inside[twice] + width, -1)
    return np.cumsum(edge[:-1]) > 0


def dup_lines(text: str) -> tuple[int, int]:
    """Lines with a word that equal an earlier line, and all lines with a word."""
    lines = [x for x in text.split("\n") if x.strip(" \t\n\v\f\r")]
    return len(lines) - len(set(lines)), len(lines)


def statistics(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(n x 5 counts of COUNTS, n x k features of FEATURES) of the texts; a null text is empty."""
    w = Words(texts, SPACE, lower=False)
    raw, at, off = w.raw, w.text_start, w.offset
    n = np.diff(off)
    lead = (raw & 0xC0) != 0x80
    chars = _per_text(lead & ~SPACE[raw], at)
    symbols = _per_text(_SYMBOL[raw], at)
    pairs = np.array([dup_lines(t or "") for t in texts], dtype=np.int64).reshape(-1, 2)
    again = _per_text(repeated(w.hash, off, WINDOW), off)
    counts = np.stack([n, chars, symbols, pairs[:, 0], again], axis=1)
    size = np.maximum(_per_text(~SPACE[raw], at), 1)
    words, lines = np.maximum(n, 1), np.maximum(pairs[:, 1], 1)
    longest = np.zeros(len(n))
    some = n > 0
    if some.any():
        longest[some] = np.maximum.reduceat(w.end - w.start, off[:-1][some])
    upper, alpha = _per_text(_UPPER[raw], at), np.maximum(_per_text(_ALPHA[raw], at), 1)
    if len(w.hash):
        ups = np.concatenate([[0], np.cumsum(_UPPER[raw], dtype=np.int64)])
        shout = (ups[w.end] - ups[w.start] >= 2) & (2 * (ups[w.end] - ups[w.start]) >= w.end - w.start)
    else:
        shout = np.zeros(0, dtype=bool)
    distinct = _distinct(w)
    features = np.stack([
        np.log1p(n), chars / words, np.minimum(longest, 200), symbols / size, pairs[:, 0] / lines, again / words, upper / alpha,
        _per_text(_DIGIT[raw], at) / size, _per_text(_MARK[raw], at) / size, _per_text(shout, off) / words, _per_text(raw >= 128, at) / size, distinct / words, np.minimum(n / lines, 500), _per_text(_FULL_STOP[raw], at) / words,
    ], axis=1)
    return counts, features


def _distinct(w: Words) -> np.ndarray:
    """Distinct words of each text."""
    order = np.lexsort((w.hash, w.doc))
    h, d = w.hash[order], w.doc[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    return np.bincount(d[new], minlength=len(w.offset) - 1)
