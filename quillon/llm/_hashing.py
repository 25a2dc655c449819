"""Hashes of the words of many texts at once, on arrays of code points."""

from __future__ import annotations

import numpy as np

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Code points hashed at a time, which bounds the tables of powers (a longer word extends them).
_CHUNK = 1 << 18
_powers: dict[str, np.ndarray] = {"n": np.ones(1, _U), "i": np.ones(1, _U)}

#: Code points below 128 that separate words: blanks, or all but letters and digits.
BLANKS = np.isin(np.arange(128), [9, 10, 11, 12, 13, 32])
SIGNS = np.array([not chr(c).isalnum() for c in range(128)])


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finalizer of 64-bit numbers, in place where possible."""
    h = h ^ (h >> _U(30))
    h *= _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(27)
    h *= _U(0x94D049BB133111EB)
    h ^= h >> _U(31)
    return h


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["n"]) < n:
        for key, base in (("n", _BASE), ("i", _INVERSE)):
            table = np.full(n, base, _U)
            table[0] = 1
            _powers[key] = np.cumprod(table, dtype=_U)
    return _powers["n"][:n], _powers["i"][:n]


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of values[s:e] for each span, by prefix sums of a polynomial. starts ascend."""
    out = np.empty(len(starts), _U)
    i = 0
    while i < len(starts):
        base = int(starts[i])
        j = int(np.searchsorted(starts, base + _CHUNK))
        stop = int(ends[i:j].max())
        part = values[base:stop].astype(_U)
        part += _U(1)
        up, down = _power_tables(max(len(part), _CHUNK) + 1)
        sums = np.zeros(len(part) + 1, _U)
        np.cumsum(part * up[: len(part)], out=sums[1:])
        s = starts[i:j] - base
        out[i:j] = (sums[ends[i:j] - base] - sums[s]) * down[s]
        i = j
    out += (ends - starts).astype(_U) * _U(0xD6E8FEB86659FD93)
    return mix(out)


class Texts:
    """Texts as one array of code points, a blank after each, and the words in it.

    Fields: points; starts and ends of words; doc, the number of each word's text;
    first, the first word of each text and at last the number of words.
    """

    def __init__(self, texts: list[str], separators: np.ndarray = BLANKS):
        self.n = len(texts)
        self.points = np.frombuffer((" ".join(texts) + " ").encode("utf-32-le", "replace"), np.uint32)
        self.limits = np.cumsum([0, *(len(t) + 1 for t in texts)])
        low = self.points < 128
        apart = np.zeros(len(self.points) + 1, bool)
        apart[0] = True
        apart[1:][low] = separators[self.points[low]]
        apart[self.limits[1:]] = True
        self.apart = apart[1:]
        self.starts = np.flatnonzero(apart[:-1] & ~apart[1:])
        self.ends = np.flatnonzero(apart[1:] & ~apart[:-1])
        self.first = np.searchsorted(self.starts, self.limits)
        self.doc = np.repeat(np.arange(self.n), np.diff(self.first))

    def hashes(self) -> np.ndarray:
        return span_hashes(self.points, self.starts, self.ends)

    def char_ngrams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """32-bit hashes of the n-grams of code points within a word and the blank on either side, and the text of each."""
        p = np.concatenate([np.array([32], np.uint32), self.points])  # a blank before the first text too
        m = len(p) - n + 1
        if m <= 0:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        h = np.full(m, n, np.uint32)
        keep = np.ones(m, bool)
        for k in range(n):
            h ^= p[k : k + m]
            h *= np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
            if 0 < k < n - 1:
                keep &= ~self.apart[k - 1 : k - 1 + m]
        at = np.flatnonzero(keep)
        # an n-gram's second code point lies in its word, whichever text's blank is the first
        return h[at], np.searchsorted(self.limits, at, side="right") - 1


def ngrams(words: np.ndarray, doc: np.ndarray, gaps: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words at i, i + gaps[0], ... of the same text, and the text of each."""
    reach = max(gaps, default=0)
    m = len(words) - reach
    if m <= 0:
        return words[:0], doc[:0]
    h = words[:m].copy()
    for g in gaps:
        h *= _U(0xFF51AFD7ED558CCD)
        h ^= h >> _U(32)
        h += words[g : g + m] * _U(2 * g + 1)
    keep = doc[:m] == doc[reach:]
    return mix(h[keep] + _U(len(gaps) * 64 + reach)), doc[:m][keep]
