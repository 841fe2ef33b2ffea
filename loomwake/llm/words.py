"""Words of many texts as arrays: hashes, places and lengths."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

from loomwake.llm import codepoints as C

#: An odd number, so that it has an inverse modulo 2**64.
MULTIPLIER = 0x9E3779B97F4A7C15
_INV = pow(MULTIPLIER, -1, 1 << 64)


@lru_cache(8)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        return np.cumprod(np.full(n, MULTIPLIER, np.uint64)), np.cumprod(np.full(n, _INV, np.uint64))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit mixing function on arrays."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))


@lru_cache(1)
def _fold() -> tuple[np.ndarray, np.ndarray]:
    """Of each code point: the mixed value of its small letter, 0 outside words; whether it is of words."""
    t = C.tables()
    low = np.arange(C.TOP, dtype=np.uint64)
    for c in np.flatnonzero(t.word):
        x = chr(c).lower()
        if len(x) == 1:
            low[c] = ord(x)
    return mix(low + np.uint64(1)) * t.word, t.word


class Words:
    """Words of many texts end to end: hash, place, and the place of each text's words.

    A word is a run of letters, marks and digits of the text's one form, in lower case, so
    punctuation, spacing and line breaks play no part. ``blank`` numbers the stretches between
    white space, which count as one word each where words are counted.
    """

    def __init__(self, texts: pa.Array):
        self._read(*C.canonical_points(texts)[:2])

    @classmethod
    def of(cls, cp: np.ndarray, off: np.ndarray) -> Words:
        """From code points of texts in their one form, with the offsets of the texts."""
        w = cls.__new__(cls)
        w._read(cp, off)
        return w

    def _read(self, cp: np.ndarray, off: np.ndarray) -> None:
        value, word = _fold()
        n = len(off) - 1
        c = np.minimum(cp, C.TOP - 1)
        inside = word[c]
        head = inside.copy()
        head[1:] &= ~inside[:-1]
        first = off[:-1][off[:-1] < len(cp)]
        head[first] |= inside[first]
        tail = inside.copy()
        tail[:-1] &= ~inside[1:]
        last = off[1:][off[1:] > 0] - 1
        tail[last] |= inside[last]
        begin, end = np.flatnonzero(head), np.flatnonzero(tail) + 1
        up, down = _powers(1 << max(18, int(len(cp)).bit_length()))
        with np.errstate(over="ignore"):
            total = np.zeros(len(cp) + 1, np.uint64)
            np.cumsum(value[c] * up[: len(cp)], out=total[1:])
            self.hash = mix((total[end] - total[begin]) * down[begin])
        row = np.repeat(np.arange(n), np.diff(off))
        self.cp, self.off, self.begin, self.end, self.n_texts = cp, off, begin, end, n
        self.row = row[begin]
        self.start = np.searchsorted(begin, off)
        space = (cp == 32) | ((cp >= 9) & (cp <= 13)) | (cp == 0x85) | (cp == 0x2028) | (cp == 0x2029)
        self.blank = np.cumsum(space)[begin] if len(cp) else np.zeros(0, np.int64)

    def spelled(self, i: int) -> str:
        """Word ``i`` in lower case."""
        return self.cp[self.begin[i] : self.end[i]].astype("<u4").tobytes().decode("utf-32-le").lower()
