"""Compressed bitmaps over integer codes."""

from __future__ import annotations

import numpy as np

#: Codes per container, and the count from which a container is held as bits.
SPAN, DENSE = 1 << 16, 4096


class Bitmap:
    """A set of non-negative integers in containers of 65,536 codes.

    A container with up to 4,096 codes is a sorted uint16 array (2 bytes a code), a fuller one
    8 KB of bits, so a set takes at most 2 bytes a code and at most a bit for each code of its span.
    """

    __slots__ = ("parts",)

    def __init__(self, parts: dict[int, np.ndarray] | None = None):
        self.parts = parts or {}

    @staticmethod
    def _pack(low: np.ndarray) -> np.ndarray:
        if len(low) <= DENSE:
            return low.astype(np.uint16)
        bits = np.zeros(SPAN, bool)
        bits[low] = True
        return np.packbits(bits, bitorder="little")

    @staticmethod
    def _low(part: np.ndarray) -> np.ndarray:
        return part if part.dtype == np.uint16 else np.flatnonzero(np.unpackbits(part, bitorder="little")).astype(np.uint16)

    @classmethod
    def of(cls, codes: np.ndarray) -> Bitmap:
        codes = np.unique(np.asarray(codes, np.int64))
        high = codes >> 16
        cuts = np.flatnonzero(np.diff(high)) + 1
        return cls({int(c[0] >> 16): cls._pack(c & 0xFFFF) for c in np.split(codes, cuts) if len(c)})

    def andnot(self, other: Bitmap) -> Bitmap:
        """The codes of this set that ``other`` lacks."""
        out = {}
        for k, a in self.parts.items():
            b = other.parts.get(k)
            if b is None:
                out[k] = a
                continue
            if a.dtype == np.uint8 and b.dtype == np.uint8:
                left = self._low(a & ~b)
            elif b.dtype == np.uint8:
                left = a[((b[a >> 3] >> (a & 7).astype(np.uint8)) & 1) == 0]
            else:
                left = np.setdiff1d(self._low(a), b, assume_unique=True)
            if len(left):
                out[k] = self._pack(left)
        return Bitmap(out)

    def __len__(self) -> int:
        return sum(len(p) if p.dtype == np.uint16 else int(np.unpackbits(p).sum()) for p in self.parts.values())

    def decode(self) -> np.ndarray:
        return np.concatenate([self._low(p).astype(np.int64) + (k << 16) for k, p in sorted(self.parts.items())]) if self.parts else np.zeros(0, np.int64)

    @property
    def nbytes(self) -> int:
        return sum(p.nbytes for p in self.parts.values())
