"""Compressed integer bitmaps: sorted 16-bit arrays for sparse containers, packed words for dense ones."""

from __future__ import annotations

import numpy as np

DENSE_FROM = 4096
WORDS = 1024


def _pack(low: np.ndarray) -> np.ndarray:
    bits = np.zeros(65536, dtype=bool)
    bits[low] = True
    return np.packbits(bits, bitorder="little").view(np.uint64)


def _unpack(words: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(words.view(np.uint8), bitorder="little")).astype(np.uint16)


class Bitmap:
    """A set of non-negative 32-bit codes, split by their high 16 bits into containers.

    A container of fewer than 4,096 codes is a sorted ``uint16`` array, any
    other one is 1,024 packed 64-bit words.
    """

    __slots__ = ("parts",)

    def __init__(self, parts: dict[int, np.ndarray] | None = None):
        self.parts = parts or {}

    @classmethod
    def of(cls, codes) -> "Bitmap":
        codes = np.unique(np.asarray(codes, dtype=np.uint32))
        high = codes >> 16
        cuts = np.flatnonzero(np.diff(high)) + 1
        parts = {}
        for piece in np.split(codes, cuts) if len(codes) else []:
            parts[int(piece[0] >> 16)] = cls._best((piece & 0xFFFF).astype(np.uint16))
        return cls(parts)

    @staticmethod
    def _best(low: np.ndarray) -> np.ndarray:
        return _pack(low) if len(low) >= DENSE_FROM else low

    @staticmethod
    def _dense(part: np.ndarray) -> np.ndarray:
        return part if part.dtype == np.uint64 else _pack(part)

    @staticmethod
    def _low(part: np.ndarray) -> np.ndarray:
        return _unpack(part) if part.dtype == np.uint64 else part

    def __or__(self, other: "Bitmap") -> "Bitmap":
        parts = dict(self.parts)
        for h, b in other.parts.items():
            a = parts.get(h)
            if a is None:
                parts[h] = b
            elif a.dtype == np.uint64 or b.dtype == np.uint64:
                parts[h] = self._dense(a) | self._dense(b)
            else:
                parts[h] = self._best(np.union1d(a, b))
        return Bitmap(parts)

    def and_not(self, other: "Bitmap") -> "Bitmap":
        parts = {}
        for h, a in self.parts.items():
            b = other.parts.get(h)
            if b is None:
                parts[h] = a
                continue
            if a.dtype == np.uint64:
                left = self._best(_unpack(a & ~self._dense(b)))
            elif b.dtype == np.uint64:
                left = a[(b[a >> 6] >> (a & 63).astype(np.uint64)) & np.uint64(1) == 0]
            else:
                left = np.setdiff1d(a, b, assume_unique=True)
            if len(left):
                parts[h] = left
        return Bitmap(parts)

    def codes(self) -> np.ndarray:
        out = [self._low(p).astype(np.uint32) + (np.uint32(h) << np.uint32(16)) for h, p in sorted(self.parts.items())]
        return np.concatenate(out) if out else np.empty(0, np.uint32)

    def __len__(self) -> int:
        return len(self.codes())
