"""Compressed bitmaps over 32-bit codes, in numpy.

A bitmap maps the high 16 bits of a code to a container of its low 16 bits: a sorted ``uint16`` array while
it holds at most ``SPARSE`` codes, a bit set of 65,536 bits above that.
"""

from __future__ import annotations

import numpy as np

SPARSE = 4096


class Bitmap:
    __slots__ = ("parts",)

    def __init__(self, parts: dict[int, np.ndarray] | None = None):
        self.parts = parts or {}

    @classmethod
    def of(cls, codes: np.ndarray) -> Bitmap:
        codes = np.unique(codes.astype(np.uint32))
        high = codes >> 16
        cuts = np.flatnonzero(np.diff(high)) + 1
        groups = np.split(codes, cuts) if len(codes) else []
        return cls({int(g[0] >> 16): _pack((g & 0xFFFF).astype(np.uint16)) for g in groups})

    def codes(self) -> np.ndarray:
        """The codes held, ascending."""
        found = [(_unpack(part).astype(np.uint32) | np.uint32(high << 16)) for high, part in sorted(self.parts.items())]
        return np.concatenate(found) if found else np.empty(0, np.uint32)

    def and_not(self, other: Bitmap) -> Bitmap:
        return self._keep(other, absent=True)

    def __and__(self, other: Bitmap) -> Bitmap:
        return self._keep(other, absent=False)

    def __or__(self, other: Bitmap) -> Bitmap:
        out = dict(self.parts)
        for high, part in other.parts.items():
            mine = out.get(high)
            out[high] = part if mine is None else _pack_bits(_bits(mine) | _bits(part))
        return Bitmap(out)

    def __len__(self) -> int:
        return sum(len(p) if p.dtype == np.uint16 else int(np.bitwise_count(p).sum()) for p in self.parts.values())

    def nbytes(self) -> int:
        return sum(p.nbytes for p in self.parts.values())

    def _keep(self, other: Bitmap, absent: bool) -> Bitmap:
        out = {}
        for high, mine in self.parts.items():
            theirs = other.parts.get(high)
            if theirs is None:
                if absent:
                    out[high] = mine
                continue
            if mine.dtype == np.uint16:
                there = _holds(theirs, mine)
                kept = mine[~there] if absent else mine[there]
                if len(kept):
                    out[high] = kept
            else:
                bits = _bits(mine) & (~_bits(theirs) if absent else _bits(theirs))
                if bits.any():
                    out[high] = _pack_bits(bits)
        return Bitmap(out)


def _holds(part: np.ndarray, low: np.ndarray) -> np.ndarray:
    if part.dtype == np.uint16:
        return np.isin(low, part, assume_unique=True)
    return (part[low >> 3] >> (low & 7).astype(np.uint8)) & 1 == 1


def _bits(part: np.ndarray) -> np.ndarray:
    if part.dtype == np.uint8:
        return part
    flags = np.zeros(65_536, np.uint8)
    flags[part] = 1
    return np.packbits(flags, bitorder="little")


def _unpack(part: np.ndarray) -> np.ndarray:
    return part if part.dtype == np.uint16 else np.flatnonzero(np.unpackbits(part, bitorder="little")).astype(np.uint16)


def _pack(low: np.ndarray) -> np.ndarray:
    return low if len(low) <= SPARSE else _bits(low)


def _pack_bits(bits: np.ndarray) -> np.ndarray:
    return bits if int(np.bitwise_count(bits).sum()) > SPARSE else _unpack(bits)
