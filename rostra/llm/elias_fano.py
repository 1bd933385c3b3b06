"""Elias-Fano sequences over NumPy buffers: all lookups take and give whole arrays."""

from __future__ import annotations

import numpy as np

_U = np.uint64
_BLOCK = 1 << 16


def pack_bits(values: np.ndarray, width: int) -> np.ndarray:
    """Values of `width` bits each, end to end in 64-bit words (one spare word at the end)."""
    if not width:
        return np.zeros(1, np.uint64)
    out = []
    for i in range(0, len(values), _BLOCK):
        bits = np.unpackbits(values[i : i + _BLOCK].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, count=width, bitorder="little")
        out.append(np.packbits(bits.ravel(), bitorder="little"))
    raw = np.concatenate(out) if out else np.empty(0, np.uint8)
    return np.frombuffer(raw.tobytes() + b"\0" * (-len(raw) % 8 + 8), np.uint64)


def unpack_bits(words: np.ndarray, width: int, at: np.ndarray) -> np.ndarray:
    if not width:
        return np.zeros(len(at), np.uint64)
    bit = at.astype(np.uint64) * _U(width)
    w, off = (bit >> _U(6)).astype(np.int64), bit & _U(63)
    high = (words[w + 1] << _U(1)) << (_U(63) - off)
    return ((words[w] >> off) | high) & _U((1 << width) - 1)


def _select_in_word(words: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Place of set bit number k (from 0) in each word."""
    place = np.zeros(len(words), np.uint64)
    words, k = words.copy(), k.astype(np.int64)
    for step in (32, 16, 8, 4, 2, 1):
        ones = np.bitwise_count(words & _U((1 << step) - 1)).astype(np.int64)
        up = k >= ones
        k -= np.where(up, ones, 0)
        shift = np.where(up, _U(step), _U(0))
        words >>= shift
        place += shift
    return place.astype(np.int64)


class EliasFano:
    """A sorted sequence of n integers below 2**64: high parts in unary, low parts in `low_bits` each."""

    def __init__(self, n: int, low_bits: int, lows: np.ndarray, highs: np.ndarray, ones: np.ndarray):
        self.n, self.low_bits, self.lows, self.highs, self.ones = n, low_bits, lows, highs, ones

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = values.astype(np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        low_bits = max(0, ((top + 1) // max(n, 1)).bit_length() - 1)
        high = (values >> _U(low_bits)).astype(np.int64)
        bits = np.zeros((n + (top >> low_bits) + 2 + 63) // 64 * 64, np.uint8)
        bits[high + np.arange(n)] = 1
        highs = np.packbits(bits, bitorder="little").view(np.uint64)
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(highs), dtype=np.int64)]).astype(np.uint32)
        return cls(n, low_bits, pack_bits(values & _U((1 << low_bits) - 1), low_bits), highs, ones)

    def parts(self) -> list[np.ndarray]:
        return [self.lows, self.highs, self.ones]

    def _select1(self, k: np.ndarray) -> np.ndarray:
        w = np.searchsorted(self.ones, k, "right") - 1
        return w * 64 + _select_in_word(self.highs[w], k - self.ones[w])

    def _ones_before_zero(self, k: np.ndarray) -> np.ndarray:
        """How many ones stand before zero number k; all for a zero beyond the end."""
        zeros = np.arange(len(self.ones), dtype=np.int64) * 64 - self.ones
        beyond = k >= zeros[-1]
        k = np.where(beyond, 0, k)
        w = np.searchsorted(zeros, k, "right") - 1
        at = w * 64 + _select_in_word(~self.highs[w], k - zeros[w])
        return np.where(beyond, self.n, at - k)

    def get(self, at: np.ndarray) -> np.ndarray:
        high = (self._select1(at) - at).astype(np.uint64)
        return (high << _U(self.low_bits)) | unpack_bits(self.lows, self.low_bits, at)

    def successor(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each value the place of the first element not below it (n if none), and whether it equals the value."""
        values = values.astype(np.uint64)
        if not self.n:
            return np.zeros(len(values), np.int64), np.zeros(len(values), bool)
        high = np.minimum(values >> _U(self.low_bits), _U(64 * len(self.highs))).astype(np.int64)
        low = values & _U((1 << self.low_bits) - 1)
        begin = np.where(high > 0, self._ones_before_zero(np.maximum(high - 1, 0)), 0)
        end = self._ones_before_zero(high)
        a, b = begin, end.copy()
        todo = np.flatnonzero(a < b)
        while len(todo):
            mid = (a[todo] + b[todo]) >> 1
            less = unpack_bits(self.lows, self.low_bits, mid) < low[todo]
            a[todo] = np.where(less, mid + 1, a[todo])
            b[todo] = np.where(less, b[todo], mid)
            todo = todo[a[todo] < b[todo]]
        inside = a < end
        return a, inside & (unpack_bits(self.lows, self.low_bits, np.where(inside, a, 0)) == low)
