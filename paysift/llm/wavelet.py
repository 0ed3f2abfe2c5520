"""Wavelet matrix and FM-index over integer sequences, in numpy.

A wavelet matrix stores a sequence of ``bits``-bit symbols as ``bits``
bit-planes; each plane has counts of ones per 64-bit word, so rank, select
and access cost one step a plane.  All calls take arrays and answer them at
once.
"""

from __future__ import annotations

import struct

import numpy as np
import zstandard

_U = np.uint64
#: _LOW[k] has the k lowest bits set.
_LOW = (_U(1) << np.arange(64, dtype=_U)) - _U(1)


class BitPlane:
    """Bits packed in 64-bit words, with the ones before each word."""

    def __init__(self, words: np.ndarray, n: int):
        self.words, self.n = words, n
        ones = np.bitwise_count(words).astype(np.int64)
        self.before = np.concatenate(([0], np.cumsum(ones)))[:-1]
        self.ones = int(ones.sum())

    @classmethod
    def of(cls, bits: np.ndarray) -> BitPlane:
        packed = np.packbits(bits, bitorder="little")
        # one word more, so that rank(n) needs no special case
        room = np.zeros((len(bits) // 64 + 1) * 8, dtype=np.uint8)
        room[: len(packed)] = packed
        return cls(room.view(_U), len(bits))

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones among the first ``i`` bits."""
        w = i >> 6
        word = self.words[w]
        word &= _LOW[i & 63]
        out = self.before[w]
        out += np.bitwise_count(word)
        return out

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(_U)) & _U(1) != 0

    def select(self, k: np.ndarray, bit: int) -> np.ndarray:
        """Place of the ``k``-th (from 0) bit equal to ``bit``."""
        at = np.arange(len(self.words)) * 64
        before = self.before if bit else at - self.before
        w = np.searchsorted(before, k, side="right") - 1
        left = k - before[w]
        word = self.words[w] if bit else ~self.words[w]
        for _ in range(int(left.max(initial=0))):
            word = np.where(left > 0, word & (word - _U(1)), word)
            left = left - (left > 0)
        low = word & (~word + _U(1))
        return w * 64 + np.bitwise_count(low - _U(1)).astype(np.int64)


class WaveletMatrix:
    def __init__(self, planes: list[BitPlane], n: int):
        self.planes, self.n, self.bits = planes, n, len(planes)
        self.zeros = [n - p.ones for p in planes]

    @classmethod
    def of(cls, values: np.ndarray, bits: int) -> WaveletMatrix:
        planes = []
        for level in range(bits - 1, -1, -1):
            bit = (values >> level) & 1 != 0
            planes.append(BitPlane.of(bit))
            values = np.concatenate((values[~bit], values[bit]))
        return cls(planes, len(values))

    def access(self, i: np.ndarray) -> np.ndarray:
        """The symbols at places ``i``."""
        i = np.asarray(i, dtype=np.int64)
        out = np.zeros(len(i), dtype=np.uint32)
        for plane, zeros in zip(self.planes, self.zeros):
            bit, r = plane.get(i), plane.rank(i)
            out = (out << np.uint32(1)) | bit
            i = np.where(bit, zeros + r, i - r)
        return out

    def decode(self, dtype=np.uint32) -> np.ndarray:
        """The whole sequence, plane by plane from the last."""
        out = np.zeros(self.n, dtype=dtype)
        for level in range(self.bits):
            plane = self.planes[self.bits - 1 - level]
            bit = np.unpackbits(plane.words.view(np.uint8), count=self.n,
                                bitorder="little").view(bool)
            up = np.empty(self.n, dtype=dtype)
            zeros = self.n - plane.ones
            up[~bit] = out[:zeros]
            up[bit] = out[zeros:] | dtype(1 << level)
            out = up
        return out

    def _down(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for level, (plane, zeros) in enumerate(zip(self.planes, self.zeros)):
            bit = symbol & (1 << (self.bits - 1 - level)) != 0
            r = plane.rank(i)
            i = i - r
            r += zeros
            np.copyto(i, r, where=bit)
        return i

    def starts(self, symbol: np.ndarray) -> np.ndarray:
        """Where each symbol's run begins below the last plane."""
        symbol = np.asarray(symbol, dtype=np.int64)
        return self._down(symbol, np.zeros(len(symbol), dtype=np.int64))

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol occurs among the first ``i`` places."""
        symbol = np.asarray(symbol, dtype=np.int64)
        i = np.asarray(i, dtype=np.int64)
        return self._down(symbol, i) - self.starts(symbol)

    def select(self, symbol: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Place of the ``k``-th (from 0) occurrence of each symbol; it must
        exist."""
        symbol = np.asarray(symbol, dtype=np.int64)
        i = self.starts(symbol) + np.asarray(k, dtype=np.int64)
        for level in range(self.bits - 1, -1, -1):
            plane, zeros = self.planes[level], self.zeros[level]
            bit = (symbol >> (self.bits - 1 - level)) & 1 != 0
            up = np.zeros(len(i), dtype=np.int64)
            if bit.any():
                up[bit] = plane.select(i[bit] - zeros, 1)
            if not bit.all():
                up[~bit] = plane.select(i[~bit], 0)
            i = up
        return i

    def to_bytes(self) -> bytes:
        """One compressed block: number of places and planes, the planes."""
        body = b"".join(p.words.tobytes() for p in self.planes)
        return struct.pack("<QI", self.n, self.bits) + \
            zstandard.ZstdCompressor(level=3).compress(body)

    @classmethod
    def from_bytes(cls, data: bytes) -> WaveletMatrix:
        n, bits = struct.unpack_from("<QI", data)
        body = zstandard.ZstdDecompressor().decompress(bytes(data[12:]))
        words = np.frombuffer(body, dtype=_U).reshape(bits, -1) if bits \
            else np.zeros((0, 1), _U)
        return cls([BitPlane(w, n) for w in words], n)


def sorted_places(codes: np.ndarray, depth: int) -> np.ndarray:
    """Places of ``codes`` ordered by the next ``depth`` or more symbols, in
    any order where these are equal (prefix doubling from as many symbols as
    one key holds; the end counts as smallest)."""
    n = len(codes)
    bits = max(1, int(codes.max(initial=0) + 1).bit_length())
    k = max(1, min(depth, 62 // bits))
    key = np.zeros(n, dtype=np.int64)
    for j in range(k):
        key <<= bits
        key[: max(0, n - j)] += codes[j:] + 1
    while True:
        order = np.argsort(key)
        if k >= depth:
            return order
        sorted_key = key[order]
        new = np.cumsum(np.concatenate(
            ([1], (sorted_key[1:] != sorted_key[:-1]).astype(np.int64))))
        if new[-1] == n:
            return order
        rank = np.empty(n, dtype=np.int64)
        rank[order] = new
        key = rank * (int(new[-1]) + 1)
        key[: n - k] += rank[k:]
        k *= 2


class FMIndex:
    """Backward search for patterns of up to ``depth`` symbols over codes
    0..sigma-1 (0 separates texts and is in no pattern)."""

    def __init__(self, codes: np.ndarray, depth: int):
        self.places = sorted_places(codes, depth)
        sigma = int(codes.max(initial=0)) + 1
        self.bwt = WaveletMatrix.of(
            codes[self.places - 1].astype(np.int64),
            max(1, int(sigma - 1).bit_length()))
        self.starts = self.bwt.starts(np.arange(sigma))
        self.below = np.concatenate(
            ([0], np.cumsum(np.bincount(codes, minlength=sigma))))

    def extend(self, symbol: np.ndarray, lo: np.ndarray,
               hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One step of backward search on many ranges of suffixes."""
        m = len(lo)
        i = self.bwt._down(np.concatenate((symbol, symbol)),
                           np.concatenate((lo, hi)))
        base = self.below[symbol] - self.starts[symbol]
        return base + i[:m], base + i[m:]

    def matching(self, codes: np.ndarray, ends: np.ndarray,
                 limit: int, lone: bool = False
                 ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matching statistics of a streamed sequence: for every end (one
        past a place of ``codes``) the length of the longest match ending
        there, up to ``limit``, and its range of suffixes.

        With ``lone`` a search ends as soon as one suffix is left, which is
        right for patterns that are known to occur: their range cannot
        change, and the length is then the length so far."""
        lo = np.zeros(len(ends), dtype=np.int64)
        hi = np.full(len(ends), len(self.places), dtype=np.int64)
        length = np.zeros(len(ends), dtype=np.int64)
        live = np.arange(len(ends))
        for step in range(1, limit + 1):
            live = live[ends[live] >= step]
            symbol = codes[ends[live] - step].astype(np.int64)
            known = (symbol > 0) & (symbol < len(self.starts))
            live, symbol = live[known], symbol[known]
            if not len(live):
                break
            if step == 1:  # all suffixes that begin with the symbol
                a, b = self.below[symbol], self.below[symbol + 1]
            else:
                a, b = self.extend(symbol, lo[live], hi[live])
            ok = a < b
            live, a, b = live[ok], a[ok], b[ok]
            lo[live], hi[live], length[live] = a, b, step
            if lone:
                live = live[b - a > 1]
        return length, lo, hi
