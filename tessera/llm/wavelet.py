"""A wavelet matrix of token ids in one compressed file.

Layout (little-endian): the magic WMX1, the length of a JSON header, the header,
then zstd frames: document ids and sizes, and for each bit-plane, highest first,
the packed bits and the number of ones before each block of RANK_BITS.  A plane
is decompressed when a query first needs it.
"""

from __future__ import annotations

import json
import struct
from functools import cached_property

import numpy as np
import zstandard

MAGIC = b"WMX1"
RANK_BITS = 4096
_STRIDE = 1 << 16  # ids moved at once, so that their positions stay in the processor's cache


def _small(width: int) -> type:
    return np.uint16 if width <= 16 else np.uint32


def _parted(values: np.ndarray, bit: np.integer) -> tuple[np.ndarray, np.ndarray, int]:
    """The packed plane of a bit, the values with those without it first, and how many those are."""
    packed, out, rest = np.empty(-(-len(values) // 8), np.uint8), np.empty_like(values), np.empty_like(values)
    zeros = ones = 0
    for at in range(0, len(values), _STRIDE):
        part = values[at : at + _STRIDE]
        bits = part & bit != 0
        plane = np.packbits(bits)
        packed[at // 8 : at // 8 + len(plane)] = plane
        low, high = np.flatnonzero(~bits), np.flatnonzero(bits)
        out[zeros : zeros + len(low)] = part.take(low)
        rest[ones : ones + len(high)] = part.take(high)
        zeros, ones = zeros + len(low), ones + len(high)
    out[zeros:] = rest[:ones]
    return packed, out, zeros


def encode(ids: np.ndarray, doc_ids: np.ndarray, sizes: np.ndarray, nulls: list[int] = ()) -> bytes:
    """A file of the ids of documents that lie one after the other."""
    values = np.asarray(ids, np.uint32)
    width = max(1, int(values.max(initial=0)).bit_length())
    values = values.astype(_small(width))
    press = zstandard.ZstdCompressor(level=1).compress
    frames = [press(np.asarray(doc_ids, "<i8").tobytes()), press(np.asarray(sizes, "<u4").tobytes())]
    zeros = []
    for shift in range(width - 1, -1, -1):
        packed, values, low = _parted(values, values.dtype.type(1 << shift))
        padded = np.zeros(-(-len(values) // RANK_BITS) * RANK_BITS // 8, np.uint8)
        padded[: len(packed)] = packed
        ones = np.cumsum(np.bitwise_count(padded).reshape(-1, RANK_BITS // 8).sum(axis=1, dtype=np.uint32), dtype=np.uint32)
        frames += [press(packed.tobytes()), press(np.concatenate([[0], ones[:-1]]).astype("<u4").tobytes() if len(ones) else b"")]
        zeros.append(low)
    header = json.dumps({"n": len(values), "width": width, "zeros": zeros, "docs": len(doc_ids), "frames": [len(f) for f in frames], "nulls": list(nulls)}).encode()
    return b"".join([MAGIC, struct.pack("<I", len(header)), header, *frames])


class WaveletShard:
    """Queries on one file: access, rank, count, select and occurrences of ids."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a wavelet shard")
        (size,) = struct.unpack_from("<I", data, 4)
        self.header = json.loads(data[8 : 8 + size])
        self.n, self.width, self.zeros = self.header["n"], self.header["width"], self.header["zeros"]
        self._frames, at = [], 8 + size
        for length in self.header["frames"]:
            self._frames.append(data[at : at + length])
            at += length
        self._planes: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    @staticmethod
    def _open(frame: bytes) -> bytes:
        return zstandard.ZstdDecompressor().decompress(frame)

    @cached_property
    def doc_ids(self) -> np.ndarray:
        return np.frombuffer(self._open(self._frames[0]), "<i8")

    @cached_property
    def sizes(self) -> np.ndarray:
        return np.frombuffer(self._open(self._frames[1]), "<u4")

    def _plane(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        if level not in self._planes:
            packed, ranks = self._frames[2 + 2 * level : 4 + 2 * level]
            self._planes[level] = np.frombuffer(self._open(packed), np.uint8), np.frombuffer(self._open(ranks), "<u4")
        return self._planes[level]

    def _bit(self, level: int, i: int) -> int:
        return int(self._plane(level)[0][i >> 3]) >> (7 - (i & 7)) & 1

    def _ones(self, level: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        if i == 0:
            return 0
        packed, ranks = self._plane(level)
        block = (i - 1) // RANK_BITS
        first = block * RANK_BITS
        return int(ranks[block]) + int(np.unpackbits(packed[first >> 3 : (i + 7) >> 3], count=i - first).sum())

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        out = 0
        for level in range(self.width):
            bit, ones = self._bit(level, i), self._ones(level, i)
            out, i = out << 1 | bit, self.zeros[level] + ones if bit else i - ones
        return out

    def _range(self, token: int, end: int) -> tuple[int, int]:
        """Where the occurrences of token among the first `end` ids lie after the last plane."""
        a, b = 0, end
        if token >> self.width:
            return 0, 0
        for level in range(self.width):
            ones_a, ones_b = self._ones(level, a), self._ones(level, b)
            if token >> (self.width - 1 - level) & 1:
                a, b = self.zeros[level] + ones_a, self.zeros[level] + ones_b
            else:
                a, b = a - ones_a, b - ones_b
        return a, b

    def rank(self, token: int, end: int) -> int:
        """Occurrences of token among the first `end` ids."""
        a, b = self._range(token, end)
        return b - a

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def _select_bit(self, level: int, bit: int, k: int) -> int:
        """Position of the k-th (from 0) zero or one of a plane: binary search on rank."""
        low, high = 0, self.n
        while low < high:
            mid = (low + high) // 2
            ones = self._ones(level, mid + 1)
            if (ones if bit else mid + 1 - ones) > k:
                high = mid
            else:
                low = mid + 1
        return low

    def select(self, token: int, k: int) -> int:
        """Position of the k-th (from 0) occurrence of token."""
        a, b = self._range(token, self.n)
        if not 0 <= k < b - a:
            raise IndexError(k)
        at = a + k
        for level in range(self.width - 1, -1, -1):
            bit = token >> (self.width - 1 - level) & 1
            at = self._select_bit(level, bit, at - self.zeros[level] if bit else at)
        return at

    def occurrences(self, token: int) -> list[int]:
        return [self.select(token, k) for k in range(self.count(token))]

    def decode(self) -> np.ndarray:
        """All ids: from the last plane up, each stable partition is undone."""
        values = np.zeros(self.n, _small(self.width))
        for level in range(self.width - 1, -1, -1):
            packed, before = self._plane(level)[0], np.empty_like(values)
            bit, low, high = values.dtype.type(1 << (self.width - 1 - level)), 0, self.zeros[level]
            for at in range(0, self.n, _STRIDE):
                part = before[at : at + _STRIDE]
                bits = np.unpackbits(packed[at // 8 : (at + len(part) + 7) // 8], count=len(part)).view(bool)
                zeros, ones = np.flatnonzero(~bits), np.flatnonzero(bits)
                part[zeros] = values[low : low + len(zeros)]
                part[ones] = values[high : high + len(ones)] | bit
                low, high = low + len(zeros), high + len(ones)
            values = before
        return values.astype(np.uint32)
