"""Wavelet matrix over token ids: bit-planes with rank and select, kept as one compressed blob."""

from __future__ import annotations

import struct

import numpy as np
import zstandard

MAGIC = b"WVM2"
_HEAD = struct.Struct("<4sBQQ")  # magic, planes, tokens, documents
_PART = struct.Struct("<BQQ")  # whether it is compressed, its bytes and those in the file
_STEP = 512  # bits between two counts of the rank directory
_MANY = 64  # occurrences from which whole planes are unpacked to place them


def _directory(plane: np.ndarray) -> np.ndarray:
    """1s before every ``_STEP`` bits of a plane, and in all of it."""
    step = _STEP // 8
    sums = np.add.reduceat(np.bitwise_count(plane).astype(np.int64), np.arange(0, len(plane), step)) if len(plane) else np.zeros(0, np.int64)
    return np.concatenate([[0], np.cumsum(sums)])


class WaveletMatrix:
    """Random access, counting and occurrence lookup over a sequence of unsigned ids.

    Plane l holds bit (planes - 1 - l) of the ids in that plane's order; from one plane to the
    next, ids with a 0 go before those with a 1, each in their order. ``zeros[l]`` counts the 0s. A plane and its rank directory are
    given as values or as functions that load them when they are needed.
    """

    def __init__(self, planes: list, zeros: list[int], n: int, ranks: list | None = None) -> None:
        self.planes, self.zeros, self.n = planes, zeros, n
        self._ranks = ranks or [lambda k=k: _directory(self.plane(k)) for k in range(len(planes))]

    def plane(self, level: int) -> np.ndarray:
        if callable(self.planes[level]):
            self.planes[level] = self.planes[level]()
        return self.planes[level]

    def directory(self, level: int) -> np.ndarray:
        if callable(self._ranks[level]):
            self._ranks[level] = self._ranks[level]()
        return self._ranks[level]

    def loaded(self) -> int:
        """Planes that have been unpacked so far."""
        return sum(not callable(p) for p in self.planes)

    @classmethod
    def build(cls, ids: np.ndarray, bits: int) -> WaveletMatrix:
        cur, planes, zeros = np.ascontiguousarray(ids), [], []
        for b in range(bits - 1, -1, -1):
            bit = (cur & cur.dtype.type(1 << b)) != 0
            planes.append(np.packbits(bit))
            low = np.flatnonzero(~bit)
            zeros.append(len(low))
            if b:
                cur = np.concatenate([cur.take(low), cur.take(np.flatnonzero(bit))])
        return cls(planes, zeros, len(ids))

    def decode(self) -> np.ndarray:
        """All ids, from the lowest plane up."""
        bits = len(self.planes)
        v = np.zeros(self.n, np.uint16 if bits <= 16 else np.uint32)
        for level in range(bits - 1, -1, -1):
            bit = np.unpackbits(self.plane(level), count=self.n).view(np.bool_)
            z = self.zeros[level]
            w = np.empty_like(v)
            w[np.flatnonzero(~bit)] = v[:z]
            w[np.flatnonzero(bit)] = v[z:] | v.dtype.type(1 << (bits - 1 - level))
            v = w
        return v

    def _rank1(self, level: int, i: int) -> int:
        """1s of a plane before place i."""
        if i >= self.n:
            return int(self.directory(level)[-1])
        done = int(self.directory(level)[i // _STEP])
        if i % _STEP:
            plane, full = self.plane(level), i // 8
            done += int(np.bitwise_count(plane[(i // _STEP) * (_STEP // 8) : full]).sum())
            done += int(plane[full] >> (8 - i % 8)).bit_count() if i % 8 else 0
        return done

    def _select(self, level: int, one: bool, k: int) -> int:
        """Place of a plane's k-th 1 (or 0): the directory names its ``_STEP`` bits, which alone are looked at."""
        ones = self.directory(level)
        before = ones if one else np.minimum(np.arange(len(ones)) * _STEP, self.n) - ones
        block = int(np.searchsorted(before, k, side="right")) - 1
        bits = np.unpackbits(self.plane(level)[block * (_STEP // 8) : (block + 1) * (_STEP // 8)])
        return block * _STEP + int(np.flatnonzero(bits == one)[k - int(before[block])])

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level in range(len(self.planes)):
            bit = self.plane(level)[i // 8] >> (7 - i % 8) & 1
            ones = self._rank1(level, i)
            i = self.zeros[level] + ones if bit else i - ones
            value = value << 1 | int(bit)
        return value

    def _range(self, symbol: int, i: int) -> tuple[int, int]:
        """Where, below the last plane, the symbol's occurrences before place i begin and end."""
        a, b, bits = 0, i, len(self.planes)
        if symbol < 0 or symbol >> bits:
            return 0, 0
        for level in range(bits):
            if a == b:
                return 0, 0  # no plane below is looked at
            ra, rb = self._rank1(level, a), self._rank1(level, b)
            a, b = (self.zeros[level] + ra, self.zeros[level] + rb) if symbol >> (bits - 1 - level) & 1 else (a - ra, b - rb)
        return a, b

    def rank(self, symbol: int, i: int) -> int:
        """Occurrences of the symbol before place i."""
        a, b = self._range(symbol, min(max(i, 0), self.n))
        return b - a

    def count(self, symbol: int) -> int:
        return self.rank(symbol, self.n)

    def select(self, symbol: int, k: int) -> int:
        """Place of the k-th occurrence, from 0; -1 if there are fewer."""
        a, b = self._range(symbol, self.n)
        if not 0 <= k < b - a:
            return -1
        at, bits = a + k, len(self.planes)
        for level in range(bits - 1, -1, -1):
            one = symbol >> (bits - 1 - level) & 1
            at = self._select(level, bool(one), at - self.zeros[level] if one else at)
        return at

    def places(self, symbol: int) -> np.ndarray:
        """All places of the symbol, rising."""
        a, b = self._range(symbol, self.n)
        if b - a < _MANY:
            return np.array([self.select(symbol, k) for k in range(b - a)], np.int64)
        at, bits = np.arange(a, b), len(self.planes)
        for level in range(bits - 1, -1, -1):
            one = symbol >> (bits - 1 - level) & 1
            at = np.flatnonzero(np.unpackbits(self.plane(level), count=self.n) == one)[at - self.zeros[level] if one else at]
        return at

    def to_bytes(self, starts: np.ndarray, doc_ids: np.ndarray, known: np.ndarray) -> bytes:
        """The blob: head, document table (starts, ids, which ids aren't null), then each plane after its rank directory; each part compressed only where that helps."""
        out = [_HEAD.pack(MAGIC, len(self.planes), self.n, len(doc_ids))]
        table = [starts.astype("<u8").tobytes(), doc_ids.astype("<i8").tobytes(), np.packbits(known.astype(bool)).tobytes()]
        table.append(np.array(self.zeros, "<u8").tobytes())
        planes = [x for k in range(len(self.planes)) for x in (self.directory(k).astype("<u8").tobytes(), self.plane(k).tobytes())]
        for raw in [*table, *planes]:
            small = _squeezed(raw)
            out += [_PART.pack(small is not raw, len(raw), len(small)), small]
        return b"".join(out)

    @classmethod
    def from_bytes(cls, blob: bytes) -> tuple[WaveletMatrix, np.ndarray, np.ndarray, np.ndarray]:
        """The matrix, the documents' starts (and one past the last token), ids and non-null marks."""
        magic, bits, n, docs = _HEAD.unpack_from(blob)
        if magic != MAGIC:
            raise ValueError("not a wavelet shard")
        at, parts = _HEAD.size, []
        for _ in range(4 + 2 * bits):
            small, whole, size = _PART.unpack_from(blob, at)
            parts.append((small, whole, at + _PART.size, size))
            at += _PART.size + size
        if at > len(blob):
            raise ValueError("truncated shard")

        def load(k: int, kind) -> np.ndarray:
            small, whole, start, size = parts[k]
            raw = blob[start : start + size]
            raw = zstandard.decompress(raw, max_output_size=whole) if small else raw
            if len(raw) != whole:
                raise ValueError("truncated shard")
            return np.frombuffer(raw, kind)

        starts, ids, zeros = load(0, "<u8"), load(1, "<i8"), load(3, "<u8").astype(int).tolist()
        known = np.unpackbits(load(2, np.uint8), count=docs).astype(bool)
        ranks = [lambda k=k: load(4 + 2 * k, "<u8").astype(np.int64) for k in range(bits)]
        planes = [lambda k=k: load(5 + 2 * k, np.uint8) for k in range(bits)]
        return cls(planes, zeros, n, ranks), starts, ids, known


def _squeezed(raw: bytes) -> bytes:
    """Compressed if a sample of 4 KB shrinks by a tenth, else as it is."""
    pack = zstandard.ZstdCompressor(level=1).compress
    if len(pack(raw[:4096])) > 0.9 * min(len(raw), 4096):
        return raw
    small = pack(raw)
    return small if len(small) < len(raw) else raw
