"""Word shingles as 64-bit hashes and their minima, over whole batches of texts.

A word is a run of bytes other than space and the controls 0x09 to 0x0D; A to Z count as a to z. A word's
hash is the sum of its bytes' random 64-bit values times powers of an odd number, by prefix sums over
the batch, then mixed; a shingle's hash mixes those of its words in order. A text with fewer words
than a shingle has is one shingle of all of them; a text without words has none.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_CHUNK = 1 << 18  # bytes worked on at once


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits look independent."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@functools.cache
def _byte_values() -> tuple[np.ndarray, np.ndarray]:
    """The value of each byte, and which bytes part words."""
    values = np.random.default_rng(11).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
    values[65:91] = values[97:123]
    parts = np.zeros(256, bool)
    parts[[32, 9, 10, 11, 12, 13]] = True
    values[parts] = 0
    return values, parts


_HELD: list[tuple[np.ndarray, np.ndarray]] = []  # powers up to the largest number asked for yet, unless a single word is longer than any chunk


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n, at least, of the base and of its inverse."""
    if _HELD and len(_HELD[0][0]) > n:
        return _HELD[0]
    inverse = pow(_BASE, -1, 1 << 64)
    with np.errstate(over="ignore"):
        up = np.cumprod(np.array([1] + [_BASE] * n, np.uint64), dtype=np.uint64)
        down = np.cumprod(np.array([1] + [inverse] * n, np.uint64), dtype=np.uint64)
    if n <= 4 * _CHUNK:
        _HELD[:] = [(up, down)]
    return up, down


def word_hashes(data: bytes) -> np.ndarray:
    """Hashes of the words of ``data`` in order, 0 for a lone NUL word (the mark between texts)."""
    values, parts = _byte_values()
    raw = np.frombuffer(data, np.uint8)
    apart = parts[raw]
    first = np.flatnonzero(~apart & np.concatenate([[True], apart[:-1]]))
    end = np.flatnonzero(~apart & np.concatenate([apart[1:], [True]])) + 1
    size = 1 << max(16, int(len(raw)).bit_length())
    up, down = _powers(size)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(values[raw] * up[: len(raw)])])
    h = mix((sums[end] - sums[first]) * down[first] + (end - first).astype(np.uint64))
    h[(end - first == 1) & (raw[first] == 0)] = 0
    return h


def shingle_sets(texts: list[str | None], words: int) -> list[np.ndarray]:
    """The distinct shingle hashes of each text, rising."""
    out: list[np.ndarray] = []
    batch: list[bytes] = []
    held = 0
    for t in texts:
        raw = (t or "").encode("utf-8", "surrogatepass")
        if b"\0" in raw or len(raw) > _CHUNK:  # NULs are marks between texts, and long texts go in parts
            out += _sets(batch, words)
            batch, held = [], 0
            out.append(_set_of(_long_words(raw), words))
            continue
        batch.append(raw)
        held += len(raw)
        if held > _CHUNK:
            out += _sets(batch, words)
            batch, held = [], 0
    return out + _sets(batch, words)


def _long_words(raw: bytes) -> np.ndarray:
    """Word hashes of one text, part by part, cut where words end."""
    found, at = [], 0
    raw_parts = np.flatnonzero(_byte_values()[1][np.frombuffer(raw, np.uint8)])
    while at < len(raw):
        end = len(raw)
        if end - at > _CHUNK:
            k = np.searchsorted(raw_parts, at + _CHUNK)
            end = int(raw_parts[k]) if k < len(raw_parts) else end
        h = word_hashes(raw[at:end])
        h[h == 0] = 1
        found.append(h)
        at = end
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def _joined(h: np.ndarray, words: int) -> np.ndarray:
    n = len(h) - words + 1
    x = h[:n]
    for k in range(1, words):
        x = mix(x * np.uint64(0x9FB21C651E98DF25) + h[k : n + k])
    return x


def _set_of(h: np.ndarray, words: int) -> np.ndarray:
    if not len(h):
        return h
    return np.unique(_joined(h, min(words, len(h))))


def _sets(batch: list[bytes], words: int) -> list[np.ndarray]:
    if not batch:
        return []
    h = word_hashes(b" \0 ".join([*batch, b""]))
    ends = np.flatnonzero(h == 0)
    begins = np.concatenate([[0], ends[:-1] + 1])
    whole = _joined(h, words) if len(h) >= words else h[:0]
    return [np.unique(whole[a : b - words + 1]) if b - a >= words else _set_of(h[a:b], words) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]


@functools.cache
def _functions(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(5)
    return rng.integers(0, 1 << 64, n, np.uint64, endpoint=False), rng.integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1)


def minima(sets: list[np.ndarray], n: int) -> np.ndarray:
    """Minima of ``n`` hash functions over each set, which must not be empty."""
    out = np.empty((len(sets), n), np.uint64)
    if not sets:
        return out
    xor, times = _functions(n)
    a = 0
    while a < len(sets):
        b, held = a, 0
        while b < len(sets) and (held == 0 or held + len(sets[b]) <= 60_000):
            held += len(sets[b])
            b += 1
        flat = np.concatenate(sets[a:b])
        starts = np.concatenate([[0], np.cumsum([len(s) for s in sets[a : b - 1]])]).astype(np.int64)
        for k in range(n):
            x = (flat ^ xor[k]) * times[k]
            out[a:b, k] = np.minimum.reduceat(x ^ (x >> np.uint64(29)), starts)
        a = b
    return out


def digest(s: np.ndarray) -> bytes:
    """128 bits that name the set."""
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()
