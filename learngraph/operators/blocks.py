"""Pairs inside blocks of rows, met in numpy inside tasks: what leaves a task is the pairs that hold."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def whole_blocks(batches: Iterator[pa.RecordBatch], rows: int = 8192, size: int = 32 << 20) -> Iterator[pa.Table]:
    """Tables of whole blocks, several where they are small; batches come sorted by block, their first column."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.num_rows for b in held) < rows and sum(b.nbytes for b in held) < size:
            continue
        at = batch.column(0).to_numpy()
        ends = np.flatnonzero(at[1:] != at[:-1])
        last = int(ends[-1]) + 1 if len(ends) else 0
        if not last and (len(held) == 1 or held[-2].column(0)[held[-2].num_rows - 1].as_py() == int(at[0])):
            continue  # one block since the last yield
        yield pa.Table.from_batches([*held[:-1], batch.slice(0, last)])
        held = [batch.slice(last)]
    if held:
        yield pa.Table.from_batches(held)


def pairs_inside(block: np.ndarray, limit: int = 200_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j), i < j, of equal consecutive values of ``block``, about ``limit`` pairs at a time."""
    n = len(block)
    if not n:
        return
    edge = np.concatenate([[0], np.flatnonzero(block[1:] != block[:-1]) + 1, [n]])
    after = np.repeat(edge[1:], np.diff(edge)) - np.arange(n) - 1
    total = np.concatenate([[0], np.cumsum(after)])
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(total, total[a] + limit, side="right")) - 1)
        i = np.repeat(np.arange(a, b), after[a:b])
        yield i, np.arange(len(i)) - np.repeat(total[a:b] - total[a], after[a:b]) + i + 1
        a = b


def ragged(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column, and where each row's begin and end among them. Null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.where(column.is_valid().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy(zero_copy_only=False)), 0)
    return column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)


def unit_rows(column: pa.ChunkedArray | pa.Array, dim: int | None = None) -> np.ndarray:
    """Vectors as rows of length one in double precision; null and zero vectors, those with a component that is null or not finite, and those of another length than ``dim`` (the longest's, if not given), are zero."""
    values, at = ragged(column)
    n, lengths = len(at) - 1, np.diff(at)
    dim = int(lengths.max(initial=0)) if dim is None else dim
    out = np.zeros((n, dim))
    fits = np.flatnonzero(lengths == dim)
    if dim and len(fits):
        out[fits] = values.astype(np.float64)[at[fits][:, None] + np.arange(dim)]
        out[~np.isfinite(out).all(1)] = 0
    norm = np.sqrt((out * out).sum(1, keepdims=True))
    return out / np.where(norm > 0, norm, 1)


def common(codes: np.ndarray, at: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many codes the sets of rows i and j share, and the least of these (the largest number for none). Sets have each code once."""
    none = np.iinfo(np.int64).max
    lengths = np.diff(at)
    longest = int(lengths.max(initial=0))
    if not len(i) or not longest:
        return np.zeros(len(i), np.int64), np.full(len(i), none)
    if longest <= 24:
        table = np.full((len(lengths), longest), -1, np.int64)
        table[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(codes)) - np.repeat(at[:-1], lengths)] = codes
        x, y = table[i], table[j]
        met = ((x[:, :, None] == y[:, None, :]) & (x >= 0)[:, :, None]).any(2)
        return met.sum(1), np.where(met, x, none).min(1)
    n, least = np.zeros(len(i), np.int64), np.full(len(i), none)
    step = max(1, 4_000_000 // (2 * longest))
    for a in range(0, len(i), step):
        rows = np.concatenate([i[a : a + step], j[a : a + step]])
        size = lengths[rows]
        pair = np.repeat(np.concatenate([np.arange(len(rows) // 2)] * 2), size)
        code = codes[np.repeat(at[rows], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)]
        order = np.lexsort((code, pair))
        pair, code = pair[order], code[order]
        twice = np.flatnonzero((pair[1:] == pair[:-1]) & (code[1:] == code[:-1]))
        np.add.at(n, a + pair[twice], 1)
        np.minimum.at(least, a + pair[twice], code[twice])
    return n, least
