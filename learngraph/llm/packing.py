"""Order-preserving packing of documents into fixed windows by dynamic programming.

The documents of a partition form one stream of tokens. Windows may be cut at the end of a
document (free), at the end of a sentence or, where neither is near, at regular places inside a
sentence; the cuts minimise padding plus the penalties of what they truncate. With cost(j) the
least cost of a cut at j, cost(j) = penalty(j) + min over i in [j - size, j) of
cost(i) + size - (j - i): since cost(i) + i is all that depends on i, a monotone queue over that
sliding range makes each transition O(1) amortised.

The stream is cut block by block: all but the last few windows of a block are final, and what
they leave is put before the next block. Memory is bounded by a block and the longest document,
and no row is shuffled. Sequence ids are unique and rise in the order of the stream; they hold
the partition's number in the high bits.

Null and empty texts are documents of the end id alone. Null ids stay null; repeated rows are
packed as often as they occur; an empty table gives no piece; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from learngraph.llm.bpe import blocks, encoder, forget
from learngraph.llm.shared import give_back

# Of a window's size: penalties of a cut at a sentence's end and inside one, and how densely places inside one are offered.
SENTENCE_PENALTY, INSIDE_PENALTY = 1 / 256, 1 / 32
INSIDE_GRID = 1 / 8
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def candidates(ids: np.ndarray, ends: np.ndarray, ends_sentence: np.ndarray, size: int) -> tuple[list[int], list[int]]:
    """Places where the stream may be cut, and the penalty of each.

    Every end of a document, every end of a sentence, and places an eighth of a window apart, so a window
    always reaches the next ones.
    """
    step = max(1, int(size * INSIDE_GRID))
    penalty = np.full(len(ids) + 1, -1, np.int32)
    penalty[step::step] = max(2, round(size * INSIDE_PENALTY))
    penalty[np.flatnonzero(ends_sentence[ids]) + 1] = max(1, round(size * SENTENCE_PENALTY))
    penalty[ends] = 0
    penalty[0] = 0
    penalty[len(ids)] = max(0, penalty[len(ids)])
    at = np.flatnonzero(penalty >= 0)
    return at.tolist(), penalty[at].tolist()


def best_cuts(at: list[int], penalty: list[int], size: int, final: bool) -> list[int]:
    """Cuts from at[0] on, of least total cost; the last is at[-1] if ``final``, else the cheapest near it."""
    n = len(at)
    key = [0] * n  # cost(j) + at[j]
    came = [0] * n
    key[0] = at[0]
    queue: deque[int] = deque([0])
    for j in range(1, n):
        low = at[j] - size
        while at[queue[0]] < low:
            queue.popleft()
        i = queue[0]
        k = key[i] + size + penalty[j]
        key[j] = k
        came[j] = i
        while queue and key[queue[-1]] >= k:
            queue.pop()
        queue.append(j)
    last = n - 1
    if not final:
        near = [j for j in range(1, n) if at[j] > at[-1] - size]
        last = min(near, key=lambda j: (key[j] - at[j], -at[j]))
    cuts = [at[last]]
    while last:
        last = came[last]
        cuts.append(at[last])
    return cuts[::-1]


class _Packer:
    def __init__(self, first_sequence: int, size: int, ends_sentence: np.ndarray, block: int) -> None:
        self.sequence, self.size, self.ends_sentence, self.block = first_sequence, size, ends_sentence, block
        self.docs: list[tuple[int | None, int, np.ndarray, int]] = []  # id, start, ids from there on, tokens in all
        self.held = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id, 0, ids, len(ids)))
        self.held += len(ids)

    def pieces(self, final: bool) -> list[tuple]:
        """Pieces of the windows that are final, in order."""
        if not self.docs:
            return []
        ids = np.concatenate([d[2] for d in self.docs])
        ends = np.cumsum([len(d[2]) for d in self.docs])
        cuts = best_cuts(*candidates(ids, ends, self.ends_sentence, self.size), self.size, final)
        if not final:
            cuts = cuts[:-8]
        out, docs, k, begin = [], self.docs, 0, 0
        for a, b in zip(cuts, cuts[1:], strict=False):
            at = a
            while at < b:
                doc_id, start, own, total = docs[k]
                take = min(b, begin + len(own)) - at
                part = own[at - begin : at - begin + take]
                out.append((doc_id, start + at - begin, take, zlib.crc32(part.astype("<u4").tobytes()), total, self.sequence, at - a))
                at += take
                if at == begin + len(own):
                    begin, k = at, k + 1
            self.sequence += 1
        done = cuts[-1] if cuts else 0
        self.docs = docs[k:]
        if self.docs and done > begin:
            doc_id, start, own, total = self.docs[0]
            self.docs[0] = (doc_id, start + done - begin, own[done - begin :], total)
        self.held -= done
        return out


def pack(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, size: int = 2048, block: int = 1 << 18, memo: int = 1_600_000, keep: bool = True) -> DataFrame:
    """One row per piece: the document's tokens [start, start + length) stand at ``offset`` of ``sequence_id``.

    A document is its ids and then ``end_id``. ids_crc32 is of the piece's ids as little-endian
    unsigned 32-bit integers. ``memo`` bounds the chunks a worker remembers, about 220 bytes each; it forgets them
    after each task unless ``keep``.
    """

    def run(batches):
        enc = encoder(tokenizer_path, memo)
        packer = _Packer(TaskContext.get().partitionId() << 36, size, enc.ends_sentence, max(block, 64 * size))

        def rows(final):
            columns = list(zip(*packer.pieces(final), strict=True)) or [[]] * 7
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[f.split()[0] for f in SCHEMA.split(", ")])

        end = np.array([end_id], enc.dtype)
        for batch in batches:
            names, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in blocks(texts):
                for doc_id, ids in zip(names[a:b], enc.encode(texts[a:b]), strict=True):
                    packer.add(doc_id, np.append(ids, end))
                    if packer.held >= packer.block:
                        yield rows(False)
        yield rows(True)
        if not keep:
            del enc
            forget()
        give_back()

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, SCHEMA)
