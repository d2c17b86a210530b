"""Byte-level BPE ids by the tokenizers library, with a memo of space-delimited chunks.

A byte-level pre-tokenizer never lets a token run from a non-space character over a following
space, so where a text holds only lone spaces between visible characters, its ids are those of
its chunks (each with the space before it) in a row. Chunks repeat far more than texts do: each
distinct one goes through the library once per worker. A text for which this cannot be shown
(other white space, runs of spaces, line ends beside spaces) is encoded whole.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

_SPACE = re.compile(r"\s")
_TAIL = ".,;:!?%&#*$"
_NEXT = "\0next\0"
_ENCODERS: dict[tuple[str, int], BpeEncoder] = {}


class BpeEncoder:
    """ids of texts as arrays of ``dtype``; a null text has the ids of the empty text."""

    def __init__(self, path: str, memo: int = 1_600_000) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.vocab_size = self.tokenizer.get_vocab_size()
        self.dtype = np.uint16 if self.vocab_size < (1 << 16) - 2 else np.uint32
        self.memo_size = memo
        self.memo: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {}
        top = int(np.iinfo(self.dtype).max)
        self.next, self.unsafe_id = top, top - 1  # no ids of the vocabulary
        self.unsafe = np.array([top - 1], self.dtype).tobytes()
        self.memo[_NEXT] = np.array([top], self.dtype).tobytes()
        self.words = self._chunks_apart(path)
        size = max(self.tokenizer.get_vocab().values()) + 1
        self.opens = np.zeros(size, bool)
        self.ends_sentence = np.zeros(size, bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.opens[i] = token.startswith("Ġ")
            self.ends_sentence[i] = token.endswith((".", "!", "?")) or "Ċ" in token

    @staticmethod
    def _chunks_apart(path: str) -> bool:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        return pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer")

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.dtype) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> dict[str, bytes]:
        """The ids of each word (no white space in it) with a space before it."""
        found: dict[str, bytes] = {}
        for k in range(0, len(words), 1000):
            part = words[k : k + 1000]
            (ids,) = self._whole([" " + " ".join(part)])
            at = np.flatnonzero(self.opens[ids])
            if len(at) == len(part):
                raw, width = ids.tobytes(), ids.itemsize
                ends = [*(at[1:] * width).tolist(), len(raw)]
                found.update({w: raw[i:j] for w, i, j in zip(part, (at * width).tolist(), ends, strict=True)})
            else:
                found.update({w: i.tobytes() for w, i in zip(part, self._whole([" " + w for w in part]), strict=True)})
        return found

    def _learn(self, chunks: set[str]) -> dict[str, bytes]:
        """The ids of each chunk with a space before it; the mark of an unsafe text where it can't be taken alone.

        Letters and the punctuation after them are separate pre-tokens, so a known word gives those of its forms with a tail.
        """
        found: dict[str, bytes] = {}
        todo: list[str] = []
        known, tails = self.memo.get, self.tails
        for c in chunks:
            w = c.rstrip(_TAIL)
            if w.isalpha():
                ids = known(w) if len(w) < len(c) else None
                if ids is None:
                    todo.append(c)
                    continue
                t = c[len(w) :]
                if t not in tails:
                    tails[t] = self._whole([t])[0].tobytes()
                found[c] = ids + tails[t]
            elif not c or ("\n" in c and (c[0] == "\n" or c[-1] == "\n")) or _SPACE.search(c.replace("\n", "")) or "\0" in c:
                found[c] = self.unsafe
            else:
                todo.append(c)
        found.update(self._words(todo))
        if len(tails) > 100_000:
            self.tails = {}
        if room := max(0, self.memo_size - len(self.memo)):
            self.memo.update([(c, v) for c, v in found.items() if len(c) <= 64][:room])
        return found

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        texts = [t or "" for t in texts]
        if not self.words or not texts:
            return self._whole(texts)
        flat = f" {_NEXT} ".join(texts).split(" ")
        values = list(map(self.memo.get, flat))
        learned: dict[str, bytes] = {}
        if None in values:
            at = [k for k, v in enumerate(values) if v is None]
            learned = self._learn({flat[k] for k in at})
            for k in at:
                values[k] = learned[flat[k]]
        ids = np.frombuffer(b"".join(values), self.dtype)
        ends = np.flatnonzero(ids == self.next)
        if len(ends) != len(texts) - 1:  # a text holds the mark between texts
            return self._whole(texts)
        out = np.split(ids, ends)
        for k in range(1, len(out)):
            out[k] = out[k][1:]
        rest = set(np.searchsorted(ends, np.flatnonzero(ids == self.unsafe_id)).tolist())
        # The first chunk of a text has no space before it.
        heads = [t[: t.find(" ")] if " " in t else t for t in texts]
        for k, (head, own) in enumerate(zip(heads, self._whole(heads), strict=True)):
            if k in rest:
                continue
            spaced = learned.get(head) or self.memo[head] if head else self.unsafe
            if spaced == self.unsafe:
                rest.add(k)
            else:
                out[k] = np.concatenate([own, out[k][len(spaced) // ids.itemsize :]])
        if rest:
            at = sorted(rest)
            for k, own in zip(at, self._whole([texts[k] for k in at]), strict=True):
                out[k] = own
        return out


def encoder(path: str, memo: int = 1_600_000) -> BpeEncoder:
    """One encoder a worker process, kept between tasks."""
    if (path, memo) not in _ENCODERS:
        _ENCODERS[path, memo] = BpeEncoder(path, memo)
    return _ENCODERS[path, memo]


def forget() -> None:
    """Drop this worker's encoders, where other work needs the memory more than the next task needs the memo."""
    _ENCODERS.clear()


def blocks(texts: list[str | None], chars: int = 500_000):
    """Slices of ``texts`` of about ``chars`` characters: (first, one past the last)."""
    first, held = 0, 0
    for k, t in enumerate(texts):
        held += len(t or "") + 16
        if held >= chars:
            yield first, k + 1
            first, held = k + 1, 0
    if first < len(texts):
        yield first, len(texts)
