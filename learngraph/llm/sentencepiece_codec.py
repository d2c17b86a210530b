"""SentencePiece models run by the tokenizers library, with parity to the original checked as it goes.

The model's protobuf is parsed here (pieces, scores and kinds, trainer and normaliser settings) and
rebuilt: the precompiled normaliser, removal of extra white space, the metaspace mark for spaces and
the dummy prefix; then a unigram model with the pieces' scores, or, for models of kind BPE, merges
ranked by those scores; byte fallback either way. Control, unknown, unused and byte pieces never match text that reads like their names. Batches are encoded by the library's threads.

In models whose pieces hold the mark only at their beginning, no piece runs over a space into the
next word: the ids of a text with lone spaces only are those of its chunks. Each distinct chunk is
encoded once a worker, and checked once: its ids against the sentencepiece library's, and its
decoding against its normalised form. Any other text is encoded, checked and decoded whole. So parity and round trip of a
text of lone spaces follow from those of all its chunks; those of other texts are checked on the whole text.

Null and empty texts have no ids, decode to the empty text and count as in parity. A text that itself holds
the metaspace mark decodes to a space there, as in the original, so its round trip is false. Repeated rows are coded
alike, empty tables give no row, other columns are ignored.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from learngraph.llm.bpe import blocks

MARK = "▁"
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6  # kinds of pieces
SCHEMA = "doc_id long, n_tokens long, ids_crc32 long, parity boolean, round_trip boolean"


def _fields(data: bytes):
    """(field number, value) of a protobuf message: ints for varints, bytes for the rest."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(kind)
        if size is None:
            if kind != 2:
                raise ValueError("not a SentencePiece model")
            size = varint()
        yield tag >> 3, data[at : at + size]
        at += size


@dataclass
class Spec:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    unk_id: int = 0
    charsmap: bytes = b""
    dummy_prefix: bool = True
    remove_extra: bool = True
    escape: bool = True


def parse(data: bytes) -> Spec:
    spec = Spec()
    for number, value in _fields(data):
        if number == 1:
            piece, score, kind = "", 0.0, NORMAL
            for n, v in _fields(value):
                if n == 1:
                    piece = v.decode("utf-8")
                elif n == 2:
                    (score,) = struct.unpack("<f", v)
                elif n == 3:
                    kind = v
            spec.pieces.append((piece, score, kind))
        elif number == 2:
            for n, v in _fields(value):
                if n == 3:
                    spec.kind = v
                elif n == 35:
                    spec.byte_fallback = bool(v)
                elif n == 40:
                    spec.unk_id = v
        elif number == 3:
            for n, v in _fields(value):
                if n == 2:
                    spec.charsmap = v
                elif n == 3:
                    spec.dummy_prefix = bool(v)
                elif n == 4:
                    spec.remove_extra = bool(v)
                elif n == 5:
                    spec.escape = bool(v)
    return spec


def _matching(spec: Spec, bytes_too: bool) -> list[tuple[str, float]]:
    """The pieces of a unigram model as the library may match them in normalised text: only normal and user-defined ones.

    The others keep their ids under names that no normalised text holds (spaces are marks there). Byte pieces keep their names if the library is
    to fall back on them (``bytes_too``). User-defined pieces score as the original scores them, to be taken wherever they occur.
    """
    best = max((s for _, s, k in spec.pieces if k == NORMAL), default=0.0)
    out = []
    for i, (p, s, k) in enumerate(spec.pieces):
        if k == USER:
            out.append((p, len(p.encode()) * best - 0.1))
        elif k == NORMAL or (k == BYTE and bytes_too):
            out.append((p, s))
        else:
            out.append((f"{' ' if spec.escape else chr(0xFFFE) + chr(0xFFFF)}{i}", 0.0))
    return out


def build(spec: Spec, *, decoding: bool = False, strict: bool = False):
    """The tokenizers library's tokenizer of the model. ``decoding``: of a unigram model with every piece under its own name; ``strict``: one that takes normalised text and leaves what no piece matches unknown."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers

    vocab = {p: i for i, (p, _, _) in enumerate(spec.pieces)}
    if spec.kind == UNIGRAM:
        pieces = [(p, s) for p, s, _ in spec.pieces] if decoding else _matching(spec, spec.byte_fallback and not strict)
        model = models.Unigram(pieces, unk_id=spec.unk_id, byte_fallback=spec.byte_fallback and not strict)
        if strict:
            return Tokenizer(model)
    elif spec.kind == BPE:
        whole = {p: s for p, s, k in spec.pieces if k in (NORMAL, USER, UNUSED)}
        merges = []
        for p, s in whole.items():
            for cut in range(1, len(p)):
                if p[:cut] in whole and p[cut:] in whole:
                    merges.append((-s, vocab[p], cut, p[:cut], p[cut:]))
        merges.sort()
        unknown = spec.pieces[spec.unk_id][0]
        model = models.BPE(vocab, [(a, b) for *_, a, b in merges], unk_token=unknown, fuse_unk=True, byte_fallback=spec.byte_fallback)
    else:
        raise ValueError(f"models of kind {spec.kind} are not supported")
    steps = []
    if spec.charsmap:
        steps.append(normalizers.Precompiled(spec.charsmap))
    if spec.remove_extra:
        steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Strip()]
    if spec.dummy_prefix:
        steps.append(normalizers.Prepend(MARK))
    if spec.escape:
        steps.append(normalizers.Replace(" ", MARK))
    out = Tokenizer(model)
    out.normalizer = normalizers.Sequence(steps)
    back = [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
    out.decoder = decoders.Sequence([*back, decoders.Strip(" ", 1, 0)] if spec.dummy_prefix else back)
    return out


_CODECS: dict[str, Codec] = {}


class Codec:
    def __init__(self, path: str, threads: int = 2, memo: int = 1_000_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        import sentencepiece

        with open(path, "rb") as f:
            data = f.read()
        self.spec = parse(data)
        self.tokenizer = build(self.spec)
        self.decoder = build(self.spec, decoding=True) if self.spec.kind == UNIGRAM else self.tokenizer
        # The library would match the names of byte pieces in a text; texts that hold one are encoded without them, and bytes put in here.
        named = [p for p, _, k in self.spec.pieces if k == BYTE] if self.spec.kind == UNIGRAM and self.spec.byte_fallback else []
        self.byte_ids = {int(p[3:5], 16): i for i, (p, _, k) in enumerate(self.spec.pieces) if k == BYTE}
        self.holds_byte = re.compile("|".join(map(re.escape, named))).search if named else None
        self.strict = build(self.spec, strict=True) if named else None
        self.original = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.memo_size = memo
        self.memo: dict[str, bytes] = {}
        self.wrong: dict[str, tuple[bool, bool]] = {}  # chunks that fail a check, and which
        plain = self.spec.dummy_prefix and self.spec.escape and not self.spec.charsmap
        self.apart = plain and not any(MARK in p.lstrip(MARK) for p, _, _ in self.spec.pieces)

    def _whole(self, texts: list[str]) -> list[tuple[np.ndarray, bool, bool]]:
        """ids, whether they are the original's, whether they decode to the normalised text."""
        got = [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        if self.holds_byte:
            for k, t in enumerate(texts):
                if self.holds_byte(t):
                    got[k] = self._strictly(t)
        want = self.original.encode(texts, num_threads=1)
        back = self.decoder.decode_batch(got, skip_special_tokens=False)
        forms = texts if not self.spec.charsmap and not self.spec.remove_extra else [self.normalised(t) for t in texts]
        return [(np.array(g, np.uint32), g == w, b == t) for g, w, b, t in zip(got, want, back, forms, strict=True)]

    def _strictly(self, text: str) -> list[int]:
        form = self.tokenizer.normalizer.normalize_str(text)
        found = self.strict.encode(form, add_special_tokens=False)
        out = []
        for i, (a, b) in zip(found.ids, found.offsets, strict=True):
            own = [self.byte_ids.get(x) for x in form[a:b].encode()] if i == self.spec.unk_id else [i]
            out += [self.spec.unk_id] if None in own else own
        return out

    def normalised(self, text: str) -> str:
        form = self.tokenizer.normalizer.normalize_str(text).replace(MARK, " ") if text else ""
        return form[1:] if self.spec.dummy_prefix and form else form

    def encode(self, texts: list[str | None]) -> list[tuple[np.ndarray, bool, bool]]:
        texts = [t or "" for t in texts]
        split = [t.split(" ") if self.apart else [""] for t in texts]
        easy = [bool(t) and "" not in s and MARK not in t for t, s in zip(texts, split, strict=True)]
        flat = [c for s, e in zip(split, easy, strict=True) if e for c in s]
        values = list(map(self.memo.get, flat))
        if None in values:
            at = [k for k, v in enumerate(values) if v is None]
            new = list({flat[k] for k in at})
            learned = {}
            for c, (ids, same, back) in zip(new, self._whole(new), strict=True):
                learned[c] = ids.tobytes()
                if not (same and back):
                    self.wrong[c] = (same, back)
            for k in at:
                values[k] = learned[flat[k]]
            room = max(0, self.memo_size - len(self.memo))
            self.memo.update([(c, learned[c]) for c in new if len(c) <= 64][:room])
        rest = iter(self._whole([t for t, e in zip(texts, easy, strict=True) if not e]))
        out, at = [], 0
        for s, e in zip(split, easy, strict=True):
            if not e:
                out.append(next(rest))
                continue
            ids = np.frombuffer(b"".join(values[at : at + len(s)]), np.uint32)
            at += len(s)
            bad = [self.wrong[c] for c in s if c in self.wrong] if self.wrong else []
            out.append((ids, all(b[0] for b in bad), all(b[1] for b in bad)))
        if len(self.wrong) > self.memo_size:
            self.wrong, self.memo = {}, {}
        return out

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.decoder.decode_batch(ids, skip_special_tokens=False)


def codec(path: str) -> Codec:
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def encode(docs: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit), parity and round_trip; and ids, if asked for."""

    def run(batches):
        held = codec(model_path)
        for batch in batches:
            names, texts = batch.column(0), batch.column(1).to_pylist()
            for a, b in blocks(texts):
                done = held.encode(texts[a:b])
                columns = [names.slice(a, b - a), pa.array([len(i) for i, _, _ in done], pa.int64()), pa.array([zlib.crc32(i.astype("<u4").tobytes()) for i, _, _ in done], pa.int64())]
                columns += [pa.array([s for _, s, _ in done], pa.bool_()), pa.array([r for _, _, r in done], pa.bool_())]
                if with_ids:
                    columns.append(pa.array([i.astype(np.int32) for i, _, _ in done], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_crc32", "parity", "round_trip", "ids"][: len(columns)])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, SCHEMA + (", ids array<int>" if with_ids else ""))


def decode(encoded: DataFrame, model_path: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text; null ids give the empty text."""

    def run(batches):
        held = codec(model_path)
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                texts = held.decode([i or [] for i in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col(id_col).cast("long"), F.col(ids_col).cast("array<int>")).mapInArrow(run, "doc_id long, text string")
