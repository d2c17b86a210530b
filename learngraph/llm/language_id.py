"""Language of documents: script ranges, character trigrams per word and Viterbi over the words.

Fitting counts character trigrams of each language's sample; a word's score for a language is
the sum of its trigrams' log probabilities. A language is a candidate for a word only if its
sample used the word's script for at least ``MIN_SCRIPT`` of its letters (all are, where none
did). Viterbi over the words of a text with a penalty for each change of language labels spans;
the prediction is the language of most letters. All steps run over whole Arrow batches: texts as
code-point arrays, and Viterbi over the k-th words of all texts at once.

A calibrated fit also learns how far texts of its languages fall below the log probability
expected of them: half of the learned rows are judged by the table of the other half. ``verdict``
then tells texts that fall well below nearly all of them, whatever their script.

Null texts and texts without a letter (combining marks alone are none) get ``und`` and score 0; so does everything if there is no
row to learn from. Texts of any length count in full. Ties go to the language first in name. Repeated rows
are judged alike, empty tables give no row, and other columns, whatever their names, play no part.
"""

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from learngraph.llm.shared import give_back, written
from learngraph.llm.unicode_tables import SCRIPTS, code_points, letters, lower, proper_letters, scripts

BUCKETS = 1 << 15
MIN_SCRIPT = 0.01
LOWEST, MARGIN = 0.001, 1.5  # a text is of no learned language where it stands this much below the lowest thousandth of the learned rows
SCHEMA = "doc_id long, lang_pred string, score double, spans array<struct<first:long,end:long,lang:string>>"
_CHARS, _PART = 1_000_000, 200_000  # of texts labelled at once, and of those whose trigrams are held at once


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # BUCKETS x langs: log probabilities of trigrams
    allowed: np.ndarray  # scripts x langs
    average: np.ndarray | None = None  # langs: log probability of their learned trigrams
    between: float = 1.0  # spread of texts' mean excess (see ``_label``), and of one trigram's
    within: float = 1.0
    floor: float = -np.inf  # least standing of a text in a learned language


def _trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """bucket of each trigram; the place of each word's first trigram; the words' first and last (exclusive) code points; texts' begins.

    A word is a run of letters; its trigrams see a space before and after it, n + 1 of them for n letters.
    """
    flat, begins = code_points(texts)
    letter = letters()[flat]
    at = np.flatnonzero(letter)
    if not len(at):
        none = np.zeros(0, np.int64)
        return none, none, none, none, begins
    c = np.where(letter, lower()[flat], np.uint32(32))
    p1 = np.concatenate([[np.uint32(32)], c[:-1]])
    p2 = np.concatenate([[np.uint32(32)], p1[:-1]])
    p2 = np.where(p1 == 32, np.uint32(32), p2)
    with np.errstate(over="ignore"):
        h = (c * np.uint32(0x9E3779B1)) ^ (p1 * np.uint32(0x85EBCA6B) + np.uint32(0x165667B1)) ^ (p2 * np.uint32(0xC2B2AE35) << np.uint32(1))
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        bucket = h >> np.uint32(32 - 15)
    first = at[np.concatenate([[True], np.diff(at) > 1])]
    end = at[np.concatenate([np.diff(at) > 1, [True]])] + 1
    counted = letter | (p1 != 32)  # letters, and the place after each word
    index = np.cumsum(counted) - 1
    return bucket[counted], index[first], first, end, begins


def _blocks(texts: list[str], chars: int = _CHARS):
    a, held = 0, 0
    for k, t in enumerate(texts):
        held += len(t) + 1
        if held >= chars:
            yield a, k + 1
            a, held = k + 1, 0
    if a < len(texts):
        yield a, len(texts)


def fit(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", key: Column, rows_per_language: int = 1500, calibrated: bool = False) -> Model:
    """Learn from about ``rows_per_language`` rows of each language, drawn by the hash of ``key``.

    What comes to the driver is a count per language and bucket, whatever the input, and three figures of each
    drawn row if ``calibrated``.
    """
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = {r[0]: r[1] for r in known.groupBy(lang_col).count().collect()}
    if not sizes:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros((len(SCRIPTS), 0), bool))
    share = F.lit(0.0)
    for lang, n in sizes.items():
        share = F.when(F.col(lang_col) == lang, min(1.0, rows_per_language / n)).otherwise(share)
    drawn = known.where(F.pmod(F.xxhash64(key), F.lit(1 << 20)) < share * (1 << 20))
    half = F.pmod(F.xxhash64(key, F.lit(1)), F.lit(2)).cast("int") if calibrated else F.lit(0)
    drawn = drawn.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), half.alias("half"))
    if calibrated:
        drawn = written(drawn, "language-sample")  # read twice

    def count(batches):
        sums: dict[tuple[str, int], np.ndarray] = {}
        for batch in batches:
            langs, texts = list(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)), batch.column(1).to_pylist()
            for lang in set(langs):
                own = [t for g, t in zip(langs, texts, strict=True) if g == lang]
                total = sums.setdefault(lang, np.zeros(BUCKETS + len(SCRIPTS), np.int64))
                for a, b in _blocks(own):
                    total[:BUCKETS] += np.bincount(_trigrams(own[a:b])[0], minlength=BUCKETS)
                    flat, _ = code_points(own[a:b])
                    total[BUCKETS:] += np.bincount(scripts()[flat[letters()[flat]]], minlength=len(SCRIPTS))
        for (lang, part), total in sums.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array([part] * len(at), pa.int32()), pa.array(at), pa.array(total[at])], names=["lang", "half", "bucket", "n"])

    counts = drawn.mapInArrow(count, "lang string, half int, bucket long, n long").groupBy("lang", "half", "bucket").agg(F.sum("n").alias("n")).collect()
    model = _learned(counts)
    if calibrated and counts:
        _calibrate(model, drawn, [_learned([r for r in counts if r["half"] != part]) for part in (0, 1)])
    return model


def _learned(counts: list) -> Model:
    """The model of counts by language, half and bucket."""
    langs = sorted({r["lang"] for r in counts})
    seen = np.zeros((BUCKETS + len(SCRIPTS), len(langs)))
    for r in counts:
        seen[r["bucket"], langs.index(r["lang"])] += r["n"]
    grams, used = seen[:BUCKETS], seen[BUCKETS:]
    table = np.log((grams + 0.05) / (grams.sum(0) + 0.05 * BUCKETS))
    return Model(langs, table.astype(np.float32), used >= MIN_SCRIPT * np.maximum(1, used.sum(0)), (grams * table).sum(0) / np.maximum(1, grams.sum(0)))


def _calibrate(model: Model, drawn: DataFrame, judges: list[Model]) -> None:
    """Set the model's spreads and floor from the learned rows, each judged by the model of the half it isn't in."""
    shared = drawn.sparkSession.sparkContext.broadcast(judges)

    def weigh(batches):
        for batch in batches:
            texts, halves = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for part in (0, 1):
                own = [t for t, h in zip(texts, halves, strict=True) if h == part]
                for a, b in _blocks(own):
                    n, total, square = _label(shared.value[part], own[a:b])[3]
                    yield pa.RecordBatch.from_arrays([pa.array(n), pa.array(total), pa.array(square)], names=["n", "total", "square"])

    rows = drawn.mapInArrow(weigh, "n double, total double, square double").where("n > 0").collect()
    if not rows:
        return
    n, total, square = np.array(rows, float).T
    model.within = float(np.sqrt(max(1e-6, square.sum() / n.sum())))
    model.between = float(max(1e-3, 1.4826 * np.median(np.abs(total / n))))
    model.floor = MARGIN * min(-3.0, float(np.quantile(standing(model, n, total), LOWEST)))


def standing(model: Model, n: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Mean excess of texts of ``n`` trigrams in spreads to be expected at that length; 0 without trigrams."""
    n = np.maximum(n, 1)
    return total / n / np.sqrt(model.between**2 + model.within**2 / n)


def viterbi(scores: np.ndarray, texts: np.ndarray, n_texts: int, penalty: float) -> np.ndarray:
    """Best language of each word: ``scores`` is words x languages, ``texts`` the (rising) text number of each word."""
    n, k = scores.shape
    out = np.zeros(n, np.int64)
    if not n or k < 2:
        return out
    lengths = np.bincount(texts, minlength=n_texts)
    begins = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    order = np.argsort(-lengths, kind="stable")
    begins, lengths = begins[order], lengths[order]
    longest = int(lengths[0])
    active = np.searchsorted(-lengths, -np.arange(longest), side="left")  # texts longer than t
    stays = np.zeros((n, k), bool)
    best_before = np.zeros(n, np.uint8)
    value = scores[begins[: active[0]]].copy()
    state = np.zeros(len(value), np.int64)  # of each text's last word
    for t in range(1, longest):
        m = active[t]
        if m < len(value):
            state[m : len(value)] = value[m:].argmax(1)
            value = value[:m]
        at = begins[:m] + t
        top = value.argmax(1)
        switch = value[np.arange(m), top] - penalty
        stay = value >= switch[:, None]
        stays[at] = stay
        best_before[at] = top
        value = np.where(stay, value, switch[:, None]) + scores[at]
    state[: len(value)] = value.argmax(1)
    out[begins[: active[0]] + lengths[: active[0]] - 1] = state
    for t in range(longest - 1, 0, -1):
        at = begins[: active[t]] + t
        now = out[at]
        out[at - 1] = np.where(stays[at, now], now, best_before[at])
    return out


def label(model: Model, texts: list[str | None], penalty: float = 10.0, temperature: float = 3.0) -> tuple[list[str], np.ndarray, list[tuple[np.ndarray, ...]]]:
    """For each text its language, score and spans (first, end, language number).

    The score is the share of the letters in words of that language, times the probability that
    the summed scores, at this temperature, give it.
    """
    return _label(model, texts, penalty, temperature)[:3]


def _label(model: Model, texts: list[str | None], penalty: float = 10.0, temperature: float = 3.0):
    """``label``, and each text's trigrams, their excess and the sum of its words' squared excess.

    A word's excess is its log probability in the language it was given, less what that language's
    trigrams have on average.
    """
    texts = [t or "" for t in texts]
    n, k = len(texts), len(model.langs)
    none, words, bare = np.zeros(0, np.int64), [], np.ones(n, bool)
    for a, b in _blocks(texts, _PART):
        bucket, at, first, end, begins = _trigrams(texts[a:b])
        if k and len(at):
            points, _ = code_points(texts[a:b])
            proper = np.concatenate([[0], np.cumsum(proper_letters()[points])])
            bare[a:b] = proper[begins[1:]] == proper[begins[:-1]]
            owner = np.searchsorted(begins, first, side="right") - 1
            words.append((np.add.reduceat(model.table[bucket], at, axis=0), model.allowed[scripts()[points[first]]], owner + a, first - begins[owner], end - begins[owner]))
    if not words:
        return ["und"] * n, np.zeros(n), [(none, none, none)] * n, np.zeros((3, n))
    sums, allowed, owner, first, end = (np.concatenate(x) for x in zip(*words, strict=True))
    scores = np.where(allowed | ~allowed.any(1, keepdims=True), sums, sums - np.float32(1e6))
    best = viterbi(scores, owner, n, penalty)
    size = end - first
    excess = sums[np.arange(len(best)), best] - (size + 1) * (0 if model.average is None else model.average[best])
    fits = np.stack([np.bincount(owner, weights=w, minlength=n) for w in (size + 1, excess, excess**2)])
    held = np.bincount(owner * k + best, weights=size, minlength=n * k).reshape(n, k)
    total = np.where(bare, 0, held.sum(1))
    pick = held.argmax(1)
    sums = np.stack([np.bincount(owner, weights=scores[:, j], minlength=n) for j in range(k)], 1) / temperature
    sure = 1 / np.exp(np.clip(sums - sums[np.arange(n), pick][:, None], -700, 700)).sum(1)
    score = np.where(total > 0, held[np.arange(n), pick] / np.maximum(total, 1) * np.minimum(1.0, sure), 0.0)
    change = np.concatenate([[True], (np.diff(best) != 0) | (np.diff(owner) != 0)])
    run = np.flatnonzero(change)
    run_end = np.append(run[1:], len(best)) - 1
    edge = np.searchsorted(owner[run], np.arange(n + 1))
    edge = np.stack([edge[:-1], np.where(bare, edge[:-1], edge[1:])], 1)
    spans = [(first[run[a:b]], end[run_end[a:b]], best[run[a:b]]) for a, b in edge.tolist()]
    return [model.langs[p] if t else "und" for p, t in zip(pick, total, strict=True)], score, spans, fits


def identify(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", spans: bool = True) -> DataFrame:
    """doc_id, lang_pred, score and the spans of one language (code points of the text, end exclusive; empty unless ``spans``)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    span = pa.struct([("first", pa.int64()), ("end", pa.int64()), ("lang", pa.string())])

    def run(batches):
        held = shared.value
        names = pa.array(held.langs, pa.string())
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for a, b in _blocks([t or "" for t in texts]):
                langs, score, found = label(held, texts[a:b])
                offsets = np.concatenate([[0], np.cumsum([len(f[0]) if spans else 0 for f in found])]).astype(np.int32)
                if offsets[-1]:
                    first, end, which = (np.concatenate([f[i] for f in found]) for i in range(3))
                    inner = pa.StructArray.from_arrays([pa.array(first), pa.array(end), names.take(pa.array(which))], fields=list(span))
                else:
                    inner = pa.array([], span)
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(langs, pa.string()), pa.array(score), pa.ListArray.from_arrays(pa.array(offsets), inner)], names=["doc_id", "lang_pred", "score", "spans"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, SCHEMA)


def verdict(docs: DataFrame, model: Model, text_col: str = "text") -> Column:
    """A struct column beside the rows' own: lang_pred, score, foreign (the share of letters of scripts that no learned language uses) and strange (less like the learned languages than nearly all learned rows)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = StructType([StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("foreign", DoubleType()), StructField("strange", BooleanType())])

    @F.pandas_udf(schema)
    def judge(texts: pd.Series) -> pd.DataFrame:
        held, parts = shared.value, []
        all_texts = [t or "" for t in texts]
        used = held.allowed.any(1)
        for a, b in _blocks(all_texts):
            langs, score, _, fits = _label(held, all_texts[a:b])
            flat, begins = code_points(all_texts[a:b])
            at = np.flatnonzero(letters()[flat])
            owner = np.searchsorted(begins, at, side="right") - 1
            total = np.bincount(owner, minlength=b - a)
            out = np.bincount(owner, weights=~used[scripts()[flat[at]]], minlength=b - a)
            parts.append(pd.DataFrame({"lang_pred": langs, "score": score, "foreign": out / np.maximum(total, 1), "strange": standing(held, fits[0], fits[1]) < held.floor}))
        give_back()
        return pd.concat(parts, ignore_index=True) if parts else pd.DataFrame({"lang_pred": pd.Series([], dtype=str), "score": pd.Series([], dtype=float), "foreign": pd.Series([], dtype=float), "strange": pd.Series([], dtype=bool)})

    return judge(F.col(text_col).cast("string"))


def belongs(docs: DataFrame, model: Model, text_col: str = "text") -> Column:
    """Whether a text is of the learned languages, for a filter on ``docs``: it has letters, most of scripts they use, and is not strange (see ``verdict``). True for all where nothing was learned."""
    if not model.langs:
        return F.lit(True)
    judged = verdict(docs, model, text_col)
    return (judged["lang_pred"] != "und") & (judged["foreign"] <= 0.5) & ~judged["strange"]
