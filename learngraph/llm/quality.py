"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE_WORDS`` words (the last one shorter). A passage's
features are the shares of its pairs of neighbouring character classes and a few figures on its
words; an encoder h = relu(W x + b) and gated attention a = softmax(w . (tanh(V h) * sigmoid(U h)))
give the document's representation sum(a h), and a logistic unit on it the score. Only the
document's label is learned from: which passages matter is what the attention finds.

Fitting takes a bounded sample of labelled rows (``max_rows``, and fewer where their passages
would exceed ``MAX_PASSAGES``), each with all of its passages; scoring takes every whole text too.
Null and empty texts are a bag of one empty passage. Labels that are null, or repeat for a
document, count once at most (the larger label); with no label of one kind the score is the rate. Repeated rows score
alike, empty tables give no row, other columns, whatever their names, play no part.
"""

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType
from pyspark.sql.window import Window

from learngraph.llm.shared import give_back
from learngraph.llm.unicode_tables import TOP, code_points, letters, lower

PASSAGE_WORDS = 100
MAX_PASSAGES = 1 << 18  # of all rows fitted on, about 130 MB: half of each label, whole rows, the last of them going beyond
CLASSES = 16
N_FEATURES = CLASSES * CLASSES + 6
_CHARS = 200_000
_PUNCTUATION = ".,!?%&#*$|"  # each a class of its own


def _class_table() -> np.ndarray:
    global _TABLE
    if _TABLE is None:
        table = np.full(TOP, 4, np.uint8)  # other
        table[letters()] = 0
        table[np.flatnonzero(letters() & (lower() != np.arange(TOP)))] = 1  # upper case
        table[ord("0") : ord("9") + 1] = 2
        table[[ord(c) for c in " \t\r\f\v "]] = 3
        table[ord("\n")] = 5
        for k, c in enumerate(_PUNCTUATION):
            table[ord(c)] = 6 + k
        _TABLE = table
    return _TABLE


_TABLE: np.ndarray | None = None


@dataclass
class Model:
    rate: float
    weights: dict[str, np.ndarray] | None  # None: no label of one kind
    mean: np.ndarray
    scale: np.ndarray


def passages(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage, and the (rising) number of its text."""
    flat, begins = code_points(texts)
    kind = _class_table()[flat]
    space = (kind == 3) | (kind == 5)
    first = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    owner = np.searchsorted(begins, first, side="right") - 1
    n = len(texts)
    per_text = np.bincount(owner, minlength=n) if len(first) else np.zeros(n, np.int64)
    base = np.concatenate([[0], np.cumsum(np.maximum(1, -(-per_text // PASSAGE_WORDS)))])
    rank = np.arange(len(first)) - np.concatenate([[0], np.cumsum(per_text)])[owner] if len(first) else np.zeros(0, np.int64)
    word_passage = base[owner] + rank // PASSAGE_WORDS
    total = int(base[-1])
    # Every code point belongs to the passage of the last word that began in its text, or the text's first.
    marks = np.zeros(len(flat), np.int64)
    marks[begins[:-1]] = base[:-1]
    marks[first] = word_passage
    passage = np.maximum.accumulate(marks)
    pair = kind[:-1].astype(np.int64) * CLASSES + kind[1:]
    inside = passage[:-1] == passage[1:]
    counts = np.bincount(passage[:-1][inside] * (CLASSES * CLASSES) + pair[inside], minlength=total * CLASSES * CLASSES).reshape(total, -1)
    out = np.zeros((total, N_FEATURES), np.float32)
    out[:, : CLASSES * CLASSES] = np.log1p(100 * counts / np.maximum(1, counts.sum(1, keepdims=True)))
    if len(first):
        words = np.maximum(1, np.bincount(word_passage, minlength=total))
        low = lower()[flat].astype(np.uint64)
        starts = np.concatenate([[0], first])
        within = (np.arange(len(flat)) - np.repeat(starts, np.diff(np.append(starts, len(flat))))).astype(np.uint64)
        with np.errstate(over="ignore"):
            mixed = np.where(space, np.uint64(0), (low + np.uint64(1)) * (within * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0xBF58476D1CE4E5B9)))
            name = np.add.reduceat(mixed, first)
        length = np.add.reduceat((~space).astype(np.int64), first)
        same = np.concatenate([[False], (name[1:] == name[:-1]) & (word_passage[1:] == word_passage[:-1])])
        order = np.lexsort((name, word_passage))
        fresh = np.concatenate([[True], (np.diff(name[order]) != 0) | (np.diff(word_passage[order]) != 0)])
        mean = np.bincount(word_passage, weights=length, minlength=total) / words
        square = np.bincount(word_passage, weights=length.astype(float) ** 2, minlength=total) / words
        k = CLASSES * CLASSES
        out[:, k] = np.bincount(word_passage, weights=same, minlength=total) / words
        out[:, k + 1] = np.bincount(word_passage[order][fresh], minlength=total) / words
        out[:, k + 2] = np.log1p(mean)
        out[:, k + 3] = np.log1p(np.sqrt(np.maximum(0, square - mean**2)))
        out[:, k + 4] = np.log1p(words)
        out[:, k + 5] = np.log1p(np.bincount(word_passage, weights=length, minlength=total))
    return out, np.repeat(np.arange(n), np.diff(base))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def _forward(w: dict[str, np.ndarray], x: np.ndarray, starts: np.ndarray, owner: np.ndarray):
    h = np.maximum(0, x @ w["W"] + w["b"])
    t, s = np.tanh(h @ w["V"]), _sigmoid(h @ w["U"])
    e = (t * s) @ w["w"]
    e = np.exp(e - np.maximum.reduceat(e, starts)[owner])
    a = e / np.add.reduceat(e, starts)[owner]
    z = np.add.reduceat(a[:, None] * h, starts, axis=0)
    return h, t, s, a, z, _sigmoid(z @ w["c"] + w["d"])


def train(x: np.ndarray, owner: np.ndarray, y: np.ndarray, *, width: int = 32, gate: int = 16, epochs: int = 40, batch: int = 256, rate: float = 3e-3, decay: float = 1e-4, seed: int = 7) -> dict[str, np.ndarray]:
    """Adam on the mean log loss; ``owner`` is rising and names a row of ``y`` for each passage."""
    rng = np.random.default_rng(seed)
    d = x.shape[1]
    shapes = {"W": (d, width), "b": (width,), "V": (width, gate), "U": (width, gate), "w": (gate,), "c": (width,), "d": ()}
    w = {k: (rng.normal(0, (1 / max(1, v[0])) ** 0.5, v) if k not in "bd" else np.zeros(v)).astype(np.float32) for k, v in shapes.items()}
    m = {k: np.zeros_like(v) for k, v in w.items()}
    v2 = {k: np.zeros_like(v) for k, v in w.items()}
    edge = np.searchsorted(owner, np.arange(len(y) + 1))
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        for k in range(0, len(order), batch):
            pick = order[k : k + batch]
            rows = np.concatenate([np.arange(edge[i], edge[i + 1]) for i in pick])
            sizes = edge[pick + 1] - edge[pick]
            own, starts = np.repeat(np.arange(len(pick)), sizes), np.concatenate([[0], np.cumsum(sizes)[:-1]])
            bx, by = x[rows], y[pick]
            h, t, s, a, z, p = _forward(w, bx, starts, own)
            gz = ((p - by) / len(pick))[:, None] * w["c"]
            g = {"c": z.T @ (p - by) / len(pick), "d": np.mean(p - by)}
            gh = a[:, None] * gz[own]
            ga = (h * gz[own]).sum(1)
            ge = a * (ga - np.add.reduceat(a * ga, starts)[own])
            g["w"] = (t * s).T @ ge
            gt, gs = ge[:, None] * w["w"] * s * (1 - t * t), ge[:, None] * w["w"] * t * s * (1 - s)
            g["V"], g["U"] = h.T @ gt, h.T @ gs
            gh = (gh + gt @ w["V"].T + gs @ w["U"].T) * (h > 0)
            g["W"], g["b"] = bx.T @ gh, gh.sum(0)
            step += 1
            now = rate * 0.5 * (1 + np.cos(np.pi * epoch / epochs))
            for key, grad in g.items():
                grad = np.asarray(grad, np.float32) + (decay * w[key] if key not in "bd" else 0)
                m[key] = 0.9 * m[key] + 0.1 * grad
                v2[key] = 0.999 * v2[key] + 0.001 * grad * grad
                w[key] = (w[key] - now * (m[key] / (1 - 0.9**step)) / (np.sqrt(v2[key] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return w


def _blocks(texts: list[str | None]):
    a, held = 0, 0
    for k, t in enumerate(texts):
        held += len(t or "") + 1
        if held >= _CHARS:
            yield a, k + 1
            a, held = k + 1, 0
    if a < len(texts):
        yield a, len(texts)


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = 8000) -> Model:
    """Learn from about ``max_rows`` labelled documents at most, half of each label, drawn by the hash of their id.

    A label of no more than half of ``max_rows`` documents is taken whole; the intercept is set back to the true rate.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg((F.max(label_col) > 0).cast("int").alias("_y"))
    sizes = {r["_y"]: r["n"] for r in known.groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n = sum(sizes.values())
    mean, scale = np.zeros(N_FEATURES, np.float32), np.ones(N_FEATURES, np.float32)
    if len(sizes) < 2:
        return Model(float(sizes.get(1, 0) > 0) if n else 0.5, None, mean, scale)
    share = {label: min(1.0, max_rows / 2 / held) for label, held in sizes.items()}
    drawn = known.where(F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) < F.when(F.col("_y") == 1, share[1]).otherwise(share[0]) * (1 << 30))
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(drawn), "_id")  # about max_rows ids and labels

    def run(batches):
        for batch in batches:
            ids, texts, ys = (batch.column(i).to_pylist() for i in range(3))
            for a, b in _blocks(texts):
                x, owner = passages([t or "" for t in texts[a:b]])
                edge = np.searchsorted(owner, np.arange(b - a + 1))
                keep = [x[edge[i] : edge[i + 1]].astype(np.float16).tobytes() for i in range(b - a)]
                yield pa.RecordBatch.from_arrays([pa.array([int(i) for i in ids[a:b]], pa.int64()), pa.array(ys[a:b], pa.int32()), pa.array(np.diff(edge), pa.int64()), pa.array(keep, pa.binary())], names=["id", "y", "n", "x"])

    found = rows.select("_id", "_text", "_y").mapInArrow(run, "id long, y int, n long, x binary")
    before = Window.partitionBy("y").orderBy(F.xxhash64("id", F.lit(1)), "id", "x").rowsBetween(Window.unboundedPreceding, -1)
    found = found.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    found = found.withColumn("fits", F.col("before") < MAX_PASSAGES // 2)
    bags = sorted(found.select("id", "y", "fits", F.when(F.col("fits"), F.col("x")).alias("x")).collect(), key=lambda r: (r["id"], r["x"] or b""))
    seen = [sum(r["y"] == label for r in bags) for label in (0, 1)]
    bags = [r for r in bags if r["fits"]]
    if min(seen) == 0:
        return Model(sizes.get(1, 0) / n, None, mean, scale)
    for label in (0, 1):  # rows that did not fit lower the share their label was drawn at
        share[label] *= sum(r["y"] == label for r in bags) / seen[label]
    parts = [np.frombuffer(r["x"], np.float16).reshape(-1, N_FEATURES) for r in bags]
    x = np.concatenate(parts).astype(np.float32)
    owner = np.repeat(np.arange(len(bags)), [len(p) for p in parts])
    mean, scale = x.mean(0), x.std(0) + np.float32(0.05)
    y = np.array([r["y"] for r in bags], np.float32)
    del bags, parts
    weights = train((x - mean) / scale, owner, y)
    weights["d"] = np.float32(weights["d"] + np.log(share[0] / share[1]))  # the sample's odds are share[1] / share[0] times the true ones
    return Model(sizes[1] / n, weights, mean, scale)


def score_texts(model: Model, texts: list[str | None]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Score of each text, and its passages' attention."""
    out, attention = np.zeros(len(texts)), []
    for a, b in _blocks(texts):
        if model.weights is None:
            out[a:b] = model.rate
            attention += [np.zeros(0)] * (b - a)
            continue
        x, owner = passages([t or "" for t in texts[a:b]])
        starts = np.searchsorted(owner, np.arange(b - a))
        _, _, _, att, _, p = _forward(model.weights, (x - model.mean) / model.scale, starts, owner)
        out[a:b] = p
        attention += np.split(att, starts[1:])
    return out, attention


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1), n_passages and top_passage, the number from 0 of the passage of most weight."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            p, attention = score_texts(shared.value, batch.column(1).to_pylist())
            counts = [len(a) for a in attention]
            top = [int(a.argmax()) if len(a) else 0 for a in attention]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array(counts, pa.int64()), pa.array(top, pa.int64())], names=["doc_id", "score", "n_passages", "top_passage"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, score double, n_passages long, top_passage long")


def verdict(docs: DataFrame, model: Model, text_col: str = "text") -> Column:
    """The score as a column beside the rows' own."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(DoubleType())
    def judge(texts: pd.Series) -> pd.Series:
        out = pd.Series(score_texts(shared.value, list(texts))[0])
        give_back()
        return out

    return judge(F.col(text_col).cast("string"))
