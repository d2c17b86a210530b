"""The overlap join against a plain version: layers, hot keywords in several blocks, long keyword lists, fresh objects."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from learngraph.operators import blocks, overlap


def plain(objects, words, least, fresh=None):
    out = set()
    for a, la, va in objects:
        for b, lb, vb in objects:
            if a == b or (fresh is not None and a not in fresh and b not in fresh) or la is None or lb is None:
                continue
            n = len(words.get(a, set()) & words.get(b, set()))
            x, y = (np.zeros(4) if v is None else np.array(v, float) for v in (va, vb))
            norm = np.linalg.norm(x) * np.linalg.norm(y)
            if la < lb and n >= 2:
                out.add((a, b, True))
            elif la == lb and a < b and n >= 1 and (x @ y / norm if norm else 0.0) >= least:
                out.add((a, b, False))
    return out


def made(seed, n=60, hot=True, longest=6):
    rng = random.Random(seed)
    objects = [(f"o{k:03}", rng.choice([1, 2, 3]), [rng.gauss(0, 1) for _ in range(4)]) for k in range(n)]
    objects[3] = (objects[3][0], 2, None)
    objects[4] = (objects[4][0], None, objects[4][2])
    objects[5] = (objects[5][0], 2, [0.0] * 4)
    words = {i: {f"w{rng.randrange(25)}" for _ in range(rng.randrange(longest))} | ({"hot"} if hot and rng.random() < 0.6 else set()) | ({"warm"} if rng.random() < 0.4 else set()) for i, _, _ in objects}
    return objects, words


def frames(spark, objects, words):
    o = spark.createDataFrame(objects, "id string, layer int, vector array<float>")
    k = spark.createDataFrame([(i, w) for i, ws in words.items() for w in [*ws, *list(ws)[:1]]] + [(None, "hot"), ("o000", None), ("unknown", "hot")], "id string, keyword string")
    return o, k


@pytest.mark.parametrize(("seed", "block", "longest"), [(0, 512, 6), (1, 4, 6), (2, 7, 60), (3, 3, 3)])
def test_layered_pairs_equal_plain_version(spark, monkeypatch, seed, block, longest):
    monkeypatch.setattr(overlap, "BLOCK", block)
    objects, words = made(seed, longest=longest)
    objects = [(i, x, v and [float(np.float32(c)) for c in v]) for i, x, v in objects]
    o, k = frames(spark, objects, words)
    got = [tuple(r) for r in overlap.layered_pairs(o, k, 0.3).collect()]
    assert len(got) == len(set(got)) and set(got) == plain(objects, words, 0.3)
    fresh = {i for i, _, _ in objects[40:]}
    some = [tuple(r) for r in overlap.layered_pairs(o, k, 0.3, o.where(F.col("id").isin(list(fresh))).select("id")).collect()]
    assert len(some) == len(set(some)) and set(some) == plain(objects, words, 0.3, fresh)


def test_layered_pairs_of_nothing(spark):
    o, k = frames(spark, *made(0))
    assert overlap.layered_pairs(o.limit(0), k, 0.3).count() == 0 and overlap.layered_pairs(o, k.limit(0), 0.3).count() == 0


def test_pairs_inside_blocks():
    block = np.array([5, 5, 5, 1, 2, 2, 9])
    for limit in (1, 2, 100):
        found = [(int(a), int(b)) for i, j in blocks.pairs_inside(block, limit) for a, b in zip(i, j, strict=True)]
        assert sorted(found) == [(0, 1), (0, 2), (1, 2), (4, 5)]


def test_common_of_short_and_long_sets():
    rng = np.random.default_rng(0)
    for longest in (5, 40):
        sets = [np.unique(rng.integers(0, 60, rng.integers(0, longest))) for _ in range(30)]
        at = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
        i, j = np.triu_indices(30, 1)
        n, least = blocks.common(np.concatenate(sets), at, i, j)
        want = [set(sets[a].tolist()) & set(sets[b].tolist()) for a, b in zip(i, j, strict=True)]
        assert n.tolist() == [len(w) for w in want] and least.tolist() == [min(w, default=np.iinfo(np.int64).max) for w in want]


def test_layered_pairs_of_shared_vectors_near_the_least_cosine(spark):
    """Vectors that objects name, some at the least cosine but for less than a byte's step, some of other lengths: what travels is the name and a byte a component."""
    turn = [0.3 + d for d in (-1e-2, -1e-4, -1e-7, 1e-7, 1e-4, 1e-2)]
    vectors = [("z", [1.0, 0.0, 0.0]), *((f"v{k}", [c, float(np.sqrt(1 - c * c)), 0.0]) for k, c in enumerate(turn)), ("short", [1.0, 0.0]), ("none", None), ("zero", [0.0, 0.0, 0.0])]
    objects = [(k, 1, ref) for k, (ref, _) in enumerate(vectors)] + [(50, 1, "z"), (51, 1, "unknown"), (52, 2, None)]
    o, v = spark.createDataFrame(objects, "id long, layer int, ref string"), spark.createDataFrame(vectors, "ref string, vector array<double>")
    k = spark.createDataFrame([(i, w) for i, _, _ in objects for w in (["hot", "warm"] if i in (0, 52) else ["hot"])], "id long, keyword string")
    got = {tuple(r) for r in overlap.layered_pairs(o, k, 0.3, vectors=v).collect()}
    full = dict(vectors)
    plainly = [(i, layer, full.get(ref)) for i, layer, ref in objects]
    cosine = lambda x, y: 0.0 if x is None or y is None or len(x) != len(y) or not any(x) or not any(y) else float(np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y))
    want = {(a, b, False) for a, la, x in plainly for b, lb, y in plainly if a < b and la == lb and cosine(x, y) >= 0.3}
    assert got == want | {(0, 52, True)}
    assert {tuple(r) for r in overlap.layered_pairs(o, k, -1.0, vectors=v).where("NOT across").collect()} == {(a, b, False) for a, la, _ in plainly for b, lb, _ in plainly if a < b and la == lb}
