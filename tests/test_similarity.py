"""Exact similarity joins and deduplication against plain versions: many cells and blocks, copies, zero and odd vectors, streams."""

import numpy as np
import pytest

from learngraph.operators import vectors as V
from learngraph.streaming import deduplication


def cloud(seed, n=160, dim=5):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 1, (8, dim))
    x = centres[rng.integers(0, 8, n)] + rng.normal(0, 0.35, (n, dim))
    x[10:22] = x[5]
    x[30:34] = 2 * x[29]
    x = x.astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows[50], rows[51], rows[52], rows[53] = (50, None), (51, [0.0] * dim), (52, [float("nan")] * dim), (53, [1.0] * (dim - 1) + [None])
    return rows


def unit(v):
    if v is None or any(c is None or not np.isfinite(c) for c in v) or not any(v):
        return None
    return np.array(v, float) / np.linalg.norm(v)


def plain_pairs(rows, low, high=np.inf):
    u = {i: unit(v) for i, v in rows}
    cos = lambda a, b: 0.0 if u[a] is None or u[b] is None else float(u[a] @ u[b])
    ids = sorted(u)
    return {(a, b): cos(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if low <= cos(a, b) <= high}


def plain_kept(rows, least):
    u, out = {i: unit(v) for i, v in rows}, []
    for i, _ in rows:
        if u[i] is None or not any(u[k] is not None and u[k] @ u[i] >= least for k in out):
            out.append(i)
    return out


@pytest.mark.parametrize(("low", "high", "kind", "block"), [(0.9, np.inf, "float", 16), (0.3, 0.8, "double", 16), (-0.2, 0.1, "float", 50), (0.95, np.inf, "float", 4096)])
def test_similar_pairs_equal_plain_version(spark, monkeypatch, low, high, kind, block):
    monkeypatch.setattr(V, "BLOCK", block)
    rows = cloud(3)
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").repartition(3)
    got = V.similar_pairs(df, low, high).collect()
    want = plain_pairs(rows, low, high)
    assert len(got) == len(want) and all(abs(want[r["a"], r["b"]] - r["cosine"]) < 1e-9 for r in got)


def test_visits_are_few_where_vectors_cluster_and_miss_nothing():
    rng = np.random.default_rng(0)
    centres = np.eye(24)[rng.permutation(24)]
    x = np.repeat(centres, 50, axis=0) + rng.normal(0, 0.02, (1200, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    at = x[::50]
    p = V.Pivots(at, np.zeros(24, int), np.full(24, np.inf), np.full(24, -np.inf))
    angles = p.angles(x)
    cell = angles.argmin(1)
    own = angles[np.arange(1200), cell]
    p = V.Pivots(at, np.bincount(cell, minlength=24), np.array([own[cell == k].min() for k in range(24)]), np.array([own[cell == k].max() for k in range(24)]))
    for least in (0.9, 0.5, 0.01):
        go = p.visits(angles, least)
        i, j = np.nonzero(x @ x.T >= least)
        assert go[i, cell[j]].all()
        assert least < 0.9 or go.sum() == 1200


def test_deduplicate_equals_the_sequential_pass(spark, monkeypatch):
    monkeypatch.setattr(V, "BLOCK", 32)
    for seed, least in ((3, 0.9), (4, 0.6)):
        rows = cloud(seed)
        df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, label string")
        assert sorted(r["vec_id"] for r in V.deduplicate(df, least).collect()) == plain_kept(rows, least)
    assert V.deduplicate(df.limit(0), 0.9).count() == 0


def test_batches_of_a_stream_equal_one_pass(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(V, "BLOCK", 32)
    monkeypatch.setattr(deduplication, "PIVOTS", 6)
    rows = cloud(5)
    store = deduplication.open_store(spark, str(tmp_path / "s"), buckets=2)
    for k, (a, b) in enumerate([(50, 52), (0, 50), (52, 160)]):  # the first batch has no direction
        part = spark.createDataFrame(rows[a:b], "seq long, vector array<float>")
        version = deduplication.fold(store, part, k, least=0.85)
    order = rows[50:52] + rows[:50] + rows[52:]
    assert sorted(r["seq"] for r in deduplication.kept(store, version).collect()) == sorted(plain_kept(order, 0.85))
    again = deduplication.fold(store, part, 2, least=0.85)
    assert deduplication.kept(store, again).count() == len(plain_kept(order, 0.85))
