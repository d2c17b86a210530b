"""Batches that touch most of the state go through whole tables, write each row once, and rule pairs out by signatures."""

import os

import numpy as np
from test_prerequisites import OBJECT, made, rebuilt

from learngraph.operators.overlap import _signs
from learngraph.streaming import prerequisites as P
from learngraph.streaming import state


def test_whole_tables_give_the_same_graph(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(P, "FULL", 0)  # every batch that touches half of the concepts
    u, o = made(3)
    store, writes, real = P.open_store(spark, str(tmp_path / "s"), buckets=2), [], state.Store._write
    monkeypatch.setattr(state.Store, "_write", lambda self, name, *a: (writes.append(name), real(self, name, *a))[1])
    for k, (a, b) in enumerate([(0, 0.5), (0.5, 0.8), (0.8, 1)]):
        units = [x for x in u if a * 30 <= x[0] < b * 30]
        version = P.fold(store, spark.createDataFrame(units, "unit long, concept string"), spark.createDataFrame(o[int(a * 24) : int(b * 24)], OBJECT), k, least_cosine=0.5)
    want, anchors = rebuilt(spark, u, o, 0.5)
    assert {tuple(r) for r in P.candidates(store, version).collect()} == want
    assert {r["id"]: (r["anchor"], round(r["centrality"], 9)) for r in P.anchors(store, version).collect()} == anchors
    assert writes.count("edges") == 3  # once a batch, merged or not


def test_large_buckets_are_written_by_several_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(state, "ROWS", 100)
    store = state.Store(spark, str(tmp_path / "s"), {"t": state.Table("k bigint, n bigint", ("k",), ("n",))}, 2)
    held = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        version = store.commit(store.newest(), 0, {"t": spark.range(2000).selectExpr("id AS k", "1L AS n")}, sizes={"t": 2000})
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", held)
    path = version.segments["t"][0].path
    assert all(len([f for f in os.listdir(f"{path}/bucket={b}") if f.endswith(".parquet")]) > 1 for b in (0, 1))
    assert store.read(version, "t").count() == version.segments["t"][0].rows == 2000


def test_signatures_lose_no_pair():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 400, rng.integers(1, 9))) for _ in range(300)]
    codes, at = np.concatenate(sets).astype(np.int64), np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    rank = np.array([rng.choice(s) for s in sets])
    signs, ruled = _signs(codes, at, rank), 0
    for i in range(300):
        for j in range(i):
            shared = (set(sets[i]) - {rank[i]}) & (set(sets[j]) - {rank[j]})
            ruled += not (signs[i] & signs[j])
            assert not shared or signs[i] & signs[j]
    assert ruled > 10_000
