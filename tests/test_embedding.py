"""Vectors learned from co-occurrence: equal to a whole decomposition, related words nearer than unrelated ones."""

import numpy as np
from pyspark.sql import functions as F

from learngraph.operators import embedding, graph


def corpus(seed=0, units=400):
    rng = np.random.default_rng(seed)
    topics = [[f"t{k}w{i}" for i in range(9)] for k in range(4)]
    rows = []
    for u in range(units):
        words = [*rng.choice(topics[u % 4], 4, replace=False), *rng.choice(["the", "of", "and"], 2, replace=False)]
        rows += [(u, str(w)) for w in words]
    return rows


def test_equal_to_a_whole_decomposition_and_near_where_related(spark):
    inc = spark.createDataFrame(corpus(), "u long, c string")
    edges = graph.cooccurrence_edges(inc, "u", "c")
    found = {r["concept"]: np.array(r["vector"], float) for r in embedding.fit(edges, dim=4, rounds=4).collect()}  # four topics: a gap after the fourth value
    names = sorted(found)
    at = {c: k for k, c in enumerate(names)}
    w = np.zeros((len(names),) * 2)
    for r in edges.collect():
        w[at[r["src"]], at[r["dst"]]] = w[at[r["dst"]], at[r["src"]]] = r["weight"]
    f = w.sum(1)
    with np.errstate(divide="ignore"):
        a = np.maximum(np.log(w * w.sum() / np.outer(f, f)), 0)
    values, u = np.linalg.eigh(a)
    order = np.argsort(-np.abs(values))[:4]
    x = np.array([found[c] for c in names])
    want = u[:, order] * np.sqrt(np.abs(values[order]))
    assert np.abs(np.abs(x) ** 2 @ np.ones(4) - (want**2).sum(1)).max() < 0.02 and np.abs(x @ x.T - want @ want.T).max() < 0.05
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    cos = unit @ unit.T
    topic = np.array([c[:2] if c.startswith("t") and c[1].isdigit() else "-" for c in names])
    same = (topic[:, None] == topic[None]) & (topic != "-")[:, None] & ~np.eye(len(names), dtype=bool)
    other = (topic[:, None] != topic[None]) & (topic != "-")[:, None] & (topic != "-")[None]
    assert cos[same].min() > cos[other].max() + 0.3


def test_texts_of_one_topic_are_nearer(spark):
    edges = graph.cooccurrence_edges(spark.createDataFrame(corpus(1), "u long, c string"), "u", "c")
    vectors = embedding.fit(edges, dim=4)
    texts = spark.createDataFrame([(1, "t0w0 t0w1 t0w2"), (2, "t0w7 t0w8 t0w8"), (3, "t1w0 t1w1"), (4, "unknown"), (5, ""), (6, None)], "id long, t string")
    got = {r["id"]: r["vector"] for r in embedding.text_vectors(texts, "id", F.split(F.coalesce("t", F.lit("")), " "), vectors).collect()}
    assert np.dot(got[1], got[2]) > 0.8 > 0.4 > np.dot(got[1], got[3]) and got[4] is got[5] is got[6] is None and abs(np.linalg.norm(got[2]) - 1) < 1e-5
    assert embedding.text_vectors(texts, "id", F.split("t", " "), vectors.limit(0)).where("vector IS NOT NULL").count() == 0


def test_few_concepts_and_none(spark):
    edges = spark.createDataFrame([("a", "b", 2), ("b", "c", 1), ("d", "e", 3)], "src string, dst string, weight long")
    found = {r["concept"]: r["vector"] for r in embedding.fit(edges, dim=64).collect()}
    assert set(found) == set("abcde") and all(np.isfinite(v).all() and len(v) <= 5 for v in found.values())
    assert embedding.fit(edges.limit(0)).count() == 0
