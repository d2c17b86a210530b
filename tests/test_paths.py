"""Levels, depths and broken cycles against plain versions, at once in a task and in rounds."""

import random

import pytest
from pyspark.sql import functions as F

from learngraph.operators import cycles, graph, paths


def plain_levels(n, edges):
    level, left = {}, set(range(n))
    while free := {v for v in left if not any(b == v and a in left for a, b in edges)}:
        for v in free:
            level[v] = max((level[a] + 1 for a, b in edges if b == v), default=0)
        left -= free
    return level


def frame(spark, edges):
    return spark.createDataFrame(sorted(edges) or [(0, 0)], "src long, dst long").where(F.lit(bool(edges)))


@pytest.mark.parametrize(("local", "seed"), [(1 << 19, 0), (0, 1), (0, 2), (3, 3)])
def test_levels(spark, monkeypatch, local, seed):
    monkeypatch.setattr(paths, "LOCAL", local)
    rng = random.Random(seed)
    n = 18
    edges = {(a, b) for a, b in ((rng.randrange(n), rng.randrange(n)) for _ in range(18)) if a < b} | {(k, k + 1) for k in range(6, 10)}
    if seed == 2:
        edges |= {(12, 11), (11, 12), (14, 13), (13, 14), (5, 5)}
    want = plain_levels(n, edges)
    found, acyclic = graph.topological_levels(spark.range(n), frame(spark, edges))
    assert {r["id"]: r["level"] for r in found.collect()} == want and acyclic == (len(want) == n)


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    monkeypatch.setattr(paths, "LOCAL", 0)
    made, real = [], paths.written
    monkeypatch.setattr(paths, "written", lambda df, name: made.append(name) or real(df, name))
    chain = spark.range(10_000).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst")).unionByName(spark.createDataFrame([(0, 20_000), (20_000, 5000)], "src long, dst long"))
    found, acyclic = graph.topological_levels(spark.range(10_001).unionByName(spark.range(20_000, 20_001)), chain)
    top = found.agg(F.max("level"), F.count(F.lit(1))).first()
    assert acyclic and tuple(top) == (10_000, 10_002) and made.count("hung") < 45 and len(made) < 80


def test_a_long_chain_in_one_task(spark):
    chain = spark.range(10_000).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    found, acyclic = graph.topological_levels(spark.range(10_001), chain)
    assert acyclic and found.agg(F.max("level")).first()[0] == 10_000


@pytest.mark.parametrize("n", [14, 150])
def test_depths_of_many_roots(spark, n):
    rng = random.Random(n)
    edges = {(a, b) for a, b in ((rng.randrange(n), rng.randrange(n)) for _ in range(n)) if a < b} | {(k, n - 1) for k in range(0, n, 2)}
    depth = {}
    for r in (i for i in range(n) if all(b != i for _, b in edges)):
        dist, front = {r: 0}, [r]
        while front:
            front = [b for x in front for a, b in edges if a == x and b not in dist and dist.setdefault(b, dist[x] + 1)]
        depth = {i: max(depth.get(i, 0), dist.get(i, 0)) for i in {*depth, *dist}}
    edges.add((3, 3))
    got = {r["id"]: r["depth"] for r in graph.depths(spark.range(n), frame(spark, edges - {(3, 3)})).collect()}
    assert got == {i: depth.get(i) for i in range(n)}


def reach(edges, a):
    seen, front = {a}, [a]
    while front:
        front = [y for x, y in edges if x in front and y not in seen and not seen.add(y)]
    return seen


def plain_broken(edges):
    """edges: {(src, dst): sure}. In rounds: each component's least edge goes."""
    left = {e: s for e, s in edges.items() if e[0] != e[1]}
    while True:
        to = {v: reach(left, v) for e in left for v in e}
        groups = {}
        for a, b in left:
            if a in to[b]:
                groups.setdefault(frozenset(x for x in to[a] if a in to[x]), []).append((left[a, b] is not None, left[a, b] or 0, a, b))
        if not groups:
            return set(left)
        for group in groups.values():
            left.pop(min(group)[2:])


@pytest.mark.parametrize(("local", "seed"), [(1 << 16, 0), (1 << 16, 1), (1 << 16, 2), (0, 3)])
def test_broken_cycles(spark, monkeypatch, local, seed):
    monkeypatch.setattr(cycles, "LOCAL", local)
    rng = random.Random(seed)
    n = 9 if local == 0 else 16
    edges = {(rng.randrange(n), rng.randrange(n)): rng.choice([None, 1, 2, 2, 3]) for _ in range(n + 5)}
    df = spark.createDataFrame([(a, b, s) for (a, b), s in edges.items()] + [(None, 1, 2)], "src long, dst long, sure int")
    got = [tuple(r) for r in cycles.broken(df, "sure").collect()]
    assert len(got) == len(set(got)) and set(got) == plain_broken(edges)
    assert cycles.broken(df.limit(0)).count() == 0


def test_strong_components(spark):
    edges = {(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (5, 6), (6, 7), (8, 1), (9, 9), (10, 11), (11, 12), (12, 10), (4, 10)}
    got = {r["node"]: r["component"] for r in cycles.strong_components(frame(spark, edges)).collect()}
    assert got == {1: 3, 2: 3, 3: 3, 4: 5, 5: 5, 10: 12, 11: 12, 12: 12}
