"""The prerequisite graph folded batch by batch equals one built at once, on random splits."""

import random

import pytest
from pyspark.sql import functions as F

from learngraph.operators import graph
from learngraph.streaming import prerequisites as P

OBJECT = "id string, layer int, vector array<float>, keywords array<string>, seq long"


def made(seed, units=30, objects=24):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(14)]
    u = [(k, c) for k in range(units) for c in rng.sample(words, rng.randrange(1, 4))]
    o = [(f"o{k:02}", rng.choice([1, 2, 2, 3]), [rng.gauss(0, 1) + 1 for _ in range(3)], rng.sample([*words, "odd", "hot"], rng.randrange(0, 5)), k) for k in range(objects)]
    return u, o


def rebuilt(spark, u, o, least):
    inc = spark.createDataFrame(u, "unit long, concept string")
    vertex, edges = graph.vertices(inc, "concept"), graph.cooccurrence_edges(inc, "unit", "concept")
    obj = spark.createDataFrame(o, OBJECT)
    words = obj.select("id", F.explode("keywords").alias("keyword"))
    anchors = graph.anchors(words, graph.degree_centrality(vertex, edges))
    placed = obj.join(anchors, "id", "left").withColumn("centrality", F.coalesce("centrality", F.lit(0.0)))
    return {tuple(r) for r in graph.layered_edges(placed, words, least).collect()}, {r["id"]: (r["anchor"], round(r["centrality"], 9)) for r in placed.collect()}


@pytest.mark.parametrize(("seed", "cuts"), [(1, [0.05, 0.6])])
def test_batches_equal_a_rebuild(spark, tmp_path, seed, cuts):
    u, o = made(seed)
    store = P.open_store(spark, str(tmp_path / "s"), buckets=2)
    asked = []

    def verify(edges):
        found = edges.collect()
        asked.extend(tuple(r) for r in found)
        return edges.where(F.crc32(F.concat("src", "dst").cast("binary")) % 3 != 0)

    bounds = [0.0, *cuts, 1.0]
    for k, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
        units = [x for x in u if a * 30 <= x[0] < b * 30]
        objects = o[int(a * 24) : int(b * 24)]
        args = (spark.createDataFrame(units, "unit long, concept string"), spark.createDataFrame(objects, OBJECT), k)
        version = P.fold(store, *args, least_cosine=0.5, verify=verify)
    want, anchors = rebuilt(spark, u, o, 0.5)
    assert {tuple(r) for r in P.candidates(store, version).collect()} == want
    assert {r["id"]: (r["anchor"], round(r["centrality"], 9)) for r in P.anchors(store, version).collect()} == anchors
    kept = spark.createDataFrame(sorted(want) or [("", "")], "src string, dst string").where(F.crc32(F.concat("src", "dst").cast("binary")) % 3 != 0).where("src != ''")
    assert {tuple(r) for r in P.verified(store, version).collect()} == {tuple(r) for r in kept.collect()}
    assert len(asked) == len(set(asked))
    again = P.fold(store, *args, least_cosine=0.5, verify=verify)  # the last batch once more
    assert {tuple(r) for r in P.candidates(store, again).collect()} == want


def test_first_concept_alone_known_ids_and_no_rows(spark, tmp_path):
    store = P.open_store(spark, str(tmp_path / "s"), buckets=2)
    frame = lambda rows: spark.createDataFrame(rows, OBJECT)
    units = lambda rows: spark.createDataFrame(rows, "unit long, concept string")
    first = [("a", 1, [1.0, 0.0], ["x", "b"], 0), ("b", 1, [1.0, 0.1], ["b"], 1)]
    version = P.fold(store, units([(1, "x")]), frame(first), 0)
    assert {r["id"]: (r["anchor"], r["centrality"]) for r in P.anchors(store, version).collect()} == {"a": ("x", 1.0), "b": ("b", 0.0)}
    assert [tuple(r) for r in P.candidates(store, version).collect()] == [("a", "b")]
    version = P.fold(store, units([(2, "y")]), frame([("a", 3, [0.0, 1.0], ["y"], 0), ("c", None, None, None, 1), (None, 1, None, None, 2)]), 1)
    assert {r["id"]: (r["anchor"], r["centrality"]) for r in P.anchors(store, version).collect()} == {"a": ("b", 0.0), "b": ("b", 0.0), "c": (None, 0.0)}
    assert P.candidates(store, version).count() == 0
    version = P.fold(store, units([]), frame([]), 2)
    assert P.anchors(store, version).count() == 3 and version.number == 2


def test_stream(spark, tmp_path):
    u, o = made(5, units=24)
    concepts = {k: [c for x, c in u if x == k] for k in range(24)}
    rows = [(i, concepts[k], layer, v, ks) for k, (i, layer, v, ks, _) in enumerate(o)]
    schema = "id string, concepts array<string>, layer int, vector array<float>, keywords array<string>"
    for k in range(2):
        spark.createDataFrame(rows[k * 12 : k * 12 + 12], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = P.prerequisite_stream(stream, str(tmp_path / "s"), str(tmp_path / "log"), least_cosine=0.5, buckets=2)
    query.awaitTermination()
    store = P.open_store(spark, str(tmp_path / "s"), buckets=2)
    want, _ = rebuilt(spark, u, o, 0.5)
    assert store.newest().number == 1 and {tuple(r) for r in P.candidates(store, store.newest()).collect()} == want
