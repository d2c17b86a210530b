"""Work that follows the size of a table: partitions, and shuffles that are left out."""

from itertools import combinations

import pytest
from pyspark.sql import functions as F

from learngraph import shared
from learngraph.functions import statistics as S
from learngraph.operators import graph, quality


@pytest.fixture
def few_rows(spark, monkeypatch):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    monkeypatch.setattr(shared, "ROWS", 20)
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def plan(df, which="optimizedPlan"):
    return getattr(df._jdf.queryExecution(), which)().toString()


def test_edges_of_many_rows_are_dealt_by_their_number(spark, few_rows):
    rows = [(u, (u * 7 + k * 3) % 50) for u in range(60) for k in range(4)]
    found = graph.cooccurrence_edges(spark.createDataFrame(rows, "u long, c long"), "u", "c")
    want = {}
    for u in range(60):
        for pair in combinations(sorted({c for v, c in rows if v == u}), 2):
            want[pair] = want.get(pair, 0) + 1
    assert {(r["src"], r["dst"]): r["weight"] for r in found.collect()} == want
    assert found.rdd.getNumPartitions() == 12  # 240 rows, 20 a partition
    assert graph.cooccurrence_edges(spark.createDataFrame(rows[:8], "u long, c long"), "u", "c").count() and spark.conf.get("spark.sql.shuffle.partitions") == "12"


def test_defined_edges_without_a_distinct_over_all(spark):
    objects = [(1, "a"), (1, "a"), (2, "b"), (3, "a"), (3, "b"), (4, ""), (5, None), (6, "c")]
    keywords = [(1, "a"), (2, "a"), (2, "a"), (3, "a"), (3, "b"), (7, "a"), (7, "b"), (6, "d")]
    found = graph.defines_edges(spark.createDataFrame(objects, "id long, defines string"), spark.createDataFrame(keywords, "id long, keyword string"))
    want = {(i, j) for i, k in objects if k for j, x in keywords if x == k and i != j}
    assert sorted((r["src"], r["dst"]) for r in found.collect()) == sorted(want)
    assert plan(found).startswith("Union")


def test_raters_meet_once_for_signed_ranks(spark):
    ratings = spark.createDataFrame([(i, m, (i * k) % 5) for i in range(30) for k, m in enumerate("abc", 1)], "item long, model string, score long")
    assert "Generate" not in plan(S.wilcoxon(ratings))


def test_batches_take_one_shuffle(spark):
    dealt = quality.batches(spark.range(100).select((99 - F.col("id")).alias("seq")), 8, "seq")
    assert plan(dealt, "executedPlan").count("Exchange") == 1
    rows = sorted(dealt.collect(), key=lambda r: r["seq"])
    for x, y in zip(rows, rows[1:], strict=False):
        assert (y["batch"] == x["batch"] and y["pos"] == x["pos"] + 1) or (y["pos"] == 0 and y["batch"] != x["batch"])
    assert max(r["pos"] for r in rows) == 7


def test_regeneration_writes_no_object_twice(spark, monkeypatch):
    from learngraph.operators import generation as G

    names, write = [], G.written
    monkeypatch.setattr(G, "written", lambda df, name: names.append(name) or write(df, name))
    units = spark.createDataFrame([(k, "fact", f"unit number {k} of several words", "t", 1) for k in range(12)], "seq long, type string, statement string, source_title string, source_page int")
    objects = G.add_choices(G.generate_objects(units, G.stub_client).drop("statement"), G.stub_client)
    held, _ = G.filter_and_regenerate(objects, units, ["stub/a", "stub/b"], G.stub_client)
    assert sorted(r["seq"] for r in held.collect()) == list(range(12)) and "statement" not in held.columns
    assert names.count("objects") == 1 and "again" in names


def test_regeneration_names_statements(spark, monkeypatch):
    """Statements are with the objects at first, the units and what is asked to write anew, not with objects written anew; they come back at the end."""
    from learngraph.operators import generation as G

    made, write = [], G.written
    monkeypatch.setattr(G, "written", lambda df, name: made.append((name, df.columns)) or write(df, name))
    units = spark.createDataFrame([(k, "fact", f"unit number {k} " + "of several words " * 40, "t", 1) for k in range(12)], "seq long, type string, statement string, source_title string, source_page int")
    objects = G.add_choices(G.generate_objects(units, G.stub_client).drop("statement"), G.stub_client)
    lost = objects.limit(1).withColumns({"seq": F.lit(99).cast("long"), "id": F.lit("lost"), "source_statement": F.lit(None).cast("string"), "question": F.lit("See the table below.")})
    made.clear()
    held, _ = G.filter_and_regenerate(objects.unionByName(lost), units, ["stub/a", "stub/b"], G.stub_client)
    again = [c for name, c in made if name == "again"]
    assert again and not any({"statement", "source_statement"} & set(c) for c in again)
    statements = {r["seq"]: r["statement"] for r in units.collect()} | {99: None}
    assert {r["seq"]: r["source_statement"] for r in held.collect()} == statements and {r["regen_status"] for r in held.where("seq = 99").collect()} == {"unmatched"}


def test_question_and_answer_are_embedded_by_one_worker(spark):
    from learngraph.plans.bindings import question_answers
    from learngraph.plans.vector_queries import semantic_similarity
    from learngraph.sources.connectors import hashing_embedder

    sf = "/root/testdata/sf0.001"
    found = semantic_similarity(spark, sf)
    assert plan(found).count("ArrowEvalPython") == 1
    embed, got = hashing_embedder(), {(r["conv_id"], r["turn"]): r["semantic_similarity"] for r in found.collect()}
    rows = question_answers(spark, sf).collect()
    assert len(rows) == len(got) > 10
    for r in rows:
        q, a = embed([r["question"], r["answer"]]).astype(float)
        assert abs(got[r["conv_id"], r["turn"]] - q @ a) < 1e-4


def test_embedding_takes_few_texts_at_once(spark):
    from learngraph.sources import connectors

    def told():  # how many texts and characters came with each
        return lambda texts: [[len(texts), sum(map(len, texts)), len(t), float(t.split("-")[0] or -1)] for t in texts]

    long = F.concat(F.col("id").cast("string"), F.lit("-"), F.repeat(F.lit("x"), 30_000))
    texts = spark.range(0, 700, 1, 1).select("id", F.when(F.col("id") % 7 != 0, F.concat(F.col("id").cast("string"), F.lit("-"))).alias("short"), long.alias("long"))
    for out in (connectors.embed(texts, "short", "v", told).collect(), connectors.embed(texts, "long", "v", told).collect()):
        assert [r["id"] for r in out] == list(range(700))
        assert max(r["v"][0] for r in out) <= 256 and max(r["v"][1] for r in out) <= 1 << 21
        assert all(r["v"][3] in (r["id"], -1) for r in out)
