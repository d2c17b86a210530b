"""Operators that only the service path or single calls use: merging, retries of missing scores, one-item tasks, reports, progress."""

import json
import time


from learngraph.functions import statistics as S
from learngraph.operators import generation
from learngraph.plans import api
from learngraph.sources import connectors
from learngraph.streaming.logs import LogBuffer, ProgressListener

UNIT = "seq long, type string, statement string, concepts array<string>, source_title string, source_page int"


def units(spark, rows):
    return spark.createDataFrame(rows, UNIT)


def test_merging_unites_concepts_and_keeps_the_first_provenance(spark):
    held = units(spark, [(1, "rule", "alpha beta gamma", ["a", "b"], None, 4), (2, "fact", "alpha beta delta", ["b", "c"], "T", 7)])
    merged = generation.merge_units(spark.createDataFrame([(1, 2)], "a long, b long"), held, generation.stub_client).first()
    assert merged["concepts"] == ["a", "b", "c"] and (merged["source_title"], merged["source_page"], merged["seq"]) == ("T", 4, 1) and merged["statement"] == "alpha beta gamma delta"

    def broken():
        return lambda *_: "no json"

    kept = generation.merge_units(spark.createDataFrame([(1, 2)], "a long, b long"), held, broken).first()
    assert kept["statement"] == "alpha beta gamma" and kept["type"] == "rule" and kept["concepts"] == ["a", "b", "c"]


def test_similar_units_are_merged_until_none_are_left(spark):
    held = units(spark, [(1, "fact", "one two three four", ["x"], "S", 1), (2, "fact", "one two three four", ["y"], "S", 2), (3, "fact", "one two three four", ["z"], "S", 3), (4, "rule", "something else entirely here", ["w"], "S", 4)])
    done = generation.merge_similar(held, lambda df: connectors.embed(df, "statement"), generation.stub_client, threshold=0.9)
    assert sorted((r["seq"], sorted(r["concepts"])) for r in done.collect()) == [(1, ["x", "y", "z"]), (4, ["w"])]


def flaky(path):
    """Answers nothing the first time it is asked with this model's name."""

    def client():
        import os

        good = generation.stub_client()

        def answer(messages, model, temperature):
            mark = f"{path}/{model.replace('/', '-')}"
            if model == "m/late" and not os.path.exists(mark):
                open(mark, "w").close()
                return ""
            return good(messages, model, temperature)

        return answer

    return client


def test_missing_scores_are_asked_for_again(spark, tmp_path):
    objects = spark.createDataFrame([("a", 1, "Q?", "A", "H", "S")], "id string, seq long, question string, answer string, hint string, source_statement string")
    client = flaky(str(tmp_path))
    first = generation.evaluate(objects, ["m/b"], client)
    done = generation.evaluate_missing(objects, ["m/late", "m/b"], client, first)
    assert sorted((r["lo_id"], r["model"]) for r in done.collect()) == [("a", "m/b"), ("a", "m/late")]
    never = generation.evaluate_missing(objects, ["m/x"], lambda: lambda *_: "[]", first, rounds=2)
    assert [r["model"] for r in never.collect()] == ["m/b"]


def test_tasks_of_one_item(spark):
    sections = spark.createDataFrame([(i, f"section number {i} text") for i in range(5)], "seq long, content string")
    for task, payload in ((generation.EXTRACT, ["content"]), (generation.DISTRACT, ["content"]), (generation.VERIFY, ["content"])):
        found, raw = generation.ask(sections, generation.single(task), generation.stub_client, payload)
        assert raw.count() == 5 and found.where("answered").count() == 5


def test_generation_by_type_reaches_the_service(spark):
    held = spark.createDataFrame([(i, t, f"The {t} says {i} things.", "s", i) for i, t in enumerate(["fact", "rule", "example"])], "seq long, type string, statement string, source_title string, source_page int")
    made = api.generate_objects(held, generation.stub_client, by_type=True).collect()
    assert sorted((r["type"], r["mc_options"] is not None) for r in made) == [("example", False), ("fact", True), ("rule", True)]


def test_learning_paths_and_depths(spark):
    nodes = spark.createDataFrame([("a",), ("b",), ("c",), ("d",), ("e",)], "id string")
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("d", "c")], "src string, dst string")
    r = api.learning_paths(nodes, edges).first()
    assert (r["nodes"], r["edges"], r["root_nodes"], r["longest_path"], r["is_dag"]) == (5, 4, 3, 2, True)
    assert api.learning_paths(nodes, edges.unionByName(spark.createDataFrame([("c", "a")], "src string, dst string"))).first()["is_dag"] is False
    h = {x["bin"]: x["n"] for x in api.depth_histogram(nodes, edges, 4).collect()}
    assert h == {1: 3, 2: 0, 3: 0, 4: 2}


def test_histograms_between_the_extremes(spark):
    one = S.range_histogram(spark.createDataFrame([(3,), (3,)], "x int"), "x", 4).collect()
    assert [(r["bin"], r["low"], r["n"]) for r in one] == [(1, 2.5, 0), (2, 2.75, 0), (3, 3.0, 2), (4, 3.25, 0)]
    assert S.range_histogram(spark.createDataFrame([(None,)], "x int"), "x", 4).count() == 0


def test_learned_vectors_in_the_service(spark):
    texts = [(k, f"{a} {b} {c}") for k, (a, b, c) in enumerate([("cat", "dog", "pet"), ("dog", "pet", "fur"), ("cat", "pet", "fur"), ("tax", "law", "court"), ("law", "court", "judge"), ("tax", "judge", "law")] * 3)] + [(90, "cat dog pet fur"), (91, "")]
    got = {r["seq"]: r["vector"] for r in api.embedded(spark.createDataFrame(texts, "seq long, t string"), "seq", "t", learned=True).collect()}
    dot = lambda a, b: sum(x * y for x, y in zip(got[a], got[b], strict=True))
    assert len(got) == 20 and got[91] is None and dot(90, 1) > dot(90, 3) + 0.5


def test_progress_of_a_stream_reaches_subscribers(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "in"))
    logs = LogBuffer(50)
    logs.subscribe("ui")
    listener = ProgressListener(logs)
    spark.streams.addListener(listener)
    try:
        stream = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
        query = stream.writeStream.format("noop").queryName("landing").option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start()
        query.awaitTermination()
        seen = []
        for _ in range(100):
            seen += logs.read("ui")
            if any("ended" in x for x in seen):
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    assert "landing::started" in seen and any(x.startswith("landing::batch 0: 5 rows") for x in seen)


def test_answers_without_objects_are_none():
    from learngraph.functions import responses

    assert json.loads(responses.rows('[{"a": "{"}, {"b": 1}')[1]) == {"b": 1}
