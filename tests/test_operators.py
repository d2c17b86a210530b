import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from learngraph.functions import responses
from learngraph.functions import statistics as S
from learngraph.operators import components, export, generation, graph, quality, vectors
from learngraph.operators.concepts import lemma, normalize, normalize_concept
from learngraph.plans import api


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns or df.columns) for r in df.collect())


def test_cooccurrence_and_centrality(spark):
    inc = spark.createDataFrame([(1, "a"), (1, "b"), (1, "a"), (2, "a"), (2, "b"), (2, "c"), (3, "d"), (None, "x"), (4, None)], "u int, c string")
    edges = graph.cooccurrence_edges(inc, "u", "c")
    assert rows(edges) == [("a", "b", 2), ("a", "c", 1), ("b", "c", 1)]
    vertex = graph.vertices(inc, "c")
    found = rows(graph.degree_centrality(vertex, edges))
    assert found == [("a", 2, 0.5), ("b", 2, 0.5), ("c", 2, 0.5), ("d", 0, 0.0), ("x", 0, 0.0)]
    alone = vertex.where("concept = 'a'")
    assert rows(graph.degree_centrality(alone, edges.limit(0))) == [("a", 0, 1.0)]
    assert rows(graph.graph_summary(vertex, edges))[0][:2] == (5, 3)
    assert rows(graph.graph_summary(vertex.limit(0), edges.limit(0))) == [(0, 0, 0.0, 0.0)]
    assert rows(graph.heavy_edges(edges, 2)) == [("a", "b", 2)] and rows(graph.without_isolated(vertex, edges)) == [("a",), ("b",), ("c",)]


def test_published_graph_figures(spark):
    vertex, edges = spark.range(110).select(F.col("id").alias("concept")), spark.range(115).select(F.col("id").alias("src"), F.col("id").alias("dst"))
    r = graph.graph_summary(vertex, edges).first()
    assert abs(r["density"] - 0.019182652210175146) < 1e-15 and abs(r["avg_degree"] - 2.090909090909091) < 1e-14


def test_anchor_ties_and_unknown(spark):
    kw = spark.createDataFrame([(1, "z"), (1, "b"), (1, "a"), (2, "q"), (3, None)], "id int, keyword string")
    cen = spark.createDataFrame([("z", 0.1), ("b", 0.5), ("a", 0.5)], "concept string, centrality double")
    assert rows(graph.anchors(kw, cen)) == [(1, "a", 0.5), (2, "q", 0.0)]


def test_layered_edges_and_prerequisites(spark):
    obj = spark.createDataFrame([("a", 1, 0.5, [1.0, 0.0]), ("b", 2, 0.1, [1.0, 0.0]), ("c", 2, 0.3, [1.0, 0.1]), ("d", 2, 0.3, [0.0, 1.0]), ("e", 3, 0.0, [0.0, 0.0])], "id string, layer int, centrality double, vector array<double>")
    kw = spark.createDataFrame([(i, k) for i, ks in {"a": "xy", "b": "xyz", "c": "xz", "d": "z", "e": "x"}.items() for k in ks], "id string, keyword string")
    edges = graph.layered_edges(obj, kw, 0.6)
    assert rows(edges) == [("a", "b"), ("c", "b")]
    assert rows(graph.prerequisites(obj, edges)) == [("a", []), ("b", ["a", "c"]), ("c", []), ("d", []), ("e", [])]
    d = {r["id"]: r for r in graph.in_out_degrees(obj, edges).collect()}
    assert d["a"]["is_start"] and d["d"]["is_isolated"] and d["d"]["is_root"] and not d["b"]["is_root"] and d["b"]["in_degree"] == 2
    assert rows(graph.defines_edges(spark.createDataFrame([("a", "x"), ("b", "")], "id string, defines string"), kw)) == [("a", "b"), ("a", "c"), ("a", "e")]


@pytest.mark.parametrize("seed", range(3))
def test_iterative_graph_operators(spark, seed):
    rng = random.Random(seed)
    n = 14
    edges = sorted({(a, b) for a, b in ((rng.randrange(n), rng.randrange(n)) for _ in range(14)) if a < b})
    nodes = spark.range(n).withColumnRenamed("id", "id")
    df = spark.createDataFrame(edges, "src long, dst long")
    level = [0] * n
    for _ in range(n):
        for a, b in edges:
            level[b] = max(level[b], level[a] + 1)
    found, acyclic = graph.topological_levels(nodes, df)
    assert acyclic and rows(found, "id", "level") == list(enumerate(level))
    label = list(range(n))
    for _ in range(n):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    assert rows(graph.components(nodes.withColumnRenamed("id", "concept"), df)) == list(enumerate(label))
    roots = [i for i in range(n) if all(b != i for _, b in edges)]
    depth = [None] * n
    for r in roots:
        dist, front = {r: 0}, [r]
        while front:
            front = [b for x in front for a, b in edges if a == x and b not in dist and dist.setdefault(b, dist[x] + 1)]
        for i, v in dist.items():
            depth[i] = v if depth[i] is None else max(depth[i], v)
    assert {r["id"]: r["depth"] for r in graph.depths(nodes, df).collect()} == dict(enumerate(depth))


def test_cycles_are_found(spark):
    nodes, edges = spark.range(3), spark.createDataFrame([(0, 1), (1, 2), (2, 1)], "src long, dst long")
    assert graph.topological_levels(nodes, edges)[1] is False
    assert graph.topological_levels(nodes.limit(0), edges.limit(0))[1] is True


def sequential_keep(n, pairs):
    kept = []
    for i in range(n):
        if not any((k, i) in pairs for k in kept):
            kept.append(i)
    return kept


def sequential_matching(n, pairs):
    gone, out = set(), []
    for i in range(n):
        if i not in gone:
            j = next((j for j in range(i + 1, n) if j not in gone and (i, j) in pairs), None)
            if j is not None:
                gone.update((i, j))
                out.append((i, j))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_greedy_rounds_equal_the_sequential_pass(spark, seed):
    rng = random.Random(seed)
    n = 12
    pairs = {(a, b) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.25}
    df = spark.createDataFrame(sorted(pairs) or [(0, 1)], "a long, b long").where(F.lit(bool(pairs)))
    ids = spark.range(n).select(F.col("id").alias("vec_id"))
    assert [r[0] for r in rows(vectors.greedy_keep(ids, df))] == sequential_keep(n, pairs)
    assert rows(vectors.greedy_matching(df)) == sequential_matching(n, pairs)


def test_similar_pairs(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 2)
    v = [[1.0, 0.0], [1.0, 0.1], [0.0, 1.0], [0.0, 0.0], None, [2.0, 0.0]]
    df = spark.createDataFrame(list(enumerate(v)), "vec_id long, embedding array<double>")
    assert [(a, b) for a, b, _ in rows(vectors.similar_pairs(df, 0.9))] == [(0, 1), (0, 5), (1, 5)]
    assert df.where("vec_id in (0, 3)").crossJoin(df.where("vec_id = 3").select(F.col("embedding").alias("z"))).select(vectors.cosine(F.col("embedding"), F.col("z"))).first()[0] == 0.0


def test_consensus(spark):
    e = spark.createDataFrame([("a", 3, 2, "no", "yes"), ("b", 2, 2, "no", None), ("b", 3, 1, "no", None), ("c", None, None, None, None), ("d", 5, None, "yes", "no"), ("d", 5, None, "no", "no")], "lo_id string, faithfulness int, hint_quality int, atomic string, self_contained string")
    found = {r["lo_id"]: r["reasons"] for r in quality.consensus(e).collect()}
    assert found == {"a": ["not atomic"], "b": ["faithfulness", "not atomic", "hint quality"], "c": [], "d": ["not self-contained"]}
    tries = e.withColumn("attempt", F.lit(0)).unionByName(spark.createDataFrame([("b", 5, 5, "yes", "yes", 1)], "lo_id string, faithfulness int, hint_quality int, atomic string, self_contained string, attempt int"))
    assert {r["lo_id"]: r["reasons"] for r in quality.consensus(quality.latest(tries)).collect()}["b"] == []
    assert rows(quality.missing_evaluations(spark.createDataFrame([("a",)], "id string"), ["m", "n"], spark.createDataFrame([("m", "a")], "model string, lo_id string"))) == [("n", "a")]


def test_batches_cover_every_row_once(spark):
    dealt = quality.batches(spark.range(50).withColumnRenamed("id", "seq"), 8, "seq").collect()
    assert len({(r["batch"], r["pos"]) for r in dealt}) == 50 and max(r["pos"] for r in dealt) <= 7


def kappa(pairs, weight):
    labels = sorted({x for p in pairs for x in p})
    n = len(pairs)
    o = sum(weight(labels.index(a), labels.index(b)) for a, b in pairs) / n
    e = sum(weight(labels.index(a), labels.index(b)) for a, _ in pairs for _, b in pairs) / n**2
    return 1 - o / e if e else None


def test_agreement(spark):
    rng = random.Random(3)
    pairs = [(rng.choice([1, 2, 5]), rng.choice([1, 2, 4, 5])) for _ in range(40)]
    long = spark.createDataFrame([(i, m, s) for i, p in enumerate(pairs) for m, s in zip("ab", p, strict=True)] + [(99, "a", 1), (98, "a", None), (98, "b", 2)], "item int, model string, score int")
    assert abs(S.cohens_kappa(long).first()["kappa"] - kappa(pairs, lambda x, y: x != y)) < 1e-12
    assert abs(S.cohens_kappa(long, weighted=True).first()["kappa"] - kappa(pairs, lambda x, y: (x - y) ** 2)) < 1e-12
    rank = lambda xs: [sum(y < x for y in xs) + (sum(y == x for y in xs) + 1) / 2 for x in xs]
    ra, rb = rank([a for a, _ in pairs]), rank([b for _, b in pairs])
    ma, mb = sum(ra) / 40, sum(rb) / 40
    rho = sum((x - ma) * (y - mb) for x, y in zip(ra, rb, strict=True)) / (sum((x - ma) ** 2 for x in ra) * sum((y - mb) ** 2 for y in rb)) ** 0.5
    got = S.spearman(long).first()
    assert abs(got["rho"] - rho) < 1e-12 and 0 <= got["p"] <= 1
    d = [a - b for a, b in pairs if a != b]
    r = rank([abs(x) for x in d])
    w = min(sum(v for v, x in zip(r, d, strict=True) if x > 0), sum(v for v, x in zip(r, d, strict=True) if x < 0))
    found = S.wilcoxon(long).first()
    assert found["w"] == w and found["n"] == len(d) and 0 <= found["p"] <= 1


def test_agreement_of_constant_and_equal_raters(spark):
    same = spark.createDataFrame([(i, m, 3) for i in range(5) for m in "ab"], "item int, model string, score int")
    assert S.cohens_kappa(same).first()["kappa"] is None and S.spearman(same).first()["rho"] is None and S.wilcoxon(same).count() == 0
    assert S.cohens_kappa(same.limit(0)).count() == 0


def test_statistics_of_few_values(spark):
    df = spark.createDataFrame([(1.5,), (None,)], "x double")
    found = {r["metric"]: r for r in S.numeric_stats(df, ["x", "y"]).collect()}
    assert found["x"]["std"] == 0.0 and found["y"]["n"] == 0 and found["y"]["mean"] is None
    assert S.boolean_rates(df.limit(0).withColumn("f", F.lit("yes")), ["f"]).first()["rate"] is None
    h = {r["bin"]: r["n"] for r in S.histogram(spark.createDataFrame([(0.5,), (1.0,), (0.2,), (1.2,), (None,)], "x double"), "x", 0.5, 1.0, 29).collect()}
    assert h[1] == 1 and h[29] == 1 and sum(h.values()) == 2 and len(h) == 29
    b = S.five_numbers(spark.createDataFrame([("m", x) for x in (1, 2, 3, 4, 100)], "g string, x int"), "g", "x").first()
    assert (b["q1"], b["median"], b["q3"], b["high_whisker"], b["max"]) == (2.0, 3.0, 4.0, 4.0, 100.0)


def test_export(spark):
    lo = spark.createDataFrame([(2, "M 1 - x", "q2", "a", ["a", "b"], 1, "Think. [Source: M 1, p. 2]"), (1, "M 1 - x", "q1", None, [], None, None), (3, None, "q3", "c", None, 0, "h")], "seq long, source_title string, question string, answer string, mc_options array<string>, mc_correct_index int, hint string")
    units = {r["title"]: r["questions"] for r in export.by_source(lo).collect()}
    first, second = units["M 1 - x"]
    assert (first["description"], first["type"], first["name"], first["hints"]) == ("q1", "open", "[M 1] Learning Object", [])
    assert [c.asDict() for c in second["choices"]] == [{"text": "a", "is_correct": False}, {"text": "b", "is_correct": True}]
    assert [h.asDict() for h in second["hints"]] == [{"name": "Hint", "url": "<p>Think</p>"}, {"name": "Source", "url": "<p>[Source:M 1]</p>"}]
    assert units["Unknown Source"][0]["name"] == "Learning Object" and export.total_questions(export.by_source(lo)).first()["questions"] == 3
    made = export.shuffled_options(spark.createDataFrame([("i", "a", ["x", "y", "z", "w", "a"]), ("j", "a", ["a", "x"])], "id string, answer string, distractors array<string>")).collect()
    assert sorted(made[0]["mc_options"]) == ["a", "x", "y", "z"] and made[0]["mc_options"][made[0]["mc_correct_index"]] == "a" and made[1]["mc_options"] is None


def test_export_rows_without_groups(spark):
    rng = np.random.default_rng(5)
    rows = [(int(rng.integers(0, 400)), None if rng.random() < 0.4 else "" if rng.random() < 0.1 else f"S{rng.integers(0, 5)} - x", f"q{rng.integers(0, 50)}", "a", None) for _ in range(1500)]
    lo = spark.createDataFrame(rows, "seq long, source_title string, question string, answer string, hint string").repartition(7)
    packed = export.by_source(lo).select("title", F.posexplode("questions").alias("place", "question"))
    key = lambda df: sorted((r["title"], r["place"], r["question"]["description"], r["question"]["name"]) for r in df.collect())
    assert key(export.question_rows(lo)) == key(packed)
    assert export.question_rows(lo.limit(0)).count() == 0
    assert export.source_totals(lo).first() == export.total_questions(export.by_source(lo)).first()
    assert export.source_totals(lo.limit(0)).first()["questions"] == 0


def test_kappa_of_many_labels(spark):
    rng = np.random.default_rng(6)
    pairs = [(int(a), int(a + rng.integers(0, 12))) for a in rng.integers(0, 60, 300)]
    long = spark.createDataFrame([(i, m, s) for i, (a, b) in enumerate(pairs) for m, s in (("x", a), ("y", b))], "item long, model string, score long")
    place = {v: k for k, v in enumerate(sorted({v for p in pairs for v in p}))}
    placed = [(place[a], place[b]) for a, b in pairs]
    assert abs(S.cohens_kappa(long).first()["kappa"] - kappa(placed, lambda x, y: x != y)) < 1e-12
    assert abs(S.cohens_kappa(long, weighted=True).first()["kappa"] - kappa(placed, lambda x, y: (x - y) ** 2)) < 1e-12


def test_cycles_and_graphs_without_edges(spark):
    obj = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    edges = spark.createDataFrame([("a", "b", 1), ("b", "c", 1), ("c", "b", 2), ("b", "a", None), ("a", "a", 5), ("c", "d", 0)], "src string, dst string, sure int")
    assert rows(graph.without_cycles(edges, "sure")) == [("a", "b"), ("c", "b"), ("c", "d")]
    vertex, none = graph.nodes_only(obj)
    assert rows(vertex) == [("a",), ("b",), ("c",)] and none.columns == ["src", "dst", "weight"] and none.count() == 0


def test_prompts_by_type(spark):
    units = spark.createDataFrame([(i, t, f"The {t} says {i}.", "s", i) for i, t in enumerate(["fact", "fact", "rule", "example"])], "seq long, type string, statement string, source_title string, source_page int")
    made = generation.generate_by_type(units, generation.stub_client)
    assert sorted(r["type"] for r in made.collect()) == ["example", "fact", "fact", "rule"]


def test_model_answers():
    assert responses.parse('```json\n{"a": "\\d"}\n```') == {"a": "\\d"}
    with pytest.raises(ValueError):
        responses.parse(" ")
    assert [json.loads(x) for x in responses.rows('[{"a": 1,}, // c\n{"a": 2}]')] == [{"a": 1}, {"a": 2}]
    assert [json.loads(x) for x in responses.rows('[{"a": "}"}, {"b": {"c": 1}}, {"d": ')] == [{"a": "}"}, {"b": {"c": 1}}]
    assert responses.rows('{"a": 1}') == responses.rows(None) == responses.rows("no") == []


def broken_client():
    good = generation.stub_client()

    def answer(messages, model, temperature):
        text = messages[-1]["content"]
        if "bad0" in text:
            raise RuntimeError("down")
        found = good(messages, model, temperature)
        return found[: len(found) // 2] if "short0" in text else found

    return answer


UNITS = "seq long, type string, statement string, source_title string, source_page int"


def test_short_and_failing_answers_shift_nothing(spark):
    units = spark.createDataFrame([(i, "fact", f"{'bad' if i == 3 else 'word'}{i % 3} statement number {i} here", "S", i) for i in range(10)], UNITS)
    made = generation.generate_objects(units, broken_client)
    assert 0 < made.count() < 10
    for r in made.collect():
        assert r["hint"].endswith(f"[Source: S, p. {r['seq']}]" if r["seq"] else "[Source: S]") and r["source_statement"].split()[3] == str(r["seq"])
        assert r["question"].split()[4].startswith(("fact", "word", "statement"))
    enriched = generation.enrich(made, broken_client)
    assert enriched.count() == made.count() and enriched.where("generated_name IS NULL").count() == 0


def test_replay_asks_nothing_again(spark):
    units = spark.createDataFrame([(i, "fact", f"word{i} is here", "S", 1) for i in range(4)], UNITS)
    first, raw = generation.ask(units, generation.GENERATE, generation.stub_client, ["statement"])

    def forbidden():
        def answer(*_):
            raise AssertionError("asked again")

        return answer

    again, _ = generation.ask(units, generation.GENERATE, forbidden, ["statement"], replay=raw)
    assert rows(first, "seq", "question") == rows(again, "seq", "question") and again.where("answered").count() == 4


def test_regeneration_loop(spark):
    units = spark.createDataFrame([(i, "rule", f"word{i} follows the rule number {i}", "S", 1) for i in range(12)], UNITS)
    objects = generation.add_choices(generation.generate_objects(units, generation.stub_client), generation.stub_client)
    lost = objects.limit(1).withColumns({"id": F.lit("lost"), "source_statement": F.lit("nowhere"), "question": F.lit("See the table below")})
    held, scores = generation.filter_and_regenerate(objects.unionByName(lost), units, ["m/a", "m/b"], generation.stub_client)
    got = {r["id"]: r for r in held.collect()}
    assert len(got) == 13 and got["lost"]["regen_status"] == "unmatched" and scores.select("attempt").distinct().count() <= 2
    assert all(r["evaluated"] or r["regen_status"] for r in got.values())


def test_concepts(spark):
    assert [lemma(w) for w in ("pointers", "class", "classes", "boxes", "indices", "queries", "bus", "is")] == ["pointer", "class", "class", "box", "index", "query", "bus", "is"]
    assert normalize_concept("The Pointers of Arrays") == "pointer array" and normalize_concept(None) == ""
    df = spark.createDataFrame([(["The Loops", "loop", "the"],), ([],), (None,)], "concepts array<string>")
    assert [r["normalized_concepts"] for r in normalize(df).collect()] == [["loop"], [], []]
    assert [r["normalized_concepts"] for r in normalize(df, keep_empty=True).collect()][0] == ["", "loop"]


def test_service_functions(spark):
    pages = spark.createDataFrame([("a/x.html", bytearray(b"<h1>Loops</h1><p>A loop repeats its body.</p><h2>Arrays</h2><p>An array holds values in order.</p>")), ("b.doc", bytearray(b"?"))], "path string, content binary")
    units, counts, refused = api.extract_units(pages, generation.stub_client)
    assert units.count() >= 1 and refused.count() == 1 and {r["what"] for r in counts.collect()} >= {"concepts", "type fact"}
    objects = api.generate_objects(units, generation.stub_client)
    built = api.build_graph(units, objects, generation.stub_client)
    assert built["counts"].first()["is_dag"] and built["objects"].count() == objects.count()
    judged, scores = api.evaluate(objects, units, ["m"], generation.stub_client)
    assert judged.count() == objects.count()
    assert api.statistics(objects, scores)["overlap"].first()["n"] == objects.count()
    assert api.export_units(objects, generation.stub_client).count() == 1 and api.export_units(objects, generation.stub_client, title="T").first()["title"] == "T"
    old, new = spark.createDataFrame([("a", 1, "o")], "id string, seq int, x string"), spark.createDataFrame([("a", 0), ("b", 2)], "id string, seq int")
    assert rows(api.add_sources(old, new), "id", "x") == [("a", "o"), ("b", None)] and api.add_sources(old, new, distinct=False).count() == 3


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (5, 5), (8, 7), (7, 9), (9, 8), (4, 20), (20, 19)] + [(100 + i, 101 + i) for i in range(40)] + [(300, 301 + i) for i in range(40)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {1: 1, 2: 1, 3: 1, 4: 1, 19: 1, 20: 1, 5: 5, 7: 7, 8: 7, 9: 7} | {100 + i: 100 for i in range(41)} | {300 + i: 300 for i in range(41)}
    assert got == want and components.components(spark.createDataFrame([], "a long, b long")).count() == 0
