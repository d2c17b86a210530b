"""One function per service operation: DataFrames in, DataFrames out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from learngraph.functions import statistics as S
from learngraph.functions import text as T
from learngraph.operators import embedding, export, generation, graph, quality, vectors
from learngraph.operators.concepts import normalize
from learngraph.shared import written
from learngraph.sources import connectors, documents, tables
from learngraph.sources.sections import dispatch

EVALUATION_METRICS = ["faithfulness", "clarity", "question_clarity", "hint_quality", "pedagogical_value"]


def embedded(df: DataFrame, key: str, text: str, learned: bool = False) -> DataFrame:
    """``df`` with the vector of a text column: by the hashing embedder, or ``learned`` from which words stand together in these texts. ``key`` names rows."""
    if not learned:
        return connectors.embed(df, text)
    words = T.tokens(F.col(text))
    vectors = embedding.fit(graph.cooccurrence_edges(df.select(key, F.explode(words).alias("concept")), key, "concept"))
    return df.join(embedding.text_vectors(df, key, words, vectors), key)


def extract_units(files: DataFrame, client, *, threshold: float = 0.82, learned: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Units of files (path, content), their counts (types, raw and normalised concepts), and the files refused.

    ``seq`` numbers them in reading order (file, section, place in the answer); of units alike the first stays.
    """
    known, refused = dispatch(files)
    sections = written(documents.scan(known).orderBy("id", "seq").withColumn("seq", F.monotonically_increasing_id()), "sections")
    raw = written(generation.extract_units(sections, client, places=True), "units")
    clean = written(raw.orderBy("seq", "place").withColumn("seq", F.monotonically_increasing_id()).drop("place"), "units")
    units = normalize(vectors.deduplicate(written(embedded(clean, "seq", "statement", learned), "embedded-units"), threshold, id_col="seq", vector_col="vector").drop("vector"))
    each = lambda c: units.select(F.explode(c).alias("c")).agg(F.countDistinct("c").alias("n")).select(F.lit(c).alias("what"), "n")
    types = units.groupBy(F.concat(F.lit("type "), "type").alias("what")).agg(F.count(F.lit(1)).alias("n"))
    return units, types.unionByName(each("concepts")).unionByName(each("normalized_concepts")), refused


def generate_objects(units: DataFrame, client, *, by_type: bool = False) -> DataFrame:
    """Learning objects with choices; ``by_type`` asks for what suits each type of unit."""
    make = generation.generate_by_type if by_type else generation.generate_objects
    return generation.add_choices(make(units, client), client)


def evaluate(objects: DataFrame, units: DataFrame, models: list[str], client, **thresholds) -> tuple[DataFrame, DataFrame]:
    return generation.filter_and_regenerate(objects, units, models, client, **thresholds)


def build_graph(units: DataFrame, objects: DataFrame, client: Callable | None = None, *, least_cosine: float = 0.6, learned: bool = False) -> dict[str, DataFrame]:
    """The concept graph, objects with anchor and prerequisites, and the verified edges (all candidates without a client). Of objects with one id the last counts; cycles are broken at their least confident edges, other edges stay."""
    incidence = units.select(F.monotonically_increasing_id().alias("unit"), F.explode("normalized_concepts").alias("concept")).where("concept != ''")
    incidence = written(incidence, "incidence")
    vertex, edges = graph.vertices(incidence, "concept"), graph.cooccurrence_edges(incidence, "unit", "concept")
    objects = written(quality.last_by_key(objects.drop("anchor", "prerequisite_ids"), ["id"], "seq"), "objects")
    keywords = objects.select("id", F.explode("keywords").alias("keyword"))
    anchors = graph.anchors(keywords, graph.degree_centrality(vertex, edges))
    known = embedded(objects.select("id", T.layer(F.col("type")).alias("layer"), T.question_and_answer(F.col("question"), F.col("answer")).alias("text")), "id", "text", learned)
    placed = known.join(anchors, "id", "left").withColumn("centrality", F.coalesce("centrality", F.lit(0.0)))
    candidates = written(graph.layered_edges(placed, keywords, least_cosine), "candidates")
    sure = F.when(F.col("confidence") == "high", 2).otherwise(1).alias("sure")
    verified = generation.verify_edges(candidates, objects, client).select("src", "dst", sure) if client else candidates.withColumn("sure", F.lit(0))
    verified = written(graph.without_cycles(written(verified, "verified"), "sure"), "verified")
    _, acyclic = graph.topological_levels(objects.select("id"), verified)
    full = objects.join(anchors.select("id", "anchor"), "id", "left").join(graph.prerequisites(objects, verified), "id")
    counts = candidates.agg(F.count(F.lit(1)).alias("candidates")).crossJoin(verified.agg(F.count(F.lit(1)).alias("verified"))).withColumn("is_dag", F.lit(acyclic))
    return {"vertices": vertex, "edges": edges, "objects": full, "prerequisites": verified, "summary": graph.graph_summary(vertex, edges), "counts": counts}


def statistics(objects: DataFrame, evaluations: DataFrame) -> dict[str, DataFrame]:
    overlap = objects.withColumn("lexical_overlap", T.lexical_overlap(F.col("source_statement"), F.col("answer")))
    return {
        "objects": overlap, "overlap": S.numeric_stats(overlap, ["lexical_overlap"], 4), "overlap_histogram": S.histogram(overlap, "lexical_overlap", 0.5, 1.0, 29),
        "types": objects.groupBy("type").agg(F.count(F.lit(1)).alias("n")), "scores": S.numeric_stats(evaluations, EVALUATION_METRICS),
        "rates": S.boolean_rates(evaluations, [c for c in ("atomic", "self_contained", "hallucination_detected") if c in evaluations.columns]),
    }


def learning_paths(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, is_dag, longest path and root nodes (isolated ones included); ``depth_histogram`` goes with it."""
    levels, acyclic = graph.topological_levels(nodes, edges)
    degrees = graph.in_out_degrees(nodes, edges)
    counts = degrees.agg(F.count(F.lit(1)).alias("nodes"), F.sum("out_degree").cast("long").alias("edges"), F.count_if("is_root").alias("root_nodes"))
    return counts.crossJoin(levels.agg(F.max("level").alias("longest_path"))).withColumn("is_dag", F.lit(acyclic))


def depth_histogram(nodes: DataFrame, edges: DataFrame, bins: int = 20) -> DataFrame:
    """How many nodes lie how deep behind the roots."""
    return S.range_histogram(written(graph.depths(nodes, edges), "depths"), "depth", bins)


def add_sources(old: DataFrame, new: DataFrame, key: str = "id", order: str = "seq", *, distinct: bool = True) -> DataFrame:
    """Old and new rows; of one id the old row stays (all rows, if not ``distinct``)."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    if not distinct:
        return both.drop("_new")
    rest = [c for c in both.columns if c != key]
    first = both.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct("_new", order)).alias("s"))
    return first.select(key, *[F.col("s")[c].alias(c) for c in rest if c != "_new"])


def export_units(objects: DataFrame, client, *, title: str | None = None) -> DataFrame:
    """Enriched objects as units: by source, or one unit under a title."""
    full = generation.enrich(objects, client)
    return export.as_one_unit(full, title) if title else export.by_source(full)


def save_objects(objects: DataFrame, root: str, name: str) -> str:
    path = tables.export_path(root, name)
    tables.write_json_lines(objects, path)
    return path
