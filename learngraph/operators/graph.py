"""Concept graph operators as vertex and edge DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from learngraph.operators import components as stars
from learngraph.operators import cycles, overlap, paths
from learngraph.shared import enough_partitions, written


def cooccurrence_edges(incidence: DataFrame, unit: str, concept: str) -> DataFrame:
    """Undirected edges (src < dst) weighted by the number of units that hold both concepts.

    ``incidence`` has one row per (unit, concept); repeated rows and nulls count for nothing.
    The pairs are made inside each unit's own sorted array, so the only shuffles are the one on
    the unit and the one on the pair, the latter after map-side partial counts. Tables of many rows are dealt into as many
    partitions as their rows ask for, which adaptive execution does not put together again, and without the partial counts: pairs that come once fill memory there.
    """
    many = enough_partitions(incidence)
    dealt = lambda rows, *keys: rows.repartition(many, *keys) if many else rows
    clean = incidence.where(F.col(unit).isNotNull() & F.col(concept).isNotNull())
    sets = dealt(clean, unit).groupBy(F.col(unit).alias("_u")).agg(F.array_sort(F.collect_set(concept)).alias("_c"))
    firsts = sets.where(F.size("_c") > 1).select("_c", F.posexplode("_c").alias("_i", "src"))
    pairs = firsts.select("src", F.explode(F.expr("slice(_c, _i + 2, size(_c))")).alias("dst"))
    return dealt(pairs, "src", "dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight"))


def vertices(incidence: DataFrame, concept: str) -> DataFrame:
    """Every concept, isolated ones included."""
    return incidence.where(F.col(concept).isNotNull()).select(F.col(concept).alias("concept")).distinct()


def degrees(vertex: DataFrame, edges: DataFrame) -> DataFrame:
    """concept, degree (0 for isolated vertices; a self-loop counts twice)."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("concept"))
    counted = ends.groupBy("concept").agg(F.count(F.lit(1)).alias("degree"))
    return vertex.join(counted, "concept", "left").select("concept", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def degree_centrality(vertex: DataFrame, edges: DataFrame) -> DataFrame:
    """degree / (n - 1); 1.0 where the graph has one vertex."""
    n = vertex.agg(F.count(F.lit(1)).alias("_n"))
    share: Column = F.when(F.col("_n") > 1, F.col("degree") / (F.col("_n") - 1)).otherwise(F.lit(1.0))
    return degrees(vertex, edges).crossJoin(F.broadcast(n)).select("concept", "degree", share.alias("centrality"))


def graph_summary(vertex: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes, edges, density and average degree; zeros where they would divide by nothing."""
    n, m = vertex.agg(F.count(F.lit(1)).alias("n")), edges.agg(F.count(F.lit(1)).alias("m"))
    both = n.crossJoin(F.broadcast(m))  # one row beside one row
    density = F.when(F.col("n") > 1, 2 * F.col("m") / (F.col("n") * (F.col("n") - 1))).otherwise(0.0)
    return both.select(F.col("n").alias("nodes"), F.col("m").alias("edges"), density.alias("density"), F.when(F.col("n") > 0, 2 * F.col("m") / F.col("n")).otherwise(0.0).alias("avg_degree"))


def heavy_edges(edges: DataFrame, least: int = 3) -> DataFrame:
    return edges.where(F.col("weight") >= least)


def drawing_sizes(vertex: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What a picture of the graph shows: concept and node size (20 + 10 a degree); src, dst and width (0.2 + 1.5 of the heaviest edge)."""
    nodes = degrees(vertex, edges).select("concept", (20 + 10 * F.col("degree")).alias("size"))
    top = edges.agg(F.max("weight").alias("_top"))  # one row
    widths = edges.crossJoin(F.broadcast(top)).select("src", "dst", (0.2 + 1.5 * F.col("weight") / F.col("_top")).alias("width"))
    return nodes, widths


def named_edges(edges: DataFrame, objects: DataFrame, id_col: str, name_col: str, default: str = "") -> DataFrame:
    """Edges with the names of both ends; the default for ends that no object has."""
    name = lambda side: objects.select(F.col(id_col).alias(side), F.col(name_col).alias(f"{side}_name"))
    known = edges.join(name("src"), "src", "left").join(name("dst"), "dst", "left")
    return known.withColumns({c: F.coalesce(c, F.lit(default)) for c in ("src_name", "dst_name")})


def without_isolated(vertex: DataFrame, edges: DataFrame) -> DataFrame:
    ends = edges.select(F.explode(F.array("src", "dst")).alias("concept")).distinct()
    return vertex.join(ends, "concept", "left_semi")


def anchors(objects: DataFrame, centrality: DataFrame, id_col: str = "id") -> DataFrame:
    """id, anchor and its centrality: the keyword of highest centrality (0 if unknown; of ties the least keyword) of objects with (id, keyword) rows."""
    known = objects.where("keyword IS NOT NULL").join(centrality.select(F.col("concept").alias("keyword"), "centrality"), "keyword", "left")
    known = known.withColumn("centrality", F.coalesce("centrality", F.lit(0.0)))
    best = known.groupBy(id_col).agg(F.min(F.struct((-F.col("centrality")).alias("c"), F.col("keyword").alias("k"))).alias("best"))
    return best.select(id_col, F.col("best.k").alias("anchor"), (-F.col("best.c")).alias("centrality"))


def layered_edges(objects: DataFrame, keywords: DataFrame, least_cosine: float = 0.6, vectors: DataFrame | None = None) -> DataFrame:
    """Candidate prerequisite edges src -> dst between objects (id, layer, centrality, vector; or ref, which names one of ``vectors``).

    Across layers, from the lower, for two shared keywords; inside a layer, from the higher centrality, for one
    and a cosine of ``least_cosine``. (layer up, centrality down) rises along every edge, so
    with unique ids there is no cycle.
    """
    held = written(objects.select("id", "layer", "centrality", "vector" if vectors is None else "ref"), "objects")
    return overlap.directed(written(overlap.layered_pairs(held, keywords, least_cosine, vectors=vectors), "object-pairs"), held)


def without_cycles(edges: DataFrame, confidence: str | None = None) -> DataFrame:
    """src, dst of the edges with the least confident ones of each cycle removed, until there is no cycle. Edges outside of cycles stay.

    Self-loops go. Strongly connected components are found (``cycles.strong_components``); in every round each component that is left drops its least edge, by
    ``confidence`` (a column of numbers, higher is surer; nulls are least), then src, then dst. An edge goes only while it lies
    inside a component, so on some cycle.
    """
    return cycles.broken(edges, confidence)


def nodes_only(nodes: DataFrame, id_col: str = "id") -> tuple[DataFrame, DataFrame]:
    """The graph of the nodes without any edge: (concept), (src, dst, weight)."""
    vertex = nodes.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("concept")).distinct()
    return vertex, vertex.select(F.col("concept").alias("src"), F.col("concept").alias("dst"), F.lit(0).cast("long").alias("weight")).limit(0)


def band_edges(pairs: DataFrame, objects: DataFrame, factor: float = 1.2) -> DataFrame:
    """src -> dst of similar pairs (a, b) whose anchors (non-empty) differ in centrality by ``factor``, from the higher."""
    brief = objects.where("anchor IS NOT NULL AND anchor != ''").select("id", "centrality")
    both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    known = both.join(brief.select(F.col("id").alias("a"), F.col("centrality").alias("ca")), "a").join(brief.select(F.col("id").alias("b"), F.col("centrality").alias("cb")), "b")
    return known.where(F.col("ca") > factor * F.col("cb")).select(F.col("a").alias("src"), F.col("b").alias("dst"))


def prerequisites(objects: DataFrame, edges: DataFrame) -> DataFrame:
    """id and its sorted prerequisite_ids, empty for none."""
    before = edges.groupBy(F.col("dst").alias("id")).agg(F.array_sort(F.collect_set("src")).alias("prerequisite_ids"))
    kind = before.schema["prerequisite_ids"].dataType
    return objects.select("id").join(before, "id", "left").select("id", F.coalesce("prerequisite_ids", F.array().cast(kind)).alias("prerequisite_ids"))


def defines_edges(objects: DataFrame, keywords: DataFrame) -> DataFrame:
    """src -> dst where dst has the concept that src defines among its keywords.

    Only edges of objects with several concepts can come twice, so only those are looked through for it.
    """
    enough_partitions(keywords)
    defining = objects.where("defines IS NOT NULL AND defines != ''").groupBy(F.col("id").alias("src")).agg(F.collect_set("defines").alias("k"))
    having = keywords.select(F.col("id").alias("dst"), "keyword").distinct()
    met = lambda some: defining.where(some).select("src", F.explode("k").alias("keyword")).join(having, "keyword").where("src != dst").select("src", "dst")
    return met("size(k) = 1").unionByName(met("size(k) > 1").distinct())


def in_out_degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, in_degree, out_degree of every node; is_root (nothing before it), is_start (a root with something after it), is_isolated."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("e"))
    sums = ends.groupBy("e.id").agg(F.sum("e.i").alias("i"), F.sum("e.o").alias("o"))
    known = nodes.select("id").join(sums, "id", "left").select("id", F.coalesce("i", F.lit(0)).alias("in_degree"), F.coalesce("o", F.lit(0)).alias("out_degree"))
    root = F.col("in_degree") == 0
    return known.withColumns({"is_root": root, "is_start": root & (F.col("out_degree") > 0), "is_isolated": root & (F.col("out_degree") == 0)})


def components(vertex: DataFrame, edges: DataFrame) -> DataFrame:
    """concept and component, the least concept it reaches (its own where it has no edge)."""
    held = written(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")), "edges")  # read several times, by few tasks at last
    roots = stars.components(held).withColumnRenamed("node", "concept")
    return vertex.select("concept").join(roots, "concept", "left").select("concept", F.coalesce("root", "concept").alias("component"))


def topological_levels(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, bool]:
    """(id, level), the edges of the longest path to each node, and whether the graph has no cycle; nodes on or behind a cycle have no row."""
    return paths.levels(nodes, edges)


def depths(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id and depth: the longest, over all roots that reach it, of the shortest paths from a root; null for nodes that none reaches."""
    return paths.depths(nodes, edges)
