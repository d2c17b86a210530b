"""Graph queries: concepts are parts that share orders; learning objects are orders, their keywords the parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from learngraph.functions import statistics as S
from learngraph.operators import graph
from learngraph.shared import written
from learngraph.tables import table

COSINE = 0.3  # of two orders' vectors inside a layer: the embeddings hold few pairs above


def incidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.cooccurrence_edges(incidence(spark, sf_dir), "l_orderkey", "l_partkey")


def vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.vertices(incidence(spark, sf_dir), "l_partkey")


def centrality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = graph.degree_centrality(vertices(spark, sf_dir), edges(spark, sf_dir))
    return found.select("concept", "degree", F.round("centrality", 6).alias("centrality"))


def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = graph.graph_summary(vertices(spark, sf_dir), edges(spark, sf_dir))
    return found.select("nodes", "edges", F.round("density", 6).alias("density"), F.round("avg_degree", 6).alias("avg_degree"))


def heavy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.heavy_edges(edges(spark, sf_dir), 2)


def not_isolated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.without_isolated(vertices(spark, sf_dir), heavy(spark, sf_dir))


def degree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five concepts of highest degree, ties by concept."""
    return graph.degrees(vertices(spark, sf_dir), edges(spark, sf_dir)).orderBy(F.desc("degree"), "concept").limit(5)


def node_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.drawing_sizes(vertices(spark, sf_dir), edges(spark, sf_dir))[0]


def edge_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = graph.drawing_sizes(vertices(spark, sf_dir), edges(spark, sf_dir))[1]
    return found.select("src", "dst", F.round("width", 6).alias("width"))


def _keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incidence(spark, sf_dir).select(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("keyword"))


def anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = graph.anchors(_keywords(spark, sf_dir), graph.degree_centrality(vertices(spark, sf_dir), edges(spark, sf_dir)))
    return found.select("id", "anchor", F.round("centrality", 6).alias("centrality"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("ref"), F.col("embedding").alias("vector"))


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders: layer by priority, centrality of their anchor and which vector of the embeddings is theirs."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.substring("o_orderpriority", 1, 1).cast("int").alias("layer"))
    count = table(spark, sf_dir, "embeddings").agg((F.max("vec_id") + 1).alias("n"))  # one row
    placed = orders.crossJoin(F.broadcast(count)).withColumn("ref", F.col("id") % F.col("n")).drop("n")
    known = placed.join(vectors(spark, sf_dir).select("ref"), "ref", "left_semi").join(anchor(spark, sf_dir), "id")
    return known.select("id", "layer", "centrality", "ref")


def layered_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.layered_edges(objects(spark, sf_dir), _keywords(spark, sf_dir), COSINE, vectors(spark, sf_dir))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))


def prerequisites(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = graph.prerequisites(nodes(spark, sf_dir), layered_edges(spark, sf_dir))
    return found.select("id", F.array_join(F.col("prerequisite_ids").cast("array<string>"), ",").alias("prerequisite_ids"))


def in_out_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.in_out_degrees(nodes(spark, sf_dir), layered_edges(spark, sf_dir))


def in_degree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five objects that most others come before, ties by id."""
    return in_out_degrees(spark, sf_dir).select("id", "in_degree").orderBy(F.desc("in_degree"), "id").limit(5)


def named_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate edges with the priorities of both orders; those of finished orders only, ``other`` for the rest."""
    done = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    return graph.named_edges(layered_edges(spark, sf_dir), done, "o_orderkey", "o_orderpriority", "other")


def edge_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes, candidate edges, roots by either definition and isolated nodes."""
    d = in_out_degrees(spark, sf_dir)
    return d.agg(F.count(F.lit(1)).alias("nodes"), F.sum("out_degree").cast("long").alias("edges"), F.count_if("is_root").alias("roots"), F.count_if("is_start").alias("starts"), F.count_if("is_isolated").alias("isolated"))


def _layered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(layered_edges(spark, sf_dir), "layered")


def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.components(nodes(spark, sf_dir).withColumnRenamed("id", "concept"), _layered(spark, sf_dir))


def longest_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels, acyclic = graph.topological_levels(nodes(spark, sf_dir), _layered(spark, sf_dir))
    return levels.agg(F.max("level").cast("long").alias("longest_path")).withColumn("is_dag", F.lit(acyclic))


def depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.depths(nodes(spark, sf_dir), _layered(spark, sf_dir)).withColumn("depth", F.col("depth").cast("long"))


def degree_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.range_histogram(centrality(spark, sf_dir), "degree", 15)


def centrality_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of degrees over all concepts but one, as they are, not rounded."""
    found = graph.degree_centrality(vertices(spark, sf_dir), edges(spark, sf_dir))
    return S.range_histogram(written(found, "centrality"), "centrality", 30)


def depth_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.range_histogram(written(depths(spark, sf_dir), "depths"), "depth", 20)


EDGES_SQL = """
inc AS (SELECT DISTINCT l_orderkey u, l_partkey c FROM lineitem WHERE l_orderkey IS NOT NULL AND l_partkey IS NOT NULL),
edges AS (SELECT a.c AS src, b.c AS dst, count(*)::BIGINT AS weight FROM inc a JOIN inc b ON a.u = b.u AND a.c < b.c GROUP BY 1, 2),
vertices AS (SELECT DISTINCT c AS concept FROM inc),
deg AS (SELECT v.concept, coalesce(d.n, 0)::BIGINT AS degree FROM vertices v LEFT JOIN (SELECT concept, count(*) n FROM (SELECT src AS concept FROM edges UNION ALL SELECT dst FROM edges) GROUP BY 1) d USING (concept)),
cen AS (SELECT concept, degree, degree / ((SELECT count(*) FROM vertices) - 1)::DOUBLE AS centrality FROM deg),
anc AS (SELECT u AS id, c AS anchor, round(centrality, 6) AS centrality FROM (SELECT u, c, centrality, row_number() OVER (PARTITION BY u ORDER BY centrality DESC, c) k FROM inc JOIN cen ON inc.c = cen.concept) WHERE k = 1)
"""
LAYERED_SQL = f"""{EDGES_SQL},
obj AS (SELECT o_orderkey AS id, substr(o_orderpriority, 1, 1)::INTEGER AS layer, a.centrality, e.embedding::DOUBLE[] AS vector FROM orders JOIN anc a ON a.id = o_orderkey JOIN embeddings e ON e.vec_id = o_orderkey % (SELECT max(vec_id) + 1 FROM embeddings)),
shr AS (SELECT x.u AS a, y.u AS b, count(*) AS shared FROM inc x JOIN inc y ON x.c = y.c AND x.u <> y.u GROUP BY 1, 2),
prs AS (SELECT s.a, s.b, s.shared, x.layer la, y.layer lb, x.centrality ca, y.centrality cb FROM shr s JOIN obj x ON x.id = s.a JOIN obj y ON y.id = s.b),
lay AS (SELECT a AS src, b AS dst FROM prs WHERE la < lb AND shared >= 2 UNION SELECT a, b FROM prs JOIN obj x ON x.id = a JOIN obj y ON y.id = b WHERE la = lb AND ca > cb AND list_cosine_similarity(x.vector, y.vector) >= {COSINE}),
io AS (SELECT o_orderkey AS id, (SELECT count(*) FROM lay WHERE dst = o_orderkey)::BIGINT AS in_degree, (SELECT count(*) FROM lay WHERE src = o_orderkey)::BIGINT AS out_degree FROM orders)
"""

def _bins(source: str, x: str, n: int) -> str:
    """SQL of equal bins between the least and the greatest x, the last one closed."""
    return f"""e AS (SELECT min({x})::DOUBLE AS lo, max({x})::DOUBLE AS hi FROM {source}), b AS (SELECT CASE WHEN {x} = hi THEN {n} ELSE floor({n}::DOUBLE * ({x} - lo) / (hi - lo)) + 1 END::INTEGER AS bin, count(*)::BIGINT AS n FROM {source}, e WHERE {x} IS NOT NULL GROUP BY 1)
  SELECT i::INTEGER AS bin, round(lo + (i - 1) * ((hi - lo) / {n}), 6) AS low, coalesce(n, 0)::BIGINT AS n FROM range(1, {n + 1}) r(i) CROSS JOIN e LEFT JOIN b ON b.bin = r.i"""


QUERIES = {
    "concept_graph_edges": edges, "concept_graph_centrality": centrality, "concept_graph_stats": summary, "edge_weight_at_least": heavy, "without_isolated": not_isolated, "degree_topk": degree_topk,
    "node_sizes": node_sizes, "edge_widths": edge_widths, "in_degree_topk": in_degree_topk, "named_edges": named_edges,
    "anchor": anchor, "layered_edges": layered_edges, "prerequisites": prerequisites, "in_out_degrees": in_out_degrees, "edge_counts": edge_counts, "components": components, "longest_path": longest_path, "depths": depths,
    "degree_histogram": degree_histogram, "centrality_histogram": centrality_histogram, "depth_histogram": depth_histogram,
}
_DEG = "in_degree = 0 AS is_root, in_degree = 0 AND out_degree > 0 AS is_start, in_degree = 0 AND out_degree = 0 AS is_isolated"
ORACLES = {
    "concept_graph_edges": f"WITH {EDGES_SQL} SELECT src, dst, weight FROM edges",
    "concept_graph_centrality": f"WITH {EDGES_SQL} SELECT concept, degree, round(centrality, 6) AS centrality FROM cen",
    "concept_graph_stats": f"WITH {EDGES_SQL}, s AS (SELECT (SELECT count(*) FROM vertices) AS n, (SELECT count(*) FROM edges) AS m) SELECT n AS nodes, m AS edges, round(2 * m / (n * (n - 1))::DOUBLE, 6) AS density, round(2 * m / n::DOUBLE, 6) AS avg_degree FROM s",
    "edge_weight_at_least": f"WITH {EDGES_SQL} SELECT src, dst, weight FROM edges WHERE weight >= 2",
    "without_isolated": f"WITH {EDGES_SQL} SELECT DISTINCT concept FROM (SELECT src AS concept FROM edges WHERE weight >= 2 UNION ALL SELECT dst FROM edges WHERE weight >= 2)",
    "degree_topk": f"WITH {EDGES_SQL} SELECT concept, degree FROM deg ORDER BY degree DESC, concept LIMIT 5",
    "anchor": f"WITH {EDGES_SQL} SELECT id, anchor, centrality FROM anc",
    "node_sizes": f"WITH {EDGES_SQL} SELECT concept, 20 + 10 * degree AS size FROM deg",
    "edge_widths": f"WITH {EDGES_SQL} SELECT src, dst, round(0.2::DOUBLE + 1.5::DOUBLE * weight / (SELECT max(weight) FROM edges), 6) AS width FROM edges",
    "in_degree_topk": f"WITH {LAYERED_SQL} SELECT id, in_degree FROM io ORDER BY in_degree DESC, id LIMIT 5",
    "named_edges": f"WITH {LAYERED_SQL} SELECT src, dst, coalesce(x.o_orderpriority, 'other') AS src_name, coalesce(y.o_orderpriority, 'other') AS dst_name FROM lay LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'F') x ON x.o_orderkey = src LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'F') y ON y.o_orderkey = dst",
    "layered_edges": f"WITH {LAYERED_SQL} SELECT src, dst FROM lay",
    "prerequisites": f"WITH {LAYERED_SQL} SELECT o_orderkey AS id, coalesce(string_agg(src::VARCHAR, ',' ORDER BY src), '') AS prerequisite_ids FROM orders LEFT JOIN lay ON dst = o_orderkey GROUP BY 1",
    "in_out_degrees": f"WITH {LAYERED_SQL} SELECT id, in_degree, out_degree, {_DEG} FROM io",
    "edge_counts": f"WITH {LAYERED_SQL} SELECT count(*)::BIGINT AS nodes, sum(out_degree)::BIGINT AS edges, count(*) FILTER (WHERE in_degree = 0)::BIGINT AS roots, count(*) FILTER (WHERE in_degree = 0 AND out_degree > 0)::BIGINT AS starts, count(*) FILTER (WHERE in_degree = 0 AND out_degree = 0)::BIGINT AS isolated FROM io",
    "components": f"WITH RECURSIVE {LAYERED_SQL}, und AS (SELECT src AS u, dst AS v FROM lay UNION SELECT dst, src FROM lay), cc(id, label) AS (SELECT o_orderkey, o_orderkey FROM orders UNION SELECT v, label FROM cc JOIN und ON u = cc.id WHERE label < v) SELECT id AS concept, min(label) AS component FROM cc GROUP BY 1",
    "longest_path": f"WITH RECURSIVE {LAYERED_SQL}, lp(id, len) AS (SELECT o_orderkey, 0 FROM orders UNION SELECT dst, len + 1 FROM lp JOIN lay ON src = lp.id) SELECT max(len)::BIGINT AS longest_path, TRUE AS is_dag FROM lp",
    "depths": f"WITH RECURSIVE {LAYERED_SQL}, bf(id, root, dist) AS (SELECT id, id, 0 FROM io WHERE in_degree = 0 UNION SELECT dst, root, dist + 1 FROM bf JOIN lay ON src = bf.id), sp AS (SELECT id, root, min(dist) AS dist FROM bf GROUP BY 1, 2) SELECT o_orderkey AS id, max(dist)::BIGINT AS depth FROM orders LEFT JOIN sp ON sp.id = o_orderkey GROUP BY 1",
}
ORACLES |= {
    "degree_histogram": f"WITH {EDGES_SQL}, {_bins('cen', 'degree', 15)}",
    "centrality_histogram": f"WITH {EDGES_SQL}, {_bins('cen', 'centrality', 30)}",
    "depth_histogram": ORACLES["depths"].replace(" SELECT o_orderkey AS id,", ", dep AS (SELECT o_orderkey AS id,") + "), " + _bins("dep", "depth", 20),
}
