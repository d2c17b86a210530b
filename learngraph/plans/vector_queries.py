"""Vector, export and page queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from learngraph.functions import text as T
from learngraph.operators import export, graph, vectors
from learngraph.plans.bindings import QA_SQL, UNITS_SQL, question_answers, units
from learngraph.sources import connectors, documents
from learngraph.tables import table

DEDUP, BAND = 0.4, (0.25, 0.45)  # the embeddings hold 59 pairs above 0.4 and none above 0.6


def _pairs(spark: SparkSession, sf_dir: str, low: float, high: float = 2.0) -> DataFrame:
    return vectors.similar_pairs(table(spark, sf_dir, "embeddings"), low, high)


def vector_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir, DEDUP).select("a", "b", F.round("cosine", 6).alias("cosine"))


def vector_band_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centrality of a vector: 1 / (1 + its label); anchor: its label as text."""
    objects = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("anchor"), (1 / (1 + F.col("label"))).alias("centrality"))
    return graph.band_edges(_pairs(spark, sf_dir, *BAND), objects)


def semantic_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.deduplicate(table(spark, sf_dir, "embeddings"), DEDUP).select("vec_id", "label")


def merge_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.greedy_matching(_pairs(spark, sf_dir, DEDUP))


def _objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = units(spark, sf_dir)
    answer = F.element_at(T.tokens(F.col("statement")), 1)
    wrong = F.slice(F.array_except(F.array_distinct(T.tokens(F.col("statement"))), F.array(answer)), 1, 3)
    options = F.when(F.size(wrong) == 3, F.concat(F.array(answer), wrong))
    title = F.when(F.col("doc_id") % 11 != 0, F.col("source_title"))
    hint = T.with_provenance(F.col("statement"), title, F.col("source_page"))
    return u.select(F.col("doc_id").alias("seq"), title.alias("source_title"), "question", answer.alias("answer"), options.alias("mc_options"), F.lit(0).alias("mc_correct_index"), hint.alias("hint"))


def export_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a question of the export, with its place in its unit."""
    found = export.question_rows(_objects(spark, sf_dir)).withColumnRenamed("question", "q")
    return found.select("title", F.col("place").cast("long").alias("place"), "q.name", "q.type", "q.time_to_handle", F.size("q.choices").cast("long").alias("n_choices"), F.size(F.filter("q.choices", lambda c: c["is_correct"])).cast("long").alias("n_correct"), F.array_join(F.transform("q.hints", lambda h: F.concat(h["name"], F.lit("="), h["url"])), "|").alias("hints"))


def export_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.source_totals(_objects(spark, sf_dir))


def export_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One unit of all questions, every one in its place, as rows: no row and no task holds them all."""
    found = export.question_rows(_objects(spark, sf_dir), title="All")
    first = F.max(F.when(F.col("place") == 0, F.col("question.description")))
    return found.agg(F.count(F.lit(1)).alias("questions"), first.alias("first")).select(F.lit("All").alias("title"), "questions", "first")


def semantic_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine of a question's and its answer's embeddings, by the hashing embedder."""
    qa = connectors.embed_texts(question_answers(spark, sf_dir), {"q": "question", "a": "answer"})
    return qa.select("conv_id", "turn", F.round(vectors.cosine(F.col("q"), F.col("a")), 4).alias("semantic_similarity"))


def stored_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine of the stored vectors that stand for a question and its answer."""
    count = table(spark, sf_dir, "embeddings").agg((F.max("vec_id") + 1).alias("n"))  # one row
    qa = question_answers(spark, sf_dir).select("conv_id", "turn").crossJoin(F.broadcast(count))
    stored = lambda out: table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias(f"{out}_id"), F.col("embedding").alias(out))
    both = qa.withColumns({"q_id": F.col("conv_id") % F.col("n"), "a_id": (F.col("conv_id") + F.col("turn") + 1) % F.col("n")}).join(stored("q"), "q_id").join(stored("a"), "a_id")
    return both.select("conv_id", "turn", F.round(vectors.cosine(F.col("q"), F.col("a")), 4).alias("semantic_similarity"))


def html_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of the raw pages, by the page's url."""
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("path"), F.lit("html").alias("format"), F.col("html").cast("binary").alias("content"), "url")
    return documents.scan(pages, title_col="url")


_COS = "list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[])"
_PAIR = f"prs AS (SELECT x.vec_id AS a, y.vec_id AS b, {_COS} AS cosine FROM embeddings x JOIN embeddings y ON x.vec_id < y.vec_id)"
_TOKS = "regexp_extract_all(lower(statement), '[\\p{L}\\p{N}_]+')"
_EXPORT = f"""{UNITS_SQL}, t AS (SELECT *, {_TOKS} AS w, CASE WHEN doc_id % 11 <> 0 THEN source_title END AS st FROM units),
 o AS (SELECT doc_id, st, w[1] AS answer, len(list_filter(list_distinct(w), lambda x: x <> w[1])) >= 3 AS many, CASE WHEN st IS NULL THEN statement WHEN source_page <> 0 THEN regexp_replace(statement, '\\.+$', '') || '. [Source: ' || st || ', p. ' || source_page || ']' ELSE regexp_replace(statement, '\\.+$', '') || '. [Source: ' || st || ']' END AS hint, question FROM t),
 h AS (SELECT *, CASE WHEN contains(hint, '[Source:') THEN regexp_replace(trim(split_part(hint, '[Source:', 1), chr(32) || chr(9) || chr(10) || chr(13) || chr(12) || chr(11)), '\\.+$', '') ELSE trim(hint, chr(32) || chr(9) || chr(10) || chr(13) || chr(12) || chr(11)) END AS ht, CASE WHEN contains(hint, '[Source:') THEN '[Source:' || st || ']' END AS hs, trim(split_part(coalesce(st, ''), ' - ', 1)) AS prefix FROM o)"""

QUERIES = {f.__name__: f for f in (vector_pairs, vector_band_edges, semantic_dedup, merge_pairs, export_by_source, export_totals, export_single, semantic_similarity, stored_similarity, html_sections)}
ORACLES = {
    "stored_similarity": f"WITH {QA_SQL}, n AS (SELECT max(vec_id) + 1 AS n FROM embeddings) SELECT conv_id, turn, round(list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]), 4) AS semantic_similarity FROM qa, n JOIN embeddings x ON x.vec_id = conv_id % n.n JOIN embeddings y ON y.vec_id = (conv_id + turn + 1) % n.n",
    "vector_pairs": f"WITH {_PAIR} SELECT a, b, round(cosine, 6) AS cosine FROM prs WHERE cosine >= {DEDUP}",
    "vector_band_edges": f"WITH {_PAIR}, s AS (SELECT a, b FROM prs WHERE cosine BETWEEN {BAND[0]} AND {BAND[1]}), d AS (SELECT a, b FROM s UNION ALL SELECT b, a FROM s), o AS (SELECT vec_id AS id, 1 / (1 + label)::DOUBLE AS c FROM embeddings WHERE label IS NOT NULL) SELECT d.a AS src, d.b AS dst FROM d JOIN o x ON x.id = d.a JOIN o y ON y.id = d.b WHERE x.c > 1.2 * y.c",
    "semantic_dedup": f"""WITH RECURSIVE {_PAIR}, low AS (SELECT b AS id, list(a) AS below FROM prs WHERE cosine >= {DEDUP} GROUP BY 1), n AS (SELECT vec_id AS id, row_number() OVER (ORDER BY vec_id) AS k, coalesce(below, []) AS below FROM embeddings LEFT JOIN low ON low.id = vec_id),
      g(k, kept) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL SELECT g.k + 1, CASE WHEN len(list_intersect(g.kept, n.below)) = 0 THEN list_append(g.kept, n.id) ELSE g.kept END FROM g JOIN n ON n.k = g.k + 1)
      SELECT vec_id, label FROM embeddings WHERE vec_id IN (SELECT unnest(kept) FROM g WHERE k = (SELECT max(k) FROM n))""",
    "merge_pairs": f"""WITH RECURSIVE {_PAIR}, up AS (SELECT a AS id, list(b ORDER BY b) AS above FROM prs WHERE cosine >= {DEDUP} GROUP BY 1), n AS (SELECT id, row_number() OVER (ORDER BY id) AS k, above FROM up),
      g(k, gone, made) AS (SELECT 0::BIGINT, []::BIGINT[], []::BIGINT[][] UNION ALL SELECT g.k + 1,
        CASE WHEN list_contains(gone, id) OR len(list_filter(above, lambda x: NOT list_contains(gone, x))) = 0 THEN gone ELSE list_concat(gone, [id, list_filter(above, lambda x: NOT list_contains(gone, x))[1]]) END,
        CASE WHEN list_contains(gone, id) OR len(list_filter(above, lambda x: NOT list_contains(gone, x))) = 0 THEN made ELSE list_append(made, [id, list_filter(above, lambda x: NOT list_contains(gone, x))[1]]) END
        FROM g JOIN n ON n.k = g.k + 1),
      p AS (SELECT unnest(made) AS p FROM g WHERE k = (SELECT max(k) FROM n)) SELECT p[1] AS a, p[2] AS b FROM p""",
    "export_by_source": f"WITH {_EXPORT} SELECT coalesce(st, 'Unknown Source') AS title, (row_number() OVER (PARTITION BY coalesce(st, 'Unknown Source') ORDER BY doc_id) - 1)::BIGINT AS place, CASE WHEN prefix <> '' THEN '[' || prefix || '] ' ELSE '' END || 'Learning Object' AS name, CASE WHEN many THEN 'choice' ELSE 'open' END AS type, 90 AS time_to_handle, CASE WHEN many THEN 4 ELSE 1 END::BIGINT AS n_choices, 1::BIGINT AS n_correct, concat_ws('|', CASE WHEN ht <> '' THEN 'Hint=<p>' || ht || '</p>' END, 'Source=<p>' || hs || '</p>') AS hints FROM h",
    "export_totals": f"WITH {_EXPORT} SELECT count(DISTINCT coalesce(st, 'Unknown Source'))::BIGINT AS units, count(*)::BIGINT AS questions FROM h",
    "export_single": f"WITH {_EXPORT} SELECT 'All' AS title, count(*)::BIGINT AS questions, arg_min(question, doc_id) AS first FROM h",
}
