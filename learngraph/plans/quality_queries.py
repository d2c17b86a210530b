"""Evaluation statistics, consensus and rater agreement over line items, and set operations over customers and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from learngraph.functions import statistics as S
from learngraph.functions import text as T
from learngraph.operators import quality as Q
from learngraph.plans import api
from learngraph.plans.bindings import EVALS_SQL, QA_SQL, RATINGS_SQL, evaluations, question_answers, ratings
from learngraph.tables import table

METRICS = ["faithfulness", "clarity", "hint_quality", "pedagogical_value"]


def overlap_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    qa = question_answers(spark, sf_dir).select(T.lexical_overlap(F.col("question"), F.col("answer")).alias("overlap"))
    return S.numeric_stats(qa, ["overlap"], 4)


def overlap_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    qa = question_answers(spark, sf_dir).select(T.lexical_overlap(F.col("question"), F.col("answer")).alias("overlap"))
    return S.histogram(qa, "overlap", 0.0, 1.0, 29)


def eval_numeric_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.numeric_stats(evaluations(spark, sf_dir), METRICS)


def eval_boolean_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.boolean_rates(evaluations(spark, sf_dir), ["atomic", "self_contained"])


def eval_counts_per_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluations(spark, sf_dir).groupBy("model").agg(F.count(F.lit(1)).alias("n"))


def consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = Q.consensus(evaluations(spark, sf_dir))
    return judged.select("lo_id", "n", F.round("faithfulness", 6).alias("faithfulness"), F.round("hint_quality", 6).alias("hint_quality"), F.array_join("reasons", "; ").alias("reasons"))


def survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    objects = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("type"))
    return Q.survivors(objects, Q.failing(Q.consensus(evaluations(spark, sf_dir))))


def regenerate_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    objects = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey")
    failed = Q.failing(Q.consensus(evaluations(spark, sf_dir))).select(F.col("lo_id").alias("id"))
    return Q.to_evaluate_again(objects, failed, "id")


def missing_evaluations(spark: SparkSession, sf_dir: str) -> DataFrame:
    objects = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    return Q.missing_evaluations(objects, ["A", "N", "R"], evaluations(spark, sf_dir).select("model", "lo_id"))


def last_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = evaluations(spark, sf_dir).select("lo_id", "model", "l_linenumber", "faithfulness", "atomic")
    return Q.last_by_key(rows, ["lo_id", "model"], "l_linenumber")


def binary_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.agreement_by_model(evaluations(spark, sf_dir), ["self_contained", "atomic"], "hint_quality")
    return found.select("model", "n", *[F.round(c, 6).alias(c) for c in ("self_contained_rate", "atomic_rate", "hint_quality_mean")], "hint_quality_n")


def _rounded(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, F.round(column, 6))


def kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(S.cohens_kappa(ratings(spark, sf_dir)), "kappa")


def kappa_quadratic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(S.cohens_kappa(ratings(spark, sf_dir), weighted=True), "kappa")


def kappa_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = table(spark, sf_dir, "labels").unpivot("doc_id", ["quality", "toxic"], "model", "score").withColumnRenamed("doc_id", "item")
    return _rounded(S.cohens_kappa(long), "kappa")


def spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(S.spearman(ratings(spark, sf_dir)), "rho").drop("p")


def wilcoxon_w(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.wilcoxon(ratings(spark, sf_dir)).drop("p")


def wilcoxon_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Market segments as raters of nations, by their customers' balances in cents: few items, no two differences alike, so p is exact."""
    customers = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("item"), F.col("c_mktsegment").alias("model"), F.round(F.col("c_acctbal") * 100).cast("long").alias("cents"))
    found = S.wilcoxon(customers.groupBy("item", "model").agg(F.sum("cents").alias("score")))
    return found.withColumn("p", F.round("p", 12))


def boxplot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.five_numbers(evaluations(spark, sf_dir), "model", "clarity")


def add_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Existing and new objects together, the first of each id kept; new ones lack a column."""
    old = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("seq"), F.col("o_orderpriority").alias("type"))
    new = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") + 1_000_000_000).alias("seq"))
    return api.add_sources(old, new).select("id", "seq", "type")


_AVG_RANKS = "SELECT m1, m2, {0} AS v, count(*) AS n, (min(rk) + max(rk)) / 2.0 AS r FROM (SELECT m1, m2, {0}, row_number() OVER (PARTITION BY m1, m2 ORDER BY {0}) AS rk FROM pairs) GROUP BY m1, m2, {0}"
_PAIRS = f"{RATINGS_SQL}, pairs AS (SELECT x.model AS m1, y.model AS m2, x.score AS a, y.score AS b FROM ratings x JOIN ratings y ON x.item = y.item AND x.model < y.model)"
_LABELED = "labels_ AS (SELECT m1, m2, v, row_number() OVER (PARTITION BY m1, m2 ORDER BY v) AS k FROM (SELECT m1, m2, a AS v FROM pairs UNION SELECT m1, m2, b FROM pairs)), idx AS (SELECT p.m1, p.m2, x.k AS a, y.k AS b FROM pairs p JOIN labels_ x ON p.m1 = x.m1 AND p.m2 = x.m2 AND p.a = x.v JOIN labels_ y ON p.m1 = y.m1 AND p.m2 = y.m2 AND p.b = y.v)"
_KAPPA = """obs AS (SELECT m1, m2, count(*)::BIGINT AS n, avg({0}) AS o FROM idx GROUP BY 1, 2),
  ma AS (SELECT m1, m2, a, count(*)::DOUBLE AS na FROM idx GROUP BY 1, 2, 3), mb AS (SELECT m1, m2, b, count(*)::DOUBLE AS nb FROM idx GROUP BY 1, 2, 3),
  ex AS (SELECT m1, m2, sum(na * nb * {0}) AS e FROM ma JOIN mb USING (m1, m2) GROUP BY 1, 2)
  SELECT m1, m2, n, CASE WHEN e > 0 THEN round(1 - o * n * n / e, 6) END AS kappa FROM obs JOIN ex USING (m1, m2)"""
_NOMINAL, _SQUARE = "CASE WHEN a <> b THEN 1.0 ELSE 0.0 END::DOUBLE", "((a - b) * (a - b))::DOUBLE"
_LABEL_PAIRS = "pairs AS (SELECT 'quality' AS m1, 'toxic' AS m2, quality AS a, toxic AS b FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL)"
_OVERLAP = f"{QA_SQL}, t AS (SELECT list_distinct(regexp_extract_all(lower(question), '[\\p{{L}}\\p{{N}}_]+')) s, list_distinct(regexp_extract_all(lower(answer), '[\\p{{L}}\\p{{N}}_]+')) a FROM qa), ov AS (SELECT CASE WHEN len(a) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect(s, a))::DOUBLE / len(a) END AS overlap FROM t)"
_CONSENSUS = f"""{EVALS_SQL}, c AS (SELECT lo_id, count(*)::BIGINT AS n, avg(faithfulness) AS f, avg(hint_quality) AS h, bool_and(atomic = 'no') AS na, bool_and(self_contained = 'no') AS ns FROM evals GROUP BY 1),
  judged AS (SELECT lo_id, n, round(f, 6) AS faithfulness, round(h, 6) AS hint_quality, concat_ws('; ', CASE WHEN f < 3.0 THEN 'faithfulness' END, CASE WHEN na THEN 'not atomic' END, CASE WHEN ns THEN 'not self-contained' END, CASE WHEN h < 2.0 THEN 'hint quality' END) AS reasons FROM c)"""
_STATS = lambda m, src, d: f"SELECT '{m}' AS metric, count({m})::BIGINT AS n, round(avg({m})::DOUBLE, {d}) AS mean, round(CASE WHEN count({m}) = 1 THEN 0.0 ELSE stddev_samp({m}) END::DOUBLE, {d}) AS std, round(min({m})::DOUBLE, {d}) AS min, round(max({m})::DOUBLE, {d}) AS max FROM {src}"

QUERIES = {
    f.__name__: f
    for f in (
        overlap_stats, overlap_histogram, eval_numeric_stats, eval_boolean_rate, eval_counts_per_model, consensus, survivors, regenerate_semi, missing_evaluations,
        last_evaluation, binary_agreement, kappa, kappa_quadratic, kappa_labels, spearman, wilcoxon_w, wilcoxon_exact, boxplot, add_sources,
    )
}
ORACLES = {
    "overlap_stats": f"WITH {_OVERLAP} {_STATS('overlap', 'ov', 4)}",
    "overlap_histogram": f"WITH {_OVERLAP}, b AS (SELECT CASE WHEN overlap = 1 THEN 29 ELSE floor(overlap * 29)::INTEGER + 1 END AS bin, count(*) AS n FROM ov WHERE overlap BETWEEN 0 AND 1 GROUP BY 1) SELECT i::INTEGER AS bin, round((i - 1) * (1.0::DOUBLE / 29), 6) AS low, coalesce(n, 0)::BIGINT AS n FROM range(1, 30) r(i) LEFT JOIN b ON b.bin = r.i",
    "eval_numeric_stats": f"WITH {EVALS_SQL}, e AS (SELECT *, NULL::DOUBLE AS pedagogical_value FROM evals) " + " UNION ALL ".join(_STATS(m, "e", 3) for m in METRICS),
    "eval_boolean_rate": f"WITH {EVALS_SQL} " + " UNION ALL ".join(f"SELECT '{f}' AS flag, count(*) FILTER (WHERE {f} = 'yes')::BIGINT AS n_yes, count(*)::BIGINT AS total, round(count(*) FILTER (WHERE {f} = 'yes')::DOUBLE / count(*), 3) AS rate FROM evals" for f in ("atomic", "self_contained")),
    "eval_counts_per_model": f"WITH {EVALS_SQL} SELECT model, count(*)::BIGINT AS n FROM evals GROUP BY 1",
    "consensus": f"WITH {_CONSENSUS} SELECT * FROM judged",
    "survivors": f"WITH {_CONSENSUS} SELECT o_orderkey AS id, o_orderpriority AS type FROM orders WHERE o_orderkey NOT IN (SELECT lo_id FROM judged WHERE reasons <> '')",
    "regenerate_semi": f"WITH {_CONSENSUS} SELECT o_orderkey AS id, o_custkey FROM orders WHERE o_orderkey IN (SELECT lo_id FROM judged WHERE reasons <> '')",
    "missing_evaluations": f"WITH {EVALS_SQL} SELECT m.model, o_orderkey AS lo_id FROM orders CROSS JOIN (VALUES ('A'), ('N'), ('R')) m(model) WHERE NOT EXISTS (SELECT 1 FROM evals e WHERE e.model = m.model AND e.lo_id = o_orderkey)",
    "last_evaluation": f"WITH {EVALS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY lo_id, model ORDER BY l_linenumber DESC, faithfulness DESC, atomic DESC) AS k FROM evals) SELECT lo_id, model, l_linenumber, faithfulness, atomic FROM r WHERE k = 1",
    "binary_agreement": f"WITH {EVALS_SQL} SELECT model, count(*)::BIGINT AS n, round(count(*) FILTER (WHERE self_contained = 'yes')::DOUBLE / count(*), 6) AS self_contained_rate, round(count(*) FILTER (WHERE atomic = 'yes')::DOUBLE / count(*), 6) AS atomic_rate, round(avg(hint_quality), 6) AS hint_quality_mean, count(hint_quality)::BIGINT AS hint_quality_n FROM evals GROUP BY 1",
    "kappa": f"WITH {_PAIRS}, {_LABELED}, {_KAPPA.format(_NOMINAL)}",
    "kappa_quadratic": f"WITH {_PAIRS}, {_LABELED}, {_KAPPA.format(_SQUARE)}",
    "kappa_labels": f"WITH {_LABEL_PAIRS}, {_LABELED}, {_KAPPA.format(_NOMINAL)}",
    "spearman": f"WITH {_PAIRS}, ra AS ({_AVG_RANKS.format('a')}), rb AS ({_AVG_RANKS.format('b')}) SELECT p.m1, p.m2, count(*)::BIGINT AS n, round(corr(ra.r, rb.r), 6) AS rho FROM pairs p JOIN ra ON p.m1 = ra.m1 AND p.m2 = ra.m2 AND p.a = ra.v JOIN rb ON p.m1 = rb.m1 AND p.m2 = rb.m2 AND p.b = rb.v GROUP BY 1, 2",
    "wilcoxon_w": f"WITH {_PAIRS}, d AS (SELECT m1, m2, a - b AS d FROM pairs WHERE a <> b), r AS (SELECT m1, m2, abs(d) AS v, (min(rk) + max(rk)) / 2.0 AS r FROM (SELECT m1, m2, d, row_number() OVER (PARTITION BY m1, m2 ORDER BY abs(d)) AS rk FROM d) GROUP BY 1, 2, 3) SELECT d.m1, d.m2, count(*)::BIGINT AS n, least(sum(CASE WHEN d.d > 0 THEN r.r ELSE 0 END), sum(CASE WHEN d.d < 0 THEN r.r ELSE 0 END))::DOUBLE AS w FROM d JOIN r ON d.m1 = r.m1 AND d.m2 = r.m2 AND abs(d.d) = r.v GROUP BY 1, 2",
    "wilcoxon_exact": """WITH RECURSIVE r AS (SELECT c_nationkey AS item, c_mktsegment AS model, sum(round(c_acctbal * 100)::BIGINT)::BIGINT AS score FROM customer GROUP BY 1, 2),
      d AS (SELECT x.model AS m1, y.model AS m2, x.score - y.score AS d FROM r x JOIN r y ON x.item = y.item AND x.model < y.model),
      k AS (SELECT m1, m2, d, row_number() OVER (PARTITION BY m1, m2 ORDER BY abs(d)) AS rk FROM d WHERE d <> 0),
      s AS (SELECT m1, m2, count(*)::BIGINT AS n, least(sum(CASE WHEN d > 0 THEN rk ELSE 0 END), sum(CASE WHEN d < 0 THEN rk ELSE 0 END))::DOUBLE AS w FROM k GROUP BY 1, 2),
      c(n, counts) AS (SELECT 0::BIGINT, list_transform(range(1276), lambda x: CASE WHEN x = 0 THEN 1 ELSE 0 END::BIGINT) UNION ALL SELECT n + 1, list_transform(range(1276), lambda x: counts[x + 1] + CASE WHEN x > n THEN counts[x - n] ELSE 0 END) FROM c WHERE n < 50)
      SELECT m1, m2, s.n, w, round(least(1, 2 * list_sum(counts[1:w::BIGINT + 1])::DOUBLE / pow(2, s.n)), 12) AS p FROM s JOIN c ON c.n = s.n""",
    "boxplot": f"WITH {EVALS_SQL}, q AS (SELECT model, min(clarity)::DOUBLE AS min, quantile_cont(clarity, 0.25)::DOUBLE AS q1, median(clarity)::DOUBLE AS median, quantile_cont(clarity, 0.75)::DOUBLE AS q3, max(clarity)::DOUBLE AS max FROM evals GROUP BY 1) SELECT q.*, w.low_whisker, w.high_whisker FROM q JOIN (SELECT e.model, min(clarity)::DOUBLE AS low_whisker, max(clarity)::DOUBLE AS high_whisker FROM evals e JOIN q ON e.model = q.model WHERE clarity BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) GROUP BY 1) w USING (model)",
    "add_sources": "WITH b AS (SELECT o_custkey AS id, o_orderkey AS seq, o_orderpriority AS type FROM orders UNION ALL SELECT c_custkey, c_custkey + 1000000000, NULL FROM customer), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq) AS k FROM b) SELECT id, seq, type FROM r WHERE k = 1",
}
