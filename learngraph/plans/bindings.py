"""Logical inputs bound to the tables of a scale-factor directory, each with the SQL that binds it alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from learngraph.tables import table

KINDS = ["definition", "theorem", "rule", "constraint", "property", "fact", "algorithm_step", "example", "invalid"]
_CASE = "CASE doc_id % 9 " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(KINDS)) + " END"
PHRASES = ["", "As shown, ", "In the table below, ", "`x` the following: ", "Refer to it. ", "See the text. ", "the following "]
_PHRASE = "CASE doc_id % 7 " + " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(PHRASES)) + " END"

UNITS_SQL = f"units AS (SELECT doc_id, {_CASE} AS type, text AS statement, source || ' - ' || lang AS source_title, (doc_id % 50)::INTEGER AS source_page, {_PHRASE} || text AS question FROM documents)"
QA_SQL = "qa AS (SELECT u.conv_id, u.turn, u.text AS question, a.text AS answer FROM conversations u JOIN conversations a ON u.conv_id = a.conv_id AND u.turn + 1 = a.turn WHERE u.role = 'user' AND a.role = 'assistant')"
EVALS_SQL = """evals AS (SELECT l_orderkey AS lo_id, l_linenumber, l_returnflag AS model, 1 + CAST(l_quantity AS BIGINT) % 5 AS faithfulness, 1 + l_partkey % 5 AS clarity,
  CASE WHEN l_suppkey % 3 = 0 THEN NULL ELSE 1 + l_suppkey % 5 END AS hint_quality, CASE WHEN l_linestatus = 'O' THEN 'yes' ELSE 'no' END AS atomic,
  CASE WHEN l_partkey % 7 = 0 THEN NULL WHEN l_partkey % 2 = 0 THEN 'yes' ELSE 'no' END AS self_contained FROM lineitem)"""
RATINGS_SQL = """ratings AS (SELECT l_orderkey * 10 + l_linenumber AS item, 'part' AS model, 1 + l_partkey % 5 AS score FROM lineitem UNION ALL
  SELECT l_orderkey * 10 + l_linenumber, 'quantity', 1 + CAST(l_quantity AS BIGINT) % 5 FROM lineitem UNION ALL
  SELECT l_orderkey * 10 + l_linenumber, 'supplier', 1 + l_suppkey % 5 FROM lineitem)"""


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as knowledge units, each with a question that may lean on something outside of it."""
    kind, phrase = F.expr(_CASE), F.expr(_PHRASE)
    title = F.concat("source", F.lit(" - "), "lang")
    return table(spark, sf_dir, "documents").select("doc_id", kind.alias("type"), F.col("text").alias("statement"), title.alias("source_title"), (F.col("doc_id") % 50).cast("int").alias("source_page"), F.concat(phrase, "text").alias("question"))


def question_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's turn and the assistant's turn right after it."""
    turns = table(spark, sf_dir, "conversations")
    asked = turns.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    told = turns.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return asked.join(told, ["conv_id", "turn"])


def evaluations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as evaluations of their orders by up to three models."""
    q = F.col("l_quantity").cast("long")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("lo_id"), "l_linenumber", F.col("l_returnflag").alias("model"), (1 + q % 5).alias("faithfulness"), (1 + F.col("l_partkey") % 5).alias("clarity"),
        F.when(F.col("l_suppkey") % 3 != 0, 1 + F.col("l_suppkey") % 5).alias("hint_quality"), F.when(F.col("l_linestatus") == "O", "yes").otherwise("no").alias("atomic"),
        F.when(F.col("l_partkey") % 7 == 0, None).when(F.col("l_partkey") % 2 == 0, "yes").otherwise("no").alias("self_contained"),
    )


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three raters' scores of every line item."""
    item = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("item")
    wide = table(spark, sf_dir, "lineitem").select(item, (1 + F.col("l_partkey") % 5).alias("part"), (1 + F.col("l_quantity").cast("long") % 5).alias("quantity"), (1 + F.col("l_suppkey") % 5).alias("supplier"))
    return wide.unpivot("item", ["part", "quantity", "supplier"], "model", "score")
