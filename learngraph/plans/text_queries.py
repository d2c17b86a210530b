"""Scalar operators over documents and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from learngraph.functions import text as T
from learngraph.plans.bindings import QA_SQL, UNITS_SQL, question_answers, units
from learngraph.schemas import CHOICE_TYPES, LAYERS, STOPWORDS, UNIT_TYPES
from learngraph.sources.sections import dispatch, split_sections
from learngraph.tables import table

_IN = lambda words: ", ".join(f"'{w}'" for w in words)
_W = r"[\p{L}\p{N}_]"
_TOK = "regexp_extract_all(lower(coalesce({0}, '')), '[\\p{{L}}\\p{{N}}_]+')"
_BLANK = "list_distinct(list_filter(regexp_split_to_array(lower(coalesce({0}, '')), '\\s+'), lambda x: x <> ''))"


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = T.tokens(F.col("text"))
    return docs.select("doc_id", F.size(found).cast("long").alias("n_tokens"), F.size(F.array_distinct(found)).cast("long").alias("n_distinct"), F.array_join(F.array_sort(F.array_distinct(found)), " ").alias("vocabulary"))


def keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(T.keywords(F.col("text")), " ").alias("keywords"))


def lexical_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return question_answers(spark, sf_dir).select("conv_id", "turn", F.round(T.lexical_overlap(F.col("question"), F.col("answer")), 6).alias("lexical_overlap"))


def token_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, a = F.col("question"), F.col("answer")
    return question_answers(spark, sf_dir).select("conv_id", "turn", F.round(T.similarity(q, a), 6).alias("similarity"), T.are_similar(q, a).alias("are_similar"))


def concept_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keywords in all and distinct, over all documents."""
    each = table(spark, sf_dir, "documents").select(F.explode(T.keywords(F.col("text"))).alias("k"))
    return each.agg(F.count(F.lit(1)).alias("concepts"), F.countDistinct("k").alias("distinct_concepts"))


def joined_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns of each conversation in order, as one text."""
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(T.joined_sections("turn", "text").alias("content"))


def format_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Urls as file paths, with an extension by their number: what is read as what, and what is refused."""
    ends = F.element_at(F.array(*[F.lit(x) for x in (".PDF", ".html", ".htm", ".pptx", ".ppt", ".txt", "")]), (F.col("page_id") % 7 + 1).cast("int"))
    files = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("dir/page"), F.col("page_id").cast("string"), ends).alias("path"))
    known, refused = dispatch(files)
    return known.unionByName(refused, allowMissingColumns=True)


def event_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", T.event_frame(F.col("event_type"), F.col("props")).alias("frame"))


def type_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units(spark, sf_dir).groupBy(T.coerce_type(F.col("type")).alias("type")).agg(F.count(F.lit(1)).alias("n"))


def unit_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    u, kind = units(spark, sf_dir), T.coerce_type(F.col("type"))
    return u.select("doc_id", T.object_id(F.col("statement")).alias("id"), kind.alias("type"), T.layer(F.col("type")).cast("int").alias("layer"), T.allows_choices(kind).alias("allows_choices"), T.source_prefix(F.col("source_title")).alias("prefix"), T.truncate(F.col("statement")).alias("statement"))


def hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = units(spark, sf_dir)
    title = F.when(F.col("doc_id") % 5 != 0, F.col("source_title"))
    hint = T.with_provenance(F.concat("statement", F.lit("...")), title, F.col("source_page"))
    u = u.select("doc_id", hint.alias("hint"))
    return u.select("doc_id", "hint", T.hint_text(F.col("hint")).alias("hint_text"), T.hint_source(F.col("hint")).alias("hint_source"))


def external_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = units(spark, sf_dir).select("doc_id", T.outside_reference(F.col("question")).alias("reason"))
    return found.select("doc_id", F.col("reason").isNull().alias("self_contained"), "reason")


def defined_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    qa = question_answers(spark, sf_dir)
    question = F.concat(F.lit("What is the "), F.element_at(T.tokens(F.col("question")), 1), F.lit("?"))
    asked = F.when(F.col("conv_id") % 2 == 0, question).otherwise(F.col("question"))
    return qa.select("conv_id", "turn", T.defined_concept(asked, F.concat(F.lit("It "), F.lit("is "), F.col("answer"))).alias("concept"))


def section_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    header = F.concat(F.lit("--- Page "), (F.col("doc_id") % 50).cast("string"), F.lit(" | Source: "), F.col("source"), F.lit(" ---\n"), F.col("text"))
    return split_sections(docs.select("doc_id", F.concat(header, F.lit("\n--- Page x | Source: a | b ---\nrest")).alias("text")), "doc_id", "text")


_NAMED = ", ".join(f"nullif(trim(regexp_extract({c}, '{p}', 1)), '')" for c, p in [*(("q", p) for p in T.ASKED), ("a", T.TOLD)])
_FOUND = [f"nullif(regexp_extract(question, '(?i){T.LEFT}({p}){T.RIGHT}', 1), '')" for p in T.OUTSIDE]

QUERIES = {
    "tokens": tokens, "keywords": keywords, "lexical_overlap": lexical_overlap, "token_similarity": token_similarity, "type_distribution": type_distribution,
    "unit_projection": unit_projection, "hints": hints, "external_reference": external_reference, "defined_concepts": defined_concepts, "section_split": section_split, "concept_counts": concept_counts, "joined_sections": joined_sections, "format_dispatch": format_dispatch, "event_frames": event_frames,
}
ORACLES = {
    "tokens": f"WITH t AS (SELECT doc_id, {_TOK.format('text')} AS w FROM documents) SELECT doc_id, len(w)::BIGINT AS n_tokens, len(list_distinct(w))::BIGINT AS n_distinct, array_to_string(list_sort(list_distinct(w)), ' ') AS vocabulary FROM t",
    "keywords": f"SELECT doc_id, array_to_string(list_sort(list_filter(list_distinct({_TOK.format('text')}), lambda x: length(x) > 1 AND x NOT IN ({_IN(STOPWORDS)}))), ' ') AS keywords FROM documents",
    "concept_counts": f"WITH k AS (SELECT unnest(list_filter(list_distinct({_TOK.format('text')}), lambda x: length(x) > 1 AND x NOT IN ({_IN(STOPWORDS)}))) AS k FROM documents) SELECT count(*)::BIGINT AS concepts, count(DISTINCT k)::BIGINT AS distinct_concepts FROM k",
    "joined_sections": "SELECT conv_id, string_agg(coalesce(text, ''), chr(10) || chr(10) || '--- SECTION BREAK ---' || chr(10) || chr(10) ORDER BY turn, text) AS content FROM conversations GROUP BY 1",
    "format_dispatch": "WITH f AS (SELECT page_id, ['.PDF', '.html', '.htm', '.pptx', '.ppt', '.txt', ''][page_id % 7 + 1] AS e FROM pages) SELECT page_id, 'dir/page' || page_id || e AS path, CASE lower(e) WHEN '.pdf' THEN 'pdf' WHEN '.html' THEN 'html' WHEN '.htm' THEN 'html' WHEN '.pptx' THEN 'pptx' WHEN '.ppt' THEN 'pptx' END AS format, CASE WHEN e IN ('.txt', '') THEN 'unsupported file format: ' || e END AS reason FROM f",
    "event_frames": "SELECT event_id, 'data: ' || event_type || '::' || props || chr(10) || chr(10) AS frame FROM events",
    "lexical_overlap": f"WITH {QA_SQL}, t AS (SELECT conv_id, turn, list_distinct({_TOK.format('question')}) s, list_distinct({_TOK.format('answer')}) a FROM qa) SELECT conv_id, turn, CASE WHEN len(a) = 0 THEN 0.0::DOUBLE ELSE round(len(list_intersect(s, a))::DOUBLE / len(a), 6) END AS lexical_overlap FROM t",
    "token_similarity": f"WITH {QA_SQL}, t AS (SELECT conv_id, turn, {_BLANK.format('question')} s, {_BLANK.format('answer')} a FROM qa), v AS (SELECT conv_id, turn, CASE WHEN least(len(s), len(a)) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect(s, a))::DOUBLE / least(len(s), len(a)) END AS x FROM t) SELECT conv_id, turn, round(x, 6) AS similarity, x > 0.6 AS are_similar FROM v",
    "type_distribution": f"WITH {UNITS_SQL} SELECT CASE WHEN type IN ({_IN(UNIT_TYPES)}) THEN type ELSE 'fact' END AS type, count(*)::BIGINT AS n FROM units GROUP BY 1",
    "unit_projection": f"WITH {UNITS_SQL}, c AS (SELECT *, CASE WHEN type IN ({_IN(UNIT_TYPES)}) THEN type ELSE 'fact' END AS t FROM units) SELECT doc_id, substr(md5(statement), 1, 8) AS id, t AS type, CASE type {' '.join(f"WHEN '{k}' THEN {v}" for k, v in LAYERS.items())} ELSE 3 END::INTEGER AS layer, t IN ({_IN(CHOICE_TYPES)}) AS allows_choices, trim(split_part(source_title, ' - ', 1)) AS prefix, CASE WHEN length(statement) > 400 THEN substr(statement, 1, 400) || '…' ELSE statement END AS statement FROM c",
    "hints": f"WITH {UNITS_SQL}, h AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN statement || '...' WHEN source_page <> 0 THEN regexp_replace(statement || '...', '\\.+$', '') || '. [Source: ' || source_title || ', p. ' || source_page || ']' ELSE regexp_replace(statement || '...', '\\.+$', '') || '. [Source: ' || source_title || ']' END AS hint FROM units) SELECT doc_id, hint, CASE WHEN contains(hint, '[Source:') THEN regexp_replace(trim(split_part(hint, '[Source:', 1), chr(32) || chr(9) || chr(10) || chr(13) || chr(12) || chr(11)), '\\.+$', '') ELSE trim(hint, chr(32) || chr(9) || chr(10) || chr(13) || chr(12) || chr(11)) END AS hint_text, CASE WHEN contains(hint, '[Source:') THEN trim(regexp_replace('[Source:' || trim(split_part(hint, '[Source:', 2), chr(32) || chr(9) || chr(10) || chr(13) || chr(12) || chr(11)), ',\\s*p\\.\\s*\\d+', '', 'g')) END AS hint_source FROM h",
    "external_reference": f"WITH {UNITS_SQL}, r AS (SELECT doc_id, coalesce(CASE WHEN NOT regexp_matches(question, '{T.CODE}') THEN {_FOUND[0]} END, {', '.join(_FOUND[1:])}) AS reason FROM units) SELECT doc_id, reason IS NULL AS self_contained, reason FROM r",
    "defined_concepts": f"WITH {QA_SQL}, q AS (SELECT conv_id, turn, lower(CASE WHEN conv_id % 2 = 0 THEN 'What is the ' || {_TOK.format('question')}[1] || '?' ELSE question END) q, lower('It is ' || answer) a FROM qa) SELECT conv_id, turn, coalesce({_NAMED}) AS concept FROM q",
    "section_split": """WITH t AS (SELECT doc_id, '--- Page ' || (doc_id % 50) || ' | Source: ' || source || ' ---' || chr(10) || text || chr(10) || '--- Page x | Source: a | b ---' || chr(10) || 'rest' AS text FROM documents),
      p AS (SELECT doc_id, unnest(string_split(text, '--- Page')) AS part, generate_subscripts(string_split(text, '--- Page'), 1) AS i FROM t),
      c AS (SELECT doc_id, i, trim(part, chr(32) || chr(9) || chr(10) || chr(13)) AS part FROM p),
      h AS (SELECT doc_id, i, split_part(part, chr(10), 1) AS head, CASE WHEN contains(part, chr(10)) THEN trim(substr(part, instr(part, chr(10)) + 1), chr(32) || chr(9) || chr(10) || chr(13)) ELSE '' END AS content FROM c WHERE part <> '')
      SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::BIGINT AS seq, TRY_CAST(trim(split_part(head, '|', 1)) AS INTEGER) AS page,
        CASE WHEN contains(head, '|') AND TRY_CAST(trim(split_part(head, '|', 1)) AS INTEGER) IS NOT NULL THEN trim(replace(replace(split_part(head, '|', 2), 'Source:', ''), '---', '')) END AS source, content FROM h""",
}
