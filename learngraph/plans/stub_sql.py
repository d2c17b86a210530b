"""SQL of the model-backed queries: the stub's answers are string work and sums of code points, so they can be told without asking it.

An item's text is its payload's values in order of their names, joined by spaces. Its words are the distinct blank-separated ones of three
characters or more, in order of their first place (``it``, if there are none); its weight is the sum of the model's and the text's code points, by 5.
"""

from __future__ import annotations

from learngraph.plans.bindings import QA_SQL, UNITS_SQL
from learngraph.plans.graph_queries import LAYERED_SQL
from learngraph.schemas import CHOICE_TYPES, STOPWORDS, UNIT_TYPES

_BLANK = r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def _words(source: str) -> str:
    """CTE ``words`` (id, l): the words of ``source``'s rows (id, t)."""
    return f"""parts AS (SELECT id, unnest(l) AS w, generate_subscripts(l, 1) AS pos FROM (SELECT id, regexp_extract_all(t, '[^{_BLANK}]+') AS l FROM {source})),
  firsts AS (SELECT id, w, min(pos) AS pos FROM parts WHERE length(w) > 2 GROUP BY id, w),
  words AS (SELECT s.id, coalesce(l, ['it']) AS l FROM {source} s LEFT JOIN (SELECT id, list(w ORDER BY pos) AS l FROM firsts GROUP BY id) USING (id))"""


def _weight(text: str) -> str:
    return f"coalesce(list_sum(list_transform(regexp_extract_all({text}, '(?s).'), lambda c: unicode(c))), 0)::BIGINT % 5"


_JOIN = lambda n, l="l": f"array_to_string({l}[1:{n}], ' ')"  # noqa: E731, E741
_KNOWN = ", ".join(f"'{t}'" for t in UNIT_TYPES)
_CHOICE = ", ".join(f"'{t}'" for t in CHOICE_TYPES)
_STOP = ", ".join("'" + w.replace("'", "''") + "'" for w in STOPWORDS)
_CUT = lambda c: f"CASE WHEN length({c}) > 400 THEN substr({c}, 1, 400) || '…' ELSE {c} END"
_OBJECTS = f"{QA_SQL}, obj AS (SELECT conv_id * 1000 + turn AS seq, substr(md5(question || chr(10) || answer || (conv_id * 1000 + turn)), 1, 8) AS id, question, answer FROM qa)"

EXTRACT = f"""WITH src AS (SELECT doc_id AS id, coalesce(text, '') AS t, source FROM documents), {_words('src')}
  SELECT id AS seq, 'fact' AS type, {_JOIN(12)} AS statement, least(3, len(l))::INTEGER AS n_concepts, source AS source_title, 1 AS source_page FROM src JOIN words USING (id)"""

# The question names the first word, the answer has the first six, the hint the last one and the unit's provenance.
GENERATE = f"""WITH {UNITS_SQL}, src AS (SELECT *, doc_id AS id, CASE WHEN type IN ({_KNOWN}) THEN type ELSE 'fact' END AS kind FROM units), txt AS (SELECT id, statement || ' ' || kind AS t FROM src), {_words('txt')},
  made AS (SELECT src.*, 'What is said of ' || l[1] || '?' AS q, {_JOIN(6)} AS answer, regexp_replace('Think of ' || l[len(l)] || '...', '\\.+$', '') AS h FROM src JOIN words USING (id))
  SELECT doc_id AS seq, substr(md5(statement), 1, 8) AS id, kind AS type, q AS question, answer, h || '. [Source: ' || source_title || CASE WHEN source_page <> 0 THEN ', p. ' || source_page ELSE '' END || ']' AS hint,
    len(list_filter(list_distinct(regexp_extract_all(lower(q || ' ' || answer), '[\\p{{L}}\\p{{N}}_]+')), lambda x: length(x) > 1 AND x NOT IN ({_STOP})))::INTEGER AS n_keywords,
    CASE WHEN kind IN ({_CHOICE}) THEN 4 ELSE 0 END AS n_options, CASE WHEN kind IN ({_CHOICE}) THEN answer END AS right_option FROM made"""

EVALUATE = f"""WITH {_OBJECTS}, shown AS (SELECT id, {_CUT('answer')} || ' False True Look again. ' || {_CUT('question')} || ' ' || {_CUT('answer')} AS t FROM obj),
  w AS (SELECT id, m.model, {_weight('m.model || t')} AS weight FROM shown, (VALUES ('stub/a'), ('stub/b')) m(model))
  SELECT id AS lo_id, model, 0 AS attempt, (1 + weight)::INTEGER AS faithfulness, 4 AS question_clarity, (1 + weight % 4)::INTEGER AS hint_quality, NULL::INTEGER AS distractor_plausibility, CASE WHEN weight = 0 THEN 'no' ELSE 'yes' END AS atomic, 'yes' AS self_contained FROM w"""

VERIFY = f"""WITH {LAYERED_SQL}, txt AS (SELECT o_orderkey AS id, '{{"question":"' || o_orderpriority || '","answer":"' || o_orderstatus || '"}}' AS t FROM orders),
  w AS (SELECT src, dst, {_weight("y.t || ' ' || x.t")} AS weight FROM (SELECT DISTINCT src, dst FROM lay) JOIN txt x ON x.id = src JOIN txt y ON y.id = dst)
  SELECT src::VARCHAR AS src, dst::VARCHAR AS dst, CASE weight % 3 WHEN 0 THEN 'high' ELSE 'medium' END AS confidence FROM w WHERE weight > 1 AND weight % 3 < 2"""

ENRICH = f"""WITH {_OBJECTS}, txt AS (SELECT seq AS id, answer || ' ' || question AS t FROM obj), {_words('txt')}
  SELECT seq, obj.id, array_to_string(list_transform(regexp_extract_all({_JOIN(3)}, '\\p{{L}}+|[^\\p{{L}}]+'), lambda x: upper(x[1:1]) || lower(x[2:])), '') AS generated_name, (30 + {_weight('t')})::INTEGER AS time_to_handle, 20 AS time_to_explain
  FROM obj JOIN txt ON txt.id = seq JOIN words ON words.id = seq"""
