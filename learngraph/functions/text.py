"""Scalar text functions as Spark columns: all stay in the JVM's generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from learngraph.schemas import CHOICE_TYPES, DEFAULT_LAYER, DEFAULT_TYPE, LAYERS, STOPWORDS, UNIT_TYPES

# A word character as Python has it; Java's own \w and \b know ASCII only.
WORD = r"[\p{L}\p{N}_]"
LEFT, RIGHT = r"(?:^|[^\p{L}\p{N}_])", r"(?:$|[^\p{L}\p{N}_])"

# What a question says when it leans on something outside of itself.
OUTSIDE = [
    r"the (?:following|above|below|given|provided)",
    r"the (?:table|figure|diagram|chart|graph|image|passage|text|paragraph|excerpt)",
    r"(?:the|this) (?:code|snippet|example|program|function|class|method) (?:above|below|shown|provided|given)",
    r"as shown",
    r"refer to",
    r"see (?:the|above|below)",
]
# Fixed value: what makes a question hold code.
CODE = r"`|(?:^|[^\p{L}\p{N}_])(?:def|class|import) (?:$|[\p{L}\p{N}_])|<-\s|(?:^|[^\p{L}\p{N}_])print\("

# How a question, and failing it an answer, names what it defines.
ASKED = [r"what (?:is|are) (?:a |an |the )?([^\n]+?)\??$", r"unique to ([^\n]+?)\??$"]
TOLD = r"^([^,.]+?)\s+(?:is|are)(?:$|[^\p{L}\p{N}_])"
# A model's answer inside a code fence, commas before a closing bracket, comments, and backslashes that begin no JSON escape.
FENCE_OPENS, FENCE_CLOSES = r"\A```(?:json)?\s*", r"\s*```(?![\s\S])"
TRAILING_COMMA, COMMENT, BAD_ESCAPE = r",\s*([}\]])", r"//[^\n]*", r'\\(?!["\\/bfnrtu])'

_BLANK = " \t\n\r\f\v"


def strip(c: Column) -> Column:
    """Without white space at either end."""
    return F.btrim(c, F.lit(_BLANK))


def truthy(c: Column) -> Column:
    """Neither null nor the empty text."""
    return F.coalesce(F.length(c) > 0, F.lit(False))


def tokens(text: Column) -> Column:
    """All word tokens of the lower-cased text, in order; none of a null text."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({WORD}+)"), F.lit(1))


def lexical_overlap(source: Column, answer: Column) -> Column:
    """Share of the answer's distinct tokens that the source has; 0 for an answer without tokens."""
    own = F.array_distinct(tokens(answer))
    return F.when(F.size(own) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(tokens(source), own)) / F.size(own))


def blank_tokens(text: Column) -> Column:
    """Distinct lower-case tokens between white space."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda x: x != ""))


def similarity(a: Column, b: Column) -> Column:
    """Shared tokens over those of the shorter text; 0 where either has none."""
    x, y = blank_tokens(a), blank_tokens(b)
    least = F.least(F.size(x), F.size(y))
    return F.when(least == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(x, y)) / least)


def are_similar(a: Column, b: Column, threshold: float = 0.6) -> Column:
    return similarity(a, b) > threshold


def keywords(text: Column) -> Column:
    """Distinct tokens of two characters or more that are no stop words, sorted."""
    stop = F.array(*[F.lit(w) for w in STOPWORDS])
    return F.array_sort(F.filter(F.array_except(tokens(text), stop), lambda x: F.length(x) > 1))


def defined_concept(question: Column, answer: Column) -> Column:
    """What a question asks to define: from its own wording, else from the answer's subject; null if neither tells."""
    q, a = F.lower(F.coalesce(question, F.lit(""))), F.lower(F.coalesce(answer, F.lit("")))
    found = [*(F.regexp_extract(q, p, 1) for p in ASKED), F.regexp_extract(a, TOLD, 1)]
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in found])


def coerce_type(kind: Column) -> Column:
    return F.when(kind.isin(*UNIT_TYPES), kind).otherwise(F.lit(DEFAULT_TYPE))


def layer(kind: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in LAYERS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.coalesce(kind, F.lit(""))), F.lit(DEFAULT_LAYER))


def allows_choices(kind: Column) -> Column:
    return kind.isin(*CHOICE_TYPES)


def object_id(statement: Column) -> Column:
    """First eight hex digits of the statement's MD5."""
    return F.substring(F.md5(F.coalesce(statement, F.lit("")).cast("binary")), 1, 8)


def truncate(text: Column, size: int = 400) -> Column:
    text = F.coalesce(text, F.lit(""))
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit("…"))).otherwise(text)


def question_and_answer(question: Column, answer: Column) -> Column:
    return F.concat(F.coalesce(question, F.lit("")), F.lit(" "), F.coalesce(answer, F.lit("")))


def with_provenance(hint: Column, source: Column, page: Column) -> Column:
    """The hint without its last dots, then its source and page, as far as they are known."""
    bare = F.regexp_replace(F.coalesce(hint, F.lit("")), r"\.+\z", "")
    paged = truthy(page.cast("string")) & (page != 0)
    return (
        F.when(truthy(source) & F.coalesce(paged, F.lit(False)), F.concat(bare, F.lit(". [Source: "), source, F.lit(", p. "), page.cast("string"), F.lit("]")))
        .when(truthy(source), F.concat(bare, F.lit(". [Source: "), source, F.lit("]")))
        .otherwise(hint)
    )


def hint_text(hint: Column) -> Column:
    """What stands before the source of a hint."""
    hint = F.coalesce(hint, F.lit(""))
    before = F.regexp_replace(strip(F.element_at(F.split(hint, r"\[Source:"), 1)), r"\.+\z", "")
    return F.when(F.contains(hint, F.lit("[Source:")), before).otherwise(strip(hint))


def hint_source(hint: Column) -> Column:
    """The source of a hint without its page; null if it has none."""
    hint = F.coalesce(hint, F.lit(""))
    after = F.concat(F.lit("[Source:"), strip(F.element_at(F.split(hint, r"\[Source:"), 2)))
    return F.when(F.contains(hint, F.lit("[Source:")), strip(F.regexp_replace(after, r",\s*p\.\s*\d+", "")))


def source_prefix(title: Column) -> Column:
    return strip(F.substring_index(F.coalesce(title, F.lit("")), " - ", 1))


def model_short_name(model: Column) -> Column:
    return F.element_at(F.split(model, "/"), -1)


def outside_reference(question: Column) -> Column:
    """The words by which a question leans on something outside of it (the first pattern's, in order); null if none.

    Questions that hold code may point to what follows: the first pattern doesn't count for them.
    """
    q = F.coalesce(question, F.lit(""))
    found = []
    for k, p in enumerate(OUTSIDE):
        words = F.nullif(F.regexp_extract(q, f"(?i){LEFT}({p}){RIGHT}", 1), F.lit(""))
        found.append(F.when(~q.rlike(CODE), words) if k == 0 else words)
    return F.coalesce(*found)


def html_paragraph(text: Column) -> Column:
    return F.concat(F.lit("<p>"), text, F.lit("</p>"))


def strip_fences(text: Column) -> Column:
    """A model's answer without the code fence around it."""
    return F.regexp_replace(F.regexp_replace(strip(F.coalesce(text, F.lit(""))), FENCE_OPENS, ""), FENCE_CLOSES, "")


def tidy_json(text: Column) -> Column:
    """Without commas before a closing bracket and without // comments (in texts too, as the rule has it)."""
    return F.regexp_replace(F.regexp_replace(text, TRAILING_COMMA, "$1"), COMMENT, "")


def repair_escapes(text: Column) -> Column:
    """Backslashes that begin no JSON escape are doubled."""
    return F.regexp_replace(text, BAD_ESCAPE, r"\\\\")


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)$", 1)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(file_name(path), r"(\.[^.]*)$", 1))


def event_frame(stage: Column, line: Column) -> Column:
    return F.concat(F.lit("data: "), stage, F.lit("::"), line, F.lit("\n\n"))


SECTION_BREAK = "\n\n--- SECTION BREAK ---\n\n"


def joined_sections(order: str, content: str) -> Column:
    """An aggregate: the contents of a group of sections in order, a break between them."""
    packed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.coalesce(F.col(content), F.lit("")).alias("c"))))
    return F.array_join(F.transform(packed, lambda x: x["c"]), SECTION_BREAK)
