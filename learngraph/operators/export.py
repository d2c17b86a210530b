"""Learning objects as the nested units, questions, hints and choices of the export format."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from learngraph.functions import text as T
from learngraph.shared import written

# Fixed values of the format; so are the names of the fields below.
DEFAULTS = {"generated_name": "Learning Object", "time_to_handle": 90, "time_to_explain": 45}
NO_SOURCE = "Unknown Source"


def _pair(name: str, text: Column) -> Column:
    return F.when(T.truthy(text), F.struct(F.lit(name).alias("name"), T.html_paragraph(text).alias("url")))


def question(df: DataFrame) -> Column:
    """The question struct of a learning object; columns that are absent or null take their defaults."""
    has = lambda c, d: F.coalesce(F.col(c), F.lit(d)) if c in df.columns else F.lit(d)
    many = F.coalesce(F.size("mc_options") > 0, F.lit(False)) if "mc_options" in df.columns else F.lit(False)
    prefix = T.source_prefix(F.col("source_title"))
    named = has("generated_name", DEFAULTS["generated_name"])
    right = F.coalesce(F.col("mc_correct_index"), F.lit(0)) if "mc_correct_index" in df.columns else F.lit(0)
    one = F.array(F.struct(F.coalesce(F.col("answer"), F.lit("")).alias("text"), F.lit(True).alias("is_correct")))
    options = F.col("mc_options") if "mc_options" in df.columns else F.array().cast("array<string>")
    return F.struct(
        F.when(T.truthy(prefix), F.concat(F.lit("["), prefix, F.lit("] "), named)).otherwise(named).alias("name"),
        F.coalesce(F.col("question"), F.lit("")).alias("description"),
        F.when(many, "choice").otherwise("open").alias("type"),
        has("time_to_handle", DEFAULTS["time_to_handle"]).cast("int").alias("time_to_handle"),
        has("time_to_explain", DEFAULTS["time_to_explain"]).cast("int").alias("time_to_explain"),
        F.array_compact(F.array(_pair("Hint", T.hint_text(F.col("hint"))), _pair("Source", T.hint_source(F.col("hint"))))).alias("hints"),
        F.when(many, F.transform(options, lambda x, i: F.struct(x.alias("text"), (i == right).alias("is_correct")))).otherwise(one).alias("choices"),
    )


def shuffled_options(df: DataFrame, id_col: str = "id") -> DataFrame:
    """mc_options (the answer and its distractors, if there are three) in an order that the row's id fixes, and the answer's place."""
    three = F.slice(F.array_except(F.array_distinct("distractors"), F.array("answer")), 1, 3)
    keyed = F.transform(F.concat(F.array("answer"), three), lambda x: F.struct(F.xxhash64(F.col(id_col), x).alias("k"), x.alias("x")))
    options = F.transform(F.array_sort(keyed), lambda s: s["x"])
    enough = F.size(three) == 3
    out = df.withColumn("mc_options", F.when(enough, options))
    return out.withColumn("mc_correct_index", F.when(enough, (F.array_position("mc_options", F.col("answer")) - 1).cast("int")))


def _titled(df: DataFrame, *columns: Column) -> DataFrame:
    return df.select(F.when(T.truthy(F.col("source_title")), F.col("source_title")).otherwise(NO_SOURCE).alias("title"), *columns)


def by_source(df: DataFrame, order: str = "seq") -> DataFrame:
    """title, seq (of the first question) and questions in order, by source; objects without one under ``Unknown Source``.

    A row is one unit of an export file. Where a source's questions are too many for a row, ``question_rows`` has them.
    """
    packed = _titled(df, F.col(order).alias("_o"), question(df).alias("_q")).groupBy("title").agg(F.min("_o").alias("seq"), F.array_sort(F.collect_list(F.struct("_o", "_q"))).alias("_all"))
    return packed.select("title", "seq", F.lit("").alias("description"), F.transform("_all", lambda x: x["_q"]).alias("questions"))


def question_rows(df: DataFrame, order: str = "seq", title: str | None = None) -> DataFrame:
    """title, place (from 0) and question: what ``by_source`` holds (with a ``title``, ``as_one_unit``), a row a question, without a source ever standing in one task.

    Only titles and orders are dealt by ranges, sorted and written; a place is that in the range and what the source's ranges
    before it hold, of which there is a row per source and range. Questions meet their places in one join, and only those of their fields that the caller reads travel to it.
    """
    titled = lambda *columns: _titled(df, *columns) if title is None else df.select(F.lit(title).alias("title"), *columns)
    ordered = titled(F.col(order).alias("_o")).repartitionByRange("title", "_o").sortWithinPartitions("title", "_o")
    local = F.monotonically_increasing_id()  # the partition above 33 bits of the place in it
    placed = written(ordered.select("title", "_o", F.shiftright(local, 33).alias("_part"), local.bitwiseAND(F.lit((1 << 33) - 1)).alias("_at")), "question-places")
    runs = placed.groupBy("title", "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("title").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = runs.select("title", "_part", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_start"))
    places = placed.join(starts, ["title", "_part"]).select("title", "_o", (F.col("_at") + F.col("_start")).alias("place"))
    tied = not placed.groupBy("title", "_o").count().where("count > 1").isEmpty()
    if tied:  # the places of one title and order, from the least on, go by the question
        places = places.groupBy("title", "_o").agg(F.min("place").alias("place"))
    places = places.withColumnsRenamed({"title": "_title", "_o": "_order"})
    found = titled(F.col(order).alias("_o"), question(df).alias("question")).join(places, (F.col("title") == F.col("_title")) & F.col("_o").eqNullSafe(F.col("_order")))
    if tied:
        found = found.withColumn("place", F.col("place") + F.row_number().over(Window.partitionBy("title", "_o").orderBy("question")) - 1)
    return found.select("title", "place", "question")


def as_one_unit(df: DataFrame, title: str, order: str = "seq") -> DataFrame:
    """One unit of all questions in order: for one export file's objects."""
    packed = df.agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), question(df).alias("_q")))).alias("_all"))
    return packed.select(F.lit(title).alias("title"), F.lit("").alias("description"), F.transform("_all", lambda x: x["_q"]).alias("questions"))


def total_questions(units: DataFrame) -> DataFrame:
    return units.agg(F.count(F.lit(1)).alias("units"), F.coalesce(F.sum(F.size("questions")), F.lit(0)).alias("questions"))


def source_totals(df: DataFrame) -> DataFrame:
    """``total_questions`` of the units by source, counted without making them."""
    sizes = _titled(df).groupBy("title").agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.count(F.lit(1)).alias("units"), F.coalesce(F.sum("n"), F.lit(0)).alias("questions"))
