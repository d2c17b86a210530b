"""Sections of a text with page headers, and the dispatch of source files by their extension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from learngraph.functions.text import extension

MARK = "--- Page"
FORMATS = {".pdf": "pdf", ".html": "html", ".htm": "html", ".pptx": "pptx", ".ppt": "pptx"}
_BLANK = " \t\n\r"


def _trim(c: Column) -> Column:
    return F.btrim(c, F.lit(_BLANK))


def split_sections(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, seq (from 0), page, source and content of each section.

    Texts are split at every ``--- Page``, in bodies too. The first line of a part is its header
    ``page | Source: title ---``: page is null unless it is a whole number, and then so is source, which
    ends at a second ``|``. Blank parts are no sections; null and empty texts have none.
    """
    parts = texts.select(id_col, F.posexplode(F.split(F.coalesce(text_col, F.lit("")), MARK)).alias("_i", "_part")).withColumn("_part", _trim(F.col("_part"))).where("_part != ''")
    head = F.substring_index("_part", "\n", 1)
    page = F.expr("try_cast(trim(substring_index(_head, '|', 1)) AS INT)")
    source = F.trim(F.replace(F.replace(F.element_at(F.split("_head", r"\|"), 2), F.lit("Source:"), F.lit("")), F.lit("---"), F.lit("")))
    content = F.when(F.contains("_part", F.lit("\n")), _trim(F.expr("substring(_part, instr(_part, '\n') + 1)"))).otherwise("")
    found = parts.withColumn("_head", head).withColumns({"page": page, "content": content})
    found = found.withColumn("source", F.when(F.col("page").isNotNull() & F.contains("_head", F.lit("|")), source))
    # Sections are numbered inside each text's own array: no window over the texts.
    packed = found.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("_i", "page", "source", "content"))).alias("_s"))
    return packed.select(id_col, F.posexplode("_s").alias("seq", "_x")).select(id_col, F.col("seq").cast("long").alias("seq"), "_x.page", "_x.source", "_x.content")


def source_format(path: Column) -> Column:
    """pdf, html or pptx by the lower-cased extension; null for what isn't supported."""
    table = F.create_map(*[F.lit(x) for pair in FORMATS.items() for x in pair])
    return F.try_element_at(table, extension(path))


def dispatch(files: DataFrame, path_col: str = "path") -> tuple[DataFrame, DataFrame]:
    """Files with their ``format``, and the unsupported ones set apart with a reason."""
    known = files.withColumn("format", source_format(F.col(path_col)))
    refused = known.where("format IS NULL").drop("format").withColumn("reason", F.concat(F.lit("unsupported file format: "), F.coalesce(extension(F.col(path_col)), F.lit(""))))
    return known.where("format IS NOT NULL"), refused
