"""Plain table sources and sinks: JSON arrays, key-value texts, stage tables with resume, exports under one root."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a file that holds one JSON array; fields that don't fit are null, fields that are absent too."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path)


def from_rows(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A request's rows: missing keys are null, others than the schema's are left out."""
    names = [f.split(":")[0] for f in spark.createDataFrame([], schema).columns]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)


def export_path(root: str, name: str) -> str:
    """A path under ``root`` for a client's file name, which must be one plain name."""
    if not re.fullmatch(r"[A-Za-z0-9_][A-Za-z0-9._-]{0,127}", name or "") or ".." in name:
        raise ValueError(f"not a plain file name: {name!r}")
    return f"{root.rstrip('/')}/{name}"


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def as_json_array(df: DataFrame, order: str) -> DataFrame:
    """One row, ``json``: all rows as one array in the order of a column. For results of one file's size only."""
    return df.agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("k"), F.to_json(F.struct(*df.columns)).alias("j")))).alias("a")).select(F.concat(F.lit("["), F.array_join(F.transform("a", lambda x: x["j"]), ","), F.lit("]")).alias("json"))


def key_values(df: DataFrame) -> DataFrame:
    """key and value of every cell of a one-row result, as ``key:<tab>value`` lines in ``line``."""
    cells = df.select([F.col(c).cast("string").alias(c) for c in df.columns]).unpivot([], df.columns, "key", "value")
    return cells.withColumn("line", F.concat("key", F.lit(":\t"), F.coalesce("value", F.lit("None"))))


def write_key_values(df: DataFrame, path: str) -> None:
    key_values(df).select("line").write.mode("overwrite").text(path)


def summary(reports: dict[str, DataFrame]) -> DataFrame:
    """One row, ``json``: an object with each report's rows under its name, an object for a report of one row. For statistics, whose rows don't grow with the data."""
    parts = None
    for place, (name, df) in enumerate(reports.items()):
        rows = df.agg(F.array_sort(F.collect_list(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}))).alias("r"))
        many = F.concat(F.lit("["), F.array_join("r", ","), F.lit("]"))
        part = rows.select(F.lit(place).alias("k"), F.concat(F.to_json(F.array(F.lit(name))), F.lit(": "), F.when(F.size("r") == 1, F.col("r")[0]).otherwise(many)).alias("j"))
        parts = part if parts is None else parts.unionByName(part)
    named = F.transform(F.array_sort(F.collect_list(F.struct("k", "j"))), lambda x: F.regexp_replace(x["j"], r'^\["(.*?)"\]: ', '"$1": '))
    return parts.agg(F.concat(F.lit("{"), F.array_join(named, ", "), F.lit("}")).alias("json"))


def write_summary(reports: dict[str, DataFrame], path: str) -> None:
    summary(reports).coalesce(1).write.mode("overwrite").text(path)


def write_download(df: DataFrame, path: str, kind: str = "csv") -> None:
    """Rows for people: CSV with a header and nested columns as JSON, or JSON lines."""
    if kind == "csv":
        csv_ready(df).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    elif kind == "json":
        write_json_lines(df, path)
    else:
        raise ValueError(f"no such kind of download: {kind}")


def csv_ready(df: DataFrame) -> DataFrame:
    """Nested columns as JSON texts, so that the rows can be written as CSV."""
    nested = [c for c, t in df.dtypes if t.startswith(("array", "map", "struct"))]
    return df.withColumns({c: F.to_json(c) for c in nested}) if nested else df


def write_graph(vertices: DataFrame, edges: DataFrame, path: str) -> None:
    """A graph is its two tables."""
    vertices.write.mode("overwrite").parquet(f"{path}/vertices")
    edges.write.mode("overwrite").parquet(f"{path}/edges")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/vertices"), spark.read.parquet(f"{path}/edges")


def stage_done(spark: SparkSession, path: str) -> bool:
    """Whether Spark's committer finished the stage table."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    target = hadoop.Path(f"{path}/_SUCCESS")
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def stage(spark: SparkSession, path: str, make) -> DataFrame:
    """The stage table at ``path``: made once, read again on resume."""
    if not stage_done(spark, path):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def remaining(inputs: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Inputs that no finished output has yet."""
    return inputs.join(done.select(key).distinct(), key, "left_anti")


