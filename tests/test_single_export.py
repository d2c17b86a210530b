"""One unit of all questions as rows, without a task that holds them all."""

from pyspark.sql import functions as F

from learngraph.operators import export


def test_single_unit_as_rows(spark):
    df = spark.createDataFrame([(k, "s" * (k % 3), f"q{k}", "a", "h") for k in range(40)], "seq long, source_title string, question string, answer string, hint string")
    want = [q["description"] for q in export.as_one_unit(df, "All").first()["questions"]]
    found = export.question_rows(df, title="All")
    assert [r["d"] for r in found.orderBy("place").select(F.col("question.description").alias("d")).collect()] == want
    assert {r["title"] for r in found.collect()} == {"All"}


def test_single_export_gathers_nothing(spark):
    from learngraph.plans.vector_queries import export_single

    found = export_single(spark, "/root/testdata/sf0.001")
    assert "collect_list" not in found._jdf.queryExecution().toString() and found.count() == 1


def test_places_are_made_without_texts(spark):
    import os

    from learngraph.shared import shared_folder

    rows = [(None if k % 7 == 0 else k // 3, "s" * (k % 3), f"q{k * 17 % 40}", "a", "h") for k in range(40)]  # seq ties, and is null
    df = spark.createDataFrame(rows, "seq long, source_title string, question string, answer string, hint string")
    before = set(os.listdir(shared_folder(spark)))
    found = export.question_rows(df, title="All")
    made = [spark.read.parquet(f"{shared_folder(spark)}/{x}") for x in set(os.listdir(shared_folder(spark))) - before]
    assert made and all(kind in ("string", "bigint") and name != "question" for t in made for name, kind in t.dtypes)
    want = [q["description"] for q in export.as_one_unit(df, "All").first()["questions"]]
    assert [r["d"] for r in found.orderBy("place").select(F.col("question.description").alias("d")).collect()] == want
