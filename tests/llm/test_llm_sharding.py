"""Shards of any DataFrame: filtered, exploded, joined, united, limited, and files read twice."""

import pytest
from pyspark.sql import functions as F

from learngraph.llm import sharding, shared


def holds(df, n):
    found = sharding.shuffle_into_shards(df, 8, seed=3).select("id", "shard", "slot").collect()
    sizes = [sum(r["shard"] == s for r in found) for s in range(8)]
    assert len(found) == n and max(sizes) - min(sizes) <= 1
    for s in range(8):
        assert sorted(r["slot"] for r in found if r["shard"] == s) == list(range(sizes[s]))
    return sorted(r["id"] for r in found)


@pytest.fixture(scope="module")
def table(spark):
    return shared.written(spark.range(3000).withColumn("text", F.concat(F.lit("t"), "id")).repartition(3), "rows")


def test_any_dataframe(spark, table):
    assert holds(table.select("id", F.upper("text").alias("text")), 3000) == list(range(3000))
    assert holds(table.where("id % 3 = 1"), 1000) == list(range(1, 3000, 3))
    assert holds(table.select("id", F.explode(F.array(F.lit(1), F.lit(2))).alias("twice")), 6000) == sorted([*range(3000)] * 2)
    assert holds(table.unionByName(table), 6000) == sorted([*range(3000)] * 2)
    assert holds(table.join(table.select((F.col("id") * 2).alias("id")), "id"), 1500) == list(range(0, 3000, 2))
    assert len(set(holds(table.limit(1001), 1001))) == 1001
    assert holds(table.groupBy((F.col("id") % 7).alias("id")).count(), 7) == list(range(7))


def test_files_read_twice(spark, table):
    files = sorted(set(table.inputFiles()))
    n = spark.read.parquet(files[0]).count()
    assert len(holds(spark.read.parquet(files[0], files[0]), 2 * n)) == 2 * n


def test_places_must_be_whole(spark, table):
    rows = sharding._named(table, "file", "at")
    assert sum(n for _, _, n in sharding._spans(rows, "file", "at")) == 3000
    assert sharding._spans(rows.where("at != 5"), "file", "at") is None and sharding._spans(rows.where("at > 0"), "file", "at") is None
    assert sharding._spans(rows.unionByName(rows.where("at = 1")), "file", "at") is None
