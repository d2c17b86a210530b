"""How near-duplicate groups are dealt into blocks: rows in proportion to a group, every pair across roots met."""

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from learngraph.llm import near_duplicates as N


def group(spark, n):
    return spark.range(n).select(F.lit(1).cast("long").alias("bucket"), F.col("id").cast("string").cast("binary").alias("digest"), F.when(F.col("id") % 3 == 0, F.lit("0")).otherwise(F.col("id").cast("string")).cast("binary").alias("root"), (F.col("id") % 3 == 0).alias("main"), F.lit(10).cast("long").alias("size"))


def test_rows_grow_with_a_group_and_not_its_square(spark):
    few, many = (N._dealt(group(spark, n), "bucket", items=True).count() for n in (12_000, 48_000))
    assert many <= 16 * 48_000 and many <= 4.5 * few


@pytest.mark.parametrize("most", [2, 100])
def test_every_pair_across_roots_meets(spark, monkeypatch, most):
    for name, value in {"BLOCK": 4, "CHUNKS": 3, "MOST": most}.items():
        monkeypatch.setattr(N, name, value)
    blocks = defaultdict(list)
    for r in N._dealt(group(spark, 40), "bucket", items=False).collect():
        blocks[r["block"]].append((r["part"], bytes(r["root"]), bytes(r["digest"])))
    met = defaultdict(int)
    for rows in blocks.values():
        several = len({part for part, _, _ in rows}) > 1
        for k, (p, x, a) in enumerate(rows):
            for q, y, b in rows[:k]:
                if x != y and (p != q or not several):
                    met[frozenset((a, b))] += 1
    ids = [str(i).encode() for i in range(40)]
    want = {frozenset((a, b)) for a in ids for b in ids if a != b and not (int(a) % 3 == int(b) % 3 == 0)}
    assert set(met) == want  # some twice, where a chunk is empty


def test_buckets_of_one_least_class_are_one_where_they_overlap(spark):
    same = [(k, x, "a", 30) for k in range(1, 9) for x in "a" + "bcdefghijklmnopqrstuvwxyzABCD"]
    apart = [(k, f"{k}{x}" if x else "0", "0", 4) for k in range(11, 15) for x in ["", "p", "q", "r"]]
    buckets = spark.createDataFrame(same + apart, "bucket long, digest string, least string, n long").select("bucket", F.col("digest").cast("binary").alias("digest"), F.col("least").cast("binary").alias("least"), "n")
    rows = [(r["bucket"], bytes(r["digest"]).decode()) for r in N._merged(buckets).collect()]
    assert len(rows) == 29 + 12 and len({b for b, d in rows if d in "bcdef"}) == 1
    assert {b for b, d in rows if d[0] == "1"} == {11, 12, 13, 14}
