"""Consensus of evaluations: which learning objects fail, why, and what is to be evaluated again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest(evaluations: DataFrame, accumulate: bool = False) -> DataFrame:
    """Evaluations of each object's last attempt; all attempts' if ``accumulate``."""
    if accumulate or "attempt" not in evaluations.columns:
        return evaluations
    top = evaluations.groupBy("lo_id").agg(F.max("attempt").alias("attempt"))
    return evaluations.join(top, ["lo_id", "attempt"], "left_semi")


def consensus(evaluations: DataFrame, faithfulness: float = 3.0, hint_quality: float = 2.0) -> DataFrame:
    """lo_id, the averages over models, and the reasons to fail (an empty array: passes).

    Nulls are left out; an average or unanimous no over nothing fails nothing. Thresholds are exclusive.
    """
    no = lambda c: (F.count(c) > 0) & (F.count(c) == F.count_if(F.col(c) == "no"))
    sums = evaluations.groupBy("lo_id").agg(
        F.count(F.lit(1)).alias("n"), F.avg("faithfulness").alias("faithfulness"), F.avg("hint_quality").alias("hint_quality"),
        no("atomic").alias("not_atomic"), no("self_contained").alias("not_self_contained"),
    )
    reasons = [
        F.when(F.col("faithfulness") < faithfulness, "faithfulness"), F.when(F.col("not_atomic"), "not atomic"),
        F.when(F.col("not_self_contained"), "not self-contained"), F.when(F.col("hint_quality") < hint_quality, "hint quality"),
    ]
    return sums.select("lo_id", "n", "faithfulness", "hint_quality", F.array_compact(F.array(*reasons)).alias("reasons"))


def failing(judged: DataFrame) -> DataFrame:
    return judged.where(F.size("reasons") > 0)


def survivors(objects: DataFrame, failed: DataFrame, id_col: str = "id") -> DataFrame:
    return objects.join(failed.select(F.col("lo_id").alias(id_col)).distinct(), id_col, "left_anti")


def to_evaluate_again(objects: DataFrame, regenerated: DataFrame, key: str) -> DataFrame:
    return objects.join(regenerated.select(key).distinct(), key, "left_semi")


def missing_evaluations(objects: DataFrame, models: list[str], evaluations: DataFrame, id_col: str = "id") -> DataFrame:
    """(model, lo_id) that no evaluation has; the models are a short list, exploded beside each object."""
    wanted = objects.select(F.explode(F.array(*[F.lit(m) for m in models])).alias("model"), F.col(id_col).alias("lo_id"))
    return wanted.join(evaluations.select("model", "lo_id").distinct(), ["model", "lo_id"], "left_anti")


def last_by_key(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row a key, of the largest order (of ties, the largest row): what a later entry under a key leaves. Pre-aggregated, so a hot key costs a row a task."""
    rest = [order, *(c for c in rows.columns if c not in (*keys, order))]
    picked = rows.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("_last"))
    return picked.select(*keys, *[F.col("_last")[c].alias(c) for c in rest])


def batches(rows: DataFrame, size: int, order: str) -> DataFrame:
    """batch and pos of rows dealt into batches of ``size`` in order, inside each partition of a range of the order (batches don't cross ranges)."""
    place = rows.repartitionByRange(order).sortWithinPartitions(order).withColumn("_place", F.monotonically_increasing_id())  # the partition, then 33 bits of the row in it
    numbered = place.withColumns({"_part": F.shiftright("_place", 33), "_row": F.col("_place").bitwiseAND((1 << 33) - 1)})
    return numbered.withColumns({"batch": F.concat_ws("-", "_part", F.floor(F.col("_row") / size)), "pos": (F.col("_row") % size).cast("int")}).drop("_place", "_part", "_row")
