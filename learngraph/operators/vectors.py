"""Exact vector operators: cosine, similarity joins by blocks, greedy deduplication and matching."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from learngraph.operators.blocks import unit_rows, whole_blocks
from learngraph.shared import new_path, written

BLOCK = 4096  # rows of one side of a block
MOST_PIVOTS = 1024
SLACK = 1e-6  # of angles, for the rounding of cosines
TILE = 1024  # rows and columns of a product
MATCHED = 1 << 21  # pairs of a range of a greedy matching


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two vectors of a row; 0 where either is zero."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, F.lit(0.0)).otherwise(dot(a, b) / norm)


@dataclass(frozen=True)
class Pivots:
    """Unit vectors that cut space into cells (each vector belongs to its nearest one), and by cell how many vectors it has and how far they are from its pivot."""

    at: np.ndarray
    size: np.ndarray
    near: np.ndarray
    far: np.ndarray

    def angles(self, unit: np.ndarray) -> np.ndarray:
        """Angles of unit vectors (rows) to all pivots (columns)."""
        return np.arccos(np.clip(unit @ self.at.T, -1, 1))

    def visits(self, angles: np.ndarray, least: float) -> np.ndarray:
        """rows x cells: whether a vector of the cell can be within the angle whose cosine is ``least``.

        The triangle inequality holds for angles. So for x within an angle t of some y of cell d, x's angle to d's pivot is
        within t of y's, thus of the cell's range; and as y is no further from d's pivot than from x's own, x's angles to the two differ by
        2 t at most.
        """
        t = math.acos(min(1.0, max(-1.0, least))) + SLACK
        own = angles.min(axis=1, keepdims=True)
        return (angles <= self.far + t) & (angles >= self.near - t) & (angles - own <= 2 * t) & (self.size > 0)


def fit_pivots(rows: DataFrame, count: int) -> np.ndarray:
    """``count`` unit vectors at most (a bounded sample, by a hash of the id) of the rows' (id, v); fewer where vectors repeat."""
    found = rows.where("v IS NOT NULL").orderBy(F.xxhash64("id"), "id").select("v").limit(count).toArrow()
    unit = unit_rows(found.column("v")) if found.num_rows else np.zeros((0, 1))
    unit = unit[(unit != 0).any(1)]
    return np.unique(unit, axis=0) if len(unit) else unit


def measured(rows: DataFrame, at: np.ndarray) -> Pivots:
    """The pivots with the sizes and ranges of their cells over the rows: one pass, one row a task and cell."""

    def run(batches):
        size, near, far = np.zeros(len(at), np.int64), np.full(len(at), np.inf), np.full(len(at), -np.inf)
        pivots = Pivots(at, size, near, far)
        for batch in batches:
            unit = unit_rows(batch.column(0), at.shape[1])
            unit = unit[(unit != 0).any(1)]
            if len(unit):
                angles = pivots.angles(unit)
                cell = angles.argmin(1)
                own = angles[np.arange(len(unit)), cell]
                size += np.bincount(cell, minlength=len(at))
                np.minimum.at(near, cell, own)
                np.maximum.at(far, cell, own)
        some = np.flatnonzero(size)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(size[some]), pa.array(near[some]), pa.array(far[some])], names=["cell", "size", "near", "far"])

    found = rows.select("v").mapInArrow(run, "cell long, size long, near double, far double").groupBy("cell").agg(F.sum("size").alias("size"), F.min("near").alias("near"), F.max("far").alias("far")).collect()
    size, near, far = np.zeros(len(at), np.int64), np.full(len(at), np.inf), np.full(len(at), -np.inf)
    for r in found:  # as many rows as there are pivots at most
        size[r["cell"]], near[r["cell"]], far[r["cell"]] = r["size"], r["near"], r["far"]
    return Pivots(at, size, near, far)


def placed(rows: DataFrame, pivots: Pivots, least: float, *, onward: bool) -> DataFrame:
    """The rows (id, v) that have a direction, each with its cell and the cells it has to visit: of two cells' pairs the lower visits (``onward``), or every cell, its own too."""
    kind = dict(rows.dtypes)

    def run(batches):
        for batch in batches:
            unit = unit_rows(batch.column(1), pivots.at.shape[1])
            some = np.flatnonzero((unit != 0).any(1))
            if not len(some):
                continue
            angles = pivots.angles(unit[some])
            cell = angles.argmin(1)
            go = pivots.visits(angles, least)
            if onward:
                go &= np.arange(len(pivots.at)) > cell[:, None]
            row, to = np.nonzero(go)
            offsets = np.searchsorted(row, np.arange(len(some) + 1)).astype(np.int32)
            part = batch.take(pa.array(some))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell, pa.int32()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(to, pa.int32()))], names=["id", "v", "cell", "visits"])

    return rows.select("id", "v").mapInArrow(run, f"id {kind['id']}, v {kind['v']}, cell int, visits array<int>")


def multiplied(dealt: DataFrame, low: float, high: float, kind: str) -> DataFrame:
    """(a < b, cosine) within bounds, from rows (block, side, id, v): a row of side 0 meets those of side 1 in its block, one of side -1 the others there."""

    def run(batches):
        for table in whole_blocks(batches, rows=4096):
            block, side = table.column("block").to_numpy(), table.column("side").to_numpy()
            ids, unit = table.column("id").combine_chunks(), unit_rows(table.column("v"))
            small = unit.astype(np.float32)
            rounding = (unit.shape[1] + 3) * 2.0**-23  # twice what a product in single precision can be off
            edge = np.concatenate([[0], np.flatnonzero(block[1:] != block[:-1]) + 1, [len(block)]])
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                rows, inside = np.arange(a, b), side[a] < 0
                one, two = (rows, rows) if inside else (rows[side[a:b] == 0], rows[side[a:b] == 1])
                for x in range(0, len(one), TILE):
                    for y in range(x if inside else 0, len(two), TILE):
                        s = small[one[x : x + TILE]] @ small[two[y : y + TILE]].T
                        i, j = np.nonzero((s >= low - rounding) & (s <= high + rounding))
                        i, j = one[x + i], two[y + j]
                        if inside:
                            i, j = i[i < j], j[i < j]
                        exact = np.einsum("ij,ij->i", unit[i], unit[j])
                        ok = (exact >= low) & (exact <= high)
                        if ok.any():
                            p, q = ids.take(pa.array(i[ok])), ids.take(pa.array(j[ok]))
                            turned = pc.greater(p, q)
                            yield pa.RecordBatch.from_arrays([pc.if_else(turned, q, p), pc.if_else(turned, p, q), pa.array(exact[ok])], names=["a", "b", "cosine"])

    return dealt.select("block", "side", "id", "v").repartition("block").sortWithinPartitions("block").mapInArrow(run, f"a {kind}, b {kind}, cosine double")


def _chunks(rows: DataFrame, counts: dict[int, int], name: str) -> DataFrame:
    """The rows of counted cells with the number of chunks of their cell; the counts, a row a pivot at most, are broadcast."""
    known = rows.sparkSession.createDataFrame([(int(k), math.ceil(n / BLOCK)) for k, n in counts.items() if n], f"cell int, {name} int")
    return rows.join(F.broadcast(known), "cell")


def across(home: DataFrame, guests: DataFrame, size: dict[int, int], guest_size: dict[int, int]) -> DataFrame:
    """Blocks (block, side, id, v) in which each cell's home rows (id, v, cell) meet its guests: one for each pair of their chunks."""
    own, there = F.pmod(F.xxhash64("id"), F.col("h")).cast("int"), F.pmod(F.xxhash64("id"), F.col("g")).cast("int")
    counted = lambda rows: _chunks(_chunks(rows.select("id", "v", "cell"), size, "h"), guest_size, "g")
    sides = counted(home).select("id", "v", "cell", own.alias("x"), F.explode(F.sequence(F.lit(0), F.col("g") - 1)).alias("y"), F.lit(0).alias("side"))
    visiting = counted(guests).select("id", "v", "cell", F.explode(F.sequence(F.lit(0), F.col("h") - 1)).alias("x"), there.alias("y"), F.lit(1).alias("side"))
    return sides.unionByName(visiting).select(F.xxhash64(F.lit("across"), "cell", "x", "y").alias("block"), "side", "id", "v")


def within(home: DataFrame, size: dict[int, int]) -> DataFrame:
    """Blocks (block, side, id, v) in which each cell's rows meet each other: one for each chunk and each pair of chunks."""
    own = F.pmod(F.xxhash64("id"), F.col("h")).cast("int")
    dealt = _chunks(home.select("id", "v", "cell"), size, "h").select("id", "v", "cell", own.alias("x"), F.explode(F.sequence(F.lit(0), F.col("h") - 1)).alias("y"))
    side = F.when(F.col("x") == F.col("y"), -1).otherwise((F.col("x") > F.col("y")).cast("int"))
    return dealt.select(F.xxhash64(F.lit("within"), "cell", F.least("x", "y"), F.greatest("x", "y")).alias("block"), side.alias("side"), "id", "v")


def similar_pairs(vectors: DataFrame, low: float, high: float = math.inf, *, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(a < b, cosine) of all pairs with low <= cosine <= high; ids must be unique. Vectors that are null, zero, not finite or of another length have cosine 0.

    Vectors belong to the cell of their nearest pivot and visit the later cells that may hold a partner (``Pivots.visits``); a cell's rows meet
    each other and its visitors in blocks of two chunks of ``BLOCK`` rows. So a vector is copied for the cells that it cannot rule out, by
    chunks of ``BLOCK`` rows of them: n / (2 ``BLOCK``) times where angles rule out nothing, seldom where vectors cluster. Products are
    made in single precision and confirmed in double inside the task; vectors travel in the precision they come in.
    All pairs of a group of copies are pairs; ``deduplicate`` does without them.
    """
    kind = dict(vectors.dtypes)
    array = "array<float>" if kind[vector_col] == "array<float>" else "array<double>"
    rows = written(vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast(array).alias("v")).where("id IS NOT NULL"), "vectors")
    n = rows.count()
    name = kind[id_col]
    if low <= 0:  # vectors without a direction have partners too, and angles rule out little
        everyone = rows.withColumn("cell", F.lit(0))
        return multiplied(within(everyone, {0: n}), low, high, name)
    at = fit_pivots(rows, min(MOST_PIVOTS, max(1, math.ceil(n / BLOCK))))
    if not len(at):
        return rows.sparkSession.createDataFrame([], f"a {name}, b {name}, cosine double")
    pivots = measured(rows, at)
    held = written(placed(rows, pivots, low, onward=True), "placed-vectors")
    guests = held.select("id", "v", F.explode("visits").alias("cell"))
    counts = {r["cell"]: r["n"] for r in guests.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a pivot
    size = {k: int(x) for k, x in enumerate(pivots.size) if x}
    home = held.select("id", "v", "cell")
    return multiplied(within(home, size).unionByName(across(home, guests, size, counts)), low, high, name)


def deduplicate(vectors: DataFrame, least: float, *, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The rows that a pass in ascending order of id keeps: those with no kept row before them at a cosine of ``least`` or more. Ids must be unique.

    Of equal vectors with a direction only the first is compared: the others are dropped with it, or by it, whatever happens to it.
    """
    named = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("embedding"))
    first = written(named.where(has_direction("embedding")).groupBy("embedding").agg(F.min("vec_id").alias("vec_id")), "distinct-vectors")
    kept = greedy_keep(first.select("vec_id"), similar_pairs(first, least))
    kept = kept.unionByName(named.where(~has_direction("embedding")).select("vec_id"))
    return vectors.join(kept.withColumnRenamed("vec_id", id_col), id_col, "left_semi")


def has_direction(vector: str) -> Column:
    """Whether a vector is not null, all its components are finite and one isn't zero."""
    finite = F.forall(vector, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def greedy_keep(ids: DataFrame, pairs: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """Rows of ``ids`` that a pass in ascending order of id keeps: those with no kept smaller neighbour among ``pairs`` (a < b).

    In rounds over the pairs whose ends are both open: an id that is no pair's larger end is kept, and
    its larger neighbours are dropped with their pairs. The least open id settles in every round.
    """
    open_ = written(pairs.select("a", "b").distinct(), "open")
    dropped = None
    while True:
        kept = open_.select("a").distinct().join(open_.select(F.col("b").alias("a")), "a", "left_anti")
        new = written(open_.join(kept, "a", "left_semi").select("b").distinct(), "dropped")
        if new.isEmpty():
            break
        dropped = new if dropped is None else dropped.unionByName(new)
        open_ = written(open_.join(new, "b", "left_anti").join(new.withColumnRenamed("b", "a"), "a", "left_anti"), "open")
    return ids if dropped is None else ids.join(dropped.withColumnRenamed("b", id_col), id_col, "left_anti")


def greedy_matching(pairs: DataFrame) -> DataFrame:
    """Pairs (a < b) that a pass in ascending order takes: each a, unless taken, with the first b that isn't.

    The order is what makes the result, and waiting for it in rounds takes as many as the longest chain of pairs that exclude one another. So
    pairs are dealt into ranges of a of about ``MATCHED`` pairs; range by range, those with an end that was taken go in a join, and one task
    passes over what is left, in order, holding the ids it took.
    """
    spark, kind = pairs.sparkSession, dict(pairs.dtypes)["a"]
    held = written(pairs.select("a", "b").distinct(), "pairs")
    ranges = math.ceil(held.count() / MATCHED)
    if ranges <= 1:
        return written(_passed(held), "taken")
    path = new_path(spark, "ranges")
    held.repartitionByRange(ranges, "a").withColumn("range", F.spark_partition_id()).write.partitionBy("range").parquet(path)
    dealt, taken = spark.read.schema(f"a {kind}, b {kind}, range int").parquet(path), []
    for k in range(ranges):
        open_ = dealt.where(F.col("range") == k).select("a", "b")
        if taken:
            gone = spark.read.schema(held.schema).parquet(*taken).select(F.explode(F.array("a", "b")).alias("id"))
            open_ = open_.join(gone.withColumnRenamed("id", "a"), "a", "left_anti").join(gone.withColumnRenamed("id", "b"), "b", "left_anti").select("a", "b")
        taken.append(new_path(spark, "taken"))
        _passed(open_).write.parquet(taken[-1])
    return spark.read.schema(held.schema).parquet(*taken)


def _passed(pairs: DataFrame) -> DataFrame:
    """The (a, b) that one pass in order takes, in one task."""

    def run(batches):
        gone = set()
        for batch in batches:
            at = []
            for k, (a, b) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                if a not in gone and b not in gone:
                    gone.update((a, b))
                    at.append(k)
            if at:
                yield batch.take(pa.array(at))

    return pairs.repartition(1).sortWithinPartitions("a", "b").mapInArrow(run, pairs.schema)
