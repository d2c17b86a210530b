"""Connected components by alternating large and small stars."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from learngraph.shared import written

SALTS = 256
EDGES = 1 << 18  # contracted at once inside a task


def labels(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Of n rows joined by pairs (i, j), each one's component as the least row in it."""
    label = np.arange(n)
    while True:
        x, y = label[i], label[j]
        least = np.minimum(x, y)
        if (x == y).all():
            return label
        np.minimum.at(label, x, least)
        np.minimum.at(label, y, least)
        while (label[label] != label).any():
            label = label[label]


def _stars(table: pa.Table) -> pa.RecordBatch:
    """The edges replaced by stars around the least node of each of their components."""
    u, v = (table.column(c).combine_chunks() for c in ("u", "v"))
    nodes = pa.concat_arrays([u, v]).dictionary_encode()
    order = pc.sort_indices(nodes.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    at = rank[nodes.indices.to_numpy()]
    label = labels(len(order), at[: len(u)], at[len(u) :])
    leaves = np.flatnonzero(label != np.arange(len(order)))
    named = nodes.dictionary.take(pa.array(order))
    return pa.RecordBatch.from_arrays([named.take(pa.array(leaves)), named.take(pa.array(label[leaves]))], names=["u", "v"])


def _contracted(pairs: DataFrame, tasks: int) -> DataFrame:
    """(u, v): stars of the same components inside each task's pairs, ``EDGES`` of them at a time. Far fewer rounds are needed after it, and none after a single task."""

    def run(batches):
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= EDGES:
                yield _stars(pa.Table.from_batches(held))
                held, n = [], 0
        if n:
            yield _stars(pa.Table.from_batches(held))

    return pairs.select("u", "v").coalesce(tasks).mapInArrow(run, pairs.select("u", "v").schema)


def _towards_least(pairs: DataFrame) -> DataFrame:
    """(u, v, m): each pair with m, the least of u and all its v.

    A hub's pairs are dealt by a salt of v; per salt one row meets on u itself.
    """
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
    parts = salted.groupBy("u", "salt").agg(F.min("v").alias("m"))
    least = parts.groupBy("u").agg(F.min("m").alias("m")).select("u", F.least("u", "m").alias("m"))
    return salted.join(parts.select("u", "salt").join(least, "u"), ["u", "salt"]).select("u", "v", "m")


def components(edges: DataFrame) -> DataFrame:
    """node, root: for every node of an edge (columns a and b of one orderable type) the least node it reaches.

    Edges may repeat, run either way or join a node to itself; edges with a null end are left out. A round rewires edges towards the
    least neighbours (rows in proportion to the edges, never to pairs of a component); rounds go on
    until nothing changes, at most about the squared logarithm of the nodes. Each round is written to the shared
    folder, so lineage stays short and a lost executor costs a task. Tasks hold ``EDGES`` edges at most, and what fits in
    one of them needs no round.
    """

    def state(pairs: DataFrame) -> tuple:
        return tuple(pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    ends = edges.where(F.col("a").isNotNull() & F.col("b").isNotNull())
    alone = ends.where(F.col("a") == F.col("b")).select(F.col("a").alias("node"), F.col("a").alias("root"))
    pairs = ends.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    tasks = max(1, math.ceil(edges.count() / EDGES))
    held = written(_contracted(pairs if tasks == 1 else pairs.distinct(), tasks), "edges")
    before = state(held) if tasks > 1 else (0,)
    while before[0]:
        both = held.unionByName(held.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _towards_least(both).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v")).distinct()
        small = _towards_least(large)
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        held = written(_contracted(small.where(F.col("u") != F.col("v")).distinct(), math.ceil(before[0] / EDGES)), "edges")
        now = state(held)
        if now == before:
            break
        before = now
    roots = held.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    found = held.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots).unionByName(alone).groupBy("node").agg(F.min("root").alias("root"))
    return written(found, "roots")
