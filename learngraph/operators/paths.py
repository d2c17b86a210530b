"""Longest and shortest paths in directed graphs, in few rounds.

Levels: a node with a single predecessor lies a known way behind it, so such nodes are taken out along their pointers, which double in
reach with every join: a chain costs rounds by the logarithm of its length. What is left loses its sources, and so on. As soon as
the edges left fit in one task (``LOCAL`` of them, a fixed bound), a task peels them off in memory.

Depths: the roots that reach a node are bits, 64 to a number, so a step of the search is one join and one aggregate over
(node, word of roots) rows, 64 times fewer than (node, root) pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from learngraph.shared import written

LOCAL = 1 << 19  # edges peeled off inside one task


def _peeled(table: pa.Table) -> pa.RecordBatch:
    """id, level of the nodes that have no cycle before them. ``table``: src, dst, w, and base (dst's level at least; such rows have no src)."""
    src, dst = (table.column(c).combine_chunks() for c in ("src", "dst"))
    nodes = pa.concat_arrays([src, dst]).dictionary_encode()
    at = pc.fill_null(nodes.indices, -1).to_numpy(zero_copy_only=False)
    u, v = at[: len(src)], at[len(src) :]
    w = table.column("w").to_numpy()
    n, real = len(nodes.dictionary), u >= 0
    level = np.zeros(n, np.int64)
    np.maximum.at(level, v[~real], w[~real])
    u, v, w = u[real], v[real], w[real]
    left = np.bincount(v, minlength=n)
    order = np.argsort(u, kind="stable")
    u, v, w = u[order], v[order], w[order]
    first = np.searchsorted(u, np.arange(n + 1))
    front, done = np.flatnonzero(left == 0), np.zeros(n, bool)
    while len(front):
        done[front] = True
        count = first[front + 1] - first[front]
        out = np.repeat(first[front] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
        x = v[out]
        np.maximum.at(level, x, np.repeat(level[front], count) + w[out])
        np.subtract.at(left, x, 1)
        x = np.unique(x)
        front = x[left[x] == 0]
    some = np.flatnonzero(done)
    return pa.RecordBatch.from_arrays([nodes.dictionary.take(pa.array(some)), pa.array(level[some])], names=["id", "level"])


def _at_once(edges: DataFrame, base: DataFrame) -> DataFrame:
    kind = dict(edges.dtypes)["src"]
    both = edges.select("src", "dst", "w").unionByName(base.select(F.lit(None).cast(kind).alias("src"), F.col("id").alias("dst"), F.col("level").alias("w")))

    def run(batches):
        held = [b for b in batches if b.num_rows]
        if held:
            yield _peeled(pa.Table.from_batches(held))

    return both.repartition(1).mapInArrow(run, f"id {kind}, level long")


def _hung(edges: DataFrame, base: DataFrame) -> DataFrame:
    """id, up, d: nodes with one predecessor and nothing else before them, the nearest node before them that is not such, and the way between. Those on a cycle of such nodes are left out."""
    one = edges.groupBy("dst").agg(F.count(F.lit(1)).alias("n"), F.first("src").alias("up"), F.first("w").alias("d")).where("n = 1")
    held = written(one.select(F.col("dst").alias("id"), "up", "d").join(base.select("id"), "id", "left_anti"), "hung")
    n, reach = held.count(), 1
    while n and reach <= n:  # the longest chain has n nodes
        on = held.select(F.col("id").alias("up"), F.col("up").alias("up2"), F.col("d").alias("d2"))
        found = held.join(on, "up", "left")
        if reach > 1 and found.where("up2 IS NOT NULL").isEmpty():
            break
        held = written(found.select("id", F.coalesce("up2", "up").alias("up"), (F.col("d") + F.coalesce("d2", F.lit(0))).alias("d")), "hung")
        reach *= 2
    return written(held.join(held.select(F.col("id").alias("up")), "up", "left_anti").select("id", "up", "d"), "hung")


def levels(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, bool]:
    """(id, level), the edges of the longest path to each node, and whether the graph has no cycle. Nodes on or behind a cycle have no row; ends of edges that aren't among the nodes count as such, but have no row either."""
    ids = nodes.select("id").where("id IS NOT NULL").distinct()
    open_ = written(edges.where("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst").distinct().withColumn("w", F.lit(1).cast("long")), "edges")
    spark = nodes.sparkSession
    kind = dict(open_.dtypes)["src"]
    done = base = spark.createDataFrame([], f"id {kind}, level long")
    hanging: list[DataFrame] = []
    while (left := open_.count()) > LOCAL:
        hung = _hung(open_, base)
        if not hung.isEmpty():
            hanging.append(hung)
            moved = open_.join(hung.select(F.col("id").alias("dst")), "dst", "left_anti").join(hung.select(F.col("id").alias("src"), "up", "d"), "src", "left")
            open_ = written(moved.select(F.coalesce("up", "src").alias("src"), "dst", (F.col("w") + F.coalesce("d", F.lit(0))).alias("w")).groupBy("src", "dst").agg(F.max("w").alias("w")), "edges")
        sources = open_.select(F.col("src").alias("id")).distinct().join(open_.select(F.col("dst").alias("id")), "id", "left_anti").join(base, "id", "left")
        sources = written(sources.select("id", F.coalesce("level", F.lit(0)).alias("level")), "sources")
        done = done.unionByName(sources)
        given = open_.join(sources.withColumnRenamed("id", "src"), "src").select(F.col("dst").alias("id"), (F.col("level") + F.col("w")).alias("level"))
        base = written(base.join(sources.select("id"), "id", "left_anti").unionByName(given).groupBy("id").agg(F.max("level").alias("level")), "levels-at-least")
        open_ = written(open_.join(sources.select(F.col("id").alias("src")), "src", "left_anti"), "edges")
        ready = written(base.join(open_.select(F.col("dst").alias("id")), "id", "left_anti").join(open_.select(F.col("src").alias("id")), "id", "left_anti"), "levels")
        done, base = done.unionByName(ready), base.join(ready.select("id"), "id", "left_anti")
        if hung.isEmpty() and sources.isEmpty():
            break  # the rest is on or behind cycles
    if left <= LOCAL:
        done = done.unionByName(_at_once(open_, base))
    done = written(done, "levels")
    for hung in reversed(hanging):
        ups = hung.select("up").distinct().withColumnRenamed("up", "id")
        # A node that other nodes hang from and that no edge is left at is a source.
        bare = ups.join(done, "id", "left_anti").join(edges.select(F.col("dst").alias("id")), "id", "left_anti").withColumn("level", F.lit(0).cast("long"))
        known = written(done.unionByName(bare), "levels")
        done = written(known.unionByName(hung.join(known.withColumnRenamed("id", "up"), "up").select("id", (F.col("level") + F.col("d")).alias("level"))), "levels")
    alone = ids.join(edges.select(F.explode(F.array("src", "dst")).alias("id")), "id", "left_anti").withColumn("level", F.lit(0).cast("long"))
    found = written(done.groupBy("id").agg(F.max("level").alias("level")).join(ids, "id", "left_semi").unionByName(alone), "levels")
    ends = edges.where("src IS NOT NULL AND dst IS NOT NULL").select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    cyclic = ends.join(done.select("id"), "id", "left_anti")
    return found.select("id", F.col("level").cast("int").alias("level")), cyclic.isEmpty()


def depths(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id and depth: the longest, over all roots that reach it, of the shortest paths from a root; null for nodes that none reaches."""
    links = written(edges.where("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst").distinct(), "edges")
    ids = nodes.select("id").distinct()
    roots = ids.join(links.select(F.col("dst").alias("id")), "id", "left_anti").withColumn("k", F.monotonically_increasing_id())
    word = F.expr("shiftright(k, 6)").alias("word")
    state = written(written(roots, "roots").select("id", word, F.expr("shiftleft(1L, cast(k & 63 as int))").alias("seen"), F.expr("shiftleft(1L, cast(k & 63 as int))").alias("new")), "front")
    found, step = state.select("id", F.lit(0).alias("depth")), 0
    while True:
        step += 1
        front = state.where("new != 0").select(F.col("id").alias("src"), "word", "new")
        ahead = front.join(links, "src").select(F.col("dst").alias("id"), "word", F.lit(0).cast("long").alias("seen"), "new")
        both = state.select("id", "word", "seen", F.lit(0).cast("long").alias("new")).unionByName(ahead)
        state = both.groupBy("id", "word").agg(F.bit_or("seen").alias("seen"), F.bit_or("new").alias("new"))
        state = written(state.select("id", "word", F.expr("seen | new").alias("seen"), F.expr("new & ~seen").alias("new")), "front")
        met = written(state.where("new != 0").select("id").distinct().withColumn("depth", F.lit(step)), "depth")
        if met.isEmpty():
            break
        found = found.unionByName(met)
    return ids.join(found.groupBy("id").agg(F.max("depth").alias("depth")), "id", "left")
