"""Strongly connected components, and cycles broken at their least confident edges."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from learngraph.operators import paths
from learngraph.shared import written

LOCAL = 1 << 16  # edges on cycles that one task takes apart


def _components(edges: list[tuple[int, int]]) -> dict[int, int]:
    """Of each node the number of its strongly connected component; depth first, without recursion."""
    out: dict[int, list[int]] = {}
    for a, b in edges:
        out.setdefault(a, []).append(b)
        out.setdefault(b, [])
    index: dict[int, int] = {}
    low: dict[int, int] = {}
    found: dict[int, int] = {}
    stack: list[int] = []
    for start in out:
        if start in index:
            continue
        index[start] = low[start] = len(index)
        stack.append(start)
        work = [(start, iter(out[start]))]
        while work:
            v, following = work[-1]
            for w in following:
                if w not in index:
                    index[w] = low[w] = len(index)
                    stack.append(w)
                    work.append((w, iter(out[w])))
                    break
                if w not in found:
                    low[v] = min(low[v], index[w])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[v])
                if low[v] == index[v]:
                    while True:
                        w = stack.pop()
                        found[w] = index[v]
                        if w == v:
                            break
    return found


def _dropped(edges: list[tuple]) -> list[tuple]:
    """Of (confidence, src, dst) edges those that go: of each component its least edge, until there is none."""
    out, todo = [], [sorted(edges, key=lambda e: (e[0] is not None, e[0] or 0.0, e[1], e[2]))]
    while todo:
        part = todo.pop()
        label = _components([(a, b) for _, a, b in part])
        inside: dict[int, list[tuple]] = {}
        for e in part:
            if label[e[1]] == label[e[2]]:
                inside.setdefault(label[e[1]], []).append(e)
        for group in inside.values():
            out.append(group[0])
            todo.append(group[1:])
    return out


def _core(edges: DataFrame) -> DataFrame:
    """The edges between nodes that have a cycle at or before them and at or behind them: those on cycles, and between cycles."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    before, acyclic = paths.levels(ends, edges)
    if acyclic:
        return edges.limit(0)
    behind, _ = paths.levels(ends, edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    free = written(before.select("id").unionByName(behind.select("id")).distinct(), "off-cycles")
    return written(edges.join(free.withColumnRenamed("id", "src"), "src", "left_anti").join(free.withColumnRenamed("id", "dst"), "dst", "left_anti"), "core")


def strong_components(edges: DataFrame) -> DataFrame:
    """node and component (its greatest node) of the nodes on cycles.

    Nodes off cycles are trimmed. Then in rounds: each node takes the greatest node that reaches it (its colour); what reaches that node back
    inside the colour is its component, and goes; the rest is trimmed again.
    """
    rest = _core(edges.where("src != dst").select("src", "dst").distinct())
    found = None
    while not rest.isEmpty():
        colour = rest.select(F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("c", F.col("node"))
        colour = written(colour, "colours")
        while True:
            ahead = rest.join(colour.withColumnRenamed("node", "src"), "src").select(F.col("dst").alias("node"), "c")
            new = written(colour.unionByName(ahead).groupBy("node").agg(F.max("c").alias("c")), "colours")
            still = new.join(colour, ["node", "c"], "left_anti").isEmpty()
            colour = new
            if still:
                break
        inside = rest.join(colour.withColumnRenamed("node", "src").withColumnRenamed("c", "x"), "src").join(colour.withColumnRenamed("node", "dst").withColumnRenamed("c", "y"), "dst")
        inside = written(inside.where("x = y").select("src", "dst", F.col("x").alias("c")), "one-colour")
        own = front = written(colour.where("node = c"), "component")
        while True:
            back = inside.join(front.withColumnRenamed("node", "dst"), ["dst", "c"]).select(F.col("src").alias("node"), "c").distinct()
            front = written(back.join(own, ["node", "c"], "left_anti"), "component")
            if front.isEmpty():
                break
            own = written(own.unionByName(front), "component")
        several = own.groupBy("c").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("c")
        part = own.join(several, "c").select("node", F.col("c").alias("component"))
        found = part if found is None else found.unionByName(part)
        gone = own.select("node")
        rest = _core(written(rest.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti"), "rest"))
    kind = dict(edges.dtypes)["src"]
    return edges.sparkSession.createDataFrame([], f"node {kind}, component {kind}") if found is None else written(found, "components")


def broken(edges: DataFrame, confidence: str | None = None) -> DataFrame:
    """src, dst without self-loops and without, of each strongly connected component, its least edge (by confidence, nulls first, then src, dst), again and again until none is left.

    Edges off cycles are never touched, of equal edges the surest counts. What lies on and between cycles is taken apart in one task where it has ``LOCAL`` edges at most, else in rounds with the same result.
    """
    sure = F.col(confidence).cast("double") if confidence else F.lit(0.0)
    known = edges.where("src IS NOT NULL AND dst IS NOT NULL AND src != dst").select("src", "dst", sure.alias("sure")).groupBy("src", "dst").agg(F.max("sure").alias("sure"))
    known = written(known, "edges")
    kind, core, gone = dict(edges.dtypes)["src"], _core(known), None
    while (n := core.count()) > LOCAL:
        own = strong_components(core)
        inside = core.join(own.withColumnsRenamed({"node": "src", "component": "x"}), "src").join(own.withColumnsRenamed({"node": "dst", "component": "y"}), "dst").where("x = y")
        least = written(inside.groupBy("x").agg(F.min(F.struct(F.col("sure").isNotNull().alias("known"), "sure", "src", "dst")).alias("e")).select("e.src", "e.dst"), "dropped")
        gone = least if gone is None else gone.unionByName(least)
        core = _core(written(inside.select("src", "dst", "sure").join(least, ["src", "dst"], "left_anti"), "core"))
    if n:

        def run(batches):
            rows = [r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("sure", "src", "dst")), strict=True)]
            if out := _dropped(rows):
                types = {f.name: f.type for f in schema}
                yield pa.RecordBatch.from_arrays([pa.array([e[1] for e in out], types["src"]), pa.array([e[2] for e in out], types["dst"])], names=["src", "dst"])

        schema = core.select("src", "dst").limit(0).toArrow().schema
        local = core.repartition(1).mapInArrow(run, f"src {kind}, dst {kind}")
        gone = local if gone is None else gone.unionByName(local)
    return known.select("src", "dst") if gone is None else known.select("src", "dst").join(written(gone, "dropped"), ["src", "dst"], "left_anti")
