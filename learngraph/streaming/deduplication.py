"""Deduplication of a stream of units: a stored index of the kept vectors, met by each batch in order of arrival.

Pivots are fitted on the first batch that has vectors and stay. Each kept vector is stored in its pivot's cell, with the cell's size and range of
angles. A batch's vectors look up the cells that can hold something alike, no others, and go if something there is; what is
left is deduplicated in itself and stored. A kept vector came before the batch, so the result equals one pass over everything in the order of batches, then
``seq``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from learngraph.operators import vectors as V
from learngraph.shared import written
from learngraph.streaming.state import BUCKETS, Store, Table, Version

PIVOTS = 256


def open_store(spark: SparkSession, root: str, *, buckets: int = BUCKETS) -> Store:
    """Kept rows by cell (-1: those without a direction, which nothing is alike), the cells, the pivots."""
    tables = {
        "kept": Table("seq bigint, cell int, v array<float>", ("seq", "cell"), by=("cell",)),
        "cells": Table("cell int, size bigint, near double, far double", ("cell",)),
        "pivots": Table("cell int, v array<double>", ("cell",)),
    }
    return Store(spark, root, tables, buckets)


def _pivots(store: Store, base: Version, rows: DataFrame) -> tuple[V.Pivots | None, bool]:
    """The stored pivots with their cells' ranges, or new ones of the batch (and that they are new)."""
    stored = store.read(base, "pivots").orderBy("cell").collect()  # PIVOTS rows at most
    at = np.array([r["v"] for r in stored]) if stored else V.fit_pivots(rows, PIVOTS)
    if not len(at):
        return None, False
    size, near, far = np.zeros(len(at), np.int64), np.full(len(at), np.inf), np.full(len(at), -np.inf)
    for r in store.read(base, "cells").collect():
        size[r["cell"]], near[r["cell"]], far[r["cell"]] = r["size"], r["near"], r["far"]
    return V.Pivots(at, size, near, far), not stored


def fold(store: Store, batch: DataFrame, number: int, *, least: float = 0.82, id_col: str = "seq", vector_col: str = "vector") -> Version:
    """Version ``number``: the newest below it and the batch's rows that are kept (``kept`` tells all)."""
    if not least > 0:
        raise ValueError("the least cosine must be above 0")
    base = store.newest(number)
    rows = written(batch.select(F.col(id_col).cast("long").alias("seq"), F.col(vector_col).cast("array<float>").alias("v")).where("seq IS NOT NULL"), "batch")
    bare = rows.where(~V.has_direction("v")).select("seq", F.lit(-1).alias("cell"), "v")
    rows = rows.where(V.has_direction("v")).select(F.col("seq").alias("id"), "v")
    pivots, new = _pivots(store, base, rows)
    if pivots is None:
        return store.commit(base, number, {"kept": bare})
    held = written(V.placed(rows, pivots, least, onward=False), "placed-vectors")
    guests = held.select("id", "v", F.explode("visits").alias("cell"))
    counts = {r["cell"]: r["n"] for r in guests.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    home = store.read(base, "kept", guests.select("cell").distinct()).select(F.col("seq").alias("id"), "v", "cell")
    met = V.multiplied(V.across(home, guests, dict(enumerate(pivots.size.tolist())), counts), least, np.inf, "bigint")
    alike = met.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    rest = written(held.select("id", "v", "cell").join(alike, "id", "left_anti"), "unlike-kept")
    stays = written(V.deduplicate(rest, least, id_col="id", vector_col="v"), "kept")
    ranges = V.measured(stays, pivots.at)
    some = np.flatnonzero(ranges.size)
    cells = [(int(k), int(pivots.size[k] + ranges.size[k]), float(min(pivots.near[k], ranges.near[k])), float(max(pivots.far[k], ranges.far[k]))) for k in some]
    changes = {"kept": stays.select(F.col("id").alias("seq"), "cell", "v").unionByName(bare), "cells": store.spark.createDataFrame(cells, store.tables["cells"].columns)}
    if new:
        changes["pivots"] = store.spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(pivots.at)], store.tables["pivots"].columns)
    return store.commit(base, number, changes)


def kept(store: Store, version: Version) -> DataFrame:
    """seq of all rows kept so far."""
    return store.read(version, "kept").select("seq")


def deduplication_stream(stream: DataFrame, root: str, checkpoint: str, *, least: float = 0.82, buckets: int = BUCKETS):
    """Start the query that folds each micro-batch of rows (seq, vector) in."""

    def step(batch: DataFrame, epoch: int) -> None:
        fold(open_store(batch.sparkSession, root, buckets=buckets), batch, epoch, least=least)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
