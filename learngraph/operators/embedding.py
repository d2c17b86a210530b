"""Vectors of concepts learned from the corpus: a randomised decomposition of their co-occurrence matrix.

The matrix holds, for concepts that share units, the positive part of log(w T / (f g)): how much oftener than by chance they
stand together. Its leading eigenvectors are found by multiplying it with a few random columns, again and again: a product is one join of entries and vectors
on a concept, sums inside each task, and one exchange of these sums. Bases are made orthonormal by their small Gram matrix, which alone
comes to the driver (width squared numbers). Nothing grows with the corpus but tables.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from learngraph.operators.blocks import ragged
from learngraph.shared import written

SPARE = 16  # columns beside those asked for: what makes a random start good enough


def association(edges: DataFrame) -> DataFrame:
    """i, j, value of the symmetric matrix, zeros left out, from undirected edges (src, dst, weight)."""
    clean = edges.where("weight > 0 AND src != dst")
    both = written(clean.select(F.col("src").alias("i"), F.col("dst").alias("j"), "weight").unionByName(clean.select(F.col("dst").alias("i"), F.col("src").alias("j"), "weight")), "entries")
    sums = written(both.groupBy("i").agg(F.sum("weight").alias("f")), "frequencies")
    total = sums.agg(F.sum("f").alias("t"))  # one row
    known = both.join(sums, "i").join(sums.withColumnsRenamed({"i": "j", "f": "g"}), "j").crossJoin(F.broadcast(total))
    return known.select("i", "j", F.log(F.col("weight") * F.col("t") / (F.col("f") * F.col("g"))).alias("value")).where("value > 0")


def _summed(rows: DataFrame, width: int, kind: str) -> DataFrame:
    """i and the sum of its vectors y, from rows (i, y): inside tasks first, then over tasks."""

    def part(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            names = batch.column(0).dictionary_encode()
            at = names.indices.to_numpy()
            y = ragged(batch.column(1))[0].reshape(-1, width)
            order = np.argsort(at, kind="stable")
            first = np.flatnonzero(np.concatenate([[True], at[order][1:] != at[order][:-1]]))
            out = np.add.reduceat(y[order], first)
            yield pa.RecordBatch.from_arrays([names.dictionary.take(pa.array(at[order][first])), _lists(out)], names=["i", "y"])

    def whole(batches):
        left = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([left, batch] if left is not None else [batch]).combine_chunks().to_batches()[0]
            names = table.column(0).dictionary_encode()
            at = names.indices.to_numpy()
            first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            out = pa.RecordBatch.from_arrays([names.dictionary.take(pa.array(at[first])), _lists(np.add.reduceat(ragged(table.column(1))[0].reshape(-1, width), first))], names=["i", "y"])
            left = out.slice(out.num_rows - 1)
            if out.num_rows > 1:
                yield out.slice(0, out.num_rows - 1)
        if left is not None:
            yield left

    schema = f"i {kind}, y array<double>"
    return rows.mapInArrow(part, schema).repartition("i").sortWithinPartitions("i").mapInArrow(whole, schema)


def _lists(x: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(np.ascontiguousarray(x).ravel()))


def _scaled(rows: DataFrame, width: int, kind: str) -> DataFrame:
    """(i, y) of rows (i, value, y): y times value."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), _lists(ragged(batch.column(2))[0].reshape(-1, width) * batch.column(1).to_numpy()[:, None])], names=["i", "y"])

    return rows.select("i", "value", "y").mapInArrow(run, f"i {kind}, y array<double>")


def _gram(rows: DataFrame, width: int) -> np.ndarray:
    """Sum over rows (x, y) of x transposed times y: width squared numbers, added up by Spark."""

    def run(batches):
        out = np.zeros((width, width))
        for batch in batches:
            if batch.num_rows:
                x, y = (ragged(batch.column(k))[0].reshape(-1, width) for k in (0, 1))
                out += x.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width * width)), pa.array(out.ravel())], names=["at", "v"])

    out = np.zeros(width * width)
    for r in rows.select("x", "y").mapInArrow(run, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).collect():
        out[r["at"]] = r["v"]
    return out.reshape(width, width)


def _turned(rows: DataFrame, by: np.ndarray, kind: str, out: str = "array<double>") -> DataFrame:
    """(i, y) with y times a small matrix."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                y = ragged(batch.column(1))[0].reshape(-1, len(by)) @ by
                yield pa.RecordBatch.from_arrays([batch.column(0), _lists(y.astype(np.float32) if "float" in out else y)], names=["i", "y"])

    return rows.select("i", "y").mapInArrow(run, f"i {kind}, y {out}")


def fit(edges: DataFrame, dim: int = 64, rounds: int = 3) -> DataFrame:
    """concept and vector (array<float>, ``dim`` long at most) of every concept with an association, from undirected edges (src, dst, weight).

    Deterministic but for the order of sums. The start is a random sign for each concept and column, by hash; ``rounds`` products sharpen it.
    """
    kind = dict(edges.dtypes)["src"]
    matrix = written(association(edges), "association")
    n = matrix.select("i").distinct().count()
    width = min(dim + SPARE, n)
    if not n:
        return edges.sparkSession.createDataFrame([], f"concept {kind}, vector array<float>")
    signs = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda k: F.when(F.pmod(F.xxhash64(F.col("j"), k), F.lit(2)) == 0, F.lit(1.0)).otherwise(F.lit(-1.0)))
    moved = written(_summed(_scaled(matrix.withColumn("y", signs), width, kind), width, kind), "product")
    for k in range(rounds + 1):
        gram = _gram(moved.select(F.col("y").alias("x"), "y"), width)
        values, u = np.linalg.eigh(gram)
        good = values > values.max() * 1e-12
        if k == 0 or good.sum() < width:  # columns that say nothing new go
            width = int(good.sum())
        basis = written(_turned(moved, u[:, good] / np.sqrt(values[good]), kind), "basis")
        moved = written(_summed(_scaled(matrix.join(basis.withColumnRenamed("i", "j"), "j"), width, kind), width, kind), "product")
    both = basis.select("i", F.col("y").alias("x")).join(moved, "i")
    small = _gram(both, width)
    values, u = np.linalg.eigh((small + small.T) / 2)
    order = np.argsort(-np.abs(values), kind="stable")[: min(dim, width)]
    out = _turned(basis, u[:, order] * np.sqrt(np.abs(values[order])), kind, "array<float>")
    return written(out.select(F.col("i").alias("concept"), F.col("y").alias("vector")), "concept-vectors")


def text_vectors(df: DataFrame, key: str, words: Column, vectors: DataFrame) -> DataFrame:
    """key and vector of every row: the sum of its known words' unit vectors at unit length, null where it has none. ``words`` is an array; a word counts as often as it stands."""
    each = df.select(key, F.explode(words).alias("concept")).groupBy(key, "concept").agg(F.count(F.lit(1)).cast("double").alias("value"))
    unit = vectors.select("concept", F.col("vector").cast("array<double>").alias("v"))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    unit = unit.select("concept", F.transform("v", lambda x: x / F.when(length > 0, length).otherwise(1.0)).alias("y"))
    found = each.join(unit, "concept").select(F.col(key).alias("i"), "value", "y")
    first = found.select(F.size("y").alias("n")).first()
    kind = dict(df.dtypes)[key]
    if first is None:
        return df.select(key).distinct().withColumn("vector", F.lit(None).cast("array<float>"))
    sums = _summed(_scaled(found, first["n"], kind), first["n"], kind)
    size = F.sqrt(F.aggregate("y", F.lit(0.0), lambda s, x: s + x * x))
    made = sums.select(F.col("i").alias(key), F.when(size > 0, F.transform("y", lambda x: (x / size).cast("float"))).alias("vector"))
    return df.select(key).distinct().join(made, key, "left")
