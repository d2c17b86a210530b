"""Product codes of vectors with whole-number codebooks, exact in every step.

Components become floor(256 x), vectors are cut into equal parts, and each part is named by the nearest of
its codebook's entries. The nearest entry is found by a float32 matrix product, which screens: with u = 2^-24 a
product of s terms whose factors were rounded to float32 differs from the exact one by at most
g |x| |c|, g = (s + 2) u / (1 - (s + 2) u), in whatever order it is summed. So each squared distance lies in an interval; every
entry whose interval reaches down to the least upper end is evaluated again in int64, and the least exact distance,
of ties the least index, wins. Most parts keep one entry after the screen.

A round reads the vectors once; tasks emit sums and counts of the entries they met, so what is shuffled and comes
to the driver is bounded by the codebooks' size. Codebooks alone are sent to the tasks.

Vectors that are null, hold null or non-finite components, or a component of 2^20 or more in size (its squared
distances leave 64 bits) are dropped, as are those whose length is not that of the least id's. Zero vectors stay. Null ids are the largest; repeated
ids are separate rows, ordered by their vectors. An empty table gives no rows. Fewer vectors than entries make
smaller codebooks. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from learngraph.llm.shared import written

LIMIT = float(1 << 20)
_U = 2.0**-24


def screened(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows i and entries j (rising) whose interval of distances overlaps the row's best; x and c are int64, within 2^28."""
    s = x.shape[1]
    gamma = (s + 2) * _U / (1 - (s + 2) * _U)
    product = (x.astype(np.float32) @ c.astype(np.float32).T).astype(np.float64)
    size = np.sqrt((x.astype(np.float64) ** 2).sum(1))[:, None] * np.sqrt((c.astype(np.float64) ** 2).sum(1))[None]
    square = (c * c).sum(1).astype(np.float64)[None]
    score = square - 2 * product
    # Twice the product's error, then the roundings of these doubles themselves.
    width = 2 * gamma * size * (1 + 1e-9) + 16 * 2.0**-53 * (square + 2 * np.abs(product))
    return np.nonzero(score - width <= (score + width).min(axis=1, keepdims=True))


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row of x the nearest row of c (of ties the first) and its squared distance."""
    if not len(x):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    i, j = screened(x, c)
    d = x[i] - c[j]
    d = (d * d).sum(1)
    start = np.searchsorted(i, np.arange(len(x)))
    least = np.minimum.reduceat(d, start)
    at = np.flatnonzero(d == least[i])
    first = at[np.searchsorted(i[at], np.arange(len(x)))]
    return j[first], d[first]


def _scaled(column: pa.Array, dim: int, scale: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.floor(scale * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)).astype(np.int64)


def codebooks(kept: DataFrame, *, parts: int, entries: int, rounds: int, scale: int) -> np.ndarray:
    """parts x entries x components. ``kept`` has id and vector (array<double>) of equal lengths; started from its least ids, then moved ``rounds`` times."""
    first = [r[0] for r in kept.orderBy(F.col("id").asc_nulls_last(), "vector").select("vector").limit(entries).collect()]
    dim = len(first[0])
    if dim % parts:
        raise ValueError(f"vectors of {dim} components can't be cut into {parts} equal parts")
    books = np.floor(scale * np.array(first)).astype(np.int64).reshape(len(first), parts, dim // parts).transpose(1, 0, 2).copy()
    for _ in range(rounds):

        def sums(batches, books=books):
            total, count = np.zeros_like(books), np.zeros(books.shape[:2], np.int64)
            for batch in batches:
                x = _scaled(batch.column(0), dim, scale).reshape(-1, parts, dim // parts)
                for p in range(parts):
                    j, _ = nearest(x[:, p], books[p])
                    count[p] += np.bincount(j, minlength=len(books[p]))
                    for d in range(dim // parts):  # a batch's sums stay below 2^53, so doubles hold them
                        total[p, :, d] += np.bincount(j, weights=x[:, p, d], minlength=len(books[p])).astype(np.int64)
            p, k = np.nonzero(count)
            if len(p):
                width = dim // parts
                at = ((p * books.shape[1] + k)[:, None] * width + np.arange(width)).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel()[at]), pa.array(np.repeat(count[p, k], width))], names=["at", "total", "n"])

        met = kept.select("vector").mapInArrow(sums, "at long, total long, n long").groupBy("at").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect()
        flat = books.ravel().copy()
        for r in met:  # one row a component of the codebooks at most
            flat[r["at"]] = r["total"] // r["n"]
        books = flat.reshape(books.shape)
    return books


def digest(books: np.ndarray) -> str:
    """sha-256 of all entries' components as text: by part, entry and place."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, *, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, np.ndarray]:
    """vec_id, label, code (two hex digits a part), error and label_error (over equal labels, nulls together) of every kept vector; the codebooks."""
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits: 1 to 256 entries")
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    rows = rows.where(F.col("vector").isNotNull() & (F.size("vector") > 0) & F.forall("vector", lambda x: F.coalesce(F.abs(x) < LIMIT, F.lit(False))))  # NaN is above every limit
    least = rows.orderBy(F.col("id").asc_nulls_last(), "vector").select(F.size("vector").alias("n")).first()
    out = "id {}, label {}, code string, error long"
    if least is None:
        kinds = dict(rows.dtypes)
        empty = vectors.sparkSession.createDataFrame([], out.format(kinds["id"], kinds["label"])).withColumn("label_error", F.col("error"))
        return empty.withColumnRenamed("id", "vec_id"), np.zeros((parts, 0, 0), np.int64)
    dim = least["n"]
    kept = rows.where(F.size("vector") == dim)
    books = codebooks(kept, parts=parts, entries=entries, rounds=rounds, scale=scale)

    @F.pandas_udf("code string, error long")
    def encode(column: pd.Series) -> pd.DataFrame:
        x = np.floor(scale * np.stack(column.to_list())).astype(np.int64).reshape(-1, parts, dim // parts) if len(column) else np.zeros((0, parts, dim // parts), np.int64)
        found = [nearest(x[:, p], books[p]) for p in range(parts)]
        names = np.stack([j for j, _ in found], axis=1).astype(np.uint8)
        return pd.DataFrame({"code": [row.tobytes().hex() for row in names], "error": sum(d for _, d in found)})

    coded = written(kept.select("id", "label", encode("vector").alias("c")).select("id", "label", "c.code", "c.error"), "codes")
    sums = coded.groupBy(F.col("label").alias("of")).agg(F.try_sum("error").alias("label_error"))
    full = coded.join(sums, F.col("label").eqNullSafe(F.col("of"))).drop("of")
    return full.withColumnRenamed("id", "vec_id"), books
