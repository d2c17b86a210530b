"""Approximate nearest neighbours: inverted lists scanned by adaptive dimensions.

Lists come from spherical k-means over a bounded sample (``sample_rows``); every vector is
assigned to its nearest centroid's list, rotated by one random orthogonal matrix and scanned in blocks
of ``COLUMNS`` rotated columns. After d of D columns, the squared distance so far estimates the
whole, (D / d) times as large; a candidate whose estimate exceeds the query's present k-th best
distance by more than the test's margin, (1 + EPSILON / sqrt(d))^2, is abandoned. That distance starts as the k-th best in
the fitted sample, which holds in all lists, and falls as a list is scanned. What survives all columns
is scored exactly, in double precision on the original vectors.

How many lists a query probes is set on the fitted sample: the least number that holds
``recall`` of its exact neighbours. Lists of more than ``CHUNK`` vectors are dealt in chunks by
hash and each chunk is scanned apart, so no list is too long for a task.

Vectors that are null, zero, of another length than most, or hold null or non-finite components
take no part, as queries or as candidates. Equal scores go to the smaller id; repeated ids are
candidates of their own (a query's own rows, by id, are not). Fewer candidates than ``k`` are all returned. Empty
tables give no row, other columns, whatever their names, play no part.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from learngraph.llm.embedding_duplicates import _most_common_length
from learngraph.llm.shared import written
from learngraph.llm.vectors import matrix, unit

COLUMNS = 16
EPSILON = 2.5
CHUNK = 4096
SLICE = 256  # candidates tested against one bound


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The row of c nearest to each row of x, some rows at a time."""
    return np.concatenate([(x[a : a + 1024] @ c.T).argmax(1) for a in range(0, len(x), 1024)])


def _kmeans(x: np.ndarray, lists: int, rounds: int = 8) -> np.ndarray:
    rng = np.random.default_rng(3)
    c = x[rng.choice(len(x), lists, replace=False)].copy()
    for _ in range(rounds):
        own = _nearest(x, c)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        full = np.bincount(own, minlength=lists) > 0
        c[full] = unit(sums[full])
    return c


def _probes(x: np.ndarray, c: np.ndarray, k: int, recall: float) -> int:
    """Lists to probe so that of the sample's nearest k, ``recall`` are found; a few at least."""
    pick = np.random.default_rng(4).choice(len(x), min(len(x), 256), replace=False)
    own, need = _nearest(x, c), []
    for i in pick.tolist():
        s = x @ x[i]
        s[i] = -2
        top = np.argpartition(-s, min(k, len(s) - 1))[:k]
        rank = np.argsort(np.argsort(-(c @ x[i])))
        need += rank[own[top]].tolist()
    need = np.sort(need) + 1
    return int(max(min(len(c), 10), need[min(len(need) - 1, math.ceil(recall * len(need)))]))


def cosines(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Cosine of each row of x with q, alike for equal rows whatever stands beside them."""
    return np.minimum(1.0, np.maximum(-1.0, (unit(x) * unit(q[None])).sum(axis=1)))


def scan(x: np.ndarray, ids: np.ndarray, q: np.ndarray, q_id: int, k: int, rotated: np.ndarray, q_rotated: np.ndarray, bound: float = np.inf) -> list[tuple[float, int]]:
    """The best k of one chunk for one query, (score, id), by adaptive dimensions; ``bound``: a squared distance that k candidates, somewhere, don't exceed.

    Candidates come ``SLICE`` at a time, and what a slice finds tightens the bound for the next ones.
    """
    other = np.flatnonzero(ids != q_id)
    dim = x.shape[1]
    held, far = [np.zeros(0, np.int64)], np.zeros(0)
    for a in range(0, len(other), SLICE):
        rest = other[a : a + SLICE]
        partial = np.zeros(len(rest))
        for d in range(0, dim, COLUMNS):
            end = min(dim, d + COLUMNS)
            partial += ((rotated[rest, d:end] - q_rotated[d:end]) ** 2).sum(1)
            if end < dim:
                alive = partial * (dim / end) <= bound * (1 + EPSILON / math.sqrt(end)) ** 2
            else:
                alive = partial <= bound * (1 + 1e-9) + 1e-12
            rest, partial = rest[alive], partial[alive]
            if not len(rest):
                break
        held.append(rest)
        far = np.concatenate([far, partial])
        if len(far) >= k:
            bound = min(bound, np.partition(far, k - 1)[k - 1])
    at = np.concatenate(held)[far <= bound * (1 + 1e-9) + 1e-12]
    score = cosines(x[at], q)
    order = np.lexsort((ids[at], -score))[:k]
    return [(float(score[i]), int(ids[at[i]])) for i in order]


def search(vectors: DataFrame, queries: Column, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, recall: float = 0.97, sample_rows: int = 20_000) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k nearest found of every row where ``queries`` holds."""
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(queries, F.lit(False)).alias("asks"))
    rows = rows.where("vec_id IS NOT NULL")
    dim = _most_common_length(rows)
    n = rows.count()
    share = min(1.0, sample_rows / max(1, n))

    def usable(batches):
        for batch in batches:
            x, good = matrix(batch.column(0), dim)
            ids = batch.column(1).to_numpy(zero_copy_only=False)[good].astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([x[good].tobytes()], pa.binary()), pa.array([ids.tobytes()], pa.binary())], names=["raw", "ids"])

    drawn = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) < share * (1 << 20)).select("v", "vec_id").mapInArrow(usable, "raw binary, ids binary").collect()
    sample = np.frombuffer(b"".join(bytes(r["raw"]) for r in drawn), np.float64)
    sample_ids = np.frombuffer(b"".join(bytes(r["ids"]) for r in drawn), np.int64)
    sample = unit(sample.reshape(-1, dim)) if dim and len(sample) else np.zeros((0, max(1, dim)))
    if not len(sample):
        if n == 0 or not dim:
            return spark.createDataFrame([], schema)
        sample, sample_ids = np.eye(dim)[:1], np.zeros(0, np.int64)
    centroids = _kmeans(sample, min(len(sample), math.ceil(math.sqrt(n))))
    probes = _probes(sample, centroids, k, recall) if len(sample) > k else len(centroids)
    rotation = np.linalg.qr(np.random.default_rng(9).normal(size=(dim, dim)))[0]
    shared = spark.sparkContext.broadcast((centroids, rotation, sample if len(sample_ids) else sample[:0], sample_ids))

    def assign(batches):
        c, _, known, known_ids = shared.value
        for batch in batches:
            x, good = matrix(batch.column(1), dim)
            at = np.flatnonzero(good)
            for a in range(0, len(at), 2000):
                part = at[a : a + 2000]
                s = unit(x[part]) @ c.T
                asks = batch.column(2).to_numpy(zero_copy_only=False)[part]
                ids = batch.column(0).to_numpy(zero_copy_only=False)[part]
                bound = np.full(len(part), np.inf)
                for j in np.flatnonzero(asks):
                    cosine = (known @ unit(x[part[j]][None])[0])[known_ids != ids[j]]
                    if len(cosine) >= k:
                        bound[j] = 2 + 2 * np.partition(-cosine, k - 1)[k - 1] + 1e-9
                near = np.argsort(-s, axis=1, kind="stable")[:, :probes]
                lists = [[int(r[0])] for r in near]
                asked = [r.tolist() if q else [] for r, q in zip(near, asks, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([r.tobytes() for r in x[part]], pa.binary()), pa.array([r[0] for r in lists], pa.int32()), pa.array(asked, pa.list_(pa.int32())), pa.array(bound)], names=["vec_id", "raw", "list", "probed", "bound"])

    indexed = written(rows.mapInArrow(assign, "vec_id long, raw binary, list int, probed array<int>, bound double"), "lists")
    sizes = indexed.groupBy("list").agg(F.count(F.lit(1)).alias("n")).select("list", F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks"))  # a row a list
    data = indexed.join(F.broadcast(sizes), "list").select("list", F.pmod(F.xxhash64("vec_id"), "chunks").cast("int").alias("chunk"), F.lit(True).alias("stored"), "vec_id", "raw", "bound")
    asked = indexed.where(F.size("probed") > 0).select("vec_id", "raw", "bound", F.explode("probed").alias("list")).join(F.broadcast(sizes), "list")
    asked = asked.select("list", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(False).alias("stored"), "vec_id", "raw", "bound")
    dealt = data.unionByName(asked).repartition("list", "chunk").sortWithinPartitions("list", "chunk", F.desc("stored"), "vec_id")

    def scanned(batches):
        r = shared.value[1]
        key, x, ids, rotated, parts = None, None, None, None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            lists, chunk = batch.column("list").to_numpy(), batch.column("chunk").to_numpy()
            stored, names, bound = batch.column("stored").to_numpy(zero_copy_only=False), batch.column("vec_id").to_numpy(), batch.column("bound").to_numpy(zero_copy_only=False)
            raw = np.frombuffer(b"".join(batch.column("raw").to_pylist()), np.float64).reshape(-1, dim)
            edges = np.concatenate([[0], np.flatnonzero((lists[1:] != lists[:-1]) | (chunk[1:] != chunk[:-1]) | (stored[1:] != stored[:-1])) + 1, [len(lists)]])
            out = []
            for a, b in zip(edges.tolist(), edges[1:].tolist(), strict=False):
                if (lists[a], chunk[a]) != key:
                    key, x, parts = (lists[a], chunk[a]), None, []
                if stored[a]:
                    parts.append((raw[a:b], names[a:b]))
                    continue
                if not parts:
                    continue
                if x is None:
                    x, ids = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
                    rotated = unit(x) @ r
                turned = unit(raw[a:b]) @ r
                for i in range(a, b):
                    out += [(int(names[i]), v, s) for s, v in scan(x, ids, raw[i], int(names[i]), k, rotated, turned[i - a], bound[i])]
            if out:
                q, v, s = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(v, pa.int64()), pa.array(s, pa.float64())], names=["query_id", "vec_id", "score"])

    found = dealt.mapInArrow(scanned, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
