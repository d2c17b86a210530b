"""Near duplicates of vectors by Euclidean p-stable hashing with exact cosine checks.

Vectors are normalised; table t hashes floor((A_t v + b_t) / width), ``projections`` numbers, to one
key, so vectors at a small Euclidean distance (cosine 0.9 is a distance of 0.447) share keys more
often than others. Equal vectors are one class and only classes are hashed. Within a bucket all
classes are compared in double precision by blocks: buckets of more than ``BLOCK`` classes are dealt
in chunks and each pair of chunks is a task's block, so no bucket is too large or left out, and
what leaves a block is one row per linked class (its new links and one edge towards its
group), never its pairs. A pair is counted in the first table where its keys meet.

With the defaults a pair at cosine 0.9 is found with probability 0.96, at 0.95 above 0.999. The
number of projections grows with the logarithm of the classes beyond those of the defaults, and the
tables with it, to keep chance neighbours per bucket and these probabilities as they are.

Vectors that are null, zero, of another length than most, or hold null or non-finite components
link with nothing and are components of their own. Repeated rows link to each other (equal ids
still count as other rows). An empty table gives no row; other columns, whatever their names, play no part.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from learngraph.llm.shared import written
from learngraph.llm.shingles import mix
from learngraph.llm.vectors import matrix, unit
from learngraph.operators.components import components

WIDTH = 2.0
BLOCK = 1024
_NEAR, _FAR = 0.8216, 0.4859  # chances that one projection agrees at cosine 0.9 and at 0


def parameters(n: int) -> tuple[int, int]:
    """Tables and projections for n classes: 33 and 12 up to about 50,000."""
    projections = max(12, math.ceil(math.log(max(n, 2) / 9) / -math.log(_FAR)))
    tables = max(32, math.ceil(math.log(0.04) / math.log1p(-(_NEAR**projections))))
    return tables, projections


def _hasher(dim: int, tables: int, projections: int):
    rng = np.random.default_rng(17)
    a = rng.normal(size=(dim, tables * projections))
    b = rng.uniform(0, WIDTH, tables * projections)

    def keys(u: np.ndarray) -> np.ndarray:
        cell = np.floor((u @ a + b) / WIDTH).astype(np.int64).view(np.uint64).reshape(len(u), tables, projections)
        out = np.zeros((len(u), tables), np.uint64)
        for k in range(projections):
            out = mix(out * np.uint64(0x9FB21C651E98DF25) + cell[:, :, k])
        return out

    return keys


def _matrix_of(raws: list[bytes], dim: int) -> np.ndarray:
    """Vectors as they travel, in single precision where that holds them exactly, as one double-precision matrix."""
    if all(len(r) == 4 * dim for r in raws):
        return np.frombuffer(b"".join(raws), np.float32).reshape(-1, dim).astype(np.float64)
    return np.stack([np.frombuffer(r, np.float32 if len(r) == 4 * dim else np.float64) for r in raws]).astype(np.float64)


def _most_common_length(rows: DataFrame) -> int:
    found = rows.where(F.col("v").isNotNull()).groupBy(F.size("v").alias("k")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "k").first()
    return int(found["k"]) if found else 0


def _links_of(u: np.ndarray, left: np.ndarray, keys, table: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i < j) of a block with cosine >= ``least``; which of them meet here first. ``left``: chunk of each row, pairs run across chunks."""
    s = u @ u.T
    near = np.triu(s >= least, 1)
    if (left != left[0]).any():
        near &= left[:, None] != left[None, :]
    pairs = np.argwhere(near)
    if not len(pairs):
        return pairs, np.zeros(0, bool)
    rows = np.unique(pairs)
    k = np.zeros((len(u), table), np.uint64)
    if table:
        k[rows] = keys(u[rows])[:, :table]
    fresh = np.ones(len(pairs), bool)
    for a in range(0, len(pairs), 100_000):
        part = pairs[a : a + 100_000]
        fresh[a : a + 100_000] = ~(k[part[:, 0]] == k[part[:, 1]]).any(1) if table else True
    return pairs, fresh


def link(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.9) -> DataFrame:
    """One row per row: vec_id, n_links (other rows linked directly), component_id (least id reachable, itself included) and kept (vec_id = component_id)."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    dim = _most_common_length(rows)

    def names(batches):
        for batch in batches:
            x, good = matrix(batch.column(1), dim)
            x = x + 0.0  # no negative zeros
            name = [hashlib.blake2b(r.tobytes(), digest_size=16).digest() if g else None for r, g in zip(x, good, strict=True)]
            with np.errstate(over="ignore"):
                small = x.astype(np.float32)
            exact = (small == x).all(1)
            raw = [(small[k] if exact[k] else x[k]).tobytes() if g else None for k, g in enumerate(good.tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(name, pa.binary()), pa.array(raw, pa.binary())], names=["vec_id", "digest", "raw"])

    named = rows.mapInArrow(names, "vec_id long, digest binary, raw binary")
    ids = written(named.select("vec_id", "digest"), "vectors")
    classes = written(named.where("digest IS NOT NULL").groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.first("raw").alias("raw")), "vector-classes")
    tables, projections = parameters(classes.count())

    def hashed(batches):
        keys = _hasher(dim, tables, projections)
        for batch in batches:
            if batch.num_rows:
                k = keys(unit(_matrix_of(batch.column(1).to_pylist(), dim))).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(np.arange(len(k) + 1, dtype=np.int32) * tables), pa.array(k.ravel()))], names=["digest", "keys"])

    keyed = classes.select("digest", "raw").mapInArrow(hashed, "digest binary, keys array<long>").select("digest", F.posexplode("keys").alias("table", "key"))
    keyed = written(keyed, "vector-keys")
    sizes = keyed.groupBy("table", "key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    chunks = F.expr(f"cast(ceil(size / {BLOCK}) as int)")
    chunk = F.pmod(F.xxhash64("digest"), chunks).cast("int")
    dealt = keyed.join(sizes, ["table", "key"]).select("digest", "table", "key", chunks.alias("chunks"), chunk.alias("chunk"))
    dealt = dealt.select("digest", "table", "key", "chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("with"))
    block = dealt.select("digest", "table", "chunk", F.xxhash64("table", "key", F.least("chunk", "with"), F.greatest("chunk", "with")).alias("block"))
    full = block.join(classes, "digest").repartition("block").sortWithinPartitions("block", "chunk", "digest")

    def compare(batches):
        keys = _hasher(dim, tables, projections)
        held: list[pa.RecordBatch] = []

        def groups():
            """Runs of rows of one block, across batches."""
            for batch in batches:
                if not batch.num_rows:
                    continue
                at = batch.column("block").to_numpy()
                edges = np.concatenate([[0], np.flatnonzero(at[1:] != at[:-1]) + 1, [len(at)]])
                for a, b in zip(edges.tolist(), edges[1:].tolist(), strict=False):
                    if held and held[-1].column("block")[0].as_py() != int(at[a]):
                        yield pa.Table.from_batches(held)
                        held.clear()
                    held.append(batch.slice(a, b - a))
            if held:
                yield pa.Table.from_batches(held)

        def rows(out):
            digests, counts, roots = zip(*out, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(counts, pa.int64()), pa.array(roots, pa.binary())], names=["digest", "links", "root"])

        out: list[tuple[bytes, int, bytes]] = []
        for g in groups():
            if g.num_rows < 2:
                continue
            u = unit(_matrix_of(g.column("raw").to_pylist(), dim))
            pairs, fresh = _links_of(u, g.column("chunk").to_numpy(), keys, g.column("table")[0].as_py(), cosine)
            if len(pairs):
                count, digests = g.column("n").to_numpy(), g.column("digest").to_pylist()
                links = np.zeros(len(u), np.int64)
                np.add.at(links, pairs[fresh, 0], count[pairs[fresh, 1]])
                np.add.at(links, pairs[fresh, 1], count[pairs[fresh, 0]])
                root = list(range(len(u)))

                def find(i):
                    while root[i] != i:
                        root[i] = root[root[i]]
                        i = root[i]
                    return i

                for i, j in pairs.tolist():
                    i, j = find(i), find(j)
                    if i != j:
                        root[max(i, j)] = min(i, j)
                out += [(digests[i], int(links[i]), digests[find(i)]) for i in np.unique(pairs).tolist()]
                if len(out) > 10_000:
                    yield rows(out)
                    out = []
        if out:
            yield rows(out)

    found = written(full.mapInArrow(compare, "digest binary, links long, root binary"), "vector-links")
    links = found.groupBy("digest").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("digest").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "digest")
    own = ids.where("digest IS NOT NULL").groupBy("digest").agg(F.min("vec_id").alias("low"), F.count(F.lit(1)).alias("n"))
    own = own.join(roots, "digest", "left").join(links, "digest", "left").withColumn("root", F.coalesce("root", "digest"))
    least = own.groupBy("root").agg(F.min("low").alias("component_id"))
    per_class = own.join(least, "root").select("digest", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    joined = ids.join(per_class, "digest", "left")
    component = F.when(F.col("digest").isNotNull(), F.col("component_id")).otherwise(F.col("vec_id"))
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
