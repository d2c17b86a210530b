"""Near duplicates of documents by MinHash with tensored banding, every link confirmed on full shingle sets.

Two collections of ``SIDE`` keys are made, each key of ``TIE`` minima. Table (i, j) is keyed by the
i-th key of the first and the j-th of the second collection, so 2 * SIDE * TIE minima serve
SIDE^2 tables; at similarity 0.8 a pair shares no table with probability 6e-4, at 0.9 below 1e-6. Second keys are
expanded only where a first key is shared, which leaves out texts like no other.

Texts of equal shingle sets are one class, named by a 128-bit digest, and only classes are
compared. Buckets of the same classes count once, and those of one least class are met as one where that is no more work. In each bucket every class is compared to the least one: rows in
proportion to the bucket's size. Components of confirmed links follow. Buckets whose classes
then lie in more than one component may hide links that miss the least class. Their pairs across
components are met inside tasks, in blocks, by sizes and set bitmaps that rule out no link; what leaves a
block is one row a class (a class is in 16 blocks of a group at most, until blocks reach a size that memory sets), first its most promising partner (confirmed, most groups are whole after
that), then, where components still face each other, its group of classes that bitmaps leave open. Such a
group's full sets are compared exactly, again in blocks, and what leaves a block is a forest of links.
So no pairs of a group are ever rows, nothing is capped and a bucket or group of any size is met in full.

The full sets of classes in some bucket are made again from the texts, in a scan that passes over
other documents by a bitmap of hashed ids of bounded size (a false hit costs time alone), and
are written to the shared folder.

Null and empty texts, and texts without words, have the empty set: they link with nothing. Rows
with one id but other texts are separate texts of that id; null ids are the largest of a component. Empty tables
give none, and other columns of any names are ignored by ``link`` and kept by ``deduplicate``.
"""

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, LongType
from pyspark.sql.window import Window

from learngraph.llm.shared import give_back, unused, written
from learngraph.llm.shingles import digest, minima, mix, shingle_sets
from learngraph.operators.components import components, labels

SIDE, TIE = 8, 2
BLOCK, BLOCK_ITEMS = 512, 400_000  # classes, and items of their sets, of one side of a block on average
CHUNKS = 8  # of a side of a group; from there on blocks grow with the group instead
MOST, MOST_ITEMS = 65_536, 4_000_000  # classes, and items where sets travel, of one side of a block at most on average
PAIRS = 200_000  # looked at at once
BITS = 512  # of a set's bitmap
_MAPS = [f"m{k}" for k in range(BITS // 64)]
SIGNATURES = "doc_id long, n_shingles long, digest binary, first array<long>, second array<long>"


def _rows(batch: pa.RecordBatch, size: int = 4000):
    for a in range(0, batch.num_rows, size):
        part = batch.slice(a, size)
        yield [part.column(i).to_pylist() for i in range(part.num_columns)]


def signatures(docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """The set size, set digest and keys of every row."""

    def run(batches):
        for batch in batches:
            for ids, texts in _rows(batch):
                sets = shingle_sets(texts, words)
                full = [k for k, s in enumerate(sets) if len(s)]
                low = minima([sets[k] for k in full], 2 * SIDE * TIE).reshape(len(full), 2 * SIDE, TIE)
                keys = np.zeros((len(full), 2 * SIDE), np.uint64)
                for t in range(TIE):
                    keys = mix(keys * np.uint64(0x9FB21C651E98DF25) + low[:, :, t])
                both = np.zeros((len(sets), 2 * SIDE), np.int64)
                both[full] = keys.view(np.int64)
                offsets = pa.array(np.arange(len(sets) + 1, dtype=np.int32) * SIDE)
                arrays = [pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(both[:, part]).ravel())) for part in (slice(0, SIDE), slice(SIDE, None))]
                names = [digest(s) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(names, pa.binary()), *arrays], names=["doc_id", "n_shingles", "digest", "first", "second"])
        give_back()

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, SIGNATURES)


def _buckets(classes: DataFrame) -> DataFrame:
    """bucket, digest, least, n: classes that share a table's key with another class; of buckets of the same classes, one.

    What is joined by key is written first, so adaptive execution can split the join where one key has many rows.
    """
    first = classes.select("digest", F.posexplode("first").alias("i", "key"))
    shared = written(first.groupBy("i", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("i", "key"), "shared-keys")
    active = first.join(shared, ["i", "key"]).join(classes.select("digest", "second"), "digest")
    tables = active.select("digest", "i", "key", F.posexplode("second").alias("j", "other"))
    rows = tables.select(F.xxhash64("i", "key", "j", "other").alias("bucket"), "digest")
    held = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("digest").alias("least"), F.bit_xor(F.xxhash64("digest")).alias("x"), F.bit_xor(F.xxhash64("digest", F.lit(1))).alias("y")).where("n > 1")
    once = written(held.groupBy("n", "least", "x", "y").agg(F.min("bucket").alias("bucket")).select("bucket", "least", "n"), "bucket-names")
    return rows.join(once, "bucket")


def _wanted_bitmap(ids: DataFrame, n: int) -> tuple[np.ndarray, int]:
    """Bits set at the hashes of ``id``: about 32 bits an id, 64 MB at most."""
    bits = min(29, max(16, math.ceil(math.log2(max(1, n) * 32))))
    at = F.pmod(F.xxhash64("id"), F.lit(1 << bits))
    parts = ids.select(at.alias("at")).groupBy(F.expr("at div 32768").alias("part")).agg(F.bitmap_construct_agg((F.col("at") % 32768)).alias("map")).collect()
    out = np.zeros(1 << (bits - 3), np.uint8)
    for r in parts:
        out[r["part"] * 4096 : (r["part"] + 1) * 4096] = np.frombuffer(bytes(r["map"]), np.uint8)
    return out, bits


def _maybe_in(keys: DataFrame, column: str) -> Callable[[Column], Column]:
    """A test of a column against the keys by a bitmap of bounded size: never false for a key, seldom true for another."""
    bitmap, bits = _wanted_bitmap(keys.select(F.col(column).alias("id")), keys.count())
    shared = keys.sparkSession.sparkContext.broadcast(bitmap)

    @F.pandas_udf(BooleanType())
    def hit(places: pd.Series) -> pd.Series:
        at = places.to_numpy()
        return pd.Series((shared.value[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool))

    return lambda c: hit(F.pmod(F.xxhash64(c), F.lit(1 << bits)))


def _sets(docs: DataFrame, classes: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """digest, size, bitmap and items (the set's hashes, 8 bytes each, rising) of the classes, which must have a least id of theirs.

    Rows that the id's bitmap hits falsely are there too; they meet no pair.
    """
    bitmap, bits = _wanted_bitmap(classes.select(F.col("doc_id").alias("id")), classes.count())
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches):
        held = shared.value
        for batch in batches:
            at = batch.column(1).to_numpy()
            hit = np.flatnonzero(held[at >> 3] >> (at & 7).astype(np.uint8) & 1)
            if len(hit):
                for texts, _ in _rows(batch.take(pa.array(hit))):
                    sets = [s for s in shingle_sets(texts, words) if len(s)]
                    on = np.zeros((len(sets), BITS), bool)
                    for k, x in enumerate(sets):
                        on[k, (x & np.uint64(BITS - 1)).astype(np.int64)] = True
                    maps = np.packbits(on, axis=1, bitorder="little").view(np.int64)
                    columns = [pa.array([digest(x) for x in sets], pa.binary()), pa.array([len(x) for x in sets], pa.int64()), *(pa.array(m) for m in maps.T.copy()), pa.array([x.tobytes() for x in sets], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, names=["digest", "size", *_MAPS, "items"])

    key = F.pmod(F.xxhash64(F.col(id_col).cast("long")), F.lit(1 << bits))
    made = docs.select(F.col(text_col).cast("string"), key).mapInArrow(run, f"digest binary, size long, {', '.join(f'{m} long' for m in _MAPS)}, items binary")
    found = written(made, "shingle-sets")
    most = found.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    # A false hit can bring a class twice, which costs little; an id on very many rows is another matter.
    return found if (most or 0) <= 4 else written(found.dropDuplicates(["digest"]), "shingle-sets")


def _few(sets: DataFrame, digests: DataFrame, column: str = "digest") -> DataFrame:
    """digest, items of the sets that may be among the digests: the others are not shuffled."""
    return sets.where(_maybe_in(digests, column)(F.col("digest"))).select("digest", "items")


def _may_share(x: str, y: str, nx: str, ny: str, percent: int) -> str:
    """SQL: sizes and bitmaps leave room for the similarity. A bit of x that y lacks stands for an item that y lacks."""
    lacks = lambda a, b: " + ".join(f"bit_count({a}{m} & ~{b}{m})" for m in _MAPS)
    need = f"{percent} * ({nx} + {ny})"
    return f"100 * least({nx}, {ny}) >= {percent} * greatest({nx}, {ny}) AND {100 + percent} * ({nx} - ({lacks(x, y)})) >= {need} AND {100 + percent} * ({ny} - ({lacks(y, x)})) >= {need}"


def _shared(x: np.ndarray, y: np.ndarray) -> int:
    """Size of the intersection of two rising arrays of distinct hashes."""
    if len(y) < len(x):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int(np.count_nonzero(y[at] == x))


@F.pandas_udf(LongType())
def _common(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series([_shared(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)) for a, b in zip(left, right, strict=True)], dtype="int64")


def _confirmed(pairs: DataFrame, sets: DataFrame, brief: DataFrame, percent: int) -> DataFrame:
    """The (a, b) whose sets are similar enough. Sets are fetched only where sizes and bitmaps leave it open."""
    side = lambda name: brief.select(F.col("digest").alias(name), F.col("size").alias(f"n{name}"), *[F.col(m).alias(f"{name}_{m}") for m in _MAPS])
    near = pairs.join(side("a"), "a").join(side("b"), "b").where(F.expr(_may_share("a_", "b_", "na", "nb", percent))).select("a", "b", "na", "nb")
    near = written(near, "candidates")
    few = _few(sets, near.select(F.explode(F.array("a", "b")).alias("digest")).distinct())
    full = near.join(few.select(F.col("digest").alias("b"), F.col("items").alias("y")), "b").join(few.select(F.col("digest").alias("a"), F.col("items").alias("x")), "a")
    counted = full.select("a", "b", "na", "nb", _common("x", "y").alias("c"))
    return written(counted.where(F.expr(f"100 * c >= {percent} * (na + nb - c)")).select("a", "b"), "links")


def _merged(buckets: DataFrame) -> DataFrame:
    """bucket, digest, least of all but the least classes, where buckets of one least class are one if its pairs are at most twice those of the buckets.

    Near copies share most of their tables, so the same classes, with the same least one, stand in dozens of buckets.
    """
    each = buckets.where(F.col("digest") == F.col("least")).groupBy("least").agg(F.count(F.lit(1)).alias("k"), F.sum(F.pow("n", F.lit(2))).alias("apart")).where("k > 1")
    met = written(buckets.where(F.col("digest") != F.col("least")).select("least", "digest", "bucket"), "bucket-rows")
    sizes = met.select("least", "digest").distinct().groupBy("least").agg(F.count(F.lit(1)).alias("u"))
    joint = written(each.join(sizes, "least").where("pow(u + 1, 2) <= 2 * apart").select("least", F.lit(True).alias("joint")), "joint")
    bucket = F.when(F.col("joint"), F.xxhash64("least")).otherwise(F.col("bucket"))
    return written(met.join(joint, "least", "left").select(bucket.alias("bucket"), "digest", "least").distinct(), "merged-buckets")


def _dealt(rows: DataFrame, group: str, *, items: bool) -> DataFrame:
    """The rows of groups with more than one root, with the ``block`` in which each is met and its ``part`` there. ``items``: sets will travel with the rows.

    ``rows`` have group, digest, root, main (the root is that of the group's least class) and size. Where a
    group is more than a block, both its main and its other classes are dealt in chunks, and each pair of chunks is a block
    but for pairs of main chunks, which have one root. In a block of several parts only pairs across parts are open. There are ``CHUNKS`` chunks
    of a kind at most, so rows grow with the group and not its square, until chunks hold ``MOST`` rows.
    """
    other = F.col("main").cast("int") == 0
    sums = [F.count_if(other).alias("others"), F.count_if("main").alias("mains"), F.sum(F.when(other, F.col("size")).otherwise(0)).alias("other_items"), F.sum(F.when(other, 0).otherwise(F.col("size"))).alias("main_items")]
    sizes = rows.groupBy(group).agg(*sums).where("others > 0")
    over = lambda n, size, rows, most: f"ceil({n} / {rows})" if not items else f"greatest(ceil({n} / {rows}), ceil({size} / {most}))"
    chunks = lambda n, size: F.expr(f"cast(greatest(least({over(n, size, BLOCK, BLOCK_ITEMS)}, {CHUNKS}), {over(n, size, MOST, MOST_ITEMS)}) as int)")
    whole = F.expr(f"others + mains <= {BLOCK}" + (f" AND other_items + main_items <= {BLOCK_ITEMS}" if items else ""))
    sizes = sizes.select(group, chunks("others", "other_items").alias("o"), chunks("mains", "main_items").alias("m"), whole.alias("whole"))
    held = rows.join(written(sizes, "block-sizes"), group).withColumn("chunk", F.pmod(F.xxhash64("digest"), F.when(F.col("main"), F.col("m")).otherwise(F.col("o"))).cast("int"))
    places = F.expr("""CASE WHEN whole THEN array(struct(0 AS kind, 0 AS x, 0 AS y))
        WHEN main THEN transform(sequence(0, o - 1), k -> struct(2 AS kind, chunk AS x, k AS y))
        ELSE concat(transform(sequence(0, o - 1), k -> struct(1 AS kind, least(chunk, k) AS x, greatest(chunk, k) AS y)), transform(slice(sequence(0, m), 1, m), k -> struct(2 AS kind, k AS x, chunk AS y))) END""")
    part = F.expr("CASE WHEN whole THEN 0 WHEN at.kind = 1 THEN chunk + 1 ELSE -cast(main as int) END")
    met = held.withColumn("at", F.explode(places))
    return met.withColumns({"block": F.xxhash64(group, "at.kind", "at.x", "at.y"), "part": part, "name": F.xxhash64("root")})


def _whole_blocks(batches, rows: int = 4000, size: int = 16 << 20):
    """Tables of whole blocks, several where they are small; batches come sorted by block, their first column."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.num_rows for b in held) < rows and sum(b.get_total_buffer_size() for b in held) < size:
            continue
        at = held[-1].column(0).to_numpy()
        ends = np.flatnonzero(at[1:] != at[:-1])
        last = int(ends[-1]) + 1 if len(ends) else 0
        if not last and (len(held) == 1 or held[-2].column(0)[held[-2].num_rows - 1].as_py() == int(at[0])):
            continue  # one block since the last yield
        yield pa.Table.from_batches([*held[:-1], held[-1].slice(0, last)])
        held = [held[-1].slice(last)]
    if held:
        yield pa.Table.from_batches(held)


def _open_pairs(block: np.ndarray, part: np.ndarray, name: np.ndarray, size: np.ndarray, maps: np.ndarray, percent: int):
    """(i, j, shared) with i < j, some at a time: pairs of a block, of different roots, that sizes and bitmaps leave open; shared is the most items that both can hold."""
    edge = np.concatenate([[0], np.flatnonzero(block[1:] != block[:-1]) + 1, [len(block)]])
    end = np.repeat(edge[1:], np.diff(edge))
    several = np.repeat(np.maximum.reduceat(part, edge[:-1]) != np.minimum.reduceat(part, edge[:-1]), np.diff(edge))
    after = end - np.arange(len(block)) - 1
    total = np.concatenate([[0], np.cumsum(after)])
    a = 0
    while a < len(block):
        b = max(a + 1, int(np.searchsorted(total, total[a] + PAIRS, side="right")) - 1)
        i = np.repeat(np.arange(a, b), after[a:b])
        j = np.arange(len(i)) - np.repeat(total[a:b] - total[a], after[a:b]) + i + 1
        a = b
        open_ones = (name[i] != name[j]) & (~several[i] | (part[i] != part[j])) & (100 * np.minimum(size[i], size[j]) >= percent * np.maximum(size[i], size[j]))
        i, j = i[open_ones], j[open_ones]
        lacks_i = np.zeros(len(i), np.int64)  # bits of j that i lacks stand for items that i lacks
        lacks_j = np.zeros(len(i), np.int64)
        for m in maps:
            x, y = m[i], m[j]
            lacks_j += np.bitwise_count(x & ~y)
            lacks_i += np.bitwise_count(y & ~x)
        shared = np.minimum(size[i] - lacks_j, size[j] - lacks_i)
        fits = (100 + percent) * shared >= percent * (size[i] + size[j])
        yield i[fits], j[fits], shared[fits]


def _folded(label: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Each row's least row by its label and the pairs."""
    if not pairs:
        return label
    i, j = (np.concatenate(x) for x in zip(*pairs, strict=True))
    return labels(len(label), np.concatenate([i, np.arange(len(label))]), np.concatenate([j, label]))


def _partners(rows: DataFrame, brief: DataFrame, percent: int, nearest: bool) -> DataFrame:
    """(a, b), one row a class and block at most. ``nearest``: an open pair, the one that may share most; else b stands for all that open pairs lead to in the block."""
    columns = ["digest", "part", "name", "size", *_MAPS]

    def run(batches):
        for table in _whole_blocks(batches):
            block, part, name, size = (table.column(c).to_numpy() for c in ("block", "part", "name", "size"))
            maps = [table.column(m).to_numpy().view(np.uint64) for m in _MAPS]
            digests = table.column("digest").combine_chunks()
            label, best, most = np.arange(len(block)), np.full(len(block), -1), np.zeros(len(block))
            joined: list[tuple[np.ndarray, np.ndarray]] = []  # open pairs, folded into the labels when they outnumber the rows
            for i, j, shared in _open_pairs(block, part, name, size, maps, percent):
                if nearest:
                    close = shared / (size[i] + size[j] - shared)
                    x, y, z = np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([close, close])
                    order = np.lexsort((y, -z, x))
                    x, y, z = x[order], y[order], z[order]
                    top = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)
                    top = top[z[top] > most[x[top]]]
                    best[x[top]], most[x[top]] = y[top], z[top]
                elif len(i):
                    joined.append((i, j))
                    if sum(len(x) for x, _ in joined) > max(PAIRS, len(block)):
                        label = _folded(label, joined)
                        joined = []
            label = _folded(label, joined)
            to = best if nearest else np.where(label == np.arange(len(block)), -1, label)
            at = np.flatnonzero(to >= 0)
            if len(at):
                yield pa.RecordBatch.from_arrays([digests.take(pa.array(at)), digests.take(pa.array(to[at]))], names=["a", "b"])

    met = _dealt(rows.join(brief, "digest"), "bucket", items=False).select("block", *columns)
    found = met.repartition("block").sortWithinPartitions("block").mapInArrow(run, "a binary, b binary")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _forest(block: np.ndarray, part: np.ndarray, name: np.ndarray, items: list[np.ndarray], percent: int) -> tuple[list[int], list[int]]:
    """(i, j) of a forest of the links across roots in each block; ``items`` are the sets, rising.

    Each row meets those after it that bitmaps leave open, all at once: first one of each component, then two, four and so on
    of those not yet linked to the row. Bitmaps have two bits an item on average, so they still tell long sets apart.
    """
    size = np.array([len(x) for x in items], np.int64)
    bits = 1 << min(14, max(BITS.bit_length() - 1, int(2 * size.mean()).bit_length()))
    on = np.zeros((len(items), bits), bool)
    on[np.repeat(np.arange(len(items)), size), (np.concatenate(items) & np.uint64(bits - 1)).astype(np.int64)] = True
    maps = list(np.packbits(on, axis=1, bitorder="little").view(np.uint64).T.copy())
    del on
    _, root = np.unique(np.stack([block, name]), axis=1, return_inverse=True)
    root = root.ravel()
    a: list[int] = []
    b: list[int] = []
    for left, right, _ in _open_pairs(block, part, name, size, maps, percent):
        for rest in np.split(np.arange(len(left)), np.flatnonzero(left[1:] != left[:-1]) + 1):
            if not len(rest):
                continue
            i, rest, most = int(left[rest[0]]), right[rest], 1
            while len(rest := rest[root[rest] != root[i]]):
                own = root[rest]
                order = np.argsort(own, kind="stable")
                begins = np.flatnonzero(np.concatenate([[True], own[order][1:] != own[order][:-1]]))
                place = np.arange(len(rest)) - np.repeat(begins, np.diff(np.concatenate([begins, [len(rest)]])))
                met, rest = rest[order[place < most]], rest[order[place >= most]]
                found = np.concatenate([items[j] for j in met])
                at = np.searchsorted(items[i], found)
                at[at == size[i]] = 0
                ends = np.cumsum(size[met])
                shared = np.diff(np.concatenate([[0], np.cumsum(items[i][at] == found)[ends - 1]]))
                for j in met[(100 + percent) * shared >= percent * (size[i] + size[met])].tolist():
                    if root[j] != root[i]:
                        a.append(i)
                        b.append(j)
                        root[root == root[j]] = root[i]
                most *= 2
    return a, b


def _exactly(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): a forest of the links across roots in each block of the groups in ``rows`` (group, digest, root, main, size)."""

    def run(batches):
        for table in _whole_blocks(batches, rows=500):
            block, part, name = (table.column(c).to_numpy() for c in ("block", "part", "name"))
            digests = table.column("digest").combine_chunks()
            a, b = _forest(block, part, name, [np.frombuffer(x, np.uint64) for x in table.column("items").to_pylist()], percent)
            if a:
                yield pa.RecordBatch.from_arrays([digests.take(pa.array(a)), digests.take(pa.array(b))], names=["a", "b"])

    met = _dealt(rows, "group", items=True).select("block", "digest", "part", "name")
    full = met.join(_few(sets, rows.select("digest").distinct()), "digest").select("block", "part", "name", "digest", "items")
    return full.repartition("block").sortWithinPartitions("block").mapInArrow(run, "a binary, b binary").distinct()


def _open(groups: DataFrame, roots: DataFrame, group: str) -> DataFrame:
    """group, digest, root and main of the rows (group, digest, least): main where the root is that of the group's least class."""
    named = groups.join(roots.withColumnRenamed("node", "digest"), "digest", "left").withColumn("root", F.coalesce("root", "digest"))
    named = named.join(roots.select(F.col("node").alias("least"), F.col("root").alias("_main")), "least", "left")
    return named.select(group, "digest", "root", (F.col("root") == F.coalesce("_main", "least")).alias("main"))


def link(docs: DataFrame, *, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept, digest and root (the component's name, null for the empty set) of every row.

    Linked are texts with 100 * |intersection| >= percent * |union| of their sets of ``words``-word
    shingles; component_id is the least id reachable, itself included; kept is doc_id = component_id.
    """
    signed = written(signatures(docs, words, id_col, text_col), "signatures")
    classes = signed.where("n_shingles > 0").groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.first("first").alias("first"), F.first("second").alias("second"))
    classes = written(classes, "classes")
    buckets = written(_buckets(classes), "buckets")
    active = classes.select("digest", "doc_id").join(buckets.select("digest").distinct(), "digest", "left_semi")
    sets = _sets(docs, written(active, "active"), words, id_col, text_col)
    brief = written(sets.drop("items").dropDuplicates(["digest"]), "set-bitmaps")
    stars = buckets.where(F.col("digest") != F.col("least")).select(F.col("least").alias("a"), F.col("digest").alias("b")).distinct()
    links = _confirmed(stars, sets, brief, percent)
    rest = _merged(buckets.where("n > 2"))  # without the least class, which has met all
    tied = links.select(F.col("a").alias("least"), F.col("b").alias("digest"), F.lit(True).alias("main"))
    tied = rest.join(tied, ["least", "digest"], "left").withColumn("main", F.coalesce("main", F.lit(False)))
    tied = tied.select("bucket", "digest", F.when(F.col("main"), F.col("least")).otherwise(F.col("digest")).alias("root"), "main")
    links = links.unionByName(_confirmed(_partners(tied, brief, percent, nearest=True), sets, brief, percent))
    roots = components(links)
    facing = written(_partners(_open(rest, roots, "bucket"), brief, percent, nearest=False), "facing")
    if not facing.isEmpty():
        groups = components(facing).select(F.col("root").alias("group"), F.col("node").alias("digest"), F.col("root").alias("least"))
        met = _open(groups, roots, "group").join(brief.select("digest", "size"), "digest")
        last = written(_exactly(met, sets, percent), "links")
        if not last.isEmpty():
            links = links.unionByName(last)
            roots = components(links)
    own = classes.select("digest", "doc_id").join(roots.withColumnRenamed("node", "digest"), "digest", "left").withColumn("root", F.coalesce("root", "digest"))
    least = written(own.groupBy("root").agg(F.min("doc_id").alias("component_id")), "least-ids")  # of few rows beside one with many: a join that can be split
    named = own.join(least, "root").select("digest", "root", "component_id")
    out = signed.select("doc_id", "n_shingles", "digest").join(named, "digest", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "digest", "root")


def deduplicate(docs: DataFrame, *, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, of which one of each component stays: the one of least id.

    Rows without shingles stay. Ids that are null or stand on several rows don't tell a row, so those rows
    are met again with their sets' digests; of rows alike in id and set any one stays.
    """
    linked = link(docs, words=words, percent=percent, id_col=id_col, text_col=text_col)
    found = written(linked.select("doc_id", "n_shingles", "kept", "digest", "root"), "linked")
    several = written(found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR doc_id IS NULL").select("doc_id"), "several")
    key = F.col(id_col).cast("long")
    gone = found.where("NOT kept AND doc_id IS NOT NULL").select("doc_id").unionByName(several.where("doc_id IS NOT NULL")).distinct()
    own_id, name, place, of, least, root, rank = unused(docs.columns, "id", "digest", "place", "of", "least", "root", "rank")
    gone = written(gone, "gone").withColumnRenamed("doc_id", own_id)
    # Only rows that a bitmap of the ids to go hits are joined; the others, most of them, stay where they are.
    maybe = _maybe_in(gone, own_id)(key)
    once = docs.where(key.isNotNull() & ~maybe).unionByName(docs.where(key.isNotNull() & maybe).join(gone, key == F.col(own_id), "left_anti"))
    if several.isEmpty():
        return once

    @F.pandas_udf(BinaryType())
    def named(texts: pd.Series) -> pd.Series:
        return pd.Series([digest(s) if len(s) else None for s in shingle_sets(list(texts), words)], dtype=object)

    again = docs.join(several.withColumnRenamed("doc_id", own_id), key.eqNullSafe(F.col(own_id)), "left_semi")
    again = again.withColumns({own_id: key, name: named(F.col(text_col).cast("string")), place: F.monotonically_increasing_id()})
    roots = found.where("kept AND n_shingles > 0").select(F.col("digest").alias(of), F.col("doc_id").alias(least), F.col("root").alias(root)).distinct()
    full = again.join(roots, (F.col(name) == F.col(of)) & F.col(own_id).eqNullSafe(F.col(least)))
    first = Window.partitionBy(root).orderBy(name, place)
    one = full.withColumn(rank, F.row_number().over(first)).where(F.col(rank) == 1)
    bare = again.where(F.col(name).isNull())
    return once.unionByName(one.select(docs.columns)).unionByName(bare.select(docs.columns))
