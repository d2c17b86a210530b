"""A uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

Source rows are cut into chunks by their file and place in it, which no split, retry or lost
executor changes (rows that aren't a plain scan of Parquet files are written first, so they have such places); target blocks have sizes fixed beforehand, consecutive blocks making a shard.
Row v of the communication matrix (how many rows of chunk v go to each block) is multivariate
hypergeometric given the rows before it; halving the chunks again and again, with a generator
seeded by the halves, lets every task draw the rows it needs, alike in all tasks, from the chunk
sizes alone: the matrix is nowhere. A seeded permutation inside the chunk says which row goes
where (the local permutation), one exchange moves the rows to their blocks, and a hash order of
the rows' numbers permutes each block (the second one). Blocks and chunks per task grow with the
square root of the table, so neither a block nor a row of the matrix grows in proportion to it.

Sizes of shards differ by one row at most (law ``rows``), whatever sources, keys or copies the
rows hold. Equal texts are the groups of the contract; this law leaves them where they fall.
Nulls travel like other values, repeated rows are separate rows, an empty table gives none, and
columns of any names travel along (the added ones replace columns of their names).
"""

import contextlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from learngraph.llm.shared import unused, written

CHUNK_ROWS = 1 << 16
_BITS = 1 << 15  # places that one bitmap holds
BLOCK_UNIT = 4096  # blocks a shard: the root of the table's rows over this
_LIMIT = 1_000_000_000  # of the library's exact draw
_SINGLY = 16  # draws made one by one beyond it


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """Good ones among ``draws`` without replacement, exactly at any size.

    Beyond the library's limit each one is taken with probability draws / (good + bad): given how many were taken,
    the good ones among them are a hypergeometric draw. Those missing or too many, about the root of the draws, are
    drawn likewise from the rest or from the taken ones.
    """
    if draws == 0 or good == 0:
        return 0
    if bad == 0:
        return draws
    if good + bad < _LIMIT:
        return int(rng.hypergeometric(good, bad, draws))
    if draws <= _SINGLY:
        taken = 0
        for k in range(draws):
            taken += int(rng.integers(good + bad - k)) < good - taken
        return taken
    share = draws / (good + bad)
    g, b = int(rng.binomial(good, share)), int(rng.binomial(bad, share))
    missing = draws - g - b
    if missing >= 0:
        return g + hypergeometric(rng, good - g, bad - b, missing)
    return g - hypergeometric(rng, g, b, -missing)


def split_counts(rng: np.random.Generator, room: np.ndarray, draws: int) -> np.ndarray:
    """Of ``room[k]`` places in block k, those taken by ``draws`` rows."""
    out = np.zeros_like(room)
    rest = int(room.sum())
    for k, r in enumerate(room.tolist()):
        if not draws:
            break
        rest -= r
        out[k] = hypergeometric(rng, r, rest, draws)
        draws -= int(out[k])
    return out


class CommunicationMatrix:
    """Rows of the matrix for chunks of ``sizes`` rows and blocks of ``room`` places."""

    def __init__(self, sizes: np.ndarray, room: np.ndarray, seed: int) -> None:
        self.before = np.concatenate([[0], np.cumsum(sizes)])
        self.room, self.seed, self._last = room, seed, {}

    def row(self, v: int) -> np.ndarray:
        low, high, room, path = 0, len(self.before) - 1, self.room, {}
        while high - low > 1:
            mid = (low + high) // 2
            if (low, high) not in self._last:
                rng = np.random.default_rng([self.seed, low, high])
                left = split_counts(rng, room, int(self.before[mid] - self.before[low]))
                self._last[low, high] = (left, room - left)
            path[low, high] = left, right = self._last[low, high]
            low, high, room = (low, mid, left) if v < mid else (mid, high, right)
        self._last = path  # the next chunk shares most of it
        return room

    def targets(self, v: int) -> np.ndarray:
        """The block of each row of chunk v."""
        return np.random.default_rng([self.seed, v]).permutation(np.repeat(np.arange(len(self.room)), self.row(v)))


def _is_scan(df: DataFrame) -> bool:
    """Whether the DataFrame is one relation under projections and names: its rows are a table's, each once, alike whenever they are read."""
    plan = df._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "SubqueryAlias", "View"):
        plan = plan.children().apply(0)
    return plan.nodeName() == "LogicalRelation"


def _named(df: DataFrame, file: str, at: str) -> DataFrame:
    meta = df.metadataColumn("_metadata")
    return df.select("*", meta["file_path"].alias(file), meta["row_index"].alias(at))


def _spans(rows: DataFrame, file: str, at: str) -> list[tuple[str, int, int]] | None:
    """(file, chunk, rows) in order; None unless the rows' places are 0, 1, 2 and so on in each file, each once."""
    part = F.expr(f"`{at}` div {_BITS}")
    found = rows.groupBy(F.col(file).alias("f"), part.alias("p")).agg(F.count(F.lit(1)).alias("n"), F.bitmap_count(F.bitmap_construct_agg(F.expr(f"`{at}` % {_BITS}"))).alias("d"), F.max(F.expr(f"`{at}` % {_BITS}")).alias("top")).collect()
    sizes: dict[tuple[str, int], int] = {}
    known = {(r["f"], r["p"]): r for r in found}
    for (f, p), r in known.items():
        if r["n"] != r["d"] or r["top"] != r["n"] - 1 or (p and known.get((f, p - 1), {"n": 0})["n"] != _BITS):
            return None
        key = (f, p * _BITS // CHUNK_ROWS)
        sizes[key] = sizes.get(key, 0) + r["n"]
    return [(f, c, n) for (f, c), n in sorted(sizes.items())]


def _placed(df: DataFrame, file: str, at: str) -> tuple[DataFrame, list[tuple[str, int, int]]]:
    """Every row with its file and place there, and the chunks. What isn't a plain scan of Parquet files (filtered, exploded, joined, united or limited rows) is written first."""
    if _is_scan(df):
        with contextlib.suppress(AnalysisException):  # another format
            rows = _named(df, file, at)
            if (chunks := _spans(rows, file, at)) is not None:
                return rows, chunks
    rows = _named(written(df, "to-shuffle"), file, at)
    return rows, _spans(rows, file, at)


def shuffle_into_shards(df: DataFrame, shards: int = 8, seed: int = 20240607) -> DataFrame:
    """``df`` with shard (int, 0 to shards - 1) and slot (long, gapless from 0 in each shard).

    The driver holds the size of each chunk of 65,536 rows, nothing else.
    """
    spark = df.sparkSession
    df = df.drop("shard", "slot")
    file, at_, to = unused(df.columns, "file", "at", "to")
    rows, chunks = _placed(df, file, at_)
    n = sum(r[2] for r in chunks)
    per = max(1, math.ceil(math.sqrt(n / BLOCK_UNIT)))
    sizes = [n // shards + (s < n % shards) for s in range(shards)]
    room = np.array([size * (j + 1) // per - size * j // per for size in sizes for j in range(per)], np.int64)
    shared = spark.sparkContext.broadcast(({(f, c): v for v, (f, c, _) in enumerate(chunks)}, np.array([r[2] for r in chunks], np.int64), room))

    @F.pandas_udf("block long, key long")
    def place(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        index, lengths, places = shared.value
        matrix = CommunicationMatrix(lengths, places, seed)
        held: dict[int, np.ndarray] = {}
        for files, at in parts:
            at = at.to_numpy()
            codes, names = pd.factorize(files)
            pair = codes.astype(np.int64) << 40 | at // CHUNK_ROWS
            block, key = np.empty(len(at), np.int64), np.empty(len(at), np.int64)
            for p in np.unique(pair):
                v = index[names[p >> 40], int(p & (1 << 40) - 1)]
                if v not in held:
                    held = {v: matrix.targets(v)}
                own = pair == p
                inside = at[own] % CHUNK_ROWS
                block[own] = held[v][inside]
                key[own] = v * CHUNK_ROWS + inside
            yield pd.DataFrame({"block": block, "key": key})

    moved = rows.withColumn(to, place(file, at_))
    block, key = f"`{to}`.block", f"`{to}`.key"
    order = Window.partitionBy(F.expr(block)).orderBy(F.xxhash64(F.lit(seed), F.expr(key)), F.expr(key))
    shard = F.expr(f"{block} div {per}")
    start = F.expr(f"(({n // shards} + if({block} div {per} < {n % shards}, 1, 0)) * ({block} % {per})) div {per}")
    slot = start + F.row_number().over(order) - 1
    return moved.withColumns({"shard": shard.cast("int"), "slot": slot.cast("long")}).drop(file, at_, to)
