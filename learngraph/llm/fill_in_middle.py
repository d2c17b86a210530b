"""Fill-in-middle transformation over an index of distinct texts.

Texts are named by a 64-bit hash. Where several documents have one name, their texts are grouped by the
text itself, so equality is verified on whole contents; a map-side combine folds copies before they
are shuffled. Each distinct text's line boundaries (code points) are found once and kept as an
Elias-Fano list: high parts in unary, low parts packed, a few bits a line. Documents of copied texts, ids alone, are
joined to the index (a group of very many documents in parts, each with its copy of the text), select
their two seeded boundaries and are cut. A text that a single document has is an index entry of one: it is indexed and
cut where it is read, and isn't shuffled. Names that stand for several texts are told apart by the texts.

Null texts are empty. Null ids are the empty number in the seed. Repeated rows are separate rows with one result. An
empty table gives none. Columns other than id and text are ignored, whatever their names. Texts without a line and texts that hold a mark stay plain.
"""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructType

from learngraph.llm.near_duplicates import _maybe_in
from learngraph.llm.shared import written

MARKS = ("<P>", "<S>", "<M>")
PART = 512  # documents of one text that a task cuts from one copy of it
_HEAD = struct.Struct("<QQB")


def elias_fano(values: np.ndarray) -> bytes:
    """A rising list of whole numbers, not negative: its length, largest value and low bits a value, then the low parts and the unary high parts."""
    n = len(values)
    if not n:
        return _HEAD.pack(0, 0, 0)
    top = int(values[-1])
    low = max(0, (top // n).bit_length() - 1)
    v = values.astype(np.uint64)
    lows = np.packbits((v[:, None] >> np.arange(low, dtype=np.uint64) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little").tobytes()
    unary = np.zeros(n + (top >> low) + 1, np.uint8)
    unary[(v >> np.uint64(low)).astype(np.int64) + np.arange(n)] = 1
    return _HEAD.pack(n, top, low) + lows + np.packbits(unary, bitorder="little").tobytes()


def select(blob: bytes, k: int) -> int:
    """The k-th value (from 0) of an Elias-Fano list, without unpacking the others."""
    n, _, low = _HEAD.unpack_from(blob)
    if not 0 <= k < n:
        raise IndexError(k)
    at = _HEAD.size + (n * low + 7) // 8
    unary = np.frombuffer(blob, np.uint8, offset=at)
    before = np.cumsum(np.bitwise_count(unary), dtype=np.int64)
    byte = int(np.searchsorted(before, k, side="right"))
    left = k - (int(before[byte - 1]) if byte else 0)
    bit = int(np.flatnonzero(np.unpackbits(unary[byte : byte + 1], bitorder="little"))[left])
    first, last = k * low, (k + 1) * low
    bits = int.from_bytes(blob[_HEAD.size + first // 8 : _HEAD.size + (last + 7) // 8], "little")
    return (byte * 8 + bit - k) << low | bits >> first % 8 & (1 << low) - 1


def line_ends(text: str) -> np.ndarray:
    """Code points before the end of each line; a line ends after its newline or with the text."""
    ends = np.flatnonzero(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32) == 10) + 1
    return ends if not text or text[-1] == "\n" else np.append(ends, len(text))


@F.pandas_udf(StructType().add("n", LongType()).add("ends", BinaryType()))
def _entry(texts: pd.Series) -> pd.DataFrame:
    lists = [line_ends(t) for t in texts]
    return pd.DataFrame({"n": pd.Series([len(x) for x in lists], dtype="int64"), "ends": [elias_fano(x) for x in lists]})


@F.pandas_udf(StructType().add("prefix", LongType()).add("upto", LongType()))
def _bounds(ends: pd.Series, first: pd.Series, second: pd.Series) -> pd.DataFrame:
    found = [[select(b, int(k) - 1) if k else 0 for k in (min(x, y), max(x, y))] for b, x, y in zip(ends, first, second, strict=True)]
    return pd.DataFrame(np.array(found, np.int64).reshape(-1, 2), columns=["prefix", "upto"])


def _name(text: str) -> Column:
    return F.xxhash64(text)


def distinct_texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, text, n_docs and its entry (n lines, their Elias-Fano list): one row for each distinct text, told apart by whole contents."""
    counted = docs.groupBy(key, text).agg(F.count(F.lit(1)).alias("n_docs"))
    return counted.withColumn("entry", _entry(text)).select(key, text, "n_docs", "entry.n", "entry.ends")


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text, from output and form alone."""
    p, s, m = marks
    after = lambda c, mark: F.substring(c, F.locate(mark, c) + len(mark), F.length(c))

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        rest = F.substring(output, F.lit(len(first) + 1), F.length(output))
        tail = after(rest, second)
        return F.substring_index(rest, second, 1), F.substring_index(tail, m, 1), after(tail, m)

    prefix, suffix, middle = parts(p, s)
    suffix_, prefix_, middle_ = parts(s, p)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(prefix_, middle_, suffix_)).otherwise(output)


def transform(docs: DataFrame, *, seed: int = 7, rate: int = 100, spm: int = 50, marks: tuple[str, str, str] = MARKS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n (lines), form (plain, psm or spm), prefix_chars, middle_chars (null if plain) and output of every row.

    ``rate`` percent of the documents are cut, ``spm`` percent of these in suffix-prefix-middle order; which and
    where follows from the sha-256 of seed and id.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("key", _name("text"))
    copied = written(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"), "copied-texts")
    maybe = _maybe_in(copied, "key")(F.col("key"))  # every copied text, and a few others, which are groups of one
    index = written(distinct_texts(rows.where(maybe), "key", "text"), "text-index")
    alone = rows.where(~maybe).withColumn("entry", _entry("text")).select("doc_id", "text", "entry.n", "entry.ends")
    names = index.groupBy("key").agg(F.count(F.lit(1)).alias("texts"), F.sum("n_docs").alias("n_docs"))
    names = written(names, "text-names")
    parts = lambda n: F.ceil(n / PART).cast("int")
    ids = rows.where(maybe).select("doc_id", "key").join(names.where("texts = 1").select("key", parts(F.col("n_docs")).alias("parts")), "key")
    ids = ids.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int"))
    dealt = index.withColumn("part", F.explode(F.sequence(F.lit(0), parts(F.col("n_docs")) - 1)))
    joined = ids.select("doc_id", "key", "part").join(dealt, ["key", "part"]).select("doc_id", "text", "n", "ends")
    several = written(names.where("texts > 1").select("key"), "shared-names")
    if not several.isEmpty():  # one name for different texts: these documents are told apart by content
        joined = joined.unionByName(rows.where(maybe).join(several, "key").join(index, ["key", "text"]).select("doc_id", "text", "n", "ends"))
    return _cut(alone.unionByName(joined), seed, rate, spm, marks)


def _cut(rows: DataFrame, seed: int, rate: int, spm: int, marks: tuple[str, str, str]) -> DataFrame:
    p, s, m = (F.lit(x) for x in marks)
    rows = rows.withColumn("h", F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256))
    h = [F.conv(F.substring("h", 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]
    units = F.col("n") + 1
    holds = F.contains("text", p) | F.contains("text", s) | F.contains("text", m)
    form = F.when((F.col("text") == "") | holds | (h[2] % 100 >= rate), "plain").when(h[3] % 100 < spm, "spm").otherwise("psm")
    rows = rows.select("doc_id", "text", "n", form.alias("form"), _bounds("ends", h[0] % units, h[1] % units).alias("at"))
    prefix = F.substring("text", F.lit(1), F.col("at.prefix").cast("int"))
    middle = F.substring("text", (F.col("at.prefix") + 1).cast("int"), (F.col("at.upto") - F.col("at.prefix")).cast("int"))
    suffix = F.substring("text", (F.col("at.upto") + 1).cast("int"), F.length("text"))
    cut = F.when(F.col("form") == "psm", F.concat(p, prefix, s, suffix, m, middle)).when(F.col("form") == "spm", F.concat(s, suffix, p, prefix, m, middle)).otherwise(F.col("text"))
    known = lambda c: F.when(F.col("form") != "plain", c)
    return rows.select("doc_id", "n", "form", known(F.col("at.prefix")).alias("prefix_chars"), known(F.col("at.upto") - F.col("at.prefix")).alias("middle_chars"), cut.alias("output"))
