"""Token-id shards: documents in order of their id, each shard one wavelet-matrix blob.

Documents are range-partitioned by id and sorted, so shards in (part, shard) order hold the
corpus in ascending id order; ties of ids come in the order of their texts, null ids first. Each
task turns its rows into shards of about ``shard_tokens`` tokens (a document is never split) and
the blobs are written as rows of a Parquet table by Spark's committer, so a lost executor's task
is simply run again. Null and empty texts have the end id alone. Places over the whole corpus
come from two running sums, over parts and over the shards of a part: no task sees all shards. Shards carry their rank directories, so tokens are counted and
located without decoding. Repeated rows are separate documents, an empty table makes no shard, other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from learngraph.llm.bpe import blocks, encoder
from learngraph.llm.wavelet import WaveletMatrix

SHARD_SCHEMA = "part int, shard int, n_docs long, n_tokens long, payload binary"
DOC_SCHEMA = "part int, shard int, doc_id long, shard_start long, n_tokens long, ids_crc32 long"


def write_shards(docs: DataFrame, path: str, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, shard_tokens: int = 1 << 18) -> None:
    """Encode every text, append ``end_id`` to each document and write the shards to ``path``."""

    def run(batches):
        enc = encoder(tokenizer_path)
        bits = max(1, int(enc.vocab_size - 1).bit_length())
        part, shard = TaskContext.get().partitionId(), 0
        names, parts, held = [], [], 0

        def out():
            nonlocal shard, names, parts, held
            lengths = np.array([len(p) for p in parts], np.int64)
            starts = np.concatenate([[0], np.cumsum(lengths)])
            known = np.array([x is not None for x in names], bool)
            doc_ids = np.array([x or 0 for x in names], np.int64)
            blob = WaveletMatrix.build(np.concatenate(parts), bits).to_bytes(starts, doc_ids, known)
            row = [[part], [shard], [len(names)], [int(starts[-1])], [blob]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            batch = pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, kinds, strict=True)], names=["part", "shard", "n_docs", "n_tokens", "payload"])
            shard, names, parts, held = shard + 1, [], [], 0
            return batch

        end = np.array([end_id], enc.dtype)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in blocks(texts):
                for doc_id, tokens in zip(ids[a:b], enc.encode(texts[a:b]), strict=True):
                    names.append(doc_id)
                    parts.append(np.append(tokens, end))
                    held += len(tokens) + 1
                    if held >= shard_tokens:
                        yield out()
        if names:
            yield out()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ordered = rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    ordered.mapInArrow(run, SHARD_SCHEMA).write.option("compression", "uncompressed").parquet(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SHARD_SCHEMA).parquet(path)


def shard_starts(shards: DataFrame) -> DataFrame:
    """part, shard, corpus_start: tokens of all shards before this one."""
    sizes = shards.select("part", "shard", "n_tokens")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("_n")).select("part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    own = sizes.withColumn("_inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return own.join(parts, "part").select("part", "shard", (F.col("_before") + F.col("_inside")).alias("corpus_start"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, decoded from the shards at ``path``."""

    def run(batches):
        for batch in batches:
            for part, shard, blob in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                matrix, starts, doc_ids, known = WaveletMatrix.from_bytes(blob)
                raw = memoryview(matrix.decode().astype("<u4")).cast("B")
                edge = starts.astype(int).tolist()
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(edge, edge[1:], strict=False)]
                n = len(doc_ids)
                columns = [pa.array(np.full(n, part, np.int32)), pa.array(np.full(n, shard, np.int32)), pa.array(doc_ids, mask=~known)]
                columns += [pa.array(starts[:-1].astype(np.int64)), pa.array(np.diff(starts.astype(np.int64))), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in DOC_SCHEMA.split(", ")])

    shards = read_shards(spark, path)
    found = shards.select("part", "shard", "payload").mapInArrow(run, DOC_SCHEMA)
    return found.join(shard_starts(shards), ["part", "shard"]).select("doc_id", (F.col("corpus_start") + F.col("shard_start")).alias("start"), "n_tokens", "ids_crc32")


def count_tokens(spark: SparkSession, path: str, tokens: list[int]) -> DataFrame:
    """token and n, its occurrences in all shards, of each given token (0 for one that nowhere stands). Shards are counted by rank, not decoded."""
    wanted = sorted(set(tokens))

    def run(batches):
        total = np.zeros(len(wanted), np.int64)
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                matrix = WaveletMatrix.from_bytes(blob)[0]
                total += [matrix.count(t) for t in wanted]
        yield pa.RecordBatch.from_arrays([pa.array(wanted, pa.int64()), pa.array(total)], names=["token", "n"])

    counted = read_shards(spark, path).select("payload").mapInArrow(run, "token long, n long")
    given = spark.createDataFrame([(int(t), 0) for t in wanted], "token long, n long")
    return counted.unionByName(given).groupBy("token").agg(F.sum("n").alias("n"))


def locate_token(spark: SparkSession, path: str, token: int) -> DataFrame:
    """doc_id, at (place in the document, from 0) and start (place in the corpus) of every occurrence of a token, by select from the shards that hold it."""

    def run(batches):
        for batch in batches:
            for part, shard, blob in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                matrix, starts, doc_ids, known = WaveletMatrix.from_bytes(blob)
                places = matrix.places(token)
                if len(places):
                    doc = np.searchsorted(starts, places, side="right") - 1
                    n = len(places)
                    columns = [pa.array(np.full(n, part, np.int32)), pa.array(np.full(n, shard, np.int32)), pa.array(doc_ids[doc], mask=~known[doc])]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(places - starts[doc].astype(np.int64)), pa.array(places)], names=["part", "shard", "doc_id", "at", "place"])

    shards = read_shards(spark, path)
    found = shards.select("part", "shard", "payload").mapInArrow(run, "part int, shard int, doc_id long, at long, place long")
    return found.join(shard_starts(shards), ["part", "shard"]).select("doc_id", "at", (F.col("corpus_start") + F.col("place")).alias("start"))
