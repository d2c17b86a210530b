"""Incremental sources: each micro-batch brings stored state up to date, at a cost that follows the batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from learngraph.operators.graph import cooccurrence_edges
from learngraph.streaming.state import BUCKETS, Store, Table

WHOLE = ("tinyint", "smallint", "int", "bigint")


def _edge_store(spark: SparkSession, root: str, kind: str, buckets: int = BUCKETS) -> Store:
    return Store(spark, root, {"edges": Table(f"src {kind}, dst {kind}, weight bigint", ("src", "dst"), ("weight",))}, buckets)


def current(spark: SparkSession, root: str, before: int | None = None, kind: str = "bigint", buckets: int = BUCKETS) -> DataFrame:
    """The newest edges (below a version, if given). At first none, of concepts of this ``kind``."""
    store = _edge_store(spark, root, kind, buckets)
    version = store.newest(before)
    store.tables["edges"] = Table(version.facts.get("columns", {}).get("edges", store.tables["edges"].columns), ("src", "dst"), ("weight",))
    return store.read(version, "edges")


def uploads(spark: SparkSession, folder: str, pattern: str = "*", files_a_batch: int = 1000):
    """A stream of the files that land in a folder: path, modificationTime, length and content; so many files a micro-batch at most."""
    schema = "path STRING, modificationTime TIMESTAMP, length LONG, content BINARY"
    return spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_a_batch).load(folder)


def cooccurrence_stream(stream: DataFrame, unit: str, concept: str, state: str, checkpoint: str, buckets: int = BUCKETS):
    """Start the query that folds each micro-batch's edges into ``state``.

    A unit's concepts must come in one batch. Batch k makes version k from the newest version below it, so a batch that is run
    again after a failure adds nothing twice. Concepts are whole numbers or text.
    """
    kind = dict(stream.dtypes)[concept]
    kind = "bigint" if kind in WHOLE else kind

    def fold(batch: DataFrame, epoch: int) -> None:
        store = _edge_store(batch.sparkSession, state, kind, buckets)
        new = cooccurrence_edges(batch, unit, concept)
        new = new.select(F.col("src").cast(kind), F.col("dst").cast(kind), F.col("weight").cast("long"))
        store.commit(store.newest(epoch), epoch, {"edges": new})

    return stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_units(stream: DataFrame, path: str, checkpoint: str):
    """Start the query that appends new units to a table: exactly once, by the file sink's log."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
