"""Files that land in a folder, taken through scan, extraction and deduplication to units, batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from learngraph.operators import generation
from learngraph.operators.concepts import normalize
from learngraph.shared import written
from learngraph.sources import connectors, documents, tables
from learngraph.sources.sections import dispatch
from learngraph.streaming import deduplication
from learngraph.streaming.incremental import uploads
from learngraph.streaming.state import BUCKETS

_SHIFT = 1 << 44  # numbers of units a batch


def unit_stream(spark: SparkSession, folder: str, client: Callable, root: str, *, threshold: float = 0.82, pattern: str = "*", buckets: int = BUCKETS, files_a_batch: int = 1000):
    """Start the query that turns landed files into the units under ``root`` (``units`` reads them), in order of batch, file, section and place.

    A unit that is alike one kept before, from whatever file, is left out. Answers of the model are stored by batch before they are used,
    so a batch that is run again asks nothing again and writes the same rows. Files of other formats are told by ``refused``.
    """

    def step(batch: DataFrame, epoch: int) -> None:
        known, other = dispatch(written(batch.select("path", "content"), "landed"))
        other.write.mode("overwrite").parquet(f"{root}/refused/batch={epoch}")
        sections = lambda: documents.scan(known).orderBy("id", "seq").withColumn("seq", F.monotonically_increasing_id())
        held = tables.stage(spark, f"{root}/sections/{epoch}", sections)
        raw = tables.stage(spark, f"{root}/answers/{epoch}", lambda: generation.extract_units(held, client, places=True))
        numbered = raw.orderBy("seq", "place").withColumn("seq", F.lit(epoch * _SHIFT) + F.monotonically_increasing_id()).drop("place")
        found = written(connectors.embed(numbered, "statement"), "embedded-units")
        store = deduplication.open_store(spark, f"{root}/index", buckets=buckets)
        version = deduplication.fold(store, found, epoch, least=threshold)
        kept = found.drop("vector").join(deduplication.kept(store, version), "seq", "left_semi")
        normalize(kept).write.mode("overwrite").parquet(f"{root}/units/batch={epoch}")

    stream = uploads(spark, folder, pattern, files_a_batch)
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{root}/log").trigger(availableNow=True).start()


def units(spark: SparkSession, root: str) -> DataFrame:
    """All units so far."""
    return spark.read.parquet(f"{root}/units").drop("batch")


def refused(spark: SparkSession, root: str) -> DataFrame:
    """Files that no reader takes, with the reason."""
    return spark.read.parquet(f"{root}/refused").drop("batch")
