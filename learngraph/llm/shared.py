"""Bounds on what workers hold, and the library's tables in the shared folder."""

from __future__ import annotations

import contextlib
import ctypes

from pyspark.sql import SparkSession

from learngraph.shared import new_path, shared_folder, written

__all__ = ["give_back", "new_path", "shared_folder", "small_batches", "unused", "written"]


def small_batches(spark: SparkSession, rows: int = 1000, size: str = "8m") -> None:
    """Bound what travels to a Python worker at once, by rows and bytes: long texts make Spark's defaults (10,000 rows, 64 MB) hundreds of MB in both processes. Smaller settings of the session stay."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    if int(spark.conf.get("spark.sql.parquet.columnarReaderBatchSize")) > rows:  # rows of long texts that a scan decodes at once
        spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(rows))
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", "64m") in ("64m", "67108864", "67108864b"):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def unused(columns: list[str], *names: str) -> list[str]:
    """``names``, each with as many underscores after it as it takes to clash with none of the columns (whatever the case)."""
    taken = {c.lower() for c in columns}
    return [next(x for k in range(len(taken) + 1) if (x := name + "_" * k).lower() not in taken) for name in names]


def give_back() -> None:
    """Return freed memory of a worker, which lives on between tasks, to the system (where the C library can)."""
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)
