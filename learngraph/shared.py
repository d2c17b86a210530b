"""Tables written in the folder that the driver and all executors share."""

from __future__ import annotations

import math
import tempfile
import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Where it is unset, a temporary folder, set here, does in local mode only."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="shared-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


ROWS = 1 << 19  # of a table to a partition of what is shuffled


def enough_partitions(df: DataFrame) -> int | None:
    """Raises the session's number of shuffle partitions to one for each ``ROWS`` rows of ``df``, so that a task's memory does not grow with the table. It is never lowered; adaptive execution puts small partitions together. Returns the number where it is above the session's parallelism, so worth dealing rows by."""
    name, wanted = "spark.sql.shuffle.partitions", math.ceil(df.count() / ROWS)
    if wanted > int(df.sparkSession.conf.get(name)):
        df.sparkSession.conf.set(name, str(wanted))
    return wanted if wanted > df.sparkSession.sparkContext.defaultParallelism else None


_scope = threading.local()


@contextmanager
def passing(spark: SparkSession):
    """Tables that this thread writes inside go when it ends: nothing that outlives it may read them."""
    outer, _scope.paths = getattr(_scope, "paths", None), []
    try:
        yield
    finally:
        for path in _scope.paths:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        _scope.paths = outer


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: a cut of the lineage that outlives lost executors."""
    path = new_path(df.sparkSession, name)
    if getattr(_scope, "paths", None) is not None:
        _scope.paths.append(path)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
