"""Keyed state for incremental jobs: tables in hash buckets, brought up to date by batches.

A table is a list of segments, each a Parquet folder cut by ``bucket`` (a hash of the key). A batch writes its own rows
as one segment; segments are merged like digits of a binary counter (a segment joins its neighbour while that one has less
than twice its rows), so a row is rewritten about log2(all rows / batch rows) times in its life and a batch costs rows in
proportion to itself. Reading merges the segments by key: sums add up, other columns take the newest value.

A version of all tables is one manifest, a small file that ends with its own checksum. It is written last, so a batch that fails
leaves the former version in force, and a batch that is run again starts from the newest version below its own and writes the same rows. No marker
of the output committer is needed. Segments that neither of the two newest versions names are removed.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from learngraph.shared import ROWS

BUCKETS = 32


@dataclass(frozen=True)
class Table:
    """Columns as DDL, the key among them, the columns that add up, and those of the key by which rows are dealt and looked up (all, if not given)."""

    columns: str
    key: tuple[str, ...]
    sums: tuple[str, ...] = ()
    by: tuple[str, ...] = ()

    @property
    def lookup(self) -> tuple[str, ...]:
        return self.by or self.key


@dataclass(frozen=True)
class Segment:
    path: str
    rows: int


@dataclass(frozen=True)
class Version:
    """What a manifest says: its number, the segments of every table, and single facts beside them."""

    number: int = -1
    segments: dict[str, tuple[Segment, ...]] = field(default_factory=dict)
    facts: dict = field(default_factory=dict)


class Store:
    """Tables of a folder that the driver and all executors share."""

    def __init__(self, spark: SparkSession, root: str, tables: dict[str, Table], buckets: int = BUCKETS) -> None:
        self.spark, self.root, self.tables, self.buckets = spark, root.rstrip("/"), tables, buckets
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._fs = self._hadoop.Path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, *parts: str):
        return self._hadoop.Path("/".join([self.root, *parts]))

    def _names(self, *parts: str) -> list[str]:
        path = self._path(*parts)
        return [s.getPath().getName() for s in self._fs.listStatus(path)] if self._fs.exists(path) else []

    def _load(self, number: int) -> Version | None:
        """None for a manifest that was not written to its end."""
        stream = self._fs.open(self._path("manifests", f"{number}.json"))
        try:
            text = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        body, _, check = text.rpartition("\n")
        if hashlib.sha256(body.encode()).hexdigest() != check:
            return None
        found = json.loads(body)
        return Version(number, {t: tuple(Segment(*s) for s in segments) for t, segments in found["segments"].items()}, found["facts"])

    def versions(self) -> list[int]:
        """Numbers of all manifests, rising."""
        return sorted(int(n[:-5]) for n in self._names("manifests") if n.endswith(".json") and n[:-5].isdigit())

    def newest(self, before: int | None = None) -> Version:
        """The newest whole version (below ``before``, if given); an empty one at first."""
        for number in reversed(self.versions()):
            if (before is None or number < before) and (found := self._load(number)):
                if found.facts["buckets"] != self.buckets:
                    raise ValueError(f"the state has {found.facts['buckets']} buckets, not {self.buckets}")
                return found
        return Version(facts={"buckets": self.buckets})

    def bucket(self, name: str):
        return F.pmod(F.xxhash64(*self.tables[name].lookup), F.lit(self.buckets)).cast("int")

    def _segments(self, name: str, segments: tuple[Segment, ...]) -> DataFrame:
        schema = f"{self.tables[name].columns}, _version long, bucket int"
        frames = [self.spark.read.schema(schema).parquet(s.path) for s in segments if s.rows]
        if not frames:
            return self.spark.createDataFrame([], schema).where(F.lit(False))  # which the optimizer knows to be empty, and what is joined to it too
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f)
        return out

    def _merged(self, name: str, rows: DataFrame) -> DataFrame:
        table = self.tables[name]
        last = [c for c in rows.columns if c not in (*table.key, *table.sums, "_version", "bucket")]
        aggs = [F.sum(c).alias(c) for c in table.sums] + [F.max_by(c, "_version").alias(c) for c in last]
        return rows.groupBy(*table.key, "bucket").agg(*aggs, F.max("_version").alias("_version"))

    def _found(self, version: Version, name: str, keys: DataFrame | None) -> DataFrame:
        """Rows of all segments, as they are, of the buckets that the keys fall in."""
        segments = version.segments.get(name, ())
        rows = self._segments(name, segments)
        if keys is None or not any(s.rows for s in segments):
            return rows
        hit = [r[0] for r in keys.select(self.bucket(name).alias("b")).distinct().collect()]  # as many as there are buckets at most
        return rows.where(F.col("bucket").isin(hit))

    def read(self, version: Version, name: str, keys: DataFrame | None = None) -> DataFrame:
        """The rows of a table; with ``keys`` (the columns to look up by), those rows alone, read from the buckets that the keys fall in."""
        rows = self._found(version, name, keys)
        if keys is not None:
            rows = rows.join(keys.select(*self.tables[name].lookup).distinct(), list(self.tables[name].lookup), "left_semi")
        whole = self._merged(name, rows) if sum(s.rows > 0 for s in version.segments.get(name, ())) > 1 else rows
        return whole.drop("_version", "bucket")

    def present(self, version: Version, name: str, keys: DataFrame | None = None) -> DataFrame:
        """The keys that a table has (with ``keys``: of their buckets), maybe several times: for joins that ask for no more."""
        return self._found(version, name, keys).select(*self.tables[name].key)

    def _write(self, name: str, rows: DataFrame, number: int, size: int | None = None, most: int = 0) -> Segment:
        """The rows as a segment, of ``size`` rows if that is known, and of ``most`` at most: a bucket of many is written by several tasks."""
        path = f"{self.root}/segments/{name}-{number}-{uuid.uuid4().hex}"
        tasks = -(-2 * max(size or 0, most) // (self.buckets * ROWS))
        dealt = rows.repartition("bucket", F.pmod(F.xxhash64(*self.tables[name].key, F.lit(1)), F.lit(tasks))) if tasks > 1 else rows.repartition("bucket")
        dealt.write.partitionBy("bucket").parquet(path)
        if size is None:
            size = self.spark.read.schema(f"{self.tables[name].columns}, _version long, bucket int").parquet(path).count() if any(x.startswith("bucket=") for x in self._names("segments", path.rsplit("/", 1)[1])) else 0
        return Segment(path, size)

    def commit(self, base: Version, number: int, changes: dict[str, DataFrame], facts: dict | None = None, sizes: dict[str, int] | None = None) -> Version:
        """Version ``number``: ``base`` with the changes (amounts to add, newest values; one row a key) and the facts. Changes whose ``sizes`` are known, being written already, join their neighbours at once."""
        segments = dict(base.segments)
        for name, rows in changes.items():
            rows = rows.select(*[F.col(f.name).cast(f.dataType) for f in self._segments(name, ()).schema if f.name not in ("_version", "bucket")])
            rows = rows.withColumns({"_version": F.lit(number).cast("long"), "bucket": self.bucket(name)})
            new = self._write(name, rows, number) if sizes is None or name not in sizes else None
            held, joined, total = list(segments.get(name, ())), [], new.rows if new else sizes[name]
            size = total
            while held and held[-1].rows < 2 * total:
                joined.insert(0, held.pop())
                total += joined[0].rows
            joined = [s for s in joined if s.rows]
            if joined:
                old = self._segments(name, tuple(joined))
                joined = [self._write(name, self._merged(name, old.unionByName(self._segments(name, (new,)) if new else rows)), number, None, total)]
            elif size:
                joined = [new or self._write(name, rows, number, size)]
            segments[name] = tuple(held + joined)
        out = Version(number, segments, {**base.facts, **(facts or {}), "columns": {t: x.columns for t, x in self.tables.items()}})
        body = json.dumps({"segments": {t: [[s.path, s.rows] for s in found] for t, found in segments.items()}, "facts": out.facts})
        stream = self._fs.create(self._path("manifests", f"{number}.json"), True)
        stream.write((body + "\n" + hashlib.sha256(body.encode()).hexdigest()).encode())
        stream.close()
        self._forget(number)
        return out

    def _forget(self, number: int) -> None:
        """Keep this version and the one before it (what a batch that is run again starts from), and what they name."""
        kept = [v for n in self.versions() if n <= number and (v := self._load(n))][-2:]
        for n in self.versions():
            if n < min(v.number for v in kept):
                self._fs.delete(self._path("manifests", f"{n}.json"), False)
        named = {s.path.rsplit("/", 1)[1] for n in self.versions() if (v := self._load(n)) for found in v.segments.values() for s in found}
        for x in self._names("segments"):
            if x not in named:
                self._fs.delete(self._path("segments", x), True)
