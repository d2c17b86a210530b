"""Secrets in texts, told apart by who owns them over the whole corpus.

Fixed patterns give the base spans. Beside them every text offers candidates: long tokens that look alive
(letters and digits, much entropy). Values, as hashes, are counted over the corpus by distinct owners and
repositories, first inside each owner's repository (folded before the shuffle), then by owner, then as a whole, so a value that
a third of all rows hold is a few rows by then. Values of many owners are widely copied examples; those of few owners are
theirs, and tokens of theirs outside of base spans are added as spans of kind ``live``. Base spans stay whatever their
values are; how many of them are owned or copied is told beside them. No value leaves a task, hashes do.

Places count code points, ends exclusive. Null and empty texts have no spans. Repeated rows are separate rows and
add nothing to owners. Null owners and repositories are one each. An empty table gives none. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from learngraph.llm.shared import written

# The kinds of base spans in their order, their patterns and least lengths.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # of a run that is too short no part is long enough
LEAST = {"assign": 6, "access": 20, "hex": 24}

LIVE = "live"
TOKEN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])")
ENTROPY = 3.0  # bits a character
_SPAN = "struct<start:long,kind:int,stop:long,value:binary>"


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, value) by start, then kind: matches of each kind from the left, without overlap inside a kind; those too short go."""
    out = [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    out += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    out += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(out)


def looks_alive(token: str) -> bool:
    """Letters and digits, and at least ``ENTROPY`` bits a character."""
    if not re.search("[0-9]", token) or not re.search("[A-Za-z]", token):
        return False
    n = len(token)
    return -sum(k / n * math.log2(k / n) for k in Counter(token).values()) >= ENTROPY


def live_spans(text: str, base: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """Tokens that look alive and touch no base span."""
    out, at = [], 0
    for m in TOKEN.finditer(text):
        while at < len(base) and base[at][0] < m.start() and base[at][2] <= m.start():
            at += 1
        if not any(b[0] < m.end() and m.start() < b[2] for b in _near(base, at, m.end())) and looks_alive(m[0]):
            out.append((m.start(), len(KINDS), m.end(), m[0]))
    return out


def _near(base: list, at: int, end: int):
    for k in range(at, len(base)):
        if base[k][0] >= end:
            return
        yield base[k]


def _name(value: str) -> bytes:
    return hashlib.blake2b(value.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def candidates(docs: DataFrame, owner: Column, repository: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row (a number of its own), doc_id, owner, repository, base and live spans of every row."""
    given = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(owner.cast("string"), F.lit("")).alias("owner"), F.coalesce(repository.cast("string"), F.lit("")).alias("repository"), F.col(text_col).cast("string").alias("text"))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("stop", pa.int64()), ("value", pa.binary())]))
    named = lambda spans: [{"start": a, "kind": k, "stop": b, "value": _name(v)} for a, k, b, v in spans]

    def run(batches):
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            base = [base_spans(t) if t else [] for t in batch.column(3).to_pylist()]
            live = [live_spans(t, b) if t else [] for t, b in zip(batch.column(3).to_pylist(), base, strict=True)]
            rows = pa.array(range(row, row + len(base)), pa.int64())
            row += len(base)
            spans = [pa.array([named(x) for x in found], kind) for found in (base, live)]
            yield pa.RecordBatch.from_arrays([rows, *batch.columns[:3], *spans], names=["row", "doc_id", "owner", "repository", "base", "live"])

    return given.mapInArrow(run, f"row long, doc_id {dict(given.dtypes)['doc_id']}, owner string, repository string, base array<{_SPAN}>, live array<{_SPAN}>")


def ownership(found: DataFrame) -> DataFrame:
    """value (a hash), owners, repositories and uses: distinct owners, distinct repositories and places of every candidate."""
    every = found.select("owner", "repository", F.explode(F.concat("base", "live")).alias("c")).select("owner", "repository", "c.value")
    inside = every.groupBy("value", "owner", "repository").agg(F.count(F.lit(1)).alias("uses"))
    by_owner = inside.groupBy("value", "owner").agg(F.count(F.lit(1)).alias("repositories"), F.sum("uses").alias("uses"))
    return by_owner.groupBy("value").agg(F.count(F.lit(1)).alias("owners"), F.sum("repositories").alias("repositories"), F.sum("uses").alias("uses"))


def _told(spans: Column) -> Column:
    """kind:start:end of spans in order, joined by commas."""
    names = F.array(*[F.lit(k) for k in (*KINDS, LIVE)])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def scan(docs: DataFrame, *, owner: Column, repository: Column, most_owners: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_live, n_owned and n_copied (base spans by the owners of their values), base (as text) and spans (all, as text) of every row.

    A value of more than ``most_owners`` owners is a widely copied example. A repository belongs to its owner: the
    same name under another owner is another repository.
    """
    held = written(candidates(docs, owner, repository, id_col, text_col), "secret-candidates")
    freq = written(ownership(held), "secret-owners")
    uses = held.select("row", F.explode(F.concat("base", "live")).alias("c")).select("row", "c", "c.value").join(freq.select("value", (F.col("owners") <= most_owners).alias("owned")), "value")
    bare = F.struct(F.col("c.start").alias("start"), F.col("c.kind").alias("kind"), F.col("c.stop").alias("stop"))
    is_base = F.col("c.kind") < len(KINDS)
    judged = uses.groupBy("row").agg(F.collect_list(F.when(~is_base & F.col("owned"), bare)).alias("added"), F.count_if(is_base & F.col("owned")).alias("n_owned"), F.count_if(is_base & ~F.col("owned")).alias("n_copied"))
    some = (F.size("base") > 0) | (F.size("live") > 0)
    without = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["stop"].alias("stop")))
    known = held.select("row", "doc_id", without.alias("base"), some.alias("some"))
    none = known.where("NOT some").withColumns({"added": F.col("base"), "n_owned": F.lit(0).cast("long"), "n_copied": F.lit(0).cast("long")})
    full = known.where("some").join(judged, "row").unionByName(none)
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return full.select("doc_id", *[count(k) for k in range(len(KINDS))], F.size("added").cast("long").alias("n_live"), "n_owned", "n_copied", _told(F.col("base")).alias("base"), _told(F.array_sort(F.concat("base", "added"))).alias("spans"))
