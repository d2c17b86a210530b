"""The prerequisite graph under new sources, by what changes alone.

New units change weights and, where a pair of concepts is new, degrees. Changed degrees change anchors of the objects that have
such keywords; an object whose anchor's degree changes may turn or lose its edges inside its layer, never those across layers. New objects
meet what shares their keywords. So a batch looks up, by key, the concepts, objects and pairs that it touches, and writes what became different.

Objects are compared by the degree of their anchor: centrality is that number over one less than all concepts, so it orders them alike
and no object has to be visited because the number of concepts grew. (Of a single concept the centrality is 1; that one case is
scored so, and scored again when a second concept comes.) Pairs of one layer that are alike enough are kept whatever their
order, so a changed order turns edges without comparing vectors again. Objects name their vectors: those they bring are a table of their own, written
once and not with every new score, and those that many share (``vectors``) aren't copied at all. Edges that were judged once keep their verdict; only edges never seen before are judged.

The state after any batches equals that of one batch with all their rows. Of objects with one id the first stays.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from learngraph.operators import overlap
from learngraph.operators.graph import cooccurrence_edges
from learngraph.shared import passing, written
from learngraph.streaming.state import BUCKETS, Store, Table, Version

_OBJECT = ("id", "layer", "ref", "keywords", "anchor", "score")
FULL = 64  # keys to a bucket of the state, from which on buckets aren't picked by key


def open_store(spark: SparkSession, root: str, *, concept: str = "string", id_kind: str = "string", ref_kind: str | None = None, buckets: int = BUCKETS) -> Store:
    """The state's tables, for concepts (and keywords), ids and names of vectors (ids, unless they are shared) of these types."""
    ref = ref_kind or id_kind
    tables = {
        "edges": Table(f"src {concept}, dst {concept}, weight bigint", ("src", "dst"), ("weight",)),
        "concepts": Table(f"concept {concept}, degree bigint", ("concept",), ("degree",)),
        "objects": Table(f"id {id_kind}, layer int, ref {ref}, keywords array<{concept}>, anchor {concept}, score bigint", ("id",)),
        "vectors": Table(f"ref {ref}, vector array<float>", ("ref",)),
        "keywords": Table(f"keyword {concept}, id {id_kind}", ("keyword", "id"), by=("keyword",)),
        "alike": Table(f"id {id_kind}, other {id_kind}", ("id", "other"), by=("id",)),
        "links": Table(f"src {id_kind}, dst {id_kind}, alive bigint", ("src", "dst"), ("alive",)),
        "verdicts": Table(f"src {id_kind}, dst {id_kind}, accepted boolean", ("src", "dst")),
    }
    return Store(spark, root, tables, buckets)


def _score(degree: Column, concepts: int) -> Column:
    """What orders concepts as their centrality does; 0 for unknown ones."""
    return F.coalesce(degree, F.lit(0)) if concepts > 1 else F.when(degree.isNotNull(), 1).otherwise(0)


def fold(store: Store, units: DataFrame, objects: DataFrame, number: int, *, least_cosine: float = 0.6, verify: Callable[[DataFrame], DataFrame] | None = None, vectors: DataFrame | None = None) -> Version:
    """Version ``number``: the newest below it, with the units' (unit, concept) rows and the objects (id, layer, vector, keywords, and seq if ids repeat) added.

    With ``vectors`` (ref, vector), objects have a ref in place of the vector. A unit's rows come in one batch. What is written on the way goes at the end. ``verify`` gets new candidate edges (src, dst) and returns those it accepts; without it all are.
    """
    with passing(store.spark):
        return _folded(store, units, objects, number, least_cosine, verify, vectors)


def _folded(store: Store, units: DataFrame, objects: DataFrame, number: int, least_cosine: float, verify: Callable[[DataFrame], DataFrame] | None, vectors: DataFrame | None) -> Version:
    base = store.newest(number)
    delta = written(cooccurrence_edges(units, "unit", "concept"), "delta-edges")
    deltas = delta.count()
    near_all = deltas >= FULL * store.buckets  # so many keys leave hardly a bucket out
    asks = lambda keys: None if near_all else keys
    added = written(delta.join(store.present(base, "edges", asks(delta)), ["src", "dst"], "left_anti").select("src", "dst"), "new-edges")
    own = units.where("unit IS NOT NULL AND concept IS NOT NULL").select("concept").distinct()
    born = own.join(store.present(base, "concepts", asks(own)), "concept", "left_anti").select("concept", F.lit(0).cast("long").alias("degree"), F.lit(True).alias("born"))
    ends = added.select(F.explode(F.array("src", "dst")).alias("concept"), F.lit(1).cast("long").alias("degree"), F.lit(False).alias("born"))
    grown = written(born.unionByName(ends).groupBy("concept").agg(F.sum("degree").alias("degree"), F.max("born").alias("born")), "degree-changes")
    counted = grown.agg(F.count(F.lit(1)).alias("touched"), F.count_if("born").alias("born")).first()
    grown = grown.drop("born")
    before = base.facts.get("concepts", 0)
    concepts = before + counted["born"]
    most = near_all and 2 * counted["touched"] >= concepts  # then whole tables are cheaper to go through than to look up: what isn't touched comes out as it was
    touched = grown.select("concept") if before != 1 else grown.select("concept").unionByName(store.read(base, "concepts").select("concept")).distinct()

    new = _first(objects).where(F.col("id").isNotNull())
    own = [F.col("id").alias("ref"), F.col("vector").cast("array<float>").alias("vector")] if vectors is None else ["ref"]
    new = written(new.join(store.present(base, "objects", asks(new.select("id"))), "id", "left_anti").select("id", F.col("layer").cast("int").alias("layer"), *own, F.array_distinct(F.array_compact("keywords")).alias("keywords")), "new-objects")
    brought = new.select("ref", "vector") if vectors is None else None
    met = store.read(base, "objects", None if most else store.read(base, "keywords", touched.withColumnRenamed("concept", "keyword")).select("id").distinct())
    met = met if most and len(base.segments.get("objects", ())) < 2 else written(met, "met-objects")
    every = met.select(*_OBJECT).unionByName(new.withColumns({"anchor": F.lit(None).cast(dict(met.dtypes)["anchor"]), "score": F.lit(None).cast("long")}).select(*_OBJECT))
    rescored = written(_rescored(store, base, every, grown, concepts, most), "rescored-objects")
    changed = rescored.where("NOT (score <=> old_score AND anchor <=> old_anchor)")
    moved = rescored.where("NOT score <=> old_score")

    words = new.select("id", F.explode("keywords").alias("keyword"))
    near = store.present(base, "keywords") if most else store.read(base, "keywords", words.select("keyword"))
    others = (met if most else store.read(base, "objects", near.select("id").distinct())).select("id", "layer", "ref")
    placed = others.unionByName(new.select("id", "layer", "ref"))
    placed = placed if most else written(placed, "pair-objects")
    known = written(store.read(base, "vectors", None if most else others.select("ref")).unionByName(brought), "pair-vectors") if vectors is None else vectors
    pairs = overlap.layered_pairs(placed, near.select("id", "keyword").unionByName(words), least_cosine, new.select("id"), known)
    pairs = written(pairs, "new-pairs")
    fresh = pairs.where("NOT across").select("a", "b")
    both = lambda p: p.select(F.col("a").alias("id"), F.col("b").alias("other")).unionByName(p.select(F.col("b").alias("id"), F.col("a").alias("other")))
    turned = store.read(base, "alike", None if most else moved.select("id")).select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()
    changes = _links(store, base, turned, fresh, rescored, most).unionByName(pairs.where("across").select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit(1).cast("long").alias("alive")))
    links = written(changes.groupBy("src", "dst").agg(F.sum("alive").alias("alive")).where("alive != 0"), "link-changes")
    gained = links.where("alive > 0").select("src", "dst")
    asked = written(gained.join(store.present(base, "verdicts", asks(gained)), ["src", "dst"], "left_anti"), "new-candidates")
    accepted = verify(asked).select("src", "dst").distinct().withColumn("accepted", F.lit(True)) if verify else asked.withColumn("accepted", F.lit(True))
    verdicts = asked.join(accepted, ["src", "dst"], "left").withColumn("accepted", F.coalesce("accepted", F.lit(False))) if verify else accepted
    tables = {"edges": delta, "concepts": grown, "objects": changed.select(*_OBJECT), **({} if brought is None else {"vectors": brought}), "keywords": words.select("keyword", "id"), "alike": both(fresh), "links": links, "verdicts": verdicts}
    rows = lambda df: df.count()
    sizes = {"edges": deltas, "concepts": counted["touched"], "objects": rows(changed), "keywords": rows(words), "alike": 2 * rows(fresh), "links": rows(links), "verdicts": rows(asked)}
    return store.commit(base, number, tables, {"concepts": concepts}, sizes)


def _first(objects: DataFrame) -> DataFrame:
    """One row an id, the first by ``seq`` where there is one."""
    if "seq" not in objects.columns:
        return objects.dropDuplicates(["id"])
    rest = [c for c in objects.columns if c not in ("id", "seq")]
    return objects.groupBy("id").agg(F.min_by(F.struct(*rest), "seq").alias("s")).select("id", *[F.col("s")[c].alias(c) for c in rest])


def _rescored(store: Store, base: Version, objects: DataFrame, grown: DataFrame, concepts: int, most: bool) -> DataFrame:
    """The objects with anchor and score of now, and those of before as old_anchor and old_score (null for new ones)."""
    words = objects.select("id", F.explode("keywords").alias("concept"))
    words = words if most else written(words, "met-keywords")
    degree = store.read(base, "concepts", None if most else words.select("concept")).unionByName(grown).groupBy("concept").agg(F.sum("degree").alias("degree"))
    ranked = words.join(degree, "concept", "left").select("id", F.struct((-_score(F.col("degree"), concepts)).alias("s"), F.col("concept").alias("k")).alias("x"))
    best = ranked.groupBy("id").agg(F.min("x").alias("x")).select("id", F.col("x.k").alias("anchor"), (-F.col("x.s")).cast("long").alias("score"))
    old = objects.withColumnsRenamed({"anchor": "old_anchor", "score": "old_score"})
    return old.join(best, "id", "left").withColumn("score", F.coalesce("score", F.lit(0)))


def _links(store: Store, base: Version, turned: DataFrame, fresh: DataFrame, rescored: DataFrame, most: bool) -> DataFrame:
    """src, dst, alive: -1 where an edge inside a layer was, 1 where it is, for pairs kept before (``turned``) and new ones (``fresh``)."""
    pairs = written(turned.withColumn("was", F.lit(True)).unionByName(fresh.withColumn("was", F.lit(False))), "inside-pairs")
    scores = rescored.select("id", "score", "old_score")
    if not most:  # else all objects are among them
        now = scores.where("NOT score <=> old_score")
        ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        still = store.read(base, "objects", ids).join(now, "id", "left_anti").select("id", "score", F.col("score").alias("old_score"))
        scores = written(still.unionByName(now), "pair-scores")
    side = lambda x: scores.select(F.col("id").alias(x), F.col("score").alias(f"n{x}"), F.col("old_score").alias(f"o{x}"))
    full = pairs.join(side("a"), "a").join(side("b"), "b")
    edge = lambda x, y, when, n: F.when(when & (x != y), F.struct(F.when(x > y, F.col("a")).otherwise(F.col("b")).alias("src"), F.when(x > y, F.col("b")).otherwise(F.col("a")).alias("dst"), F.lit(n).cast("long").alias("alive")))
    found = F.array_compact(F.array(edge(F.col("oa"), F.col("ob"), F.col("was"), -1), edge(F.col("na"), F.col("nb"), F.lit(True), 1)))
    return full.select(F.explode(found).alias("e")).select("e.*")


def candidates(store: Store, version: Version) -> DataFrame:
    """src -> dst of all edges before judging."""
    return store.read(version, "links").where("alive > 0").select("src", "dst")


def verified(store: Store, version: Version) -> DataFrame:
    """src -> dst of the edges that were accepted."""
    return candidates(store, version).join(store.read(version, "verdicts").where("accepted"), ["src", "dst"], "left_semi")


def anchors(store: Store, version: Version) -> DataFrame:
    """id, anchor and its centrality; the centrality of an object without keywords is 0."""
    n = version.facts.get("concepts", 0)
    share = F.col("score") / (n - 1) if n > 1 else F.col("score").cast("double")
    return store.read(version, "objects").select("id", "anchor", share.alias("centrality"))


def prerequisite_stream(stream: DataFrame, root: str, checkpoint: str, *, least_cosine: float = 0.6, verify: Callable[[DataFrame], DataFrame] | None = None, buckets: int = BUCKETS, vectors: DataFrame | None = None):
    """Start the query that folds each micro-batch of rows (id, concepts, layer, vector, keywords) in: each row is a unit; those with a layer and a vector (with ``vectors``: a ref) are objects too."""
    kinds = dict(stream.dtypes)
    vector = "vector" if vectors is None else "ref"

    def step(batch: DataFrame, epoch: int) -> None:
        with passing(batch.sparkSession):
            store = open_store(batch.sparkSession, root, concept=kinds["concepts"][6:-1], id_kind=kinds["id"], ref_kind=kinds.get("ref"), buckets=buckets)
            held = written(batch, "batch")
            units = held.select(F.col("id").alias("unit"), F.explode("concepts").alias("concept"))
            fold(store, units, held.where(f"layer IS NOT NULL AND {vector} IS NOT NULL"), epoch, least_cosine=least_cosine, verify=verify, vectors=vectors)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
