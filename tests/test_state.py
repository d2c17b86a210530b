"""Keyed state: sums, newest values, merging of segments, batches run again, broken manifests."""

import random
from collections import Counter

import pytest

from learngraph.streaming import incremental
from learngraph.streaming.state import Store, Table

TABLES = {"counts": Table("k string, n bigint", ("k",), ("n",)), "names": Table("a bigint, b string, name string, score double", ("a", "b"))}


def stored(spark, tmp_path, buckets=3):
    return Store(spark, str(tmp_path / "state"), TABLES, buckets)


def test_batches_equal_one_pass_and_write_in_proportion(spark, tmp_path):
    store, rng, counts, names, written = stored(spark, tmp_path), random.Random(1), Counter(), {}, 0
    real = store._write

    def counted(*a):
        nonlocal written
        s = real(*a)
        written += s.rows
        return s

    store._write = counted
    total = 0
    for batch in range(12):
        rows = Counter(f"k{rng.randrange(400)}" for _ in range(30))
        new = {(k % 5, str(k)): (f"n{batch}", float(batch)) for k in rng.sample(range(20), 4)}
        counts.update(rows)
        names.update(new)
        total += len(rows) + len(new)
        store.commit(store.newest(batch), batch, {"counts": spark.createDataFrame(list(rows.items()), "k string, n bigint"), "names": spark.createDataFrame([(*k, *v) for k, v in new.items()], TABLES["names"].columns)})
    version = store.newest()
    assert {r["k"]: r["n"] for r in store.read(version, "counts").collect()} == counts
    assert {(r["a"], r["b"]): (r["name"], r["score"]) for r in store.read(version, "names").collect()} == names
    assert written <= total * 5 and len(version.segments["counts"]) <= 5
    some = spark.createDataFrame([("k1",), ("k2",), ("none",), ("k1",)], "k string")
    assert {r["k"]: r["n"] for r in store.read(version, "counts", some).collect()} == {k: counts[k] for k in ("k1", "k2") if k in counts}
    assert store.versions() == [10, 11]
    named = {s.path.rsplit("/", 1)[1] for n in (10, 11) for found in store._load(n).segments.values() for s in found}
    assert set(store._names("segments")) == named


def test_a_batch_run_again_adds_nothing_twice(spark, tmp_path):
    store = stored(spark, tmp_path)
    one = {"counts": spark.createDataFrame([("a", 1)], "k string, n bigint")}
    store.commit(store.newest(0), 0, one, {"n": 1})
    store.commit(store.newest(1), 1, one, {"n": 2})
    store.commit(store.newest(1), 1, one, {"n": 2})
    assert [tuple(r) for r in store.read(store.newest(), "counts").collect()] == [("a", 2)] and store.newest().facts["n"] == 2
    assert [tuple(r) for r in store.read(store.newest(1), "counts").collect()] == [("a", 1)]


def test_a_manifest_cut_short_does_not_count(spark, tmp_path):
    store = stored(spark, tmp_path)
    one = {"counts": spark.createDataFrame([("a", 1)], "k string, n bigint")}
    store.commit(store.newest(0), 0, one)
    store.commit(store.newest(1), 1, one)
    path = tmp_path / "state" / "manifests" / "1.json"
    path.write_text(path.read_text()[:-20])
    (tmp_path / "state" / "manifests" / ".1.json.crc").unlink(missing_ok=True)
    assert store.newest().number == 0 and [tuple(r) for r in store.read(store.newest(), "counts").collect()] == [("a", 1)]
    store.commit(store.newest(1), 1, one)
    assert [tuple(r) for r in store.read(store.newest(), "counts").collect()] == [("a", 2)]


def test_empty_state_and_other_buckets(spark, tmp_path):
    store = stored(spark, tmp_path)
    assert store.newest().number == -1 and store.read(store.newest(), "names").count() == 0
    store.commit(store.newest(0), 0, {"counts": spark.createDataFrame([], "k string, n bigint")})
    assert store.read(store.newest(), "counts").count() == 0
    with pytest.raises(ValueError, match="buckets"):
        stored(spark, tmp_path, 5).newest()
    assert incremental.current(spark, str(tmp_path / "other")).columns == ["src", "dst", "weight"]
