"""The exact distribution of the signed-rank sum, and when it is used."""

import itertools
import math

from learngraph.functions import statistics as S


def test_counts_equal_enumeration():
    for n in (0, 1, 2, 5, 9):
        sums = [sum(r for r, up in zip(range(1, n + 1), signs, strict=True) if up) for signs in itertools.product([0, 1], repeat=n)]
        assert S.signed_rank_counts(n) == [sums.count(k) for k in range(n * (n + 1) // 2 + 1)]


def ratings(spark, gaps):
    return spark.createDataFrame([(f"{name}{i}", m, float(x)) for name, ds in gaps.items() for i, d in enumerate(ds) for m, x in ((f"{name}1", d), (f"{name}2", 0))], "item string, model string, score double")


def test_exact_for_few_without_ties_and_normal_else(spark):
    gaps = {"a": [1, 2, 3, 4, -5], "b": [1, -2, 3], "tie": [1, -1, 2, 3], "zero": [0, 1, 2, 3], "many": [(-1) ** k * k for k in range(1, 61)], "none": [0, 0], "half": [-1, 2, -3, 4, -5, 6, 7.5, -8.25]}
    found = {r["m1"][:-1]: r for r in S.wilcoxon(ratings(spark, gaps)).collect()}

    def enumerated(ds):
        ranks = [sum(abs(x) <= abs(d) for x in ds) for d in ds]
        w = min(sum(r for r, d in zip(ranks, ds, strict=True) if d > 0), sum(r for r, d in zip(ranks, ds, strict=True) if d < 0))
        n = len(ds)
        below = sum(sum(r for r, up in zip(range(1, n + 1), s, strict=True) if up) <= w for s in itertools.product([0, 1], repeat=n))
        return w, min(1.0, 2 * below / 2**n)

    for name in ("a", "b", "half"):
        w, p = enumerated(gaps[name])
        assert found[name]["w"] == w and abs(found[name]["p"] - p) < 1e-12
    assert found["a"]["p"] == 0.625 and "none" not in found

    def normal(n, w, ties=0.0):
        return math.erfc(abs(w - n * (n + 1) / 4) / math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48) / math.sqrt(2))

    assert abs(found["zero"]["p"] - normal(3, 0)) < 1e-12 and abs(found["tie"]["p"] - normal(4, 1.5, 6)) < 1e-12
    assert abs(found["many"]["p"] - normal(60, found["many"]["w"])) < 1e-12
