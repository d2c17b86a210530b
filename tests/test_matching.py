"""Greedy matching along long chains, in one range and in several."""

import pytest

from learngraph.operators import vectors


@pytest.mark.parametrize("size", [1 << 21, 25])
def test_matching_of_a_long_chain(spark, monkeypatch, size):
    tables = []
    kept = vectors.written
    monkeypatch.setattr(vectors, "written", lambda df, name: tables.append(name) or kept(df, name))
    monkeypatch.setattr(vectors, "MATCHED", size)
    pairs = [(k, k + 1) for k in range(60)] + [(k, k + 7) for k in range(50)]
    gone, want = set(), []
    for a, b in sorted(pairs):
        if a not in gone and b not in gone:
            gone |= {a, b}
            want.append((a, b))
    found = vectors.greedy_matching(spark.createDataFrame([*pairs, pairs[0]], "a long, b long"))
    assert sorted(tuple(r) for r in found.collect()) == want and len(tables) <= 2
