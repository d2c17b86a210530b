"""The exact comparison inside blocks of near-duplicate groups against comparing all pairs."""

import numpy as np
import pytest

from learngraph.llm.near_duplicates import _forest


def plain(block, part, name, items, percent):
    """The component of each row, by links across roots of all pairs that are open."""
    root = {k: k for k in range(len(items))}
    pairs = [(i, j) for i in range(len(items)) for j in range(i) if block[i] == block[j]]
    several = {b: len(set(part[block == b].tolist())) > 1 for b in set(block.tolist())}
    for i, j in pairs:
        shared = len(set(items[i].tolist()) & set(items[j].tolist()))
        meets = name[i] != name[j] and (not several[block[i]] or part[i] != part[j]) and shared * (100 + percent) >= percent * (len(items[i]) + len(items[j]))
        if meets or name[i] == name[j]:
            x, y = root[i], root[j]
            root = {k: x if v == y else v for k, v in root.items()}
    return root


def same(a: dict, b: dict) -> bool:
    return len(set(a.values())) == len(set(b.values())) == len({(a[k], b[k]) for k in a})


@pytest.mark.parametrize("size", [3, 40, 3000])
@pytest.mark.parametrize("percent", [80, 90])
def test_forest_equals_all_pairs(size, percent):
    rng = np.random.default_rng(size + percent)
    for parts in (1, 3):
        block = np.sort(rng.integers(0, 3, 60)) * 1_000_003 - 2**40
        part = rng.integers(0, parts, 60)
        name = rng.integers(0, 40, 60)
        wells = [rng.integers(0, 2**63, size, dtype=np.uint64) for _ in range(4)]
        items = []
        for _ in range(60):
            own = wells[rng.integers(4)]
            keep = own[rng.random(size) < rng.choice([0.5, 0.85, 0.93, 1.0])]
            items.append(np.unique(np.concatenate([keep, rng.integers(0, 2**63, 1 + size // 20, dtype=np.uint64)])))
        a, b = _forest(block, part, name, items, percent)
        want = plain(block, part, name, items, percent)
        root = {k: k for k in range(60)}
        links = list(zip(a, b, strict=True)) + [(i, j) for i in range(60) for j in range(i) if block[i] == block[j] and name[i] == name[j]]
        for i, j in links:
            x, y = root[i], root[j]
            root = {k: x if v == y else v for k, v in root.items()}
        assert same(root, want)
        roots = len({(p, q) for p, q in zip(block.tolist(), name.tolist(), strict=True)})
        assert len(a) == roots - len(set(want.values()))  # a forest: each link joins two components


def test_forest_of_rows_without_pairs():
    one = np.zeros(1, np.int64)
    assert _forest(one, one, one, [np.array([5], np.uint64)], 80) == ([], [])
