import random
import time

import numpy as np
import pytest

from weftline.llm import jaccard
from weftline.llm.jaccard import similar_links


def flat(sets):
    return np.array([x for s in sets for x in s], np.uint64), np.repeat(np.arange(len(sets)), [len(s) for s in sets])


def named(n, pairs):
    names = list(range(n))
    for i, j in pairs:
        a, b = names[i], names[j]
        if a != b:
            names = [min(a, b) if x in (a, b) else x for x in names]
    return names


@pytest.mark.parametrize("seed", range(4))
def test_large_groups_equal_brute_force(monkeypatch, seed):
    """Sets of 1 to 400 shingles, each with copies from below to above the limit; few cells at once, few bits and many."""
    monkeypatch.setattr(jaccard, "AT_ONCE", 500)
    monkeypatch.setattr(jaccard, "MOST_BITS", 64 if seed % 2 else 4096)
    rng = random.Random(seed)
    sets = []
    for _ in range(12):
        base = rng.sample(range(3_000), rng.choice([1, 2, 9, 100, 400]))
        for _ in range(12):
            other = set(base)
            for _ in range(rng.randrange(1 + len(base) // 6)):
                other.discard(rng.choice(base))
                other.add(rng.randrange(3_000, 9_000))
            sets.append(other or {0})
    rng.shuffle(sets)
    for side in (None, np.arange(len(sets)) % 2):
        like = lambda i, j: 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) and (side is None or side[i] != side[j])  # noqa: B023, E731
        u, v = similar_links(*flat(sets), len(sets), (4, 5), side)
        assert all(like(i, j) for i, j in zip(u, v, strict=True))
        slow = named(len(sets), [(i, j) for i in range(len(sets)) for j in range(i) if like(i, j)])
        assert named(len(sets), zip(u.tolist(), v.tolist(), strict=True)) == slow
        assert len(u) == len(sets) - len(set(slow))


def test_time_of_a_large_cluster():
    """Copies of one line (three in four within the limit) that all share most shingles: far below a second per thousand."""
    rng, n = np.random.default_rng(1), 5_000
    base = np.arange(500)
    sets = []
    for i in range(n):
        changed = rng.integers(10, 40) if i % 4 else rng.integers(150, 200)
        sets.append(np.concatenate([rng.permutation(base)[changed:], 1_000 + 1_000 * i + np.arange(changed)]))
    shingles, owner = np.concatenate(sets).astype(np.uint64), np.repeat(np.arange(n), 500)
    began = time.process_time()
    u, _ = similar_links(shingles, owner, n, (4, 5))
    assert time.process_time() - began < 10
    assert len(u) == n - n // 4 - 1
