"""Large candidate clusters of lines: dealt by size, verified block against block without loss and without comparing all with all."""

import random
import time

import numpy as np
import pytest

from weftline.llm import jaccard, line_dedup
from weftline.llm.jaccard import similar_links
from weftline.llm.scratch import Scratch


def test_grades_part_no_similar_sizes():
    for some in np.array_split(np.arange(1, 200_001), 20):
        assert (line_dedup.grades(some * 5 // 4) - line_dedup.grades(some) <= 1).all()


def test_blocks_of_unlike_sizes_do_not_meet(spark, monkeypatch):
    """Each pair of rows of like size meets once; rows of unlike size never do, and components without grades are one block."""
    monkeypatch.setattr(line_dedup, "CLUSTER_BLOCK", 5)
    rng = random.Random(3)
    rows = [(c, 1000 * c + k, rng.choice([0, 1, 2, 3, 7]) if c < 3 else None) for c in range(5) for k in range(40)]
    lines = spark.createDataFrame(rows, "component long, lid long, _g int")
    met: dict[tuple, list] = {}
    for r in line_dedup.graded_pairs(lines, Scratch(spark, "test")).collect():
        met.setdefault((r.component, r._i, r._j), []).append((r.lid, r._b))
    pairs = [(c, *sorted((x, y))) for (c, i, j), some in met.items() for n, (x, b) in enumerate(some) for y, d in some[:n] if i == j or b != d]
    like = [(c, x, y) for c, x, g in rows for d, y, h in rows if c == d and x < y and (g is None or abs(g - h) <= 1)]
    assert sorted(pairs) == sorted(like)


@pytest.mark.parametrize("alike", [False, True])
def test_hashes_that_differ_in_their_last_bits_only(alike):
    """Sets whose shingles agree but for their last bits are not similar."""
    sets = [np.arange(50, dtype=np.uint64) * np.uint64(1 << 20) + np.uint64(0 if alike else i) for i in range(12)]
    u, _ = similar_links(np.concatenate(sets), np.repeat(np.arange(12), 50), 12, (4, 5))
    assert len(u) == (11 if alike else 0)


def test_sets_of_unlike_size_are_not_held_against_each_other(monkeypatch):
    """Of 6,000 sets that share a core, many a class of its own: time of two blocks against each other."""
    rng, n = np.random.default_rng(4), 6_000
    core = np.arange(160, dtype=np.uint64)
    sets = [np.concatenate([core, rng.integers(1 << 40, 1 << 60, 140 if i % 2 else 400).astype(np.uint64)]) for i in range(n)]
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    looked = []
    count = np.bitwise_count
    monkeypatch.setattr(jaccard.np, "bitwise_count", lambda x: looked.append(x.size) or count(x))
    began = time.process_time()
    u, _ = similar_links(np.concatenate(sets), owner, n, (4, 5), np.arange(n) // (n // 2))
    took = time.process_time() - began
    assert not len(u)
    assert sum(looked) < 5 * n * n // 2, took  # words of parities; whole ones of all pairs are 16 * n * n // 2
