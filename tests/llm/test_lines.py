import random

import numpy as np
import pyarrow as pa
import pytest

from weftline.llm import line_dedup
from weftline.llm.jaccard import similar_links
from weftline.llm.line_dedup import drop_repeated_lines, line_digest, shingle_hashes
from weftline.llm.runs import cuts, whole_runs

A = "the quick brown fox jumps over the lazy dog near the river bank every day of the long summer"
B = A.replace("lazy", "lezy")
C = "an entirely different line of text with no relation to what the others say at all"


def grams(line):
    return {line[i : i + 5] for i in range(max(1, len(line) - 4))}


def slow_removed(rows):
    """Line numbers to go of each row (doc_id, text) by comparing all pairs of lines; the place of a row breaks ties."""
    lines = [(d is None, d or 0, r, n, x.strip()) for r, (d, t) in enumerate(rows) for n, x in enumerate((t or "").split("\n")) if x.strip()]
    sets, first = [grams(x[4]) for x in lines], list(range(len(lines)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if first[i] != first[j] and 5 * len(a & b) >= 4 * len(a | b):
                low, high = sorted((first[i], first[j]), key=lambda k: lines[k])
                first = [low if f == high else f for f in first]
    best = {}
    for k, f in enumerate(first):
        best[f] = min(best.get(f, lines[k]), lines[k])
    gone = {i: [] for i in range(len(rows))}
    for k, f in enumerate(first):
        if best[f] != lines[k]:
            gone[lines[k][2]].append(lines[k][3])
    return sorted(((d, sorted(gone[i])) for i, (d, _) in enumerate(rows)), key=repr)


def near_copies(seed, bases=30, copies=12):
    """Rows of lines with copies in which up to a seventh of the characters change: similarity from 0.3 to 1."""
    rng = random.Random(seed)
    lines = []
    for _ in range(bases):
        base = "".join(rng.choices("abcdefghijklmnop    ", k=rng.choice([3, 12, 60, 200, 700]))).strip() or "x"
        for _ in range(rng.randrange(copies)):
            other = list(base)
            for _ in range(rng.randrange(1 + len(base) // 30)):
                other[rng.randrange(len(other))] = "Z"
            lines.append("".join(other).strip())
    rng.shuffle(lines)
    rows = [(i if i % 11 else None, "\n".join([*lines[7 * i : 7 * i + 7], *rng.choices(["", " "], k=i % 2)])) for i in range(len(lines) // 7)]
    return [*rows, (3, None), (4, ""), rows[2]]


def test_similarity_is_as_meant():
    assert len(grams(A) & grams(B)) / len(grams(A) | grams(B)) >= 0.8 > len(grams(A) & grams(C)) / len(grams(A) | grams(C))
    for lines in ([A, "abc", "x", B], ["é\u0000🙂ab", "aaaaaaaaa"]):
        h, sizes = shingle_hashes(lines)
        assert sizes.tolist() == [max(1, len(x) - 4) for x in lines]
        at = np.cumsum(sizes) - sizes
        assert [len(set(h[a : a + n].tolist())) for a, n in zip(at, sizes, strict=True)] == [len(grams(x)) for x in lines]


@pytest.mark.parametrize("seed", [1, 2])
def test_links_of_sets(seed):
    rng = random.Random(seed)
    for n in [2, 3, 40]:
        sets = [set(rng.sample(range(12), rng.randrange(1, 13))) for _ in range(n)]
        flat, owner = [x for s in sets for x in [*s, min(s)]], np.repeat(np.arange(n), [len(s) + 1 for s in sets])
        for side in (None, np.array([i % 2 for i in range(n)])):
            u, v = similar_links(np.array(flat, np.uint64), owner, n, (4, 5), side)
            like = lambda i, j: 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) and (side is None or side[i] != side[j])  # noqa: B023, E731
            assert all(like(i, j) for i, j in zip(u, v, strict=True))
            named, slow = list(range(n)), list(range(n))
            for pairs, names in ((zip(u.tolist(), v.tolist(), strict=True), named), (((i, j) for i in range(n) for j in range(i) if like(i, j)), slow)):
                for i, j in pairs:
                    a, b = names[i], names[j]
                    names[:] = [min(a, b) if x in (a, b) else x for x in names]
            assert named == slow


def test_runs_over_batches():
    keys = np.repeat(np.arange(40), np.random.default_rng(1).integers(0, 9, 40))
    other = np.arange(len(keys))
    for size in (1, 3, 7, 1000):
        batches = [pa.RecordBatch.from_arrays([pa.array(keys[i : i + size]), pa.array(other[i : i + size])], ["k", "v"]) for i in range(0, len(keys), size)]
        parts = list(whole_runs([pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 2, ["k", "v"]), *batches], 1))
        assert np.concatenate([p[1] for p in parts]).tolist() == other.tolist()
        assert all(a[0][-1] != b[0][0] for a, b in zip(parts, parts[1:], strict=False))
    assert list(whole_runs([], 1)) == [] and cuts([keys])[-1] == len(keys)


@pytest.mark.parametrize("block", [2, 4_000])
def test_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(line_dedup, "CLUSTER_BLOCK", block)
    rows = near_copies(block)
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert sorted(((r.doc_id, r.removed) for r in line_digest(df).collect()), key=repr) == slow_removed(rows)


def test_recall_of_bands():
    """Share of pairs at similarity 0.8 to 0.83 that share a bucket and pass the sketches: 0.995 by the banding."""
    rng, lines = random.Random(5), []
    for _ in range(2_000):
        base = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=300))
        other = list(base)
        for i in rng.sample(range(20, 280, 20), 6):
            other[i] = "#"
        lines += [base, "".join(other)]
    both = [len(grams(a) & grams(b)) / len(grams(a) | grams(b)) for a, b in zip(lines[::2], lines[1::2], strict=True)]
    near = np.array([0.8 <= x < 0.83 for x in both])
    sig = line_dedup.signatures(lines)
    keys, sk = line_dedup.band_keys(sig), line_dedup.sketches(sig)
    found = (keys[::2] == keys[1::2]).any(axis=1) & (line_dedup.apart(sk[::2], sk[1::2]) <= line_dedup.SKETCH_APART)
    assert near.sum() > 1_000 and found[near].mean() >= 0.99


def test_keeps_first_of_each_class(spark):
    rows = [(2, f"{A}\n\n{C}", "k"), (1, f"x\n {B} ", "l"), (3, None, "m"), (4, "", "n"), (5, f"{C}\n{C}\nshort", None), (5, f"{C}\n{C}\nshort", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component string")
    got = sorted((r.doc_id, r.removed) for r in line_digest(df).collect())
    assert got[:4] == [(1, []), (2, [0]), (3, []), (4, [])]
    assert got[4:] == [(5, [0, 1]), (5, [0, 1, 2])]
    left = sorted((r.doc_id, r.text, r.component) for r in drop_repeated_lines(df).filter("doc_id < 5").collect())
    assert left == [(1, f"x\n {B} ", "l"), (2, f"\n{C}", "k"), (3, None, "m"), (4, "", "n")]
    assert line_digest(df.limit(0)).count() == 0


def test_one_very_long_line(spark):
    rng = random.Random(3)
    long = "".join(rng.choices("abcdefgh ", k=1_000_000)).strip()
    df = spark.createDataFrame([(1, long), (2, long[:-1] + "#"), (3, "y\n" * 20_000)], "doc_id long, text string")
    assert {r.doc_id: (r.n_lines, r.n_removed) for r in line_digest(df).collect()} == {1: (1, 0), 2: (1, 1), 3: (20_001, 19_999)}
