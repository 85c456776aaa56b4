import random

import xxhash

from weftline.llm import simhash
from weftline.llm.components import connected_components
from weftline.llm.scratch import Scratch
from weftline.llm.simhash import drop_near_duplicates, fingerprint, link_fingerprints, masks, simhash_digest


def slow_fingerprint(text):
    words = "".join(c.lower() if c.isascii() else c for c in (text or "")).encode().split()
    if not words:
        return 0
    k = min(3, len(words))
    h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + k]), 42) for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprint():
    for t in ("a", "A b", "one two three FOUR é É", None, " \n", "x y z " * 50):
        assert fingerprint(t) == slow_fingerprint(t)


def test_masks_cover_every_pair():
    for i in range(64):
        for j in range(i + 1):
            assert any(not (m >> i & 1 or m >> j & 1) for m in masks())


def components(edges, nodes):
    up = {n: n for n in nodes}

    def root(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in edges:
        up[max(root(a), root(b))] = min(root(a), root(b))
    return {n: root(n) for n in nodes}


def test_links_equal_brute_force(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(30)]
    prints = set(base)
    for b in base:
        x = b
        for _ in range(6):
            x ^= 1 << rng.randrange(64)
            if rng.random() < 0.5:
                x ^= 1 << rng.randrange(64)
            prints.add(x)
    prints = sorted(p - (1 << 64) if p >> 63 else p for p in prints)
    got = link_fingerprints(spark.createDataFrame([(p,) for p in prints], "fp long"), Scratch(spark, "t")).collect()
    near = [(a, b) for i, a in enumerate(prints) for b in prints[:i] if bin((a ^ b) & (1 << 64) - 1).count("1") <= 2]
    assert components([(r.u, r.v) for r in got], prints) == components(near, prints)


ROWS = [(3, "one two three four five six", "x"), (1, "one two three four five six", None), (2, None, "y"), (5, "", "z"), (None, "one two three four five six", "w"), (9, "quite another text that has other words in it", "v"), (9, "quite another text that has other words in it", "v")]


def test_digest_and_drop(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, fp string")
    got = {r.doc_id: r.component_id for r in simhash_digest(df).collect()}
    assert got == {3: 1, 1: 1, None: 1, 2: 2, 5: 2, 9: 9}
    assert sorted((r.doc_id, r.fp) for r in drop_near_duplicates(df.withColumnRenamed("fp", "first").withColumnRenamed("first", "fp")).collect()) == [(1, None), (2, "y"), (9, "v")]
    assert simhash_digest(df.limit(0)).count() == 0


def test_components_at_once_equal_rounds_and_brute_force(spark):
    rng = random.Random(8)
    ids = sorted({rng.getrandbits(64) - (1 << 63) for _ in range(400)})
    chain = [(b, a) for a, b in zip(ids[300:], ids[301:])]
    links = [(rng.choice(ids[:300]), rng.choice(ids[:300])) for _ in range(170)] + chain + chain[:9] + [(ids[0], ids[0]), (ids[299], ids[299])]
    edges = spark.createDataFrame([*links, (None, ids[1]), (ids[2], None)], "u long, v long")
    want = sorted(components(links, {n for a, b in links if a != b for n in (a, b)}).items())
    distinct = len({(min(x), max(x)) for x in links if x[0] != x[1]})
    for at_once in (0, distinct - 1, distinct):
        scratch = Scratch(spark, "t")
        assert sorted(map(tuple, connected_components(edges, scratch, at_once).collect())) == want
        assert (scratch.count == 2) == (at_once == distinct)
    assert connected_components(edges.limit(0), Scratch(spark, "t"), 1).count() == 0


def test_few_links_are_no_rounds_of_written_tables(spark, monkeypatch):
    text = " ".join(f"w{k}" for k in range(3000))
    near = [text, *(text.replace(f" w{k} ", f" x{k} ") for k in range(40, 2900, 300))]
    df = spark.createDataFrame([*((10 + k, t) for k, t in enumerate(near)), *((r[0], r[1]) for r in ROWS)], "doc_id long, text string")

    def run():
        scratch = Scratch(spark, "t")
        found = simhash.near_duplicates(df.selectExpr("monotonically_increasing_id() AS _row", "doc_id", "text"), scratch=scratch)
        return sorted((r._row, r.fp, r.first.doc_id) for r in found.collect()), scratch.count

    got, written = run()
    assert len({x[1] for x in got}) > len({x[2] for x in got})
    assert written == 4  # fingerprints, distinct ones, links, components; a round adds two, each a file for every shuffle partition
    monkeypatch.setattr(simhash, "LINKS_AT_ONCE", 0)
    assert run()[0] == got
