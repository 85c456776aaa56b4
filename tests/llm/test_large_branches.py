"""What only large inputs enter, with the bounds lowered."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import SMALL
from pyspark.sql import functions as F
from test_mixing_packing import slow_targets

from weftline.llm import ann, mixing, packing, simhash
from weftline.llm.bpe import vocabulary
from weftline.llm.scratch import Scratch
from weftline.llm.token_store import read_digest, store_documents, write_token_files


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def test_mixing_tree_and_splits(spark, docs, monkeypatch, tmp_path):
    """A tree of several levels keeps the targets; other splits of the same table give the same mix."""
    monkeypatch.setattr(mixing, "LEAF_ROWS", 10)
    monkeypatch.setattr(mixing, "FAN_IN", 3)
    rows = docs.select("doc_id", "text", "source").collect()
    got = []
    for parts in (2, 7):
        path = f"{tmp_path}/{parts}"
        docs.repartition(parts, F.rand(parts)).write.parquet(path)
        got.append({r.doc_id: (r["size"], r.target, r.taken, r.source) for r in mixing.mix_digest(spark.read.parquet(path)).collect()})
    assert got[0] == got[1] and len(got[0]) == len(rows)
    sizes, taken = Counter(), Counter()
    for size, _, words, source in got[0].values():
        sizes[source] += size
        taken[source] += words
    most = max(size for size, *_ in got[0].values())
    assert all(abs(taken[s] - t) <= most for s, t in slow_targets(sizes).items())


def test_mixing_of_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(mixing, "LEAF_ROWS", 10)
    df = spark.createDataFrame([(1, "a b c", "s")] * 100 + [(2, "d e", None)] * 30 + [(3, "x", "t")], "doc_id long, text string, source string")
    taken = Counter()
    for r in mixing.mix_digest(df).collect():
        assert r.taken <= 2 * r["size"]
        taken[r.source] += r.taken
    want = slow_targets({"s": 300, "t": 1, None: 60})
    assert all(abs(taken[s] - t) <= 3 for s, t in want.items())


def test_packing_tree(spark, docs, monkeypatch):
    want = packing.pack_documents(docs).select("sequence_id").distinct().count()
    monkeypatch.setattr(packing, "LEAF_ITEMS", 60)
    monkeypatch.setattr(packing, "FAN_IN", 3)
    bins, total = defaultdict(list), 0
    for r in packing.pack_documents(docs).collect():
        bins[r.sequence_id].append((r.offset, r.length))
        total += r.length
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert -(-total // 1024) <= len(bins) <= 1.04 * want + 1


@pytest.mark.parametrize("bound", [2, 8192])
def test_forest_by_flips(monkeypatch, bound):
    monkeypatch.setattr(simhash, "LARGE_BUCKET", bound)
    rng = random.Random(3)
    base, members = rng.getrandbits(64), set()
    mask = simhash.masks()[0]
    free = [i for i in range(64) if not mask >> i & 1]
    for _ in range(300):
        x = base
        for i in rng.sample(free, rng.randrange(4)):
            x ^= 1 << i
        members.add(x)
    members = sorted(members)
    u, v = simhash._forest(np.array(members, np.uint64), ~mask & (1 << 64) - 1)
    name = {m: m for m in members}
    for a, b in zip(map(int, u), map(int, v), strict=True):
        assert bin(a ^ b).count("1") <= 2
        a, b = name[a], name[b]
        name = {k: min(a, b) if n in (a, b) else n for k, n in name.items()}
    slow = {m: m for m in members}
    for i, a in enumerate(members):
        for b in members[:i]:
            if bin(a ^ b).count("1") <= 2 and slow[a] != slow[b]:
                x, y = slow[a], slow[b]
                slow = {k: min(x, y) if n in (x, y) else n for k, n in slow.items()}
    assert name == slow


def test_buckets_dealt_again(spark, monkeypatch):
    rng = random.Random(8)
    bases = [rng.getrandbits(64) for _ in range(6)]
    prints = sorted({b ^ sum(1 << i for i in rng.sample(range(64), rng.randrange(3))) for b in bases for _ in range(60)})
    df = spark.createDataFrame([(simhash._signed(p),) for p in prints], "fp long")

    def components():
        links = simhash.link_fingerprints(df, Scratch(spark, "test")).collect()
        name = {p: p for p in prints}
        for r in links:
            a, b = name[r.u % (1 << 64)], name[r.v % (1 << 64)]
            name = {k: min(a, b) if n in (a, b) else n for k, n in name.items()}
        return name

    want = components()
    monkeypatch.setattr(simhash, "LARGE_BUCKET", 3)
    assert components() == want and len(set(want.values())) < len(prints)


def test_neighbours_by_groups_and_parts(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(8, 8))[rng.integers(0, 8, 600)] + 0.2 * rng.normal(size=(600, 8))
    x[::3] = x[0] + 0.01 * rng.normal(size=(200, 8))
    df = spark.createDataFrame([(i, v.tolist(), i % 2 == 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, vec string")
    rows = lambda: sorted(map(tuple, ann.nearest_neighbours(df, F.col("vec_id") % 3 == 0).collect()))
    want = rows()
    monkeypatch.setattr(ann, "GROUP_ROWS", 50)
    monkeypatch.setattr(ann, "GROUP_QUERIES", 7)
    assert rows() == want and len(want) == 1000


def test_many_token_files(spark, docs):
    import public_tokenizers

    want = sorted(map(tuple, store_documents(docs).collect()))
    scratch = Scratch(spark, "test")
    manifest = write_token_files(docs, scratch.new_path("dac"), public_tokenizers.path("word_bpe_49k.json"), file_ids=2_000, scratch=scratch)
    assert manifest.count() > 20
    assert sorted(map(tuple, read_digest(manifest).collect())) == want
    assert vocabulary(public_tokenizers.path("word_bpe_49k.json"))
