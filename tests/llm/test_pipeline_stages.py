"""Stages of the pipeline against brute-force versions on a small fixture; near duplicates: test_near_documents."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from test_mixing_packing import slow_targets
from tokenizers import Tokenizer

import corpus_pipeline

STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def rows():
    """Documents of up to six lines, of which many are near copies (one to four characters changed) of others."""
    rng = random.Random(9)
    pool = [" ".join("".join(rng.choices("abcdefghij", k=rng.randrange(2, 9))) for _ in range(rng.randrange(3, 16))) for _ in range(60)]
    out = []
    for i in range(80):
        lines = []
        for _ in range(rng.randrange(7)):
            line = list(rng.choice(pool))
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                line[rng.randrange(len(line))] = "z"
            lines.append(rng.choice(["", "", " "]) + "".join(line))
        out.append((i, "\n".join(lines), rng.choice(["a", "b", "c", None])))
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_line_dedup(spark, rows, docs):
    grams = lambda s: {s[i : i + 5] for i in range(max(1, len(s) - 4))}
    lines = [(i, n, x.strip()) for i, text, _ in rows for n, x in enumerate(text.split("\n")) if x.strip()]
    sets, first = [grams(x) for *_, x in lines], list(range(len(lines)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if first[i] != first[j] and 5 * len(a & b) >= 4 * len(a | b):
                low, high = sorted((first[i], first[j]))
                first = [low if f == high else f for f in first]
    gone = {lines[k][:2] for k, f in enumerate(first) if f != k}
    assert gone
    want = {i: "\n".join(x for n, x in enumerate(text.split("\n")) if (i, n) not in gone) for i, text, _ in rows}
    assert {r.doc_id: r.text for r in STAGES["line dedup"](spark, docs, "").collect()} == want


def test_mixing(spark, rows, docs):
    size, source = {i: len(t.split()) for i, t, _ in rows}, {i: s for i, _, s in rows}
    have, got = Counter(), Counter()
    for i, n in size.items():
        have[source[i]] += n
    copies = Counter(r.doc_id for r in STAGES["source mixing"](spark, docs, "").collect())
    for i, n in copies.items():
        got[source[i]] += n * size[i]
    assert all(size[i] and n <= 2 for i, n in copies.items())
    assert all(abs(got[s] - t) <= max(size.values()) for s, t in slow_targets(have).items())


def test_packing(spark, rows, docs):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    long = [(i, text * (30 if i % 9 == 0 else 1), s) for i, text, s in rows]
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in STAGES["best-fit packing"](spark, spark.createDataFrame(long, docs.schema), "").collect():
        pieces[r.doc_id].append((r.start, r.length, r.ids_crc32))
        bins[r.sequence_id].append((r.offset, r.length))
    total = 0
    for i, text, _ in long:
        ids = np.array([*t.encode(text, add_special_tokens=False).ids, 2], "<u4")
        at, total = 0, total + len(ids)
        for start, length, crc in sorted(pieces[i]):
            assert start == at and crc == zlib.crc32(ids[at : at + length].tobytes())
            at += length
        assert at == len(ids)
    for some in bins.values():
        at = 0
        for offset, length in sorted(some):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(bins) <= 1.1 * total / 1024 + 1
