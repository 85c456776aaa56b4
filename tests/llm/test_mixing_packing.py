import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from weftline.llm.mixing import mix_digest, mix_documents, pivotal
from weftline.llm.packing import best_fit, pack_documents


def slow_targets(sizes):
    order = sorted((k for k in sizes if k is not None), key=lambda s: s) + [k for k in sizes if k is None]
    w = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, free, out = 1.5 * sum(sizes.values()), set(order), {}
    while free:
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * sizes[s]}
        if not over:
            return out | share
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        free -= over
    return out


def test_pivotal_keeps_mass():
    rng = np.random.default_rng(0)
    size, p = rng.integers(1, 50, 500), rng.random(500)
    q = pivotal(size, p, rng)
    assert abs((size * p).sum() - (size * q).sum()) < 1e-6 and ((q > 0) & (q < 1)).sum() <= 1


def test_mix(spark):
    rows = [(i, "w " * (i % 40 + 1), ["a", "b", "c", None][i % 4 if i < 300 else 0]) for i in range(600)] + [(601, None, "a"), (602, "", "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mix_digest(df).collect()
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in got:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert r.taken % max(1, r.size) == 0 and r.taken <= 2 * r.size
    want = slow_targets(sizes)
    for s in sizes:
        assert abs(want[s] - target[s]) < 1e-6 * max(1, want[s]) and abs(taken[s] - want[s]) <= 40
    assert sorted((r.doc_id, r.taken) for r in mix_digest(df).collect()) == sorted((r.doc_id, r.taken) for r in got)
    assert mix_documents(df).count() == sum(r.copies for r in got)
    assert mix_digest(df.limit(0)).count() == 0


def test_best_fit_never_overflows():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 100, 1000)
    where, offset, fills = best_fit(sizes, 100)
    for b in range(len(fills)):
        at = np.flatnonzero(where == b)
        at = at[np.argsort(offset[at])]
        assert fills[b] <= 100 and (np.cumsum(sizes[at]) - sizes[at] == offset[at]).all()
    assert len(fills) <= 1.05 * sizes.sum() / 100 + 1


def test_pieces(spark):
    texts = {1: "Hello world, it's <|endoftext|> fine", 2: None, 3: "", 4: "a b c 123 é ü 漢字\n\n  x " * 400, 5: "don't  stop\t x"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    by_seq, by_doc = defaultdict(list), defaultdict(list)
    for r in pack_documents(df).collect():
        by_seq[r.sequence_id].append((r.offset, r.length))
        by_doc[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
    for doc, text in texts.items():
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        first = (len(ids) - 1) % 1024 + 1
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        assert sorted(by_doc[doc]) == [(i, a, b - a, zlib.crc32(ids[a:b].tobytes())) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    for parts in by_seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert pack_documents(df.limit(0)).count() == 0
