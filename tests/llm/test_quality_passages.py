import random
import re

import pytest
import xxhash

from weftline.llm.passage_dedup import drop_repeated_passages, passage_digest
from weftline.llm.quality import keep_good, quality_digest


def slow(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    wins = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    hit = {j for i, x in enumerate(wins) if wins.count(x) > 1 for j in range(i, i + 5)}
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit))


GOOD = " ".join(f"word{i} and then" for i in range(40))
CASES = [None, "", "  \n ", GOOD, "a b c d e " * 6, "x\nx\n y\n\nx", "🙂 été | # <b> z", "a b c d e f a b c d e", "one two\x0bthree\x0cfour\rfive"]


def test_features(spark):
    df = spark.createDataFrame(list(enumerate(CASES)), "doc_id long, text string")
    for r in quality_digest(df).collect():
        want = slow(CASES[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, r
        failed = want[0] < 10 or 100 * want[4] > 20 * want[0]
        assert r.base_failed == failed and not (failed and r.kept)
    assert quality_digest(df.limit(0)).count() == 0


def test_keeps_columns_that_clash(spark):
    df = spark.createDataFrame([(1, GOOD, 5, "p"), (2, "", 6, "q"), (2, GOOD, None, None)], "doc_id long, text string, n_words int, _w string")
    got = keep_good(df)
    assert got.columns == df.columns and sorted(map(tuple, got.collect()), key=str) == sorted([(1, GOOD, 5, "p"), (2, GOOD, None, None)], key=str)


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(n))


def test_repeated_passages(spark):
    rng = random.Random(4)
    shared = prose(rng, 60)
    texts = [f"{prose(rng, 30)} {shared} {prose(rng, 25)}", f"{prose(rng, 7)} {shared}", prose(rng, 100), None, "", f"{shared} {prose(rng, 3)}"]
    df = spark.createDataFrame([(i + 10, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {}
    for r in passage_digest(df).collect():
        got.setdefault(r.doc_id, []).append((r.start, r.n_words, r.removed))
    assert set(got) == {10, 11, 15}
    assert not any(x[2] for x in got[10]) and all(x[2] for d in (11, 15) for x in got[d])
    assert all(sum(x[1] for x in v) >= 40 for v in got.values()) and all(x[0] >= 28 for x in got[10])
    left = {r.doc_id: r.text for r in drop_repeated_passages(df).collect()}
    assert left[10] == texts[0] and left[12] == texts[2] and left[13] is None and len(left[11].split()) <= 30
    assert passage_digest(df.limit(0)).count() == 0


def slow_chunks(hashes):
    """(first word, words, contents) of each chunk: a chunk ends where three bits of the gear hash are low, or at 16 words."""
    out, start = [], 0
    for i in range(len(hashes)):
        gear = sum(hashes[i - k] << k for k in range(min(4, i + 1)))
        at_end = i + 1 == len(hashes)
        # The bound of 16 words counts from the last end that the hash set.
        if gear & 0b1110 < 0b0110 or at_end:
            a = start
            while i + 1 - a > 16:
                out.append((a, 16))
                a += 16
            out.append((a, i + 1 - a))
            start = i + 1
    return [(a, n, tuple(hashes[a : a + n])) for a, n in out]


def slow_spans(rows):
    """Spans by (row, start, words, removed) with plain dictionaries; rows are (doc_id, text), their place breaks ties."""
    order = {r: (d is None, d or 0, r) for r, (d, _) in enumerate(rows)}
    pairs, held = {}, {}
    for r, (_, t) in enumerate(rows):
        chunks = slow_chunks([xxhash.xxh64_intdigest(w) for w in (t or "").encode().split()])
        if len(chunks) == 1:
            pairs[r] = [(chunks[0][0], chunks[0][1], chunks[0][1], chunks[0][2])]
        else:
            pairs[r] = [(a[0], a[1], a[1] + b[1], (a[2], b[2])) for a, b in zip(chunks, chunks[1:], strict=False)]
        for *_, what in pairs[r]:
            held.setdefault(what, set()).add(r)
    out = []
    for r, some in pairs.items():
        runs, end = [], -1
        for a, own, n, what in some:
            if len(held[what]) > 1:
                if a >= end:
                    runs.append([])
                runs[-1].append((a, own, n, min(held[what], key=order.get) != r))
                end = a + n
        for run in runs:
            if max(a + n for a, _, n, _ in run) - run[0][0] >= 18:
                parts = []
                for k, (a, own, n, gone) in enumerate(run):
                    n = n if k + 1 == len(run) else own
                    if parts and parts[-1][2] == gone:
                        parts[-1][1] += n
                    else:
                        parts.append([a, n, gone])
                firm = []
                for a, n, gone in parts:
                    gone = gone and n >= 9
                    if firm and firm[-1][2] == gone:
                        firm[-1][1] += n
                    else:
                        firm.append([a, n, gone])
                out += [(rows[r][0], *x) for x in firm]
    return sorted(out, key=repr)


@pytest.mark.parametrize("repeats", [False, True])
def test_passages_equal_brute_force(spark, repeats):
    """Also with null and repeated doc_ids, repeated rows, a word said over and over, and a very long text."""
    rng = random.Random(11 + repeats)
    pool = [prose(rng, n) for n in (12, 17, 25, 40, 60, 120)]
    rows = [(i, " ".join(rng.choice([*pool, prose(rng, rng.randrange(1, 40))]) for _ in range(rng.randrange(1, 6)))) for i in range(60)]
    rows += [(100, "la " * 300), (101, "x " + "la " * 250), (102, prose(rng, 20_000) + " " + pool[4]), (103, "one"), (104, "one"), (105, ""), (106, None)]
    if repeats:
        rows += [(5, rows[5][1]), (5, rows[9][1]), (None, rows[3][1]), (None, rows[3][1])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, digest string").coalesce(1)
    got = sorted(((r.doc_id, r.start, r.n_words, r.removed) for r in passage_digest(df).collect()), key=repr)
    assert got == slow_spans(rows) and any(g[3] for g in got)


def test_share_of_passages_found(spark):
    """Words of windows that another document repeats and that lie in spans, by the windows' length."""
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    words = {r.doc_id: (r.text or "").encode().split() for r in df.collect()}
    spans = {}
    for r in passage_digest(df).collect():
        spans.setdefault(r.doc_id, set()).update(range(r.start, r.start + r.n_words))
    for n, least in ((50, 0.97), (25, 0.93), (18, 0.9)):
        seen, twice = {}, {}
        for d, w in words.items():
            for i in range(len(w) - n + 1):
                seen.setdefault(hash(tuple(w[i : i + n])), set()).add(d)
        for d, w in words.items():
            twice[d] = {j for i in range(len(w) - n + 1) if len(seen[hash(tuple(w[i : i + n]))]) > 1 for j in range(i, i + n)}
        found = sum(len(t & spans.get(d, set())) for d, t in twice.items())
        assert found / sum(map(len, twice.values())) >= least
