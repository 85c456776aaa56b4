"""The fingerprint step of the near-duplicate stage against brute force."""

import random

import numpy as np

import corpus_pipeline
from weftline.llm import near_documents, simhash
from weftline.llm.scratch import Scratch, ship


def texts():
    """Texts of 1,000 words with copies that have one or two words changed, some texts of few words and of none."""
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(5000)}"
    out = ["", None, "one two", "One  two", "one three"]
    for _ in range(25):
        base = [word() for _ in range(1_000)]
        out.append(" ".join(base))
        for _ in range(2):
            other = list(base)
            for _ in range(rng.randrange(1, 3)):
                other[rng.randrange(len(other))] = word()
            out.append(" ".join(other))
    return out


def print_of(text):
    return simhash.majority(near_documents.shingles(near_documents.words(text)))


def components(prints):
    first = list(range(len(prints)))
    for i, a in enumerate(prints):
        for j, b in enumerate(prints[:i]):
            if first[i] != first[j] and (a ^ b).bit_count() <= simhash.RADIUS:
                low, high = sorted((first[i], first[j]))
                first = [low if f == high else f for f in first]
    return first


def test_majority_is_the_fingerprint():
    h = np.array([1, 3, 7, 1 << 63], np.uint64)
    assert simhash.majority(h) == 1
    assert simhash.majority(h[:1]) == 1 and simhash.majority(h[3:]) == 1 << 63


def test_links_within_the_radius(spark):
    ship(spark)
    prints = [print_of(t) for t in texts() if (t or "").strip()]
    prints += prints[:4]
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    nodes = spark.createDataFrame([*enumerate(signed), (len(prints), None)], "lid long, fp long")
    first = list(range(len(prints)))
    for r in near_documents.fingerprint_links(nodes, Scratch(spark, "near")).collect():
        low, high = sorted((first[r.u], first[r.v]))
        first = [low if f == high else f for f in first]
    assert first == components(prints)


def test_stage_finds_copies_by_fingerprints_alone(spark, monkeypatch):
    def none(batches):
        for batch in batches:
            yield batch.slice(0, 0).select(["key", "lid"]).rename_columns(["u", "v"])

    monkeypatch.setattr(near_documents, "link_buckets", none)
    some = [t for t in texts() if (t or "").strip()]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(some)], "doc_id long, text string, lang string, source string, n_chars int").repartition(3)
    stage = dict(corpus_pipeline.STAGES)["near-duplicate removal"]
    prints = [print_of(t) for t in some]
    kept = sorted(r.doc_id for r in stage(spark, docs, "").collect())
    assert kept == sorted({*components(prints)})
    assert len(kept) < len(some) - 20
