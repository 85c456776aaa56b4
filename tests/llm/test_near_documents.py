import random

import numpy as np

import corpus_pipeline
from weftline.llm.jaccard import similar_links


def windows(text):
    w = (text or "").lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def similar(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def brute(texts):
    """Least number of each component of the exact similarity graph."""
    sets, first = [windows(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if first[i] != first[j] and similar(sets[i], sets[j]):
                a, b = sorted((first[i], first[j]))
                first = [a if f == b else f for f in first]
    return sorted(set(first))


def corpus(seed=4):
    """Texts of 3 to 400 words, each with copies that have one to six words changed; similarity from below to above 0.8."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(5000)}"
    texts = ["", None, "  ", "one two", "One  two", "one three"]
    for _ in range(60):
        base = [word() for _ in range(rng.choice([3, 5, 30, 100, 300, 400]))]
        texts.append(" ".join(base))
        for _ in range(rng.randrange(6)):
            other = list(base)
            for _ in range(rng.randrange(7)):
                other[rng.randrange(len(other))] = word()
            texts.append(" ".join(other))
    return texts


def test_stage_equals_brute_force(spark):
    texts = corpus()
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars int").repartition(3)
    stage = dict(corpus_pipeline.STAGES)["near-duplicate removal"]
    assert sorted(r.doc_id for r in stage(spark, docs, "").collect()) == brute(texts)


def test_blocks_of_a_large_cluster(spark, monkeypatch):
    from weftline.llm import near_documents

    monkeypatch.setattr(near_documents, "CLUSTER_BLOCK", 100)
    texts = corpus(5)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in near_documents.drop_near_duplicates(docs).collect()) == brute(texts)


def test_limit_is_exact():
    def links(*sizes):
        u, v = similar_links(np.concatenate([np.arange(n, dtype=np.uint64) for n in sizes]), np.repeat(np.arange(len(sizes)), sizes), len(sizes), (4, 5))
        return u.tolist(), v.tolist()

    assert links(9, 8, 7) == ([0, 1], [1, 2])
    assert links(9, 7) == ([], [])
    assert links(10, 8) == ([0], [1])
