import itertools
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.operators import embeddings
from weftline.operators.embeddings import FAR, n_similarity, transport, word_movers_distance
from weftline.sinks import write_json


@pytest.mark.parametrize("seed", range(6))
def test_transport_equals_assignment(seed):
    """Whole numbers of equal weight on both sides: the best of all assignments."""
    rng = np.random.default_rng(seed)
    n, m = rng.integers(1, 4, 2)
    left = rng.multinomial(6, np.ones(n) / n)
    right = rng.multinomial(6, np.ones(m) / m)
    cost = rng.random((n, m))
    rows, cols = np.repeat(np.arange(n), left), np.repeat(np.arange(m), right)
    best = min(sum(cost[rows[i], cols[j]] for i, j in enumerate(p)) for p in itertools.permutations(range(6)))
    assert abs(transport(left, right, cost) - best) < 1e-9


def test_pairs_of_word_lists(spark):
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [1.0, 1.0])], "word string, vector array<double>")
    pairs = spark.createDataFrame([(1, ["a", "a", "x"], ["b"]), (2, ["a", "b"], ["c"]), (3, ["x"], ["a"]), (4, None, ["a"]), (5, [], []), (6, ["a"], ["a"])], "pair_id long, a array<string>, b array<string>")
    near = {r.pair_id: r.similarity for r in n_similarity(pairs, vectors).collect()}
    far = {r.pair_id: r.distance for r in word_movers_distance(pairs, vectors).collect()}
    assert np.allclose([near[i] for i in range(1, 7)], [0, 1, 0, 0, 0, 1])
    assert np.allclose([far[i] for i in range(1, 7)], [2**0.5, 1, FAR, FAR, FAR, 0])
    assert n_similarity(pairs.limit(0), vectors).count() == word_movers_distance(pairs.limit(0), vectors).count() == 0


@pytest.mark.parametrize("most", [0, 1 << 20])
def test_word_lists_in_small_batches(spark, monkeypatch, most):
    """Pairs over many batches, words that repeat, unknown words and null components; vectors broadcast or joined."""
    monkeypatch.setattr(embeddings, "VECTOR_BYTES", most)
    rng = np.random.default_rng(7)
    known = {f"w{i}": [float(x) for x in rng.normal(size=3)] for i in range(12)}
    known["w3"][1] = None
    vectors = spark.createDataFrame(list(known.items()), "word string, vector array<double>")
    draw = lambda: [f"w{i}" for i in rng.integers(0, 16, rng.integers(0, 9))]
    rows = [(i, draw(), draw()) for i in range(60)]
    pairs = spark.createDataFrame(rows, "pair_id long, a array<string>, b array<string>").repartition(3, "pair_id")
    near = n_similarity(pairs, vectors)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 4)
    try:
        got = [tuple(r) for r in near.collect()]
        far = {r.pair_id: r.distance for r in word_movers_distance(pairs, vectors.filter("word <> 'w3'")).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(i for i, _ in got) == sorted(far) == list(range(60))

    def mean(side):
        at = np.array([known[w] for w in side if w in known], float)
        return np.nanmean(at, axis=0) if len(at) and not np.isnan(at).all(axis=0).any() else None

    for i, x in got:
        a, b = mean(rows[i][1]), mean(rows[i][2])
        if a is not None and b is not None:
            assert abs(x - a @ b / np.linalg.norm(a) / np.linalg.norm(b)) < 1e-9
    for i, a, b in rows:
        a, b = ([w for w in s if w in known and w != "w3"] for s in (a, b))
        want = FAR
        if a and b:
            (p, n), (q, m) = (np.unique(s, return_counts=True) for s in (a, b))
            want = transport(n / n.sum(), m / m.sum(), np.array([[np.linalg.norm(np.subtract(known[u], known[v])) for v in q] for u in p]))
        assert abs(far[i] - want) < 1e-9


@pytest.mark.parametrize("measure", [n_similarity, word_movers_distance])
def test_vectors_of_few_words_do_not_move(spark, measure):
    """Neither vectors nor words are dealt anew once the pairs are."""
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "word string, vector array<double>")
    pairs = spark.createDataFrame([(1, ["a"], ["b"]), (2, ["b"], ["b"])], "pair_id long, a array<string>, b array<string>")
    plan = measure(pairs, vectors)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "BroadcastHashJoin" in plan


def test_stop_words_and_lemmas(spark):
    df = spark.createDataFrame([(["The", "cats", "ran", "the"],), ([],), (None,)], "w array<string>")
    assert [r[0] for r in df.select(T.without(F.col("w"), ["the", "The"])).collect()] == [["cats", "ran"], [], None]
    said = T.lemmas(F.col("w"), lambda words: [w.rstrip("s").lower() for w in words])
    assert [r[0] for r in df.select(said).collect()] == [["the", "cat", "ran", "the"], [], None]
    assert [r[0] for r in df.select(T.lemmas(F.col("w"))).collect()] == [["The", "cats", "ran", "the"], [], None]


def test_json_dump(spark, tmp_path):
    write_json(spark.createDataFrame([("a", 1.5), ("b", None)], "word string, idf double"), f"{tmp_path}/idf")
    rows = [json.loads(x) for p in sorted((tmp_path / "idf").glob("part-*")) for x in p.read_text().splitlines()]
    assert sorted(rows, key=str) == [{"word": "a", "idf": 1.5}, {"word": "b"}]
