import numpy as np
from pyspark.sql import functions as F

from weftline.llm.ann import nearest_neighbours


def brute(ids, x, queries, k):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for q in queries:
        s = unit @ unit[q]
        s[q] = -np.inf
        out[ids[q]] = [ids[i] for i in np.lexsort((ids, -s))[:k]]
    return out


def test_recall(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(20, 16))[rng.integers(0, 20, 1500)] + 0.3 * rng.normal(size=(1500, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got: dict = {}
    for r in nearest_neighbours(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    want = brute(np.arange(1500), x, range(0, 1500, 50), 5)
    assert set(got) == set(want)
    assert np.mean([len(set(got[q]) & set(want[q])) / 5 for q in want]) >= 0.9


def test_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (7, [-1.0, 0.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r.query_id, r["rank"], r.vec_id) for r in nearest_neighbours(df, F.col("vec_id") == 0).orderBy("rank").collect()]
    assert got == [(0, 1, 1), (0, 2, 2), (0, 3, 7)]
    assert nearest_neighbours(df.filter("vec_id = 3"), F.lit(True)).count() == 0


def recall(spark, x):
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got: dict = {}
    for r in nearest_neighbours(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    want = brute(np.arange(len(x)), x, range(0, len(x), 50), 5)
    assert set(got) == set(want)
    return np.mean([len(set(got[q]) & set(want[q])) / 5 for q in want])


def test_dense_groups(spark):
    """Members of a group are closer to each other than codewords are; a third of the rows are one group."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(5, 64))
    groups = centres[np.arange(5000) % 5] + 0.05 * rng.normal(size=(5000, 64))
    assert recall(spark, groups) >= 0.9
    hot = np.where((np.arange(5000) % 3 == 0)[:, None], centres[0] + 0.05 * rng.normal(size=(5000, 64)), rng.normal(size=(5000, 64)))
    assert recall(spark, hot) >= 0.9


def test_very_large_and_small_components(spark):
    rows = [(0, [1e-200, 0.0]), (1, [1e200, 1e200]), (2, [5e-324, 0.0]), (3, [1e308, -1e308]), (4, [-3.0, 0.0]), (4, [-3.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r.vec_id, r.score) for r in nearest_neighbours(df, F.col("vec_id") == 0).orderBy("rank").collect()]
    assert [g[0] for g in got] == [2, 1, 3, 4]
    assert np.allclose([g[1] for g in got], [1, 0.5**0.5, 0.5**0.5, -1], atol=1e-15)


def test_recall_on_embeddings(spark):
    """The table's own queries against brute force."""
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    have = [(r.vec_id, r.embedding) for r in df.select("vec_id", "embedding").collect() if r.embedding]
    ids, x = np.array([h[0] for h in have]), np.array([h[1] for h in have], float)
    asked = np.flatnonzero(ids % 50 == 0)
    want = brute(ids, x, asked, 5)
    got: dict = {}
    for r in nearest_neighbours(df.withColumn("codes", F.lit("x")), F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
        a, b = x[ids == r.query_id][0], x[ids == r.vec_id][0]
        assert abs(r.score - a @ b / np.sqrt((a @ a) * (b @ b))) < 1e-12
    assert np.mean([len(got[q] & set(want[q])) / 5 for q in want]) >= 0.9
