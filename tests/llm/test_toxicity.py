import random

import numpy as np
import pytest

from weftline.llm import toxicity as T


def corpus(n, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["ba", "do", "ke", "lu", "mi", "no", "ra", "ti"]) for _ in range(rng.randint(1, 3)))
    out = []
    for _ in range(n):
        w = [word() for _ in range(rng.randint(3, 120))]
        bad = rng.random() < 0.2
        if bad:
            w[rng.randrange(len(w))] = rng.choice(["grumz", "Zhlox" + word()])
        out.append((" ".join(w), int(bad)))
    return out


@pytest.fixture(scope="module")
def net():
    rows = corpus(600, 1)
    return T.train([t for t, _ in rows], np.array([y for _, y in rows]))


def test_held_out_accuracy(net):
    rows = corpus(400, 2)
    p = T.Scorer(net).scores([t for t, _ in rows])
    assert np.mean((p >= 0.5) == np.array([y for _, y in rows])) >= 0.97


def test_slopes():
    rng = np.random.default_rng(0)
    net = T.Network.fresh({}, rng)
    for k in T.Network.TRAINED:
        setattr(net, k, getattr(net, k).astype(np.float64))
    x, ids = rng.normal(size=(5, 2 * T.DIM)), rng.integers(0, 6, (3, T.WINDOW))
    ids[:, 0] = 0
    slope, keep = rng.normal(size=3), []
    net.forward_ids(net.gates(x), ids, keep)
    d, d_x = net.backward(x, ids, keep, slope)
    for k, at in (("state", (1, 2, 3)), ("inputs", (0, 1, 2)), ("bias", (0, 0, 4)), ("attend", (1, 1)), ("focus", (2,)), ("out", (3,))):
        w, eps = getattr(net, k), 1e-3
        w[at] += eps
        up = net.forward_ids(net.gates(x), ids) @ slope
        w[at] -= 2 * eps
        down = net.forward_ids(net.gates(x), ids) @ slope
        w[at] += eps
        assert abs((up - down) / (2 * eps) - d[k][at]) < 1e-3 * max(1, abs(d[k][at]))


def test_every_window_counts(net):
    filler = "ba do ke " * 400
    s = T.Scorer(net).scores([filler, filler + "grumz", "grumz " + filler, filler + "grumz " + filler, "", None])
    assert s[0] < 0.5 and (s[1:4] >= 0.5).all() and s[4] == s[5] < 0.5


def test_scores_do_not_depend_on_company(net):
    texts = [t for t, _ in corpus(50, 9)]
    one = np.array([T.Scorer(net).scores([t])[0] for t in texts])
    assert np.allclose(one, T.Scorer(net).scores(texts), atol=1e-5)


def test_digest(spark):
    rows = corpus(400, 3)
    docs = spark.createDataFrame([(i, t, 1.0) for i, (t, _) in enumerate(rows)] + [(None, None, 2.0), (5, "", 3.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(rows)] + [(None, 1), (7, None)], "doc_id long, toxic int")
    got = T.toxicity_digest(docs, labels).collect()
    assert len(got) == 402 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert np.mean([r.predicted == rows[r.doc_id][1] for r in got if r.held_out]) >= 0.95
    assert T.toxicity_digest(docs.limit(0), labels.limit(0)).count() == 0
    assert {r.predicted for r in T.toxicity_digest(docs, labels.limit(0)).collect()} == {0}


@pytest.mark.parametrize(("scale", "least", "wrong"), [("sf0.01", 0.8, 0.1), ("sf0.1", 0.95, 0.02)])
def test_held_out_labels(spark, scale, least, wrong):
    """Ranking of held-out labelled documents, and clean ones taken for toxic."""
    docs, labels = (spark.read.parquet(f"/root/testdata/{scale}/{t}.parquet") for t in ("documents", "labels"))
    got = T.toxicity_digest(docs, labels).filter("held_out").join(labels.filter("toxic IS NOT NULL"), "doc_id").collect()
    score, toxic = np.array([r.score for r in got]), np.array([r.toxic for r in got])
    good, bad = score[toxic == 0], score[toxic == 1]
    assert ((bad[:, None] > good).mean() + (bad[:, None] == good).mean() / 2) >= least
    assert (good >= 0.5).mean() <= wrong
