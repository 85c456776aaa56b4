import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.operators import clicks, extremes, graph, learning, ranking, text_stats, web
from weftline.sinks import apply_changes
from weftline.sources import binary
from weftline.sources.text import dense, parse_svmlight


def verdicts(spark, rules, urls):
    df = spark.createDataFrame([(u, rules) for u in urls], "url string, rules string")
    return [r[0] for r in df.select(web.allowed(web.compile_rules(F.col("rules")), F.col("url"))).collect()]


MANY = "Disallow: /users\nDisallow: *.php$\nDisallow: */cgi-bin/\nDisallow: /very/secret.page.html$"


@pytest.mark.parametrize(
    "rules, yes, no",
    [
        ("Disallow: /users", ["/company/about.html", "/another/prefix/users/about.html", "/another/prefix/users"], ["/users/jan", "/users/", "/users"]),
        (None, ["/company/about.html", "any_url"], []),
        ("", ["/company/about.html", "any_url"], []),
        ("Disallow: *.php$", ["file.sphp"], ["file.php"]),
        (MANY, ["/subdir2/users/about.html", "/info.php?user=123", "/info.pl", "/scgi-bin/", "/the/very/secret.page.html", "/very/secret.page.html?blah"], ["/users/jan", "/info.php", "/forum/cgi-bin/send?user=123", "/forum/cgi-bin/", "/cgi-bin/", "/very/secret.page.html"]),
        ("Disallow: x$", ["/x", "/ax"], ["/x$"]),
    ],
)
def test_robots(spark, rules, yes, no):
    assert verdicts(spark, rules, yes + no) == [True] * len(yes) + [False] * len(no)


def test_robots_bad_line(spark):
    with pytest.raises(Exception, match="bad robots rule"):
        verdicts(spark, "Allowed: /users", ["/users"])


def test_weather(spark):
    def line(top, low):
        row = [" "] * 130
        for at, s in ((0, "010010"), (14, "20010102"), (102, top.rjust(6)), (110, low.rjust(6))):
            row[at : at + len(s)] = s
        return ("".join(row),)

    a, b = extremes.parse_weather(spark.createDataFrame([line("21.6*", "17.1"), line("9999.9", "9999.9")], "value string")).collect()
    assert (a.station, a.year, a.month, a.day) == (10010, 2001, 1, 2)
    assert abs(a.max_temp + 5.7) < 0.1 and abs(a.min_temp + 8.3) < 0.1
    assert b.max_temp is None and b.min_temp is None


def test_pagerank_small(spark):
    e = spark.createDataFrame([(1, 2), (1, 3), (2, 3), (3, 1), (3, 4)], "src long, dst long")
    for own in (True, False):
        got = {r.id: r["rank"] for r in graph.pagerank(e, 0.85, 20, dangling_self=own).collect()}
        assert abs(sum(got.values()) - 1) < 1e-9 and got[3] > got[2]
    assert graph.pagerank(e.limit(0)).count() == 0
    r = {1: 0.25, 2: 0.25, 3: 0.25, 4: 0.25}
    one = {r_.id: r_["rank"] for r_ in graph.pagerank(e, 0.8, 1).collect()}
    want = {v: 0.05 + 0.8 * (s + r[4] / 4) for v, s in {1: 0.125, 2: 0.125, 3: 0.375, 4: 0.125}.items()}
    assert all(abs(one[v] - want[v]) < 1e-12 for v in want)
    early = graph.pagerank(e, 0.85, 100, tolerance=0.01).collect()
    assert len(early) == 4


def test_hits_small(spark):
    e = spark.createDataFrame([(1, 3), (2, 3), (2, 4)], "src long, dst long")
    got = {r.id: (r.authority, r.hub) for r in graph.hits(e, 2, start=1.0).collect()}
    assert got == {1: (0.0, 2.0), 2: (0.0, 3.0), 3: (3.0, 0.0), 4: (2.0, 0.0)}


def test_sessions(spark):
    lines = spark.createDataFrame([("q@213\thttp://www.a.com/,b.com,a.com\tb.com,zzz",), ("q@213\ta,b\t",), ("bad",)], "value string")
    s = clicks.parse_sessions(lines)
    assert s.collect()[0].shown == ["a.com", "b.com", "a.com"] and s.count() == 1
    rows = clicks.positions(s, ["query"]).orderBy("pos").collect()
    assert [(r.pos, r.click, r.min_click, r.last_click) for r in rows] == [(0, True, 0, 0), (1, True, 0, 0), (2, False, 0, 0)]


def test_urls(spark):
    rows = spark.createDataFrame([("http://u@Ex.com:80/a?b",), ("http://a_b.ru",), ("none",), (None,)], "u string")
    assert [r[0] for r in rows.select(T.host(F.col("u"))).collect()] == ["Ex.com", "a_b.ru", None, None]
    assert rows.select(T.url_path(F.col("u"))).first()[0] == "/a?b"


def test_words_keep_inner_empties(spark):
    got = text_stats.word_count_ws(spark.createDataFrame([("a  b ",), (None,), ("",)], "text string"))
    assert {r.word: r.cnt for r in got.collect()} == {"a": 1, "": 2, "b": 1}


def test_svmlight(spark):
    r = parse_svmlight(spark.createDataFrame([("2 qid:7 1:0.5 3:2 # x",), ("-1 2:1",)], "value string")).select("label", "qid", dense(F.col("features"), 3).alias("x")).collect()
    assert [(x.label, x.qid, x.x) for x in r] == [(2.0, 7, [0.5, 0.0, 2.0]), (-1.0, None, [0.0, 1.0, 0.0])]


def test_split_planning():
    assert binary.plan_splits([5, 5, 5, 20, 1], 11) == [(0, 2), (2, 1), (3, 1), (4, 1)]
    assert binary.plan_splits([], 10) == []


def test_pkz_corrupt(spark, tmp_path):
    binary.register(spark)
    docs = spark.createDataFrame([("one",), ("two",), ("три",)], "text string").coalesce(1)
    assert binary.write_pkz(docs, str(tmp_path)) == 3
    load = lambda **o: [r.document for r in spark.read.format("pkz").options(**o).load(str(tmp_path)).orderBy("offset").collect()]
    assert load() == ["one", "two", "три"] == load(bytesPerSplit=1)
    f = tmp_path / "part-000000.pkz"
    raw = bytearray(f.read_bytes())
    raw[12] ^= 255
    f.write_bytes(raw)
    assert load(onCorrupt="skip") == ["one", "три"] and load(onCorrupt="stop_split") == ["one"]
    with pytest.raises(Exception):
        load()


def test_record_stream(spark, tmp_path):
    binary.register(spark)
    rows = [("u1", "b" * 300, "t"), ("u2", None, None), ("u3", None, "é")]
    (tmp_path / "x.bin").write_bytes(b"".join(struct.pack("<i", len(m)) + m for m in (binary.format_message(*r) for r in rows)))
    got = spark.read.format("record_stream").load(str(tmp_path)).orderBy("url").collect()
    assert [tuple(r) for r in got] == rows


def test_fixed_torn(spark, tmp_path):
    binary.register(spark)
    (tmp_path / "x.bin").write_bytes(b"aabbc")
    with pytest.raises(Exception, match="whole number"):
        spark.read.format("fixed_records").option("recordBytes", 2).load(str(tmp_path)).collect()


def test_changes(spark):
    state = spark.createDataFrame([("a", "Y"), ("b", "Y")], "row_key string, value string")
    ch = spark.createDataFrame([("b", "delete", None), ("c", "put", "Y")], "row_key string, op string, value string")
    assert sorted(map(tuple, apply_changes(state, ch).collect())) == [("a", "Y"), ("c", "Y")]


def test_boosting_learns(spark):
    rng = np.random.default_rng(1)
    x = rng.random((400, 2))
    d = spark.createDataFrame([(float(a), float(b), float(3 * (a > 0.5) + b), float(a > 0.3)) for a, b in x], "a double, b double, y double, c double")
    squared = learning.boost(d, ["a", "b"], "y", "squared", rounds=8, depth=2)
    assert ranking.rmse(squared.predict(d), "y", "prediction").first()[0] < 0.4
    logistic = learning.boost(d, ["a", "b"], "c", "logistic", rounds=6, depth=2)
    assert ranking.log_loss(logistic.predict(d), "c", "prediction").first()[0] < 0.3


def test_ials_fits(spark):
    rng = np.random.default_rng(2)
    u, v = rng.normal(size=(30, 2)), rng.normal(size=(20, 2))
    r = spark.createDataFrame([(i, j, float(np.clip(3 + u[i] @ v[j], 1, 5))) for i in range(30) for j in range(20)], "user long, item long, rating double")
    assert ranking.rmse(learning.ials(r, rank=3, rounds=4), "rating", "prediction").first()[0] < 0.5


def test_golden_section():
    assert abs(learning.golden_section(lambda x: (x - 0.3) ** 2) - 0.3) < 1e-2


def dense_ials(train, test, start, rank, rounds, lam, alpha, eps, fade):
    """The same model on whole matrices; 0 in ``train`` is no rating, 1 in ``test`` a cell to predict."""
    seen = train > 0
    mean = train[seen].mean()
    left = np.where(seen, train - mean, 0)
    user = left.sum(1) / np.maximum(seen.sum(1), 1)
    item = np.where(seen, left - user[:, None], 0).sum(0) / np.maximum(seen.sum(0), 1)
    said = mean + user[:, None] + item[None]
    p = np.where(seen, train, np.where(test > 0, said, fade * said))
    c = 1 + alpha * np.log(1 + (train + test) / eps)
    known = (train + test) > 0
    x, y = np.hstack([np.ones((len(train), 1)), np.zeros((len(train), rank))]), np.hstack([np.ones((train.shape[1], 1)), start])

    def side(p, c, known, y, bias):
        out = np.empty((len(p), rank + 1))
        for i in range(len(p)):
            a = (y.T * c[i]) @ y + lam * known[i].sum() * np.eye(rank + 1)
            out[i] = np.linalg.solve(a, y.T @ (c[i] * (p[i] - bias)))
        return out[:, 0].copy(), np.hstack([np.ones((len(p), 1)), out[:, 1:]])

    for _ in range(rounds):
        user, x = side(p, c, known, y, item)
        item, y = side(p.T, c.T, known.T, x, user)
    return np.clip(x[:, 1:] @ y[:, 1:].T + user[:, None] + item[None], 1, 5)


def test_ials_equals_the_dense_model(spark):
    rng = np.random.default_rng(4)
    train = np.where(rng.random((12, 9)) < 0.5, rng.integers(1, 6, (12, 9)), 0).astype(float)
    test = ((rng.random((12, 9)) < 0.2) & (train == 0)).astype(float)
    start = np.array([[np.sin(j * 1.7 + i) for i in range(3)] for j in range(9)])
    want = dense_ials(train, test, start, 3, 2, 0.5, 4.0, 0.3, 0.85)
    rows = spark.createDataFrame([(int(i), int(j), float(train[i, j])) for i, j in zip(*np.nonzero(train), strict=True)] + [(None, 1, 3.0), (1, None, 3.0)], "user long, item long, rating double")
    asked = spark.createDataFrame([(int(i), int(j)) for i, j in zip(*np.nonzero(test), strict=True)], "user long, item long")
    got = learning.ials(rows, 3, 2, 0.5, 4.0, 0.3, 0.85, asked, lambda key, i: F.sin(key * 1.7 + i)).collect()
    assert len(got) == ((train + test) > 0).sum() and sum(r.rating is None for r in got) == test.sum()
    assert all(abs(r.prediction - want[r.user, r.item]) < 1e-8 for r in got)


def test_a_series_of_factorisations_shares_its_passes(spark):
    """Each model as if made alone; ratings are read once, whatever the number of models and rounds."""
    read = spark.sparkContext.accumulator(0)

    def seen(frames):
        for pdf in frames:
            read.add(len(pdf))
            yield pdf

    r = spark.createDataFrame([(u, i, float((u * i) % 5 + 1)) for u in range(8) for i in range(6) if (u + i) % 3], "user long, item long, rating double")
    starts = [lambda key, i: F.sin(key * 1.7 + i), lambda key, i: F.cos(key * 0.9 + i)]
    both = {(x.user, x.item): x.predictions for x in learning.ials_series(r.mapInPandas(seen, r.schema), starts, rank=2, rounds=2).collect()}
    assert read.value == r.count() == len(both)
    for n, start in enumerate(starts):
        alone = learning.ials(r, rank=2, rounds=2, start=start).collect()
        assert all(abs(x.prediction - both[x.user, x.item][n]) < 1e-9 for x in alone)


def test_series_of_boosters(spark):
    """Growing depth and falling rate; the model that one goes on from stays as it is. Pruning, importance, step search."""
    rng = np.random.default_rng(3)
    x = rng.random((300, 3))
    d = spark.createDataFrame([(float(a), float(b), float(c), float(2 * (a > 0.4) + (b > 0.7))) for a, b, c in x], "a double, b double, c double, y double")
    first = learning.boost(d, ["a", "b", "c"], "y", rounds=2, depth=1, rate=0.5)
    second = learning.boost(d, ["a", "b", "c"], "y", rounds=2, depth=2, rate=0.3, warm=first)
    assert (len(first.trees), first.rates, second.rates) == (2, [0.5, 0.5], [0.5, 0.5, 0.3, 0.3])
    error = lambda m: ranking.mse(m.predict(d), "y", "prediction").first()[0]
    assert error(second) < error(first)
    share = second.importance()
    assert abs(sum(share.values()) - 1) < 1e-9 and share["a"] > 0.5
    one = learning.boost(d, ["a", "b", "c"], "y", rounds=1, depth=3, line_search=True, lam=0.0)
    assert one.rates[0] > 0.95
    grown, pruned = (learning.boost(d, ["a", "b", "c"], "y", rounds=1, depth=4, gamma=g, prune=True).trees[0] for g in (0.0, 5.0))
    assert len(pruned.splits) < len(grown.splits) and all(pruned.gains[n] >= 5 for n in pruned.splits if 2 * n + 1 not in pruned.splits and 2 * n + 2 not in pruned.splits)
    assert set(pruned.leaves) == {k for n in pruned.splits for k in (2 * n + 1, 2 * n + 2)} - set(pruned.splits)
    few = learning.boost(d, ["a", "b", "c"], "y", rounds=3, depth=2, max_features=1, seed=1)
    assert error(few) < d.agg(F.var_pop("y")).first()[0]
    ties = spark.createDataFrame([(1.0, 0.0), (2.0, 1.0), (2.0, 1.0), (None, 0.0)], "a double, y double")
    tree = learning.boost(ties, ["a"], "y", rounds=1, depth=1, edges={"a": [2.0]}).trees[0]
    assert [r[0] > 0 for r in ties.select(tree.value()).collect()] == [False, True, True, False]


def test_crossings(spark):
    df = spark.createDataFrame([(["a", "b"], ["x"], ["1", "2"])], "p array<string>, q array<string>, r array<string>")
    spaces = {c: F.col(c) for c in "pqr"}
    got = df.select(learning.crossings(spaces, [("p", "q"), ("p", "q", "r"), ("r", "r")])).first()[0]
    assert got == ["a^x", "b^x", "a^x^1", "a^x^2", "b^x^1", "b^x^2", "1^2"]
    rows = [(i, float(i % 3 == 0 and i % 2 == 0), str(i % 3), str(i % 2)) for i in range(60)]
    d = spark.createDataFrame(rows, "i long, y double, u string, v string")
    fit = learning.hashed_logit(d, ["u", "v"], [], "y", [("u", "v")], bits=10, max_iter=50, l1=1e-4)
    assert fit.columns == ["i", "y", "u", "v", "prediction"] and all((r.prediction > 0.5) == (r.y == 1) for r in fit.collect())


def test_lambda_gradients_of_first_places(spark):
    rng = np.random.default_rng(5)
    rows = [(q, d, float(rng.integers(0, 9)) / 2, int(rng.integers(0, 3)) if q else 0) for q in range(4) for d in range(12)]
    got = {(r.q, r.d): (r.grad, r.hess) for r in ranking.lambda_gradients(spark.createDataFrame(rows, "q long, d long, s double, y int"), "q", "d", "s", "y", absolute=True, top=5, unit_hessian=True).collect()}
    for q in range(4):
        docs = sorted((r for r in rows if r[0] == q), key=lambda r: (-r[2], r[1]))
        weight = [1 / np.log2(p + 2) if p < 5 else 0 for p in range(12)]
        best = sorted((r[3] for r in docs), reverse=True)[:5]
        ideal = sum((2**y - 1) / np.log(i + 2) for i, y in enumerate(best)) or 1
        for i, a in enumerate(docs):
            grad = hess = 0.0
            for j, b in enumerate(docs):
                rho = 1 / (1 + np.exp(min(abs(a[2] - b[2]), 50)))
                delta = abs((2.0 ** a[3] - 2.0 ** b[3]) * (weight[i] - weight[j])) / ideal
                grad, hess = grad + np.sign(a[3] - b[3]) * rho * delta, hess + rho * (1 - rho) * delta
            assert np.allclose(got[q, a[1]], (grad, hess or 1))


@pytest.mark.parametrize("top", [None, 2])
def test_lambda_gradients_of_groups_over_many_batches(spark, monkeypatch, top):
    """Groups in several batches, pairs in several blocks, rows without a group; labels and scores that repeat."""
    monkeypatch.setattr(ranking, "PAIRS", 7)
    rng = np.random.default_rng(6)
    rows = [(q, f"d{d}", float(rng.integers(0, 5)) / 2, int(rng.integers(0, 3))) for q, n in enumerate([1, 17, 2, 9, 1, 30]) for d in range(n)]
    df = spark.createDataFrame([*rows, (None, "x", 1.0, 1), (None, "y", 2.0, 0)], "q long, d string, s double, y int")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 4)
    try:
        got = {(r.q, r.d): (r.grad, r.hess) for r in ranking.lambda_gradients(df, "q", "d", "s", "y", top=top).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for q in range(6):
        docs = sorted((r for r in rows if r[0] == q), key=lambda r: (-r[2], r[1]))
        n, log = top or len(docs), np.log if top else np.log2
        ideal = sum((2**y - 1) / log(i + 2) for i, y in enumerate(sorted((r[3] for r in docs), reverse=True)[:n]))
        weight = [1 / np.log2(p + 2) if p < n else 0 for p in range(len(docs))]
        for i, a in enumerate(docs):
            for j, b in enumerate(docs):
                if a[3] > b[3] and (i < n or j < n):
                    rho, delta = 1 / (1 + np.exp(a[2] - b[2])), abs((2.0 ** a[3] - 2.0 ** b[3]) * (weight[i] - weight[j])) / ideal
                    for d, way in ((a[1], 1), (b[1], -1)):
                        g, h = want.get((q, d), (0.0, 0.0))
                        want[q, d] = g + way * rho * delta, h + rho * (1 - rho) * delta
    assert set(got) == set(want) and all(np.allclose(got[k], want[k]) for k in want)


def test_slopes_are_dealt_once(spark):
    """One exchange for the groups, one for the sums; no join of a group with itself."""
    df = spark.createDataFrame([(1, 1, 0.5, 1), (1, 2, 0.2, 0)], "q long, d long, s double, y int")
    plan = ranking.lambda_gradients(df, "q", "d", "s", "y")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and "Join" not in plan


def test_a_round_of_ranking_writes_its_rows_once(spark, monkeypatch):
    """The levels of a tree read slopes that are made once."""
    written = []
    monkeypatch.setattr(learning, "cut", lambda df: written.append(df.columns) or df.localCheckpoint())
    df = spark.createDataFrame([(q, d, float(d * q % 5), d % 3) for q in range(5) for d in range(6)], "q long, d long, f double, y int")
    learning.boost(df, ["f"], "y", "lambda", rounds=2, depth=2, group="q", item="d", edges={"f": [1.0, 2.0]})
    assert len(written) == 2 and all("grad" in c for c in written)


def test_relevance_moves_no_counts_for_few_query_words(spark, monkeypatch):
    """Query words and weights are broadcast whatever the planner guesses of sizes; more words than allowed are joined."""
    from weftline.operators import text_stats

    docs = spark.createDataFrame([(1, "a b a c"), (2, "b c d"), (3, "x y"), (4, None)], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "a b b"), (2, "c x q")], "query_id long, text string")
    words = F.split(F.lower("text"), " ", -1)
    found, plans = [], []
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        for most in (text_stats.QUERY_WORDS, 2):
            monkeypatch.setattr(text_stats, "QUERY_WORDS", most)
            df = text_stats.relevance(docs, queries, "doc_id", words, words)
            plans.append(df._jdf.queryExecution().executedPlan().toString())
            found.append({(r.query_id, r.doc_id): (r.tf_idf, r.bm25) for r in df.collect()})
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" not in plans[0] and "SortMergeJoin" in plans[1]
    assert set(found[0]) == set(found[1]) == {(1, 1), (1, 2), (2, 1), (2, 2), (2, 3)}
    assert all(np.allclose(found[0][k], found[1][k]) for k in found[0])


def test_large_texts_are_inflated_few_at_a_time(spark):
    """No Arrow batch of thousands of streams, whose text would be held at once."""
    from weftline.sources import text as source

    df = spark.range(3).select(F.when(F.col("id") < 2, F.repeat(F.lit("é "), F.col("id").cast("int") * 1000)).alias("t"))
    back = df.select("t", source.page_html(F.base64(source.deflate(F.col("t")))).alias("u"))
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" in plan and "ArrowEvalPython" not in plan
    assert all(r.t == r.u for r in back.collect())


def test_parts_of_a_table(spark):
    from weftline.operators import splits

    df = spark.createDataFrame([(i, i % 7 if i % 5 else None) for i in range(200)], "i long, g long")
    a, b = splits.split(df, "g", 0.5, seed=3)
    assert a.count() + b.count() == 200 and not {r.g for r in a.collect()} & {r.g for r in b.collect()}
    both = splits.tagged({"x": a, "y": b.withColumn("z", F.lit(1))})
    assert both.columns == ["i", "g", "part", "z"] and both.filter("part = 'x' AND z IS NULL").count() == a.count()
    assert splits.without(df, b, ["g"]).count() == a.count()
    assert splits.without(df, df.limit(0), ["g"]).count() == 200


def test_early_stop_is_counted(spark):
    e = spark.createDataFrame([(1, 2), (2, 1), (3, 1), (None, 2)], "src long, dst long")
    ranks, steps = graph.pagerank_counted(e, steps=200, tolerance=1e-3)
    assert 1 < steps < 200 and abs(ranks.agg(F.sum("rank")).first()[0] - 1) < 1e-9
    again, most = graph.pagerank_counted(e, steps=steps)
    assert most == steps and {r.id: r["rank"] for r in again.collect()} == {r.id: r["rank"] for r in ranks.collect()}
    assert graph.pagerank_counted(e.limit(0))[1] == 0


def test_splits_of_many_records():
    rng = np.random.default_rng(1)
    lengths = rng.integers(0, 50, 500)
    for most in (1, 10, 49, 200, 10**6):
        slow, size = [], 0
        for n in lengths:
            if slow and size + n < most:
                slow[-1], size = slow[-1] + 1, size + n
            else:
                slow.append(1)
                size = n
        assert [n for _, n in binary.plan_splits(lengths, most)] == slow
    assert binary.plan_splits([], 10) == []


def test_slices_of_an_index_and_torn_messages(spark, tmp_path):
    binary.register(spark)
    texts = [f"document {i} é" * (i % 5) for i in range(60)]
    binary.write_pkz(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3), f"{tmp_path}/p")
    read = spark.read.format("pkz").option("bytesPerSplit", 100).load(f"{tmp_path}/p")
    assert sorted(r.document for r in read.collect()) == sorted(texts) and read.rdd.getNumPartitions() > 9
    assert not [f for f in (tmp_path / "p").iterdir() if f.name.startswith("_")]
    offsets = sorted(r.offset for r in read.collect())
    assert offsets[0] == 0 and len(set(offsets)) == 60
    raw = binary.format_message("u", "b", "t")
    (tmp_path / "m.bin").write_bytes(struct.pack("<i", len(raw)) + raw + struct.pack("<i", 9) + b"torn")
    with pytest.raises(Exception, match="torn"):
        spark.read.format("record_stream").load(f"{tmp_path}/m.bin").collect()


def test_log_lines_without_clicks(spark):
    lines = spark.createDataFrame([("a@1\thttp://x.com\t",), ("b@1\thttp://www.x.com/,y.com\tx.com\t\t",), ("c@1",)], "value string")
    got = clicks.parse_sessions(lines).collect()
    assert [(r.query, r.shown, r.clicked) for r in got] == [("b", ["x.com", "y.com"], ["x.com"])]
