"""Tree boosting on histograms, implicit-feedback factorisation and a hashed logistic model.

Trees grow level by level: one aggregation per level gives gradient sums per node, feature and bin, of which there are
at most nodes x features x bins rows; the driver sees these sums alone and picks the splits.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators.ranking import with_slopes
from weftline.shared import cut, new_folder

#: Bins of a feature's histogram; trees between two checkpoints of the score.
BINS, EVERY = 64, 5


def best_splits(df: DataFrame, features: list[str], target: str, min_leaf: int = 1) -> DataFrame:
    """Per feature the threshold (midway between neighbours) that lowers the squared error most: feature, threshold, gain.

    Rows are summed up by distinct value first, so windows run over values. Null values and targets take no part.
    """
    long = df.select(F.col(target).cast("double").alias("y"), F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])).alias("_x"))
    sums = long.select("y", "_x.*").filter("y IS NOT NULL AND value IS NOT NULL").groupBy("feature", "value").agg(F.count("*").alias("n"), F.sum("y").alias("s"))
    w, whole = Window.partitionBy("feature").orderBy("value"), Window.partitionBy("feature")
    c = sums.select("feature", "value", F.lead("value").over(w).alias("next"), F.sum("n").over(w).alias("nl"), F.sum("s").over(w).alias("sl"), F.sum("n").over(whole).alias("nt"), F.sum("s").over(whole).alias("st"))
    ok = c.filter((F.col("next").isNotNull()) & (F.col("nl") >= min_leaf) & (F.col("nt") - F.col("nl") >= min_leaf))
    g = ok.select("feature", ((F.col("value") + F.col("next")) / 2).alias("threshold"), F.expr("sl * sl / nl + (st - sl) * (st - sl) / (nt - nl) - st * st / nt").alias("gain"))
    best = Window.partitionBy("feature").orderBy(F.desc("gain"), "threshold")
    return g.withColumn("_i", F.row_number().over(best)).filter("_i = 1").drop("_i")


@dataclass
class Tree:
    """Splits (feature, threshold) with their gains, and leaf values, by heap number: children of n are 2n + 1 and 2n + 2."""

    splits: dict[int, tuple[str, float]] = field(default_factory=dict)
    leaves: dict[int, float] = field(default_factory=dict)
    gains: dict[int, float] = field(default_factory=dict)

    def value(self, node: int = 0) -> Column:
        """The tree as one expression; values at or above a threshold go right, others and nulls left."""
        if node not in self.splits:
            return F.lit(float(self.leaves.get(node, 0.0)))
        f, t = self.splits[node]
        return F.when(F.col(f) >= t, self.value(2 * node + 2)).otherwise(self.value(2 * node + 1))

    def pruned(self, gamma: float, values: dict[int, float]) -> Tree:
        """Without splits of a gain under ``gamma``, from the bottom up; ``values``: what each node would say as a leaf."""
        splits, leaves = dict(self.splits), dict(self.leaves)
        for n in sorted(splits, reverse=True):
            kids = (2 * n + 1, 2 * n + 2)
            if not any(k in splits for k in kids) and self.gains[n] < gamma:
                del splits[n]
                for k in kids:
                    leaves.pop(k, None)
                leaves[n] = values[n]
        return Tree(splits, leaves, {n: g for n, g in self.gains.items() if n in splits})


@dataclass
class Boosted:
    """Trees with the rate of each."""

    start: float
    loss: str
    trees: list[Tree] = field(default_factory=list)
    rates: list[float] = field(default_factory=list)

    def score(self) -> Column:
        out = F.lit(self.start)
        for t, rate in zip(self.trees, self.rates, strict=True):
            out = out + rate * t.value()
        return out

    def predict(self, df: DataFrame) -> DataFrame:
        """``df`` plus prediction: a probability under logistic loss."""
        out = df.withColumn("_s", F.lit(self.start))
        for t, rate in zip(self.trees, self.rates, strict=True):
            out = out.withColumn("_s", F.col("_s") + rate * t.value())
        s = F.col("_s")
        return out.withColumn("prediction", 1 / (1 + F.exp(-s)) if self.loss == "logistic" else s).drop("_s")

    def importance(self) -> dict[str, float]:
        """Each used feature's share of the gain of all splits."""
        total: dict[str, float] = {}
        for t in self.trees:
            for n, (f, _) in t.splits.items():
                total[f] = total.get(f, 0.0) + t.gains[n]
        whole = sum(total.values())
        return {f: g / whole for f, g in sorted(total.items())} if whole else {}


def _edges_of(df: DataFrame, features: list[str]) -> dict[str, list[float]]:
    got = df.approxQuantile(features, [i / BINS for i in range(1, BINS)], 0.5 / BINS)
    return {f: sorted(set(q)) for f, q in zip(features, got, strict=True)}


def binned(df: DataFrame, edges: dict[str, list[float]]) -> DataFrame:
    """``df`` plus ``_bins``, an array with the number of edges at or below each feature's value (0 for null)."""

    def at(f: str, q: list[float]) -> Column:
        return F.size(F.filter(F.array(*[F.lit(float(e)) for e in q]), lambda e: F.col(f) >= e)) if q else F.lit(0)

    return df.withColumn("_bins", F.array(*[at(f, q) for f, q in edges.items()]))


def _grow(df: DataFrame, edges: dict[str, list[float]], depth: int, lam: float, gamma: float, min_leaf: int, max_features: int | None, min_gain: float, prune: bool, seed: int) -> Tree:
    """``df``: grad, hess, features and _bins. Gains follow the second order of the loss; splits without gain are not made."""
    tree, values, names, rng = Tree(), {}, list(edges), np.random.default_rng(seed)
    open_nodes = [0]
    for level in range(depth + 1):
        rows_of = df.withColumn("_node", _node(tree)).filter(F.col("_node").isin(open_nodes)).select("_node", "grad", "hess", F.posexplode("_bins").alias("f", "b"))
        sums = rows_of.groupBy("_node", "f", "b").agg(F.sum("grad").alias("g"), F.sum("hess").alias("h"), F.count("*").alias("n")).toPandas()
        ahead = []
        for n, rows in sums.groupby("_node"):
            one = rows[rows["f"] == rows["f"].iloc[0]]
            g, h, count = one["g"].sum(), one["h"].sum(), one["n"].sum()
            values[int(n)] = float(-g / (h + lam))
            best = (min_gain, None)
            tried = set(rng.choice(len(names), min(max_features, len(names)), replace=False).tolist()) if max_features else range(len(names))
            for f, part in rows.groupby("f") if level < depth else []:
                if f not in tried:
                    continue
                part = part.sort_values("b")
                gl, hl, nl = part["g"].cumsum().to_numpy(), part["h"].cumsum().to_numpy(), part["n"].cumsum().to_numpy()
                with np.errstate(divide="ignore", invalid="ignore"):  # without curvature and penalty there is no gain
                    gain = np.nan_to_num(gl**2 / (hl + lam) + (g - gl) ** 2 / (h - hl + lam) - g**2 / (h + lam), nan=-np.inf, posinf=-np.inf) - (0.0 if prune else gamma)
                q = edges[names[f]]
                gain[(nl < min_leaf) | (count - nl < min_leaf) | (part["b"].to_numpy() >= len(q))] = -np.inf
                at = int(np.argmax(gain))
                if gain[at] > best[0] + 1e-12:
                    best = (float(gain[at]), (names[f], q[int(part["b"].iloc[at])]))
            if best[1]:
                tree.splits[int(n)], tree.gains[int(n)] = best[1], best[0]
                ahead += [2 * int(n) + 1, 2 * int(n) + 2]
            else:
                tree.leaves[int(n)] = values[int(n)]
        open_nodes = ahead
        if not ahead:
            break
    return tree.pruned(gamma, values) if prune else tree


def _node(tree: Tree, node: int = 0) -> Column:
    if node not in tree.splits:
        return F.lit(node)
    f, t = tree.splits[node]
    return F.when(F.col(f) >= t, _node(tree, 2 * node + 2)).otherwise(_node(tree, 2 * node + 1))


def _loss_of(loss: str, target: str, score: Column) -> Column:
    if loss == "logistic":
        return F.log1p(F.exp(-F.abs(score))) + F.greatest(score, F.lit(0.0)) - score * F.col(target)
    return F.pow(score - F.col(target), F.lit(2.0))


def boost(
    df: DataFrame, features: list[str], target: str, loss: str = "squared", rounds: int = 10, depth: int = 3, rate: float = 0.3, lam: float = 1.0, gamma: float = 0.0, min_leaf: int = 1, subsample: float = 1.0,
    group: str | None = None, item: str | None = None, warm: Boosted | None = None, edges: dict[str, list[float]] | None = None, max_features: int | None = None, min_gain: float = 0.0, prune: bool = False, line_search: bool = False, seed: int = 0,
) -> Boosted:
    """Boosted trees for ``squared``, ``logistic`` or ``lambda`` loss (ranking within ``group``).

    Starts from the mean, its log-odds or 0, or goes on from ``warm``, which stays as it is; so a series of boosters of
    growing depth and falling rate is a series of calls. ``edges``: thresholds to choose from, else quantiles.
    ``gamma`` is taken from each gain, or with ``prune`` asked of each split from the bottom up once the tree is grown;
    ``max_features``: tried per node; ``line_search``: the step of each tree is the best in [0, 1] instead of ``rate``
    (not for ``lambda``). Rows with a null target take no part. Rows of a query without pairs have no slope. Items
    of a group differ. Features are binned once; the score so far is a column, checkpointed every few trees, under
    ``lambda`` with the slopes of each.
    """
    df = df.filter(F.col(target).isNotNull())
    mean = df.agg(F.avg(target)).first()[0]
    model = Boosted(warm.start, loss, list(warm.trees), list(warm.rates)) if warm else Boosted(0.0, loss)
    if mean is None:
        return model
    share = min(max(mean, 1e-6), 1 - 1e-6)
    if not warm:
        model.start = {"squared": float(mean), "logistic": float(np.log(share / (1 - share))), "lambda": 0.0}[loss]
    edges = edges or _edges_of(df, features)
    df = binned(df, edges).withColumn("_s", model.score())
    df = df if loss == "lambda" and subsample >= 1 else cut(df)  # the slopes' rows are written below
    for r in range(rounds):
        scored = df.sample(subsample, seed=seed + r) if subsample < 1 else df
        if loss == "lambda":
            # every level of the tree reads the slopes, so these are made once
            scored = cut(with_slopes(scored, group, item, "_s", target).drop("_in").withColumn("grad", -F.col("grad")))
            df = scored.drop("grad", "hess") if subsample >= 1 else df
        elif loss == "logistic":
            p = 1 / (1 + F.exp(-F.col("_s")))
            scored = scored.withColumn("grad", p - F.col(target)).withColumn("hess", p * (1 - p))
        else:
            scored = scored.withColumn("grad", F.col("_s") - F.col(target)).withColumn("hess", F.lit(1.0))
        tree, step = _grow(scored, edges, depth, lam, gamma, min_leaf, max_features, min_gain, prune, seed + r), rate
        if line_search and loss != "lambda":
            here = cut(df.select(F.col(target), "_s", tree.value().alias("_t")))
            step = golden_section(lambda x, here=here: here.agg(F.avg(_loss_of(loss, target, F.col("_s") + x * F.col("_t")))).first()[0])
        model.trees.append(tree)
        model.rates.append(step)
        df = df.withColumn("_s", F.col("_s") + step * tree.value())
        if (r + 1) % EVERY == 0 and (loss != "lambda" or subsample < 1):
            df = cut(df)
    return model


def golden_section(loss, low: float = 0.0, high: float = 1.0, tolerance: float = 1e-3) -> float:
    """The step in [low, high] of least loss, for a loss with one valley; each call of ``loss`` may be one aggregation."""
    ratio = (5**0.5 - 1) / 2
    a, b = high - ratio * (high - low), low + ratio * (high - low)
    fa, fb = loss(a), loss(b)
    while high - low > tolerance:
        if fa < fb:
            high, b, fb = b, a, fa
            a = high - ratio * (high - low)
            fa = loss(a)
        else:
            low, a, fa = a, b, fb
            b = low + ratio * (high - low)
            fb = loss(b)
    return (low + high) / 2


def biases(ratings: DataFrame) -> DataFrame:
    """kind (user or item), id and bias: a user's mean distance from the mean of all, then an item's mean of what is left."""
    mean = F.broadcast(ratings.agg(F.avg("rating").alias("_m")))
    left = ratings.select("user", "item", "rating").crossJoin(mean).withColumn("_c", F.col("rating") - F.col("_m"))
    users = left.groupBy("user").agg(F.avg("_c").alias("bias"))
    items = left.join(users, "user").groupBy("item").agg(F.avg(F.col("_c") - F.col("bias")).alias("bias"))
    return users.select(F.lit("user").alias("kind"), F.col("user").alias("id"), "bias").unionByName(items.select(F.lit("item").alias("kind"), F.col("item").alias("id"), "bias"))


def confidence(ratings: DataFrame, alpha: float = 1.0, eps: float = 1.0) -> DataFrame:
    """user, item, rating (repeats summed up) and weight 1 + alpha * ln(1 + rating / eps)."""
    return ratings.groupBy("user", "item").agg(F.sum("rating").alias("rating")).withColumn("weight", 1 + alpha * F.log(1 + F.col("rating") / eps))


def _solve(rank: int, lam: float, side: str, grams: list[np.ndarray], rests: list[np.ndarray]):
    """Rows of sums per ``side`` to its vectors, one model's after the other: the bias first, then the factors."""

    def work(frames):
        n = rank + 1
        upper = np.triu_indices(n)
        for pdf in frames:
            found = []
            for m, (gram, rest) in enumerate(zip(grams, rests, strict=True)):
                a = np.zeros((len(pdf), n, n))
                a[:, upper[0], upper[1]] = pdf[[f"a{m}_{i}" for i in range(len(upper[0]))]].to_numpy()
                a = a + a.transpose(0, 2, 1) - a * np.eye(n) + gram + lam * pdf["n"].to_numpy()[:, None, None] * np.eye(n)
                b, e = (pdf[[f"{x}{m}_{i}" for i in range(n)]].to_numpy() for x in "be")
                b = b + pdf["_b"].to_numpy()[:, None] * e + pdf["_base"].to_numpy()[:, None] * gram[0] + rest
                found.append(np.linalg.solve(a, b[:, :, None])[:, :, 0])
            yield pd.DataFrame({side: pdf[side].to_numpy(), "_b": pdf["_b"].to_numpy(), "v": list(np.concatenate(found, axis=1))})

    return work


def ials(ratings: DataFrame, rank: int = 8, rounds: int = 5, lam: float = 5.0, alpha: float = 40.0, eps: float = 0.13, fade: float = 0.85, test: DataFrame | None = None, start=None) -> DataFrame:
    """user, item, rating and prediction (in [1, 5]) by implicit-feedback least squares with biases, in turns over the sides.

    Every cell of the matrix has a value: a rating, or what the biases say, in full for cells of ``test`` (user, item)
    and times ``fade`` for the others; confidence is 1 + alpha * ln(1 + (rating, or 1 in test) / eps), so 1 for the
    others. Biases are learnt anew in each half round as one coordinate, and ``lam`` counts once per known cell of a
    row. Other cells are never made: what they add to the normal equations of a row is the same few sums over the other
    side's vectors (at most (rank + 2) ** 2 numbers, which the driver sees), plus a correction per known cell.

    The known cells are written once. Each half round joins them with the other side's vectors and sends a cell with its
    vector, narrower than what it adds to the sums, to its row's task; of a row with very many ratings that task holds
    the sums alone. Repeated ratings of a cell count by their mean. Rows with a null user, item or rating take no part;
    test cells have a null rating in the result. ``start(key, i)`` gives the i-th factor of an item to begin with; by
    default a hash in [-1, 1].
    """
    found = ials_series(ratings, [start], rank, rounds, lam, alpha, eps, fade, test)
    return found.select("user", "item", "rating", F.col("predictions")[0].alias("prediction"))


def ials_series(ratings: DataFrame, starts: list, rank: int = 8, rounds: int = 5, lam: float = 5.0, alpha: float = 40.0, eps: float = 0.13, fade: float = 0.85, test: DataFrame | None = None) -> DataFrame:
    """user, item, rating and predictions: a factorisation as ``ials`` makes it for each entry of ``starts``, all in the same passes."""

    def kept(df: DataFrame, name: str) -> DataFrame:
        path = new_folder(df.sparkSession, name)
        df.write.parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)

    rows = ratings.filter("user IS NOT NULL AND item IS NOT NULL AND rating IS NOT NULL")
    known = kept(rows.groupBy("user", "item").agg(F.avg("rating").alias("rating")), "cells")
    first = kept(biases(known), "biases")
    mean = known.agg(F.avg("rating")).first()[0] or 0.0
    cells = known
    if test is not None:
        cells = kept(known.unionByName(test.filter("user IS NOT NULL AND item IS NOT NULL").select("user", "item").distinct().join(known, ["user", "item"], "left_anti").withColumn("rating", F.lit(None).cast("double"))), "cells")
    width, models = rank + 1, range(len(starts))

    def biased(k: str) -> DataFrame:
        """Every row of a side with its bias."""
        found = first.filter(F.col("kind") == k).select(F.col("id").alias(k), F.col("bias").alias("_b"))
        return found if test is None else cells.select(k).distinct().join(found, k, "left").na.fill(0.0, ["_b"])

    bias = {k: cut(biased(k)) for k in ("user", "item")}
    entry = lambda m, i: F.element_at("v", m * width + i + 1)
    pairs = [(p, q) for p in range(width) for q in range(p, width)]

    def half(side: str, other: str, vectors: DataFrame) -> DataFrame:
        """``vectors`` (other, _b, v): the other side's first bias, and bias and factors of each model."""
        ys = [[F.lit(1.0)] + [entry(m, i + 1) for i in range(rank)] for m in models]
        sums = vectors.agg(*[F.sum(y[p] * y[q]) for y in ys for p, q in pairs], *[F.sum((fade * F.col("_b") - entry(m, 0)) * ys[m][p]) for m in models for p in range(width)]).first()
        grams = [np.zeros((width, width)) for _ in models]
        for m in models:
            for i, (p, q) in enumerate(pairs):
                grams[m][p, q] = grams[m][q, p] = sums[m * len(pairs) + i]
        rests = [np.array(sums[len(models) * len(pairs) + m * width :][:width], float) for m in models]
        sent = cells.join(vectors, other).select(side, "rating", F.col("_b").alias("_o"), *[entry(m, i).alias(f"_{m}_{i}") for m in models for i in range(width)]).repartition(side)
        # of a cell's value the part with the bias of ``side`` is added to the sums
        more = alpha * F.log(1 + F.coalesce("rating", F.lit(1.0)) / eps)
        sent = sent.select("*", more.alias("_c"), F.coalesce("rating", mean + F.col("_o")).alias("_p"), (F.when(F.col("rating").isNull(), 1 + more).otherwise(0.0) - fade).alias("_e"))
        aggs = []
        for m in models:
            own, y = F.col(f"_{m}_0"), [F.lit(1.0)] + [F.col(f"_{m}_{i + 1}") for i in range(rank)]
            left = (1 + F.col("_c")) * (F.col("_p") - own) - (fade * (mean + F.col("_o")) - own)
            aggs += [F.sum(F.col("_c") * y[p] * y[q]).alias(f"a{m}_{i}") for i, (p, q) in enumerate(pairs)]
            aggs += [F.sum(left * y[p]).alias(f"b{m}_{p}") for p in range(width)] + [F.sum(F.col("_e") * y[p]).alias(f"e{m}_{p}") for p in range(width)]
        rows = sent.groupBy(side).agg(*aggs, F.count("*").alias("n")).join(bias[side], side).withColumn("_base", fade * (mean + F.col("_b")))
        return cut(rows.mapInPandas(_solve(rank, lam, side, grams, rests), f"`{side}` {dict(cells.dtypes)[side]}, _b double, v array<double>"))

    pick = lambda start: start or (lambda key, i: F.pmod(F.xxhash64(key, F.lit(i)), F.lit(2001)) / 1000.0 - 1)
    items = bias["item"].select("item", "_b", F.array(*[x for s in starts for x in [F.col("_b"), *[pick(s)(F.col("item"), i).cast("double") for i in range(rank)]]]).alias("v"))
    users = bias["user"].select("user", "_b", F.array(*[x for _ in models for x in [F.col("_b"), *[F.lit(0.0) for _ in range(rank)]]]).alias("v"))
    for _ in range(rounds):
        users = half("user", "item", items)
        items = half("item", "user", users)
    j = cells.join(users.select("user", F.col("v").alias("_u")), "user").join(items.select("item", "v"), "item")

    def said(m: int) -> Column:
        of_user = lambda i: F.element_at("_u", m * width + i + 1)
        dot = of_user(0) + entry(m, 0)
        for i in range(rank):
            dot = dot + of_user(i + 1) * entry(m, i + 1)
        return F.least(F.greatest(dot, F.lit(1.0)), F.lit(5.0))

    return j.select("user", "item", "rating", F.array(*[said(m) for m in models]).alias("predictions"))


def ensemble(predictions: list[DataFrame], keys: list[str]) -> DataFrame:
    """The mean of several models' predictions per key."""
    every = predictions[0].select(*keys, "prediction")
    for p in predictions[1:]:
        every = every.unionByName(p.select(*keys, "prediction"))
    return every.groupBy(*keys).agg(F.avg("prediction").alias("prediction"))


def signed_label(y: Column) -> Column:
    return y * 2 - 1


def tokens(columns: list[str], lists: list[str]) -> Column:
    """Categorical tokens C1_value, ... and list tokens CG1_0_value, ...; nulls have none."""
    single = [F.concat(F.lit(f"C{i + 1}_"), F.col(c).cast("string")) for i, c in enumerate(columns)]

    def listed(c: str, mark: str) -> Column:
        return F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: F.concat(F.lit(mark), x.cast("string")))

    many = [listed(c, f"CG{i + 1}_0_") for i, c in enumerate(lists)]
    return F.array_compact(F.concat(F.array(*single), *many))


def vw_line(label: Column, token: Column) -> Column:
    """A line of the text format of online linear learners."""
    return F.concat(label.cast("string"), F.lit(" | "), F.concat_ws(" ", token))


def vw_spaces(label: Column, spaces: dict[str, Column]) -> Column:
    """A line with a namespace per entry of ``spaces`` (arrays of text); one without tokens stays, empty."""
    return F.concat_ws(" ", label.cast("string"), *[F.concat_ws(" ", F.lit(f"|{name}"), tokens_) for name, tokens_ in spaces.items()])


def crossings(spaces: dict[str, Column], interactions: list[tuple[str, ...]]) -> Column:
    """One token per combination of the tokens (arrays of text) of each interaction's namespaces.

    An interaction names two namespaces or more, for instance ("a", "b", "c"); one that is named twice is crossed with
    itself, each set of its tokens once and no token with itself.
    """
    numbered = lambda c: F.transform(c, lambda x, i: F.struct(x.alias("t"), i.alias("i")))

    def crossed(out: Column, other: Column, same: bool) -> Column:
        def one(s):
            both = F.transform(other, lambda x, i: F.struct(F.concat_ws("^", s["t"], x).alias("t"), i.alias("i")))
            return F.filter(both, lambda y: y["i"] > s["i"]) if same else both

        return F.flatten(F.transform(out, one))

    made = []
    for names in interactions:
        out = numbered(spaces[names[0]])
        for before, name in pairwise(names):
            out = crossed(out, spaces[name], before == name)
        made.append(F.transform(out, lambda s: s["t"]))
    return F.concat(*made) if made else F.array().cast("array<string>")


def _named(column: str) -> Column:
    return F.transform(F.coalesce(F.col(column), F.array().cast("array<string>")), lambda x: F.concat(F.lit(f"{column}_"), x.cast("string")))


def hashed_logit(df: DataFrame, columns: list[str], lists: list[str], target: str, interactions: list[tuple[str, ...]] = (), bits: int = 18, max_iter: int = 10, l1: float = 0.0, l2: float = 1e-6) -> DataFrame:
    """``df`` plus prediction: logistic regression on hashed tokens and on crossings of two or more columns.

    Every column and list is a namespace of its own. ``max_iter``: passes over the data; ``l1`` and ``l2``: weights of
    the penalties. Null values have no token; rows with a null target raise.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import HashingTF
    from pyspark.ml.functions import vector_to_array

    spaces = {c: F.array_compact(F.array(F.concat(F.lit(f"{c}_"), F.col(c).cast("string")))) for c in columns}
    spaces |= {c: _named(c) for c in lists}
    named = df.withColumn("_t", F.concat(tokens(columns, lists), crossings(spaces, list(interactions))))
    hashed = HashingTF(inputCol="_t", outputCol="_f", numFeatures=1 << bits, binary=True).transform(named)
    whole = l1 + l2
    model = LogisticRegression(featuresCol="_f", labelCol=target, maxIter=max_iter, regParam=whole, elasticNetParam=l1 / whole if whole else 0.0).fit(hashed)
    return model.transform(hashed).withColumn("_p", vector_to_array("probability")[1]).drop("prediction").withColumn("prediction", F.col("_p")).select(*df.columns, "prediction")
