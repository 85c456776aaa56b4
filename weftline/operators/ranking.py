"""Ranking features, top lists and ranking metrics."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType

from weftline.functions.text import smoothed

#: Pairs of rows that a task holds at a time.
PAIRS = 1 << 19


def ratio_features(stats: DataFrame, prefix: str = "") -> DataFrame:
    """Click-through rates of statistics as made by click_stats; a ratio with nothing below is null."""
    out = stats.withColumn(f"{prefix}ctr", F.try_divide("clicks", "shows")).withColumn(f"{prefix}smooth_ctr", smoothed(F.col("clicks"), F.col("shows")))
    for i in range(1, 6):
        out = out.withColumn(f"{prefix}ctr_pos{i}", F.try_divide(f"pos{i}_clicks", f"pos{i}_shows"))
    if "cascade_shows" in stats.columns:
        out = out.withColumn(f"{prefix}cascade_ctr", F.try_divide("cascade_clicks", "cascade_shows")).withColumn(f"{prefix}dbn_attract", smoothed(F.col("dbn_clicks"), F.col("dbn_shows"))).withColumn(f"{prefix}dbn_satisfy", smoothed(F.col("dbn_satisfied"), F.col("dbn_clicks")))
    return out


def assemble(base: DataFrame, parts: list[tuple[DataFrame, list[str], str]]) -> DataFrame:
    """``base`` with the columns of each part (frame, join keys, prefix) joined on the left."""
    for part, keys, prefix in parts:
        named = part.select(*keys, *[F.col(c).alias(prefix + c) for c in part.columns if c not in keys])
        base = base.join(named, keys, "left")
    return base


def top_k(df: DataFrame, group: str, score: str, tie: str, k: int = 5) -> DataFrame:
    """The k best rows of each group with their place from 1."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(score), tie))).filter(F.col("place") <= k)


def pad_top_k(top: DataFrame, groups: DataFrame, spare: DataFrame, group: str, item: str, k: int = 5) -> DataFrame:
    """``top`` (group, item, place) with groups that have fewer than k filled by spare items that they do not hold.

    Only the k * 2 first spare items can be needed, so these alone are broadcast. Of them a group takes the first in
    order.
    """
    few = spare.select(item).distinct().orderBy(item).limit(2 * k)
    have = groups.select(group).distinct().join(top.groupBy(group).agg(F.count("*").alias("_n")), group, "left").filter(F.coalesce("_n", F.lit(0)) < k).select(group, F.coalesce("_n", F.lit(0)).alias("_n"))
    free = have.crossJoin(F.broadcast(few)).join(top.select(group, item), [group, item], "left_anti")
    filled = free.withColumn("place", (F.col("_n") + F.row_number().over(Window.partitionBy(group).orderBy(item))).cast("int")).filter(F.col("place") <= k)
    return top.select(group, item, "place").unionByName(filled.select(group, item, "place"))


def dcg(df: DataFrame, group: str, score: str, label: str, tie: str, k: int | None = None) -> DataFrame:
    """group, dcg, idcg with gains 2^label - 1 and natural logarithms of the place plus one."""
    w = Window.partitionBy(group)
    ranked = df.withColumn("_p", F.row_number().over(w.orderBy(F.desc(score), tie))).withColumn("_i", F.row_number().over(w.orderBy(F.desc(label), tie)))

    def gain(place: str):
        g = (F.pow(F.lit(2.0), F.col(label)) - 1) / F.log(F.col(place) + 1.0)
        return F.sum(F.when(F.col(place) <= k, g).otherwise(0.0) if k else g)

    return ranked.groupBy(group).agg(gain("_p").alias("dcg"), gain("_i").alias("idcg"))


def rmse(df: DataFrame, truth: str, prediction: str) -> DataFrame:
    return df.agg(F.sqrt(F.avg(F.pow(F.col(prediction) - F.col(truth), F.lit(2.0)))).alias("rmse"))


def log_loss(df: DataFrame, truth: str, probability: str, edge: float = 1e-15) -> DataFrame:
    p = F.least(F.greatest(F.col(probability), F.lit(edge)), F.lit(1 - edge))
    return df.agg((-F.avg(F.col(truth) * F.log(p) + (1 - F.col(truth)) * F.log(1 - p))).alias("log_loss"))


def mse(df: DataFrame, truth: str, prediction: str) -> DataFrame:
    return df.agg(F.avg(F.pow(F.col(prediction) - F.col(truth), F.lit(2.0))).alias("mse"))


def _slopes(group: str, label: str, score: str, most: float, absolute: bool, top: int | None):
    """Batches sorted by group, falling score and item to the same with grad, hess and whether a row is in a pair."""
    at_once = PAIRS

    def of_groups(rows: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        n = rows.num_rows
        sizes = np.diff([*starts, n])
        first = np.repeat(starts, sizes)
        place = np.arange(n) - first
        s, y = (rows.column(c).combine_chunks().cast(pa.float64()).to_numpy(zero_copy_only=False) for c in (score, label))
        gain = 2.0**y - 1
        best = np.nan_to_num(gain[np.lexsort((-y, first))])
        if top is None:
            ideal, weight = np.add.reduceat(best / np.log2(place + 2.0), starts), 1 / np.log2(place + 2.0)
        else:
            ideal = np.add.reduceat(np.where(place < top, best / np.log(place + 2.0), 0.0), starts)
            ideal[ideal == 0] = 1.0
            weight = np.where(place < top, 1 / np.log2(place + 2.0), 0.0)
        ideal = np.repeat(ideal, sizes)
        grad, hess, pairs = np.zeros(n), np.zeros(n), np.zeros(n)
        # each row with those below it in its group; with ``top`` only rows of the first places
        below = first + np.repeat(sizes, sizes) - np.arange(n) - 1
        if top is not None:
            below[place >= top] = 0
        upto, at = np.cumsum(below), 0
        while at < n:
            end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + at_once, "right")))
            count = below[at:end]
            i = np.repeat(np.arange(at, end), count)
            j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count)
            some = (y[i] > y[j]) | (y[i] < y[j])
            i, j = i[some], j[some]
            if len(i):
                sign = np.where(y[i] > y[j], 1.0, -1.0)
                apart = (s[i] - s[j]) * sign
                gap = np.minimum(np.abs(apart), most) if absolute else np.clip(apart, -most, most)
                rho = 1 / (1 + np.exp(np.where(np.isnan(gap), most, gap)))
                delta = np.abs((gain[i] - gain[j]) * (weight[i] - weight[j])) / ideal[i]
                pull, bend = sign * rho * delta, rho * (1 - rho) * delta
                last = int(j.max()) + 1
                for rows_of, way in ((i, 1.0), (j, -1.0)):
                    grad[at:last] += np.bincount(rows_of - at, way * pull, last - at)
                    hess[at:last] += np.bincount(rows_of - at, bend, last - at)
                    pairs[at:last] += np.bincount(rows_of - at, minlength=last - at)
            at = end
        made = [pa.array(grad), pa.array(hess), pa.array(pairs > 0)]
        return pa.RecordBatch.from_arrays([*(c.combine_chunks() for c in rows.columns), *made], [*rows.column_names, "grad", "hess", "_in"])

    def work(batches):
        held, last = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column(group)
            edge = other(key.slice(1), key.slice(0, len(key) - 1)) if len(key) > 1 else np.zeros(0, bool)
            begins = held and other(key[:1], last)[0]
            cuts = np.flatnonzero(edge) + 1
            if begins:
                cuts = np.concatenate([[0], cuts])
            last = key[-1:]
            if len(cuts):
                whole = pa.Table.from_batches([*(b for b, _ in held), batch.slice(0, int(cuts[-1]))])
                before = sum(b.num_rows for b, _ in held)
                starts = np.concatenate([*(st + sum(b.num_rows for b, _ in held[:k]) for k, (_, st) in enumerate(held)), ([] if held else [0]), before + cuts[:-1]]).astype(int)
                yield of_groups(whole, starts)
                held = [(batch.slice(int(cuts[-1])), np.zeros(1, int))]
            else:
                held.append((batch, np.zeros(0 if held else 1, int)))
        if held:
            yield of_groups(pa.Table.from_batches([b for b, _ in held]), np.zeros(1, int))

    def other(a: pa.Array, b: pa.Array) -> np.ndarray:
        """Where groups differ; a row without a group is alone."""
        return pc.fill_null(pc.not_equal(a, b), True).to_numpy(zero_copy_only=False)

    return work


def with_slopes(df: DataFrame, group: str, item: str, score: str, label: str, most: float = 50.0, absolute: bool = False, top: int | None = None) -> DataFrame:
    """``df`` plus grad, hess (0 without a pair) and _in, whether a row is in a pair; see ``lambda_gradients``.

    Rows are dealt and sorted by group once. A group's rows are one task's work, but its pairs come ``PAIRS`` at a time.
    """
    # rows without a group are in no pair and are dealt by item
    dealt = df.repartition(F.col(group), F.when(F.col(group).isNull(), F.col(item))).sortWithinPartitions(group, F.desc(score), item)
    made = StructType([*df.schema.fields, StructField("grad", DoubleType()), StructField("hess", DoubleType()), StructField("_in", BooleanType())])
    return dealt.mapInArrow(_slopes(group, label, score, most, absolute, top), made)


def lambda_gradients(df: DataFrame, group: str, item: str, score: str, label: str, most: float = 50.0, absolute: bool = False, top: int | None = None, unit_hessian: bool = False) -> DataFrame:
    """group, item, grad, hess of the pairwise ranking loss weighted by the change of normalised gain.

    The better document of a pair pulls up, the worse down; pairs of equal labels are none. Differences of scores stop
    at ``most``; ``absolute``: their size alone counts. ``top``: only so many first places weigh, and the ideal gain is
    that of as many documents, with natural logarithms and 0 read as 1; pairs then hold one of those places, so a group
    of any size has a number of pairs in proportion to it. Without ``top`` every pair of a group counts, which is for
    groups of bounded size. ``unit_hessian``: a row without curvature has 1. Only rows that are in a pair are returned,
    but all of them with ``unit_hessian``.
    """
    found = with_slopes(df.select(group, item, score, label), group, item, score, label, most, absolute, top)
    sums = (found if unit_hessian else found.filter("_in")).groupBy(group, item).agg(F.sum("grad").alias("grad"), F.sum("hess").alias("hess"))
    return sums.withColumn("hess", F.when(F.col("hess") == 0, F.lit(1.0)).otherwise(F.col("hess"))) if unit_hessian else sums
