"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source has the same expected number of copies: the source's target over its size. Whole copies
are certain; the fractional parts are rounded by moving word mass between two documents at random until one of them
is integral, which keeps both each document's expectation and the source's total. Groups of bounded size are rounded
by themselves and leave at most one fractional document each; a reduction tree pairs these until a source has one.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.scratch import Scratch, boxed, ship, unboxed, with_row_id, words

LEAF_ROWS, FAN_IN = 50_000, 64
#: The root of a source draws anew, so many times at most, until its last document's rounding is off by no more than
#: this part of the target; else the nearest draw stands. Only sources of few, uneven documents need it.
CLOSE, REDRAWS = 0.001, 64


def source_targets(sizes: DataFrame, weights: list[float], share: float, most: float) -> DataFrame:
    """One row per source: source_size, weight, target, rows of positive size.

    ``sizes`` has source and size. Sources in code point order, null last, take the weights in turn. The budget is
    ``share`` times all sizes; a target stops at ``most`` times its source's size and the excess goes to the others
    by weight. With sources sorted by cap over weight, those capped are a prefix of that order.
    """
    by = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"), F.sum((F.col("size") > 0).cast("long")).alias("_rows"))
    ranked = by.withColumn("_nth", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("_nth") - 1) % len(weights) + 1).cast("int"))
    capped = ranked.withColumn("weight", weight).withColumn("_cap", F.lit(float(most)) * F.col("source_size"))
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    order = Window.orderBy(F.col("_cap") / F.col("weight"), "_nth")
    here, up_to = order.rowsBetween(Window.unboundedPreceding, -1), F.col("_cap") / F.col("weight")
    level = (F.lit(float(share)) * F.sum("source_size").over(every) - F.coalesce(F.sum("_cap").over(here), F.lit(0.0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(here), F.lit(0.0)))
    # A source is capped if the level that all sources from it on would share is not below its own cap.
    leveled = capped.withColumn("_level", level).withColumn("_ok", F.col("_level") < up_to)
    final = leveled.withColumn("_final", F.min(F.when(F.col("_ok"), F.struct("_nth", "_level"))).over(every))
    first = Window.orderBy(F.col("_cap") / F.col("weight"), "_nth").rowsBetween(Window.unboundedPreceding, 0)
    free = F.max(F.col("_ok").cast("int")).over(first) == 1
    share_level = F.first(F.when(F.col("_ok"), F.col("_level")), ignorenulls=True).over(first)
    return final.select("source", "source_size", "weight", "_rows", "_nth", F.when(free, F.least(F.col("_cap"), F.col("weight") * share_level)).otherwise(F.col("_cap")).alias("target"))


def pivotal(size: np.ndarray, prob: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Probabilities after the moves: all 0 or 1 but at most one. The sum of size times probability is kept."""
    p, w, u = prob.tolist(), size.tolist(), rng.random(len(prob)).tolist()
    held = -1
    for i in range(len(p)):
        if not 0.0 < p[i] < 1.0:
            continue
        if held < 0:
            held = i
            continue
        a, b, wa, wb = p[held], p[i], w[held], w[i]
        to_held, room, to_new, left = b * wb, (1 - a) * wa, (1 - b) * wb, a * wa
        up, down = min(to_held, room), min(left, to_new)
        if u[i] * (up + down) < down:
            p[held] = 1.0 if room <= to_held else a + up / wa
            p[i] = 0.0 if to_held <= room else b - up / wb
        else:
            p[held] = 0.0 if left <= to_new else a - down / wa
            p[i] = 1.0 if to_new <= left else b + down / wb
        if not 0.0 < p[held] < 1.0:
            held = i if 0.0 < p[i] < 1.0 else -1
    return np.asarray(p)


def off(size: np.ndarray, prob: np.ndarray, drawn: np.ndarray) -> float:
    """Words that a drawn group has too many."""
    return float(np.dot(size, drawn - prob))


def _round_groups(seed: int, level: int):
    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "_key", "_row"], ascending=[False, True, True], kind="stable")
        rng = np.random.default_rng([seed, level, int(pdf["_nth"].iloc[0]), int(pdf["_chunk"].iloc[0])])
        size, prob = pdf["size"].to_numpy(), pdf["_p"].to_numpy()
        p = pivotal(size, prob, rng)
        if int(pdf["_chunks"].iloc[0]) == 1:  # the root rounds the last one to the nearer side
            best = np.rint(p)
            near = CLOSE * float(pdf["target"].iloc[0])
            for _ in range(REDRAWS):
                if abs(off(size, prob, best)) <= near:
                    break
                again = np.rint(pivotal(size, prob, rng))
                if abs(off(size, prob, again)) < abs(off(size, prob, best)):
                    best = again
            p = best
        pdf["_p"] = p
        pdf["_chunk"] //= FAN_IN
        pdf["_chunks"] = -(-pdf["_chunks"] // FAN_IN)
        return pdf

    return work


def mix_copies(items: DataFrame, weights: list[float] = (3.0, 1.0, 2.0), share: float = 1.5, most: float = 2.0, seed: int = 42, scratch: Scratch | None = None) -> DataFrame:
    """``items`` (_row, _key, source, size, ...) plus source_size, target, and ``copies`` (int): how often the mix takes the row.

    Rows of null or zero size add nothing to a source and get 0 copies. A source takes its target in words but for
    at most one rounded row. An empty table gives no rows. ``_key`` is a hash of a row's content: the draw depends on
    the seed and on it alone, so reruns agree however the table is split into files and tasks. Rows of one _key are
    alike, and it does not matter which of them is taken; only where more than LEAF_ROWS of them repeat are they dealt
    by _row, and the number taken of them may differ by a few between splits.
    """
    spark = items.sparkSession
    ship(spark)
    scratch = scratch or Scratch(spark, "mixing")
    items = scratch.keep(items.withColumn("size", F.coalesce(F.col("size"), F.lit(0)).cast("long")))
    targets = scratch.keep(source_targets(items, list(weights), share, most))
    joined = items.join(targets.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source", "weight")
    mean = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = joined.withColumn("_whole", F.when(F.col("size") > 0, F.floor(mean)).otherwise(0).cast("int")).withColumn("_p", F.when(F.col("size") > 0, mean - F.floor(mean)).otherwise(0.0))
    many = items.groupBy("_key").agg(F.count("*").alias("_n")).filter(F.col("_n") > LEAF_ROWS).select("_key", F.lit(True).alias("_many"))
    salt = F.lit(0)
    if not many.isEmpty():
        rows, salt = rows.join(many, "_key", "left"), F.when(F.col("_many"), F.col("_row")).otherwise(F.lit(0))
    rows = rows.withColumn("_chunks", F.ceil(F.greatest(F.col("_rows"), F.lit(1)) / LEAF_ROWS).cast("long")).withColumn("_chunk", F.pmod(F.xxhash64("_key", salt.cast("long")), F.col("_chunks"))).drop("_rows", "_many")
    is_open = (F.col("_p") > 0) & (F.col("_p") < 1)
    out, level = [rows.filter(~is_open)], 0
    todo = rows.filter(is_open)
    most_chunks = max(1, math.ceil((targets.agg(F.max("_rows")).first()[0] or 0) / LEAF_ROWS))
    while True:
        done = scratch.keep(todo.groupBy("_nth", "_chunk").applyInPandas(_round_groups(seed, level), todo.schema))
        out.append(done.filter(~is_open))
        if most_chunks == 1:
            break
        todo, most_chunks, level = done.filter(is_open), math.ceil(most_chunks / FAN_IN), level + 1
    result = out[0]
    for part in out[1:]:
        result = result.unionByName(part)
    return result.withColumn("copies", (F.col("_whole") + F.col("_p")).cast("int")).drop("_whole", "_p", "_nth", "_chunk", "_chunks", "_key")


def _items(documents: DataFrame, *extra: str) -> DataFrame:
    key = F.xxhash64(F.col("doc_id").isNull(), F.col("doc_id"), F.col("source").isNull(), F.col("source"), F.col("text").isNull(), F.col("text"))
    return documents.select("_row", key.alias("_key"), *extra, F.col("source"), F.size(words(F.col("text"))).cast("long").alias("size"))


def mix_digest(documents: DataFrame, seed: int = 42) -> DataFrame:
    """One row per document: its size, its source's size and target, and the words that the mix takes of it.

    Null and empty texts have size 0 and are not taken; a null source is a source, and a null doc_id is kept; repeated
    rows are documents of their own; texts of any length are counted whole; an empty table gives no rows.
    """
    scratch = Scratch(documents.sparkSession, "mixing")
    mixed = mix_copies(_items(with_row_id(documents.select("doc_id", "source", "text"), scratch), "doc_id"), seed=seed, scratch=scratch)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")


def mix_documents(documents: DataFrame, seed: int = 42) -> DataFrame:
    """``documents`` as the mix has them: each row as often as it is taken, with the same columns.

    Nulls, empties, repeats and ties: as in ``mix_digest``. Columns of any name pass through unchanged.
    """
    scratch = Scratch(documents.sparkSession, "mixing")
    docs = boxed(documents, scratch)
    items = _items(docs.select("_row", "_doc.doc_id", "_doc.source", "_doc.text"))
    copies = mix_copies(items, seed=seed, scratch=scratch).filter("copies > 0").select("_row", "copies")
    return unboxed(docs.join(copies, "_row").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))), documents)
