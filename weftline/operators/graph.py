"""Link analysis on edge tables (src, dst) in which repeated edges weigh as often as they stand.

A step is one join of the edges, which carry their source's out-degree, with the narrow ranks, and one aggregation with
partial sums. The narrow scores are checkpointed to the shared folder after every step, so a step's plan has the same
size however many came before it, and a lost executor costs one step at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.shared import cut

def vertices(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("id")).union(edges.select(F.col("dst").alias("id"))).distinct()


def out_degree(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src").agg(F.count("*").alias("degree"))


def dangling(edges: DataFrame) -> DataFrame:
    return vertices(edges).join(edges.select(F.col("src").alias("id")).distinct(), "id", "left_anti")


def pagerank(edges: DataFrame, alpha: float = 0.9, steps: int = 5, dangling_self: bool = True, tolerance: float | None = None, n_vertices: int | None = None) -> DataFrame:
    """(id, rank) after ``steps``, or earlier if all vertices move by less than ``tolerance`` of their rank.

    ``dangling_self``: mass of vertices without links is shared by all; otherwise a vertex gets none of its own. Ranks
    sum to 1 unless ``n_vertices`` overrides the count. Edges with a null end are left out; an edge table without rows
    gives none.
    """
    return pagerank_counted(edges, alpha, steps, dangling_self, tolerance, n_vertices)[0]


def pagerank_counted(edges: DataFrame, alpha: float = 0.9, steps: int = 5, dangling_self: bool = True, tolerance: float | None = None, n_vertices: int | None = None) -> tuple[DataFrame, int]:
    """As ``pagerank``, with the number of steps that were made."""
    edges = edges.filter("src IS NOT NULL AND dst IS NOT NULL")
    # Repeated edges are summed up once: the edge list of the loop has a weight instead.
    degree = out_degree(edges)
    weighted = edges.groupBy("src", "dst").agg(F.count("*").alias("_k")).join(degree, "src").select("src", "dst", (F.col("_k") / F.col("degree")).alias("_w"))
    weighted = cut(weighted)
    ids = cut(vertices(edges).join(degree.select(F.col("src").alias("id"), F.lit(False).alias("_hangs")), "id", "left").select("id", F.coalesce("_hangs", F.lit(True)).alias("_hangs")))
    n = n_vertices or ids.count()
    if not n:
        return ids.select("id", F.lit(0.0).alias("rank")), 0
    ranks = ids.withColumn("rank", F.lit(1.0 / n))
    for step in range(1, steps + 1):
        lost = ranks.agg(F.coalesce(F.sum(F.when(F.col("_hangs"), F.col("rank"))), F.lit(0.0)).alias("_d"))
        got = weighted.join(ranks.select(F.col("id").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") * F.col("_w")).alias("_in"))
        if dangling_self or n == 1:
            share = F.col("_d") / n
        else:
            share = F.when(F.col("_hangs"), (F.col("_d") - F.col("rank")) / (n - 1)).otherwise(F.col("_d") / (n - 1))
        new = (1 - alpha) / n + alpha * (F.coalesce("_in", F.lit(0.0)) + share)
        after = ranks.join(got, "id", "left").crossJoin(F.broadcast(lost)).select("id", "_hangs", F.col("rank").alias("_old"), new.alias("rank"))
        after = cut(after)
        ranks = after.drop("_old")
        if tolerance is not None and after.filter(F.abs(F.col("rank") - F.col("_old")) >= tolerance * F.col("_old")).isEmpty():
            return ranks.select("id", "rank"), step
    return ranks.select("id", "rank"), steps


def hits(edges: DataFrame, steps: int = 3, start: float = 1e-7, normalize: bool = False) -> DataFrame:
    """(id, authority, hub); both are updated from the scores of the step before. ``normalize``: to sum 1 at the end."""
    edges = cut(edges.filter("src IS NOT NULL AND dst IS NOT NULL").groupBy("src", "dst").agg(F.count("*").cast("double").alias("_k")))
    scores = cut(vertices(edges)).select("id", F.lit(start).alias("authority"), F.lit(start).alias("hub"))
    ids = scores.select("id")
    for _ in range(steps):
        a = edges.join(scores.select(F.col("id").alias("src"), "hub"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("hub") * F.col("_k")).alias("authority"))
        h = edges.join(scores.select(F.col("id").alias("dst"), "authority"), "dst").groupBy(F.col("src").alias("id")).agg(F.sum(F.col("authority") * F.col("_k")).alias("hub"))
        scores = ids.join(a, "id", "left").join(h, "id", "left").select("id", F.coalesce("authority", F.lit(0.0)).alias("authority"), F.coalesce("hub", F.lit(0.0)).alias("hub"))
        scores = cut(scores)
    if normalize:
        total = scores.agg(F.sum("authority").alias("_a"), F.sum("hub").alias("_h"))
        scores = scores.crossJoin(F.broadcast(total)).select("id", F.try_divide("authority", "_a").alias("authority"), F.try_divide("hub", "_h").alias("hub"))
    return scores
