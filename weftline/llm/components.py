"""Connected components of a link table by alternating stars; where a caller allows it, a bounded number by one task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.scratch import Scratch, ship

#: Rows of a batch that goes back to Spark.
BATCH = 1 << 16


def _min_of(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("_m"))


def least_reached(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the links (u, v), ascending, and the smallest node that each reaches."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while True:
        ra, rb = root[a], root[b]
        apart = ra != rb
        if not apart.any():
            return nodes, nodes[root]
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while not np.array_equal(up := root[root], root):
            root = up


def _at_once(batches):
    links = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches if b.num_rows]
    if not links:
        return
    nodes, least = least_reached(*(np.concatenate(x) for x in zip(*links, strict=True)))
    for k in range(0, len(nodes), BATCH):
        yield pa.RecordBatch.from_arrays([pa.array(x[k : k + BATCH]) for x in (nodes, least)], ["node", "component"])


def connected_components(edges: DataFrame, scratch: Scratch, at_once: int = 0) -> DataFrame:
    """``edges`` (u long, v long) to (node, component): the smallest node that each linked node reaches.

    Self links and repeated links are allowed; rows with a null end are ignored. Only nodes with a link to another
    node are returned. Each half round is an aggregation with partial minima and a join on the node, so a node with
    very many links is split by the adaptive skew join. The number of rounds grows with the logarithm of the size.
    Up to ``at_once`` distinct links are held by a single task instead, which writes one file where each round writes
    two tables of as many files as there are shuffle partitions; either way gives the same rows.
    """
    e = edges.filter(F.col("u").isNotNull() & F.col("v").isNotNull() & (F.col("u") != F.col("v")))
    e = scratch.keep(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    if at_once and e.count() <= at_once:
        ship(edges.sparkSession)
        return scratch.keep(e.coalesce(1).mapInArrow(_at_once, "node long, component long"))
    seen = None
    while True:
        # Large star: every neighbour above a node is tied to the least of the node's neighbourhood.
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = _min_of(both).withColumn("_m", F.least("_m", "u"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("_m").alias("v")).filter("u <> v").distinct()
        # Small star: a node and its lesser neighbours are tied to the least of them. Every row has u > v.
        large = scratch.keep(large)
        tied = large.join(_min_of(large), "u").filter("v <> _m").select(F.col("v").alias("u"), F.col("_m").alias("v"))
        own = _min_of(large).select("u", F.col("_m").alias("v"))
        small = scratch.keep(tied.unionByName(own).distinct())
        scratch.drop(e, large)
        now = small.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        e = small
        if now == seen:
            break
        seen = now
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
