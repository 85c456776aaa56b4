"""Approximate nearest neighbours by cosine: inverted file, product-quantised residuals, exact reranking.

Unit vectors are dealt to the nearest of some coarse centroids; what is left is cut into sub-vectors and each is coded
by its nearest codeword. A query looks into the lists of its nearest centroids and adds up table entries of inner
products with codewords (asymmetric distances), without decoding. A row's distance from its decoded vector bounds how
far such a sum can be off, so every row that may be among the k nearest of the lists looked into is known and ranked by
the exact measure on the original vectors, however many there are: members of a dense group, closer to each other than
codewords are, all are.

Centroids, codewords and the number of lists to look into are fitted on a bounded sample (TRAIN_ROWS, or LIST_ROWS for
each list if that is more; MOST_LISTS bounds both); every row is indexed. Lists number the root of the rows, so a search
of every fiftieth row does work in proportion to rows to the power 1.5 (linear in rows per query above MOST_LISTS ** 2). A query looks into as many lists as hold PROBE_RECALL of the sample's own nearest neighbours: few where
vectors form clusters, many where they do not. Lists are dealt to groups of bounded size by their counted rows, small
ones together and large ones over several, so a vector that fills a third of the table is searched in many tasks; a group
that very many queries look into meets them in parts of bounded size.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.scratch import Scratch, ship

#: Rows of the sample, those of a list in it at least, coarse centroids at most, sub-vectors at most, codewords of each.
TRAIN_ROWS, LIST_ROWS, MOST_LISTS, SUBVECTORS, CODEWORDS = 50_000, 12, 65_536, 16, 256
#: Share of the sample's neighbours that must lie in the lists looked into, and sample queries for that.
PROBE_RECALL, PROBE_QUERIES = 0.98, 400
#: Rows of a group that is searched at once, and queries; slack of sums in double precision.
GROUP_ROWS, GROUP_QUERIES, SLACK = 16_384, 8_192, 1e-9


def usable(v: Column) -> Column:
    """Neither null nor zero, every component present and finite."""
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & F.coalesce(ok, F.lit(False)) & F.exists(v, lambda x: x != 0)


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """Centroids (at most k; fewer if there are fewer different rows)."""
    own = np.unique(x, axis=0)
    if len(own) <= k:
        return own
    c = own[rng.choice(len(own), k, replace=False)]
    for _ in range(rounds):
        near = nearest(x, c)
        count = np.bincount(near, minlength=len(c))
        total = np.stack([np.bincount(near, weights=x[:, d], minlength=len(c)) for d in range(x.shape[1])], axis=1)
        c = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], c)
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    half = (c * c).sum(axis=1) / 2
    return np.concatenate([np.argmax(x[i : i + 4096] @ c.T - half, axis=1) for i in range(0, len(x), 4096)]) if len(x) else np.empty(0, np.int64)


class Index:
    """Centroids (lists x dim) and codebooks (one per sub-vector)."""

    def __init__(self, sample: np.ndarray, lists: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.dim = sample.shape[1]
        self.parts = max(m for m in range(1, min(SUBVECTORS, self.dim) + 1) if self.dim % m == 0)
        self.centroids = kmeans(sample, lists, rng)
        rest = sample - self.centroids[nearest(sample, self.centroids)]
        w = self.dim // self.parts
        self.books = [kmeans(rest[:, j * w : (j + 1) * w], CODEWORDS, rng) for j in range(self.parts)]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """List, codes (uint8 per sub-vector) and distance from the decoded vector of unit vectors."""
        where = nearest(x, self.centroids)
        rest, w = x - self.centroids[where], self.dim // self.parts
        codes = np.stack([nearest(rest[:, j * w : (j + 1) * w], b) for j, b in enumerate(self.books)], axis=1).astype(np.uint8)
        return where, codes, np.linalg.norm(rest - np.hstack([b[codes[:, j]] for j, b in enumerate(self.books)]), axis=1)

    def probes(self, q: np.ndarray) -> np.ndarray:
        """All lists for each query, the nearest centroid first."""
        half = (self.centroids**2).sum(axis=1) / 2
        return np.argsort(-(q @ self.centroids.T - half), axis=1, kind="stable")

    def probes_needed(self, sample: np.ndarray, k: int) -> int:
        """Lists to look into for PROBE_RECALL of the k nearest within the sample."""
        q = np.unique(np.linspace(0, len(sample) - 1, PROBE_QUERIES).astype(int))
        ranks = []
        place, where = np.argsort(self.probes(sample[q]), axis=1), nearest(sample, self.centroids)
        for one, at in zip(q, place, strict=True):
            near = sample @ sample[one]
            near[one] = -np.inf
            ranks += at[where[np.argsort(-near)[:k]]].tolist()
        return int(np.quantile(ranks, PROBE_RECALL, method="higher")) + 1

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Inner products of a query's sub-vectors with all codewords: parts x CODEWORDS."""
        w = self.dim // self.parts
        out = np.zeros((self.parts, CODEWORDS))
        for j, b in enumerate(self.books):
            out[j, : len(b)] = b @ q[j * w : (j + 1) * w]
        return out


def _raw(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two each, so that the greatest component is from 0.5 to 1: no square overflows or vanishes.

    Such factors change no digit, so cosines are those of the original vectors.
    """
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def _unit(x: np.ndarray) -> np.ndarray:
    x = _scaled(x)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _indexing(index: Index):
    def work(batches):
        for batch in batches:
            if batch.num_rows:
                x = _raw(batch.column(1))
                where, codes, off = index.encode(_unit(x))
                columns = [batch.column(0), pa.array(where.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(off), pa.array([y.tobytes() for y in x], pa.binary()), batch.column(2)]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "list", "codes", "off", "v", "_ask"])

    return work


def _probing(index: Index, n: int, base: np.ndarray, spread: np.ndarray):
    """A row per query and group of lists: the query's vector and those of its lists that the group holds."""

    def work(batches):
        for batch in batches:
            out: list[list] = [[], [], [], []]
            vectors = batch.column(1).to_pylist()
            x = _unit(np.frombuffer(b"".join(vectors)).reshape(len(vectors), -1)) if vectors else np.empty((0, index.dim))
            for query_id, q, lists in zip(batch.column(0).to_pylist(), vectors, index.probes(x)[:, :n], strict=True):
                by: dict[int, list[int]] = {}
                for one in lists.tolist():
                    for g in range(base[one], base[one] + spread[one]):
                        by.setdefault(g, []).append(one)
                for g, some in by.items():
                    for to, y in zip(out, (query_id, g, q, np.array(sorted(some), np.int32).tobytes()), strict=True):
                        to.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(out, (pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["query_id", "grp", "q", "lists"])

    return work


def _dot(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of the last axis, added in its order: equal vectors have equal ones wherever they stand."""
    out = np.zeros(np.broadcast_shapes(x.shape, y.shape)[:-1])
    for j in range(x.shape[-1]):
        out = out + x[..., j] * y[..., j]
    return out


def _searching(index: Index, k: int):
    """The k nearest of each query among the rows of a group that lie in its lists, with exact scores."""

    def work(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows) and len(queries):
            rows = rows.sort_values(["list", "vec_id"])
            ids, of, off = (rows[c].to_numpy() for c in ("vec_id", "list", "off"))
            codes = np.frombuffer(b"".join(rows["codes"]), np.uint8).reshape(len(ids), -1).astype(np.intp) + np.arange(index.parts) * CODEWORDS
            raw = np.frombuffer(b"".join(rows["v"])).reshape(len(ids), -1)
            unit, raw = _unit(raw), _scaled(raw)
            for query_id, q, lists in zip(queries["query_id"].to_numpy(), queries["q"], queries["lists"], strict=True):
                q, lists = np.frombuffer(q), np.frombuffer(lists, np.int32)
                u, q = _unit(q[None])[0], _scaled(q[None])[0]
                look = np.concatenate([np.arange(a, b) for a, b in zip(np.searchsorted(of, lists, "left"), np.searchsorted(of, lists, "right"), strict=True)])
                look = look[ids[look] != query_id]
                near = (index.centroids @ u)[of[look]] + index.tables(u).ravel()[codes[look]].sum(axis=1)
                may = look[near + off[look] >= _kth(near - off[look], k) - SLACK]
                score = unit[may] @ u
                may = may[score >= _kth(score, k) - SLACK]
                score = np.clip(_dot(raw[may], q) / (np.sqrt(_dot(q, q)) * np.sqrt(_dot(raw[may], raw[may]))), -1, 1)
                best = np.lexsort((ids[may], -score))[:k]
                out.append(pd.DataFrame({"query_id": query_id, "vec_id": ids[may[best]], "score": score[best]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": np.empty(0, np.int64), "vec_id": np.empty(0, np.int64), "score": np.empty(0)})

    return work


def _kth(x: np.ndarray, k: int) -> float:
    """The k-th largest; without so many, less than all."""
    return np.partition(x, len(x) - k)[len(x) - k] if len(x) >= k else -np.inf


def _groups(counts: dict[int, int], lists: int) -> tuple[np.ndarray, np.ndarray]:
    """First group and number of groups of each list: a large list has its own, small ones share one."""
    base, spread = np.zeros(lists, int), np.zeros(lists, int)
    at, held = -1, GROUP_ROWS
    for one in sorted(counts):
        n = counts[one]
        if n > GROUP_ROWS:
            spread[one] = math.ceil(n / GROUP_ROWS)
            base[one] = at + 1
            at, held = at + int(spread[one]), GROUP_ROWS
        else:
            if held + n > GROUP_ROWS:
                at, held = at + 1, 0
            held += n
            base[one], spread[one] = at, 1
    return base, spread


def nearest_neighbours(vectors: DataFrame, queries: Column, k: int = 5, scratch: Scratch | None = None) -> DataFrame:
    """The k nearest of each query row: query_id, rank (int, from 1), vec_id, score (cosine in double precision).

    ``vectors`` has vec_id and embedding; ``queries`` tells which of its rows are queries. Rows with a null vec_id, or a
    vector that is null, zero, holds null or non-finite components or has not the most common length (the lesser, if
    equally common), take no part. Rows of one vec_id are one candidate, by their first vector in scan order of values;
    a query is never its own candidate. Ties go to the smaller vec_id. Without vectors there are no rows.
    """
    spark = vectors.sparkSession
    ship(spark)
    scratch = scratch or Scratch(spark, "ann")
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), F.coalesce(queries, F.lit(False)).alias("_ask")).filter(F.col("vec_id").isNotNull() & usable(F.col("v")))
    sizes = v.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    empty = "query_id long, rank int, vec_id long, score double"
    if sizes is None:
        return spark.createDataFrame([], empty)
    v = scratch.keep(v.filter(F.size("v") == sizes["d"]).groupBy("vec_id").agg(F.min("v").alias("v"), F.max("_ask").alias("_ask")))
    n = v.count()
    lists = max(1, min(MOST_LISTS, math.isqrt(n)))
    fit = max(TRAIN_ROWS, LIST_ROWS * lists)
    sample = v.filter(F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(math.ceil(n / fit))) == 0).select("vec_id", "v").orderBy("vec_id").limit(2 * fit).toArrow()
    sample = _unit(_raw(sample.column(1).combine_chunks()))
    index = Index(sample, lists)
    lists = len(index.centroids)
    coded = scratch.keep(v.select("vec_id", "v", "_ask").mapInArrow(_indexing(index), "vec_id long, list int, codes binary, off double, v binary, _ask boolean"))
    scratch.drop(v)
    counts = {r["list"]: r["count"] for r in coded.groupBy("list").count().collect()}  # a row per list, at most MOST_LISTS
    base, spread = _groups(counts, lists)
    where = spark.createDataFrame([(one, int(base[one]), int(spread[one])) for one in counts], "list int, base int, spread int")
    rows = coded.join(F.broadcast(where), "list").select("vec_id", "list", "codes", "off", "v", (F.col("base") + F.pmod(F.xxhash64("vec_id"), F.col("spread"))).cast("int").alias("grp"))
    asked = scratch.keep(coded.filter("_ask").select("vec_id", "v").mapInArrow(_probing(index, index.probes_needed(sample, k), base, spread), "query_id long, grp int, q binary, lists binary"))
    # A group that many queries look into is searched once for each part of them.
    parts = asked.groupBy("grp").agg(F.ceil(F.count("*") / GROUP_QUERIES).cast("int").alias("_parts"))
    rows = rows.join(parts, "grp").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    asked = asked.join(parts, "grp").withColumn("part", F.pmod(F.xxhash64("query_id"), F.col("_parts")).cast("int")).drop("_parts")
    found = rows.groupBy("grp", "part").cogroup(asked.groupBy("grp", "part")).applyInPandas(_searching(index, k), "query_id long, vec_id long, score double")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
