"""Similarity of word lists by word vectors, which come as a table (word, vector); no model is part of this."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the distance of a pair of which a side has no known word.
FAR = 1_000_000.0
#: Vectors of so many bytes at most are broadcast.
VECTOR_BYTES = 64 << 20


def _known(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """pair_id, side, word and vector of the known words, and per pair a row of side -1; rows of a pair stand together.

    Vectors of up to ``VECTOR_BYTES`` in all are broadcast, so that words stay where their pairs are and no vector moves.
    Larger tables are joined by word, and a vector then moves once per word, as it is.
    """
    words = lambda side, n: F.transform(F.coalesce(F.col(side), F.array().cast("array<string>")), lambda w: F.struct(F.lit(n).alias("side"), w.alias("word")))
    # a word of its own per pair, so that these rows do not meet in one task
    mark = F.array(F.struct(F.lit(-1).alias("side"), F.concat(F.lit("\0"), F.col("pair_id").cast("string")).alias("word")))
    each = pairs.select("pair_id", F.explode(F.concat(mark, words("a", 0), words("b", 1))).alias("_w")).select("pair_id", "_w.side", "_w.word")
    wide = {"float": 4}.get(dict(vectors.dtypes)["vector"][6:-1], 8)
    size = vectors.agg(F.sum(F.greatest(F.size("vector"), F.lit(0)) * wide + F.octet_length("word") + 64)).first()[0] or 0
    small = size <= VECTOR_BYTES
    vectors = vectors.select("word", "vector")
    joined = each.join(F.broadcast(vectors) if small else vectors, "word", "left").filter("side < 0 OR vector IS NOT NULL").select("pair_id", "side", "word", "vector")
    return joined if small else joined.repartition("pair_id").sortWithinPartitions("pair_id", "side")


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray | None]:
    """A list column without nulls as rows of numbers and where these are known (None: everywhere); short lists are filled up."""
    n, flat = len(column), column.flatten()
    sizes = np.diff(column.offsets.to_numpy())
    width = int(sizes.max(initial=0))
    if not flat.null_count and len(flat) == n * width:
        return flat.to_numpy(zero_copy_only=False).reshape(n, width), None
    at = np.arange(width) < sizes[:, None]
    x, known = np.zeros((n, width)), at.copy()
    x[at] = pc.fill_null(flat.cast(pa.float64()), 0.0).to_numpy(zero_copy_only=False)
    known[at] = flat.is_valid().to_numpy(zero_copy_only=False)
    return x, known


def _new(column: pa.Array) -> np.ndarray:
    """Whether each value differs from the one before; the first does."""
    n = len(column)
    if n < 2:
        return np.ones(n, bool)
    after, before = column.slice(1), column.slice(0, n - 1)
    other = pc.fill_null(pc.not_equal(after, before), False).to_numpy(zero_copy_only=False)
    return np.concatenate([[True], other | (after.is_null().to_numpy(zero_copy_only=False) != before.is_null().to_numpy(zero_copy_only=False))])


def _similar(batches):
    """Sums per pair, side and component; those of a batch's last pair go on to the next batch, so no pair is held whole."""
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key, side = batch.column(0), batch.column(1).to_numpy()
        starts = np.flatnonzero(_new(key))
        pair = np.repeat(np.arange(len(starts)), np.diff([*starts, len(side)]))
        have, keys = np.flatnonzero(side >= 0), key.take(pa.array(starts))
        to = 2 * pair[have] + side[have]
        if (to[1:] < to[:-1]).any():
            order = np.argsort(to, kind="stable")
            have, to = have[order], to[order]
        x, known = _matrix(batch.column(3).take(pa.array(have)))
        total, count = (np.zeros((2 * len(starts), x.shape[1])) for _ in range(2))
        if len(have):
            first = np.flatnonzero(np.diff(to, prepend=-1))
            total[to[first]] = np.add.reduceat(x, first, dtype=float)
            count[to[first]] = np.diff([*first, len(to)])[:, None] if known is None else np.add.reduceat(known, first, dtype=float)
        total, count = (v.reshape(len(starts), 2, -1) for v in (total, count))
        if rest is not None:
            width = max(total.shape[2], rest[1].shape[2])
            total, count, *old = (np.pad(v, ((0, 0), (0, 0), (0, width - v.shape[2]))) for v in (total, count, *rest[1:]))
            if rest[0][0].equals(keys[0]):
                total[0] += old[0][0]
                count[0] += old[1][0]
            else:
                keys, total, count = pa.concat_arrays([rest[0], keys]), np.concatenate([old[0], total]), np.concatenate([old[1], count])
        rest = (keys[-1:], total[-1:], count[-1:])
        yield _cosines(keys[:-1], total[:-1], count[:-1])
    if rest is not None:
        yield _cosines(*rest)


def _cosines(keys: pa.Array, total: np.ndarray, count: np.ndarray) -> pa.RecordBatch:
    """0 where a side has no known word or no length, or where components are known of one side only."""
    mean = total / np.maximum(count, 1)
    a, b = mean[:, 0], mean[:, 1]
    with np.errstate(divide="ignore", invalid="ignore"):
        length = np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1))
        near = np.where(length == 0, 0.0, (a * b).sum(1) / length)
    known = count > 0
    near[(known[:, 0] != known[:, 1]).any(1)] = 0.0
    return pa.RecordBatch.from_arrays([keys, pa.array(near)], ["pair_id", "similarity"])


def n_similarity(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """``pairs`` (pair_id, a, b: arrays of words) to pair_id and similarity: cosine of the mean vectors of both sides.

    Words repeat as often as they stand; unknown words are left out, and a side without a known word, null ones too,
    makes 0. A pair_id stands once, a word of ``vectors`` as well.
    """
    kind = dict(pairs.dtypes)["pair_id"]
    return _known(pairs, vectors).mapInArrow(_similar, f"pair_id {kind}, similarity double")


def transport(supply: np.ndarray, demand: np.ndarray, cost: np.ndarray) -> float:
    """Least cost of moving all supply to the demand (equal sums), by shortest augmenting paths."""
    n, m = cost.shape
    if min(n, m) == 1:  # there is one way only
        return float((supply[:, None] * demand[None] / supply.sum() * cost).sum())
    left, need, flow, total = supply.astype(float), demand.astype(float), np.zeros((n, m)), 0.0
    price_from, price_to = np.zeros(n), np.zeros(m)
    tiny = 1e-12 * max(1.0, left.sum())
    while left.max() > tiny:
        reach = np.where(left > tiny, 0.0, np.inf)
        to, via_from, via_to = np.full(m, np.inf), np.full(m, -1), np.full(n, -1)
        done_from, done_to = np.zeros(n, bool), np.zeros(m, bool)
        while True:
            i = int(np.argmin(np.where(done_from, np.inf, reach)))
            j = int(np.argmin(np.where(done_to, np.inf, to)))
            best_i, best_j = (np.inf if done_from[i] else reach[i]), (np.inf if done_to[j] else to[j])
            if min(best_i, best_j) == np.inf:
                break
            if best_i <= best_j:
                done_from[i] = True
                along = reach[i] + np.maximum(cost[i] + price_from[i] - price_to, 0)
                better = along < to
                to[better], via_from[better] = along[better], i
            else:
                done_to[j] = True
                back = np.where(flow[:, j] > tiny, to[j] + np.maximum(price_to[j] - cost[:, j] - price_from, 0), np.inf)
                better = back < reach
                reach[better], via_to[better] = back[better], j
        end = int(np.argmin(np.where(need > tiny, to, np.inf)))
        price_from += np.minimum(reach, to[end])
        price_to += np.minimum(to, to[end])
        path, j = [], end
        while True:
            i = int(via_from[j])
            path.append((i, j, 1))
            if via_to[i] < 0:
                break
            j = int(via_to[i])
            path.append((i, j, -1))
        move = min([left[path[-1][0]], need[end], *(flow[i, j] for i, j, way in path if way < 0)])
        for i, j, way in path:
            flow[i, j] += way * move
        left[path[-1][0]] -= move
        need[end] -= move
    return float((flow * cost).sum()) + total


def _distance(a: list, x: list, b: list, y: list) -> float:
    if not a or not b:
        return FAR
    (p, n), (q, m) = (np.unique(np.asarray(w, dtype=object), return_counts=True) for w in (a, b))
    at = {w: v for w, v in [*zip(a, x, strict=True), *zip(b, y, strict=True)]}
    one, two = np.array([at[w] for w in p], float), np.array([at[w] for w in q], float)
    cost = np.sqrt(((one[:, None] - two[None]) ** 2).sum(axis=2))
    return transport(n / n.sum(), m / m.sum(), cost)


def _movers(batches):
    """One pair at a time; the last of a batch waits for the next."""
    none = object()
    pair, sides = none, ([], [], [], [])
    for batch in batches:
        starts = np.flatnonzero(_new(batch.column(0)))
        keys, out, sides_of = batch.column(0).take(pa.array(starts)), [], batch.column(1).to_numpy()
        for i, (at, end) in enumerate(zip(starts, [*starts[1:], batch.num_rows], strict=True)):
            key = keys[i].as_py()
            if key != pair:
                if pair is not none:
                    out.append((pair, _distance(*sides)))
                pair, sides = key, ([], [], [], [])
            for n in (0, 1):
                rows = at + np.flatnonzero(sides_of[at:end] == n)
                if len(rows):
                    sides[2 * n].extend(batch.column(2).take(pa.array(rows)).to_pylist())
                    sides[2 * n + 1].extend(_rows(batch.column(3).take(pa.array(rows))))
        yield _distances(out, batch.schema.field(0).type)
    if pair is not none:
        yield _distances([(pair, _distance(*sides))], keys.type)


def _rows(vectors: pa.Array) -> list[np.ndarray]:
    """Each vector as numbers of double precision; a null component is no number."""
    flat, ends = vectors.flatten().to_numpy(zero_copy_only=False).astype(float), np.cumsum(np.diff(vectors.offsets.to_numpy()))
    return np.split(flat, ends[:-1])


def _distances(out: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p for p, _ in out], kind), pa.array([d for _, d in out], pa.float64())], ["pair_id", "distance"])


def word_movers_distance(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """``pairs`` (pair_id, a, b) to pair_id and distance: least mean way from the words of a to those of b.

    A word weighs by its share of its side's known words; ways are Euclidean. A side without a known word makes FAR.
    A pair is one task's work and grows with the cube of its different words, so it is for titles and queries.
    A pair_id stands once, a word of ``vectors`` as well.
    """
    kind = dict(pairs.dtypes)["pair_id"]
    return _known(pairs, vectors).mapInArrow(_movers, f"pair_id {kind}, distance double")
