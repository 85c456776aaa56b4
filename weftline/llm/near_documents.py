"""Near-duplicate documents: Jaccard similarity of five-word shingles of at least 0.8.

Documents are nodes by the hash of their words, so copies cost one node. SimHash fingerprints of the shingles are
searched by the covering masks of ``simhash``: pairs within its radius are candidates, without loss. Most pairs at
similarity 0.8 are further apart than any such radius, so MinHash signatures of the same shingles are cut into bands
besides: a pair at similarity 0.8 shares one with probability 0.9998, more similar pairs more surely. Inside a bucket,
two-bit sketches rule out chance collisions. The candidates of both form clusters, each document in one. Within a
cluster, exact similarity of the shingle sets decides every link; union-find joins links to components and the first
document of each stays. Shingles move once and for candidates only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.components import connected_components
from weftline.llm.jaccard import similar_links
from weftline.llm.line_dedup import _ADD, _MUL, PERMS, block_pairs, link_buckets, sketches
from weftline.llm.runs import cuts, whole_runs
from weftline.llm.scratch import Scratch, boxed, ship, unboxed
from weftline.llm.simhash import link_fingerprints, majority

#: Words of a shingle, values of a band (all PERMS are used), least similarity as a fraction.
SHINGLE, ROWS, SIMILAR = 5, 4, (4, 5)
#: Shingles hashed at once; shingles of a candidate cluster above which it is verified in blocks.
AT_ONCE, CLUSTER_BLOCK = 40_000, 1_000_000


def words(text: str | None) -> list[bytes]:
    """As in the fingerprints: only A-Z are lowered, only ASCII white space cuts."""
    return (text or "").encode().lower().split()


def shingles(some: list[bytes]) -> np.ndarray:
    """Hashes (uint64) of the word shingles in order; fewer words are one shingle, none have none."""
    n = len(some)
    if not n:
        return np.empty(0, np.uint64)
    code = np.fromiter(map(xxhash.xxh64_intdigest, some), np.uint64, n)
    k = min(SHINGLE, n)
    h = np.zeros(n - k + 1, np.uint64)
    for i in range(k):
        h = (h ^ code[i : n - k + 1 + i]) * np.uint64(0x9E37_79B9_7F4A_7C15)
        h ^= h >> np.uint64(29)
    return h * np.uint64(0xBF58_476D_1CE4_E5B9)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash values, one row of PERMS uint32 per document (none may be empty)."""
    out = np.empty((len(sets), PERMS), np.uint32)
    at = 0
    while at < len(sets):
        size, to = 0, at
        while to < len(sets) and (size < AT_ONCE or to == at):
            size += len(sets[to])
            to += 1
        h = (np.concatenate(sets[at:to]) >> np.uint64(32)).astype(np.uint32)
        starts = np.cumsum([0, *map(len, sets[at : to - 1])])
        for k in range(PERMS):
            out[at:to, k] = np.minimum.reduceat(h * _MUL[k] + _ADD[k], starts)
        at = to
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key per document and band; bands share one space of keys."""
    keys = np.tile(np.arange(1, PERMS // ROWS + 1, dtype=np.uint64), (len(sig), 1))
    for r in range(ROWS):
        keys = (keys ^ sig[:, r::ROWS]) * np.uint64(0x9E37_79B9_7F4A_7C15)
        keys ^= keys >> np.uint64(31)
    return keys.view(np.int64)


def _prints(batches):
    """Rows (_row, doc_id, text) to the hash of the words, fingerprint (null without words), band keys (none without) and sketch."""
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            split = [words(t) for t in part.column(2).to_pylist()]
            ids = np.array([xxhash.xxh64_intdigest(b" ".join(w), 42) for w in split], np.uint64).view(np.int64)
            full = np.flatnonzero([len(w) > 0 for w in split])
            sets = [shingles(split[i]) for i in full]
            sig = signatures(sets)
            prints = np.zeros(len(split), np.uint64)
            prints[full] = [majority(h) for h in sets]
            worded = np.zeros(len(split), bool)
            worded[full] = True
            keys: list[list[int]] = [[] for _ in split]
            for i, row in zip(full.tolist(), band_keys(sig).tolist(), strict=True):
                keys[i] = row
            two = np.zeros((len(split), 2), np.int64)
            two[full] = sketches(sig).view(np.int64)
            columns = [part.column(0), part.column(1), pa.array(ids), pa.array(prints.view(np.int64), mask=~worded), pa.array(keys, pa.list_(pa.int64())), pa.array(two[:, 0].copy()), pa.array(two[:, 1].copy())]
            yield pa.RecordBatch.from_arrays(columns, ["_row", "doc_id", "lid", "fp", "keys", "s1", "s2"])


def fingerprint_links(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """``nodes`` (lid, fp) to links (u, v) that span the components of fingerprints within the radius; null ones have none.

    One node stands for each fingerprint; the others that have it are linked to that one.
    """
    held = scratch.keep(nodes.filter(F.col("fp").isNotNull()).groupBy("fp").agg(F.min("lid").alias("lid"), F.count("*").alias("n")))
    near = link_fingerprints(held.select("fp"), scratch).withColumnsRenamed({"u": "fp", "v": "other"})
    near = near.join(held.select("fp", F.col("lid").alias("u")), "fp").join(held.select(F.col("fp").alias("other"), F.col("lid").alias("v")), "other")
    same = nodes.select("lid", "fp").join(held.filter("n > 1").select("fp", F.col("lid").alias("u")), "fp").filter("lid <> u")
    return near.select("u", "v").unionByName(same.select("u", F.col("lid").alias("v")))


def _sets(batches):
    """Rows (component, lid, text) with the set of shingles in place of the text, and its size."""
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            sets = [np.unique(shingles(words(t))) for t in part.column(2).to_pylist()]
            columns = [part.column(0), part.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["component", "lid", "size", "shingles"])


def _verify(batches):
    """Rows (component, _i, _j, _b, lid, shingles) in order of the first three to links of the exact similarity graph."""
    for component, i, j, b, lid, shingle in whole_runs(batches, 3):
        us, vs = [], []
        bounds = cuts([component, i, j])
        for at, to in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if to - at > 1:
                sets = [np.frombuffer(x, np.uint64) for x in shingle[at:to]]
                owner = np.repeat(np.arange(to - at), [len(x) for x in sets])
                u, v = similar_links(np.concatenate(sets), owner, to - at, SIMILAR, b[at:to] if i[at] != j[at] else None)
                us.append(lid[at:to][u])
                vs.append(lid[at:to][v])
        if us:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (us, vs)], ["u", "v"])


def kept_rows(documents: DataFrame, scratch: Scratch) -> DataFrame:
    """``documents`` (_row, doc_id, text) to the _row of the first of each component by (doc_id, _row), null doc_ids last.

    Documents without a word (null and empty texts too) are copies of each other, and so are repeated rows. Texts of
    any length are read whole. An empty table gives no rows.
    """
    prints = documents.select("_row", F.col("doc_id").cast("long"), "text").mapInArrow(_prints, "_row long, doc_id long, lid long, fp long, keys array<long>, s1 long, s2 long")
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("_row"))
    same = [F.first(c).alias(c) for c in ("fp", "keys", "s1", "s2")]
    nodes = scratch.keep(prints.groupBy("lid").agg(F.min(order).alias("first"), *same))
    dealt = nodes.select(F.explode("keys").alias("key"), "lid", "s1", "s2").repartition("key").sortWithinPartitions("key")
    candidates = dealt.mapInArrow(link_buckets, "u long, v long").unionByName(fingerprint_links(nodes, scratch))
    clusters = connected_components(scratch.keep(candidates), scratch)
    wanted = nodes.join(clusters.withColumnRenamed("node", "lid"), "lid").select("component", "lid", F.col("first._row").alias("_row"))
    named = scratch.keep(documents.select("_row", "text").join(wanted, "_row").select("component", "lid", "text").mapInArrow(_sets, "component long, lid long, size long, shingles binary"))
    # A large cluster is cut into blocks and verified block against block: no task holds more than two blocks.
    sizes = named.groupBy("component").agg(F.ceil(F.sum("size") / CLUSTER_BLOCK).cast("int").alias("_k"))
    by = ["component", "_i", "_j"]
    blocks = block_pairs(named, sizes).select(*by, "_b", "lid", "shingles").repartition(*by).sortWithinPartitions(*by)
    links = scratch.keep(blocks.mapInArrow(_verify, "u long, v long"))
    scratch.drop(named)
    parts = connected_components(links, scratch)
    whole = nodes.select("lid", "first").join(parts.withColumnRenamed("node", "lid"), "lid", "left")
    return whole.groupBy(F.coalesce("component", "lid")).agg(F.min("first").alias("first")).select("first._row")


def drop_near_duplicates(documents: DataFrame) -> DataFrame:
    """``documents`` with one document of each component: that of the least doc_id, of repeated rows the first.

    Nulls, empty and very long texts, ties and empty tables: as in ``kept_rows``. Columns of any name pass through.
    """
    spark = documents.sparkSession
    ship(spark)
    scratch = Scratch(spark, "near")
    docs = boxed(documents, scratch)
    keep = scratch.keep(kept_rows(docs.select("_row", "_doc.doc_id", "_doc.text"), scratch))
    return unboxed(docs.join(keep, "_row", "left_semi"), documents)
