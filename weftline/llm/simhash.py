"""SimHash near-duplicates by covering locality-sensitive hashing.

A text's fingerprint takes the majority of each bit over the hashes of its word shingles. Fingerprints within radius
2 are found without loss: each bit position has a non-zero vector of three bits, and table v keeps the positions whose
vector has an odd inner product with v. Two positions always leave a v to which both are orthogonal, so any pair that
differs in at most two bits agrees on everything that some of the seven tables keeps.

Only distinct fingerprints are linked, so copies cost nothing but a group. A bucket is searched as a graph and emits a
spanning forest, never its pairs. Buckets above a bound are dealt once more: the bits that a table leaves out are cut
in three, of which a pair within the radius agrees on one at least, which bounds every bucket by 2 ** 19 fingerprints.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.components import connected_components
from weftline.llm.scratch import Scratch, boxed, ship, unboxed, with_row_id

BITS, RADIUS = 64, 2
#: Fingerprints in a bucket above which it is dealt once more.
LARGE_BUCKET = 8192
#: Links between distinct fingerprints that one task takes at once; more of them are contracted in rounds.
LINKS_AT_ONCE = 1 << 19


def masks() -> list[int]:
    """The seven tables' bit masks, as unsigned numbers."""
    vector = [i % 7 + 1 for i in range(BITS)]
    return [sum(1 << i for i in range(BITS) if bin(vector[i] & v).count("1") & 1) for v in range(1, 8)]


def parts(mask: int) -> list[int]:
    """The bits that a mask leaves out, cut in three."""
    free = [i for i in range(BITS) if not mask >> i & 1]
    return [sum(1 << i for i in free[k::3]) for k in range(3)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def majority(h: np.ndarray) -> int:
    """Each bit as more than half of the 64-bit hashes have it, as an unsigned number."""
    ones = np.unpackbits(h.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * ones > len(h), bitorder="little").tobytes(), "little")


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """SimHash of a text as an unsigned number; 0 without words."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z are lowered, only ASCII white space cuts
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(map(len, words), lambda a, b: a + b + 1))
    starts = [0, *(e + 1 for e in ends)]
    k = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    return majority(np.array([digest(joined[a:b], 42) for a, b in zip(starts, ends[k - 1 :], strict=False)], "<u8"))


def _fingerprints(shingle: int):
    def work(batches):
        for batch in batches:
            prints = np.array([fingerprint(t, shingle) for t in batch.column(batch.num_columns - 1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(prints)], [*batch.schema.names[:-1], "fp"])

    return work


def _forest(members: np.ndarray, free: int) -> tuple[list, list]:
    """Links of a spanning forest of the graph of members (distinct) within the radius; ``free``: bits that may differ."""
    u, v = [], []
    if len(members) <= LARGE_BUCKET:
        rest = members
        while len(rest) > 1:
            queue, rest = [rest[0]], rest[1:]
            while queue and len(rest):
                x = queue.pop()
                near = np.bitwise_count(rest ^ x) <= RADIUS
                if near.any():
                    found = rest[near]
                    u += [x] * len(found)
                    v += found.tolist()
                    queue += list(found)
                    rest = rest[~near]
        return u, v
    members = np.sort(members)
    single = [np.uint64(1 << i) for i in range(BITS) if free >> i & 1]
    flips = np.array(single + [a | b for i, a in enumerate(single) for b in single[:i]], np.uint64)
    open_ = np.ones(len(members), bool)
    for first in range(len(members)):
        if not open_[first]:
            continue
        open_[first] = False
        queue = np.array([first])
        while len(queue):
            now, queue = queue[:256], queue[256:]
            want = (members[now][:, None] ^ flips).ravel()
            at = np.minimum(np.searchsorted(members, want), len(members) - 1)
            hit = np.flatnonzero((members[at] == want) & open_[at])
            at, once = np.unique(at[hit], return_index=True)
            open_[at] = False
            u += members[now[hit[once] // len(flips)]].tolist()
            v += members[at].tolist()
            queue = np.concatenate([queue, at])
    return u, v


def _links(batches):
    """Rows (table, sub, key, fp) in order of the first three, a bucket's rows together; links of each bucket."""
    held: list[np.ndarray] = []
    last = None

    def closed(where, pieces):
        members = np.concatenate(pieces).view(np.uint64)
        if len(members) < 2:
            return [], []
        mask = masks()[where[0]]
        return _forest(members, ~mask & (1 << BITS) - 1)

    for batch in batches:
        table, sub, key, fp = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        n = len(fp)
        if not n:
            continue
        cut = np.flatnonzero((table[1:] != table[:-1]) | (sub[1:] != sub[:-1]) | (key[1:] != key[:-1])) + 1
        bounds = np.concatenate([[0], cut, [n]])
        u, v = [], []
        # Buckets of one row that lie wholly inside the batch need no work at all.
        inner = np.flatnonzero(np.diff(bounds) > 1)
        for k in sorted({0, len(bounds) - 2, *inner.tolist()}):
            a, b = bounds[k], bounds[k + 1]
            where = (int(table[a]), int(sub[a]), int(key[a]))
            if where != last:
                if held:
                    for to, x in zip((u, v), closed(last, held), strict=True):
                        to += x
                held, last = [], where
            held.append(fp[a:b].copy())
        yield pa.RecordBatch.from_arrays([pa.array(np.array(x, np.uint64).view(np.int64)) for x in (u, v)], ["u", "v"])
    if held:
        u, v = closed(last, held)
        yield pa.RecordBatch.from_arrays([pa.array(np.array(x, np.uint64).view(np.int64)) for x in (u, v)], ["u", "v"])


def link_fingerprints(prints: DataFrame, scratch: Scratch) -> DataFrame:
    """Distinct fingerprints (fp long) to links (u, v) with the components of all pairs within the radius."""
    tables = [_signed(m) for m in masks()]
    dealt = prints.select("fp", F.posexplode(F.array(*[F.lit(m) for m in tables])).alias("table", "mask")).select("table", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")
    counts = dealt.groupBy("table", "key").agg(F.count("*").alias("n")).filter(F.col("n") > LARGE_BUCKET).select("table", "key", F.lit(True).alias("_large"))
    rest = F.element_at(F.array(*[F.array(*[F.lit(_signed(p)) for p in parts(m)]) for m in masks()]), F.col("table") + 1)
    subs = F.when(
        F.col("_large"),
        F.transform(rest, lambda p, k: F.struct((k + 1).alias("sub"), (F.col("key").bitwiseOR(F.col("fp").bitwiseAND(p))).alias("key"))),
    ).otherwise(F.array(F.struct(F.lit(0).alias("sub"), F.col("key").alias("key"))))
    rows = dealt.join(counts, ["table", "key"], "left").select("table", F.explode(subs).alias("s"), "fp").select("table", "s.sub", "s.key", "fp")
    ordered = rows.repartition("table", "sub", "key").sortWithinPartitions("table", "sub", "key")
    return ordered.mapInArrow(_links, "u long, v long")


def near_duplicates(documents: DataFrame, text: str = "text", shingle: int = 3, scratch: Scratch | None = None) -> DataFrame:
    """``documents`` (with ``_row`` and doc_id; narrow columns but the text) to _row, doc_id, fp and the component.

    ``component`` is a fingerprint that stands for the class; ``first`` the least (doc_id, _row) in it, null doc_ids
    last. A null text is an empty one and has fingerprint 0. Repeated rows are members like any other.
    """
    spark = documents.sparkSession
    ship(spark)
    scratch = scratch or Scratch(spark, "simhash")
    prints = scratch.keep(documents.select("_row", F.col("doc_id").cast("long"), text).mapInArrow(_fingerprints(shingle), "_row long, doc_id long, fp long"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("_row"))
    classes = scratch.keep(prints.groupBy("fp").agg(F.min(order).alias("first")))
    parts_ = connected_components(link_fingerprints(classes.select("fp"), scratch), scratch, LINKS_AT_ONCE)
    named = classes.join(parts_.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    firsts = named.groupBy("component").agg(F.min("first").alias("_least"))
    classes = named.join(firsts, "component").select("fp", "component", F.col("_least").alias("first"))
    return prints.join(classes, "fp")


def simhash_digest(documents: DataFrame) -> DataFrame:
    """Per document: fingerprint in hexadecimal and the least doc_id of its component.

    Null and empty texts have fingerprint zero; repeated rows are members like any other; null doc_ids come last; texts
    of any length are read whole; an empty table gives no rows. Other columns are not read.
    """
    scratch = Scratch(documents.sparkSession, "simhash")
    found = near_duplicates(with_row_id(documents.select("doc_id", "text"), scratch), scratch=scratch)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("first.doc_id").alias("component_id"))


def drop_near_duplicates(documents: DataFrame) -> DataFrame:
    """``documents`` with one document of each component: that of the least doc_id, of repeated rows the first.

    Nulls, empties, ties and long texts: as in ``simhash_digest``. Columns of any name pass through unchanged.
    """
    scratch = Scratch(documents.sparkSession, "simhash")
    docs = boxed(documents, scratch)
    found = near_duplicates(docs.select("_row", "_doc.doc_id", "_doc.text"), scratch=scratch)
    keep = scratch.keep(found.filter(F.col("first._row") == F.col("_row")).select("_row"))
    return unboxed(docs.join(keep, "_row", "left_semi"), documents)
