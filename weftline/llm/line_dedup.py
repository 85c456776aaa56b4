"""Fuzzy line deduplication by MinHash.

A line is the text between newlines without ASCII white space at its ends; lines without a word are left alone. Lines
are nodes by their 64-bit hash, so copies cost one node. Signatures over character shingles are banded for high
recall (0.995 for a pair at similarity 0.8, more above); band keys travel with two-bit sketches of the signatures,
which rule out chance collisions inside a bucket, and the rest form candidate clusters, each line in one. Within a
cluster, exact Jaccard similarity decides every link. Distributed union-find joins links to components and one line of
each component stays: the first by (doc_id, row, line).

Texts move once (the lines, by hash, to meet the candidates); everything else is narrow. Runs of equal keys are read
from sorted partitions in whole batches, so small buckets and clusters cost no call of their own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.components import connected_components
from weftline.llm.jaccard import similar_links
from weftline.llm.runs import cuts, whole_runs
from weftline.llm.scratch import Scratch, boxed, ship, unboxed, with_row_id

SHINGLE, BANDS, ROWS, SIMILAR = 5, 10, 4, (4, 5)
#: Hash functions: bands use the first, sketches all of them, two bits of each.
PERMS = 64
#: Two-bit values of a sketch that may differ. At similarity 0.8 about 9.6 of 64 do (deviation 2.9).
SKETCH_APART = 22
#: Lines that a task remembers having sent; lines of a candidate cluster above which it is verified in blocks.
SEEN, CLUSTER_BLOCK = 500_000, 4_000
STRIP = " \t\n\r\x0b\x0c"

_rng = np.random.default_rng(20_240_607)
_MUL = (_rng.integers(0, 1 << 32, PERMS, dtype=np.uint64).astype(np.uint32)) | np.uint32(1)
_ADD = _rng.integers(0, 1 << 32, PERMS, dtype=np.uint64).astype(np.uint32)
_LOW = np.uint64(0x5555_5555_5555_5555)


def line_hash(line: str) -> int:
    """As Spark's xxhash64, signed."""
    h = xxhash.xxh64_intdigest(line.encode(), 42)
    return h - (1 << 64) if h >> 63 else h


def shingle_hashes(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the character shingles of all lines in order, and their number per line (none may be empty).

    A line of fewer characters is one shingle.
    """
    part = [x if len(x) >= SHINGLE else x.ljust(SHINGLE, "\0") for x in lines]
    code = np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), np.uint32)
    h = np.zeros(len(code) - SHINGLE + 1, np.uint64)
    for k in range(SHINGLE):
        h = h * np.uint64(0x9E37_79B9_7F4A_7C15) + code[k : len(code) - SHINGLE + 1 + k]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58_476D_1CE4_E5B9)
    lengths = np.array([len(x) for x in part])
    # Shingles across two lines are put aside: each line's run stops SHINGLE - 1 short of its end.
    inside = np.ones(len(h), bool)
    ends = np.cumsum(lengths)[:-1]
    for k in range(1, SHINGLE):
        inside[ends - k] = False
    return h[inside], lengths - SHINGLE + 1


def signatures(lines: list[str]) -> np.ndarray:
    """MinHash values, one row of PERMS uint32 per line (none may be empty)."""
    out = np.empty((len(lines), PERMS), np.uint32)
    at = 0
    while at < len(lines):
        size, to = 0, at
        while to < len(lines) and (size < 40_000 or to == at):
            size += max(len(lines[to]), SHINGLE)
            to += 1
        h, sizes = shingle_hashes(lines[at:to])
        h = (h >> np.uint64(32)).astype(np.uint32)
        starts = np.cumsum(sizes) - sizes
        for k in range(PERMS):
            out[at:to, k] = np.minimum.reduceat(h * _MUL[k] + _ADD[k], starts)
        at = to
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key per line and band; bands share one space of keys."""
    keys = np.zeros((len(sig), BANDS), np.uint64)
    for b in range(BANDS):
        h = np.full(len(sig), b + 1, np.uint64)
        for r in range(ROWS):
            h = (h ^ sig[:, b * ROWS + r]) * np.uint64(0x9E37_79B9_7F4A_7C15)
            h ^= h >> np.uint64(31)
        keys[:, b] = h
    return keys.view(np.int64)


def sketches(sig: np.ndarray) -> np.ndarray:
    """Two bits of each value: two uint64 per line."""
    two = (sig & np.uint32(3)).astype(np.uint64)
    shift = np.arange(32, dtype=np.uint64) * np.uint64(2)
    return np.stack([np.bitwise_or.reduce(two[:, :32] << shift, axis=1), np.bitwise_or.reduce(two[:, 32:] << shift, axis=1)], axis=1)


def apart(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Two-bit values in which a sketch differs from each of many."""
    x = many ^ one
    return np.bitwise_count((x | x >> np.uint64(1)) & _LOW).sum(axis=1, dtype=np.int64)


def _new_lines(batches, lines_of):
    """Batches of lines not sent by this task before, as far as it remembers."""
    seen: set[int] = set()
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            fresh: dict[int, str] = {}
            for text in batch.column(0).slice(at, 256).to_pylist():
                for line in (text or "").split("\n"):
                    line = line.strip(STRIP)
                    if line:
                        h = line_hash(line)
                        if h not in seen and h not in fresh:
                            fresh[h] = line
            if len(seen) + len(fresh) > SEEN:
                seen = set()
            seen.update(fresh)
            if fresh:
                yield from lines_of(list(fresh), list(fresh.values()))


def _bands(batches):
    def emit(ids, lines):
        sig = signatures(lines)
        two = sketches(sig).view(np.int64)
        columns = [band_keys(sig).ravel(), *(np.repeat(x, BANDS) for x in (np.array(ids, np.int64), two[:, 0], two[:, 1]))]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["key", "lid", "s1", "s2"])

    return _new_lines(batches, emit)


def _texts(batches):
    def emit(ids, lines):
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(lines, pa.string())], ["lid", "line"])

    return _new_lines(batches, emit)


def _places(batches):
    """Rows (_row, doc_id, text) to one row per line that has a word: _row, doc_id, its number and its hash."""
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            cut = batch.slice(at, 512)
            row, no, lid = [], [], []
            for i, text in enumerate(cut.column(2).to_pylist()):
                for k, line in enumerate((text or "").split("\n")):
                    line = line.strip(STRIP)
                    if line:
                        row.append(i)
                        no.append(k)
                        lid.append(line_hash(line))
            took = pa.array(row, pa.int32())
            yield pa.RecordBatch.from_arrays([cut.column(0).take(took), cut.column(1).take(took), pa.array(no, pa.int32()), pa.array(lid, pa.int64())], ["_row", "doc_id", "no", "lid"])


def bucket_links(key: np.ndarray, lid: np.ndarray, sk: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that span the sketch-similar lines of each bucket; rows of a bucket are consecutive and may repeat."""
    same = key[1:] == key[:-1]
    shared = np.zeros(len(key), bool)
    shared[1:] |= same
    shared[:-1] |= same
    key, lid, sk = key[shared], lid[shared], sk[shared]
    order = np.lexsort((lid, key))
    key, lid, sk = key[order], lid[order], sk[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (lid[1:] != lid[:-1])
    key, lid, sk = key[new], lid[new], sk[new]
    bounds = cuts([key])
    size = np.diff(bounds)
    two = bounds[:-1][size == 2]
    near = apart(sk[two], sk[two + 1]) <= SKETCH_APART
    us, vs = [lid[two[near]]], [lid[two[near] + 1]]
    for at, n in zip(bounds[:-1][size > 2].tolist(), size[size > 2].tolist(), strict=True):
        rest, sketch = lid[at : at + n], sk[at : at + n]
        while len(rest) > 1:
            queue, rest, sketch = [(rest[0], sketch[0])], rest[1:], sketch[1:]
            while queue and len(rest):
                x, sx = queue.pop()
                near = apart(sx, sketch) <= SKETCH_APART
                if near.any():
                    found = rest[near]
                    us.append(np.full(len(found), x))
                    vs.append(found)
                    queue += list(zip(found, sketch[near], strict=True))
                    rest, sketch = rest[~near], sketch[~near]
    return np.concatenate(us), np.concatenate(vs)


def link_buckets(batches):
    """Rows (key, lid, s1, s2) in order of key to links (u, v) that span the sketch-similar ones of each key."""
    for key, lid, s1, s2 in whole_runs(batches, 1):
        u, v = bucket_links(key, lid, np.stack([s1, s2], axis=1).view(np.uint64))
        if len(u):
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])


def grades(sizes: np.ndarray) -> np.ndarray:
    """Sets whose grades differ by more than one are too unlike in size to be similar.

    A grade ends at 1.26 times its start, a little above the ratio of sizes that similarity 0.8 allows.
    """
    return (np.log(sizes) / np.log(1.26)).astype(np.int32)


def _grades(batches):
    """Rows (component, lid, line, _large) with the grade of the line's size in place of the last, null where that is false."""
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            grade = np.zeros(part.num_rows, np.int32)
            small = ~part.column(3).to_numpy(zero_copy_only=False)
            large = np.flatnonzero(~small)
            if len(large):
                h, sizes = shingle_hashes(part.column(2).take(pa.array(large)).to_pylist())
                grade[large] = grades(np.array([len(np.unique(x)) for x in np.split(h, np.cumsum(sizes)[:-1])]))
            yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(grade, mask=small)], ["component", "lid", "line", "_g"])


def _verify(batches):
    """Rows (component, _i, _j, _b, lid, line) in order of the first three to links of the exact similarity graph of each."""
    for component, i, j, b, lid, line in whole_runs(batches, 3):
        us, vs = [], []
        bounds = cuts([component, i, j])
        for at, to in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if to - at > 1:
                h, sizes = shingle_hashes(line[at:to].tolist())
                u, v = similar_links(h, np.repeat(np.arange(to - at), sizes), to - at, SIMILAR, b[at:to] if i[at] != j[at] else None)
                us.append(lid[at:to][u])
                vs.append(lid[at:to][v])
        if us:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (us, vs)], ["u", "v"])


def block_pairs(clusters: DataFrame, sizes: DataFrame) -> DataFrame:
    """``clusters`` (component, lid, ...) with _b, _i and _j: each row once per pair of blocks that its own is part of.

    ``sizes`` has the number of blocks (_k) of each component. Each pair of rows of a component meets in one (_i, _j).
    """
    block = F.pmod(F.xxhash64("lid"), F.col("_k")).cast("int")
    pairs = F.expr("transform(sequence(0, _k - 1), o -> struct(least(_b, o) AS i, greatest(_b, o) AS j))")
    dealt = clusters.join(sizes, "component").withColumn("_b", block).withColumn("_p", F.explode(pairs))
    return dealt.withColumn("_i", F.col("_p.i")).withColumn("_j", F.col("_p.j")).drop("_p", "_k")


def graded_pairs(lines: DataFrame, scratch: Scratch) -> DataFrame:
    """``lines`` (component, lid, _g, ...) with _b, _i and _j: each row once per pair of blocks that its own is part of.

    Blocks of a component are of one grade each, and only those of the same or the next grade are paired. A component
    without grades is one block.
    """
    counts = scratch.keep(lines.filter("_g IS NOT NULL").groupBy("component", "_g").agg(F.ceil(F.count("*") / CLUSTER_BLOCK).alias("_k")))
    near = counts.select("component", F.explode(F.sequence(F.col("_g") - 1, F.col("_g") + 1)).alias("_g"), F.struct(F.col("_g").alias("g"), F.col("_k").alias("k")).alias("_n"))
    # Written, and only of large components, so that the lines need not move to meet it.
    near = scratch.keep(near.groupBy("component", "_g").agg(F.collect_list("_n").alias("_n")).join(counts, ["component", "_g"]))
    block = F.col("_g").cast("long") * (1 << 32) + F.pmod(F.xxhash64("lid"), F.col("_k"))
    others = F.expr("coalesce(flatten(transform(_n, n -> transform(sequence(0L, n.k - 1), o -> n.g * 4294967296L + o))), array(0L))")
    dealt = lines.join(near, ["component", "_g"], "left").withColumn("_b", F.coalesce(block, F.lit(0))).withColumn("_o", F.explode(others))
    return dealt.withColumn("_i", F.least("_b", "_o")).withColumn("_j", F.greatest("_b", "_o")).drop("_n", "_k", "_o")


def line_links(documents: DataFrame, scratch: Scratch) -> DataFrame:
    """Links (u, v) between hashes of similar lines of the text column, spanning all components of the exact graph."""
    text = documents.select("text")
    bands = text.mapInArrow(_bands, "key long, lid long, s1 long, s2 long")
    links = scratch.keep(bands.repartition("key").sortWithinPartitions("key").mapInArrow(link_buckets, "u long, v long"))
    clusters = scratch.keep(connected_components(links, scratch).withColumnRenamed("node", "lid"))
    scratch.drop(links)
    scratch.sweep()  # the bands' shuffle goes before the texts move
    # A large cluster is cut into blocks by size and hash and verified block against block: no task holds more than two.
    large = scratch.keep(clusters.groupBy("component").count().filter(F.col("count") > CLUSTER_BLOCK).select("component", F.lit(True).alias("_large")))
    wanted = clusters.join(large, "component", "left")
    texts = text.mapInArrow(_texts, "lid long, line string").join(wanted, "lid").dropDuplicates(["lid"])
    named = scratch.keep(texts.select("component", "lid", "line", F.coalesce("_large", F.lit(False))).mapInArrow(_grades, "component long, lid long, line string, _g int"))
    scratch.drop(clusters)
    by = ["component", "_i", "_j"]
    found = graded_pairs(named, scratch).select(*by, "_b", "lid", "line").repartition(*by).sortWithinPartitions(*by)
    links = scratch.keep(found.mapInArrow(_verify, "u long, v long"))
    scratch.drop(named)
    return links


def removed_lines(documents: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """``documents`` (_row, doc_id, text) to (_row, doc_id, n_lines, removed), ``removed`` an array of line numbers.

    Lines count from 0, blank ones too. A null or empty text has no line to remove. Rows that repeat lose all their
    lines but for the first row's. A null doc_id comes last in the choice of the line that stays. An empty table
    gives no rows. Texts of any length are read whole.
    """
    spark = documents.sparkSession
    ship(spark)
    scratch = scratch or Scratch(spark, "lines")
    found = line_links(documents, scratch)
    parts = scratch.keep(connected_components(found, scratch).withColumnRenamed("node", "lid"))
    scratch.drop(found)
    scratch.sweep()
    rows = scratch.keep(documents.select("_row", F.col("doc_id").cast("long"), "text").mapInArrow(_places, "_row long, doc_id long, no int, lid long"))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row", "no")
    each = rows.groupBy("lid").agg(F.min(place).alias("first"), F.count("*").alias("n")).join(parts, "lid", "left").filter("n > 1 OR component IS NOT NULL")
    each = scratch.keep(each.select("lid", F.coalesce("component", "lid").alias("class"), "first"))
    firsts = each.groupBy("class").agg(F.min("first").alias("first"))
    # Written, so that the join below reads two plain exchanges and a very common line is dealt over several tasks.
    stays = scratch.keep(each.select("lid", "class").join(firsts, "class").select("lid", F.col("first._row").alias("_first"), F.col("first.no").alias("_no")))
    gone = rows.join(stays, "lid").filter((F.col("_first") != F.col("_row")) | (F.col("_no") != F.col("no")))
    by_row = gone.groupBy("_row").agg(F.sort_array(F.collect_list("no")).alias("removed"))
    text = F.coalesce(F.col("text"), F.lit(""))
    n_lines = (F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).alias("n_lines")
    counts = documents.select("_row", F.col("doc_id").cast("long"), n_lines)
    return counts.join(by_row, "_row", "left").withColumn("removed", F.coalesce("removed", F.array().cast("array<int>")))


def line_digest(documents: DataFrame) -> DataFrame:
    """Per document the number of its lines, the number and the places of those that go.

    Nulls, repeated rows, ties, very long texts and empty tables: as in ``removed_lines``. Other columns are not read.
    """
    scratch = Scratch(documents.sparkSession, "lines")
    found = removed_lines(with_row_id(documents.select("doc_id", "text"), scratch), scratch)
    return found.select("doc_id", "n_lines", F.size("removed").alias("n_removed"), "removed")


def drop_repeated_lines(documents: DataFrame) -> DataFrame:
    """``documents`` with the repeated lines cut out of the texts; every row stays, if need be with an empty text.

    Null texts stay null; of repeated rows the first keeps its lines; ties go as in ``removed_lines``. A column n_chars
    is counted anew where lines go. Columns of any other name pass through unchanged.
    """
    scratch = Scratch(documents.sparkSession, "lines")
    docs = boxed(documents, scratch)
    gone = removed_lines(docs.select("_row", "_doc.doc_id", "_doc.text"), scratch).filter("size(removed) > 0").select("_row", "removed")
    text = F.col("_doc.text")
    numbered = F.transform(F.split(text, "\n", -1), lambda x, i: F.struct(i.alias("i"), x.alias("x")))
    left = F.map_from_arrays("removed", F.col("removed"))
    cut = F.array_join(F.transform(F.filter(numbered, lambda s: ~F.map_contains_key(left, s["i"])), lambda s: s["x"]), "\n")
    joined = docs.join(gone, "_row", "left").withColumn("_cut", F.when(F.col("removed").isNotNull(), cut))
    new = {"text": F.coalesce("_cut", text)}
    if "n_chars" in documents.columns:
        new["n_chars"] = F.when(F.col("removed").isNull(), F.col("_doc.n_chars")).otherwise(F.length("_cut").cast(documents.schema["n_chars"].dataType))
    return unboxed(joined, documents, new)
