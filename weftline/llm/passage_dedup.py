"""Substring deduplication by content-defined chunking with a gear rolling hash.

The gear hash rolls over words: shifted left by one bit and increased by the hash of each word, so that its low bits
depend on the last few words alone. A chunk ends where chosen bits are zero; as nothing but nearby words decides,
chunks fall into step again shortly after any insertion. Pairs
of neighbouring chunks that occur in more than one document are found by digest (a single short chunk is too common
to say much); overlapping runs of them that are long enough are repeated passages. The first row by (doc_id, row)
keeps a pair, the others lose it.

Texts are chunked twice, for the counts and for the join, rather than written as chunks, which take more room than the
texts do.

Chunks of under three words on average leave a passage of over 50 words more than 40 of them inside whole chunks,
however it is embedded, so the length that counts as a passage is set well below that. A passage is found up to the
chunks at its two ends: of the words inside windows of 50 words that another document repeats about 0.98 lie in found
spans, of 25 words about 0.94, and of 18 words, the least length, about 0.91.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.scratch import Scratch, boxed, ship, unboxed, with_row_id

#: Words that the deciding bits depend on; the bits, and the values of them below which a chunk ends (three of eight).
GEAR_WINDOW, GEAR_MASK, GEAR_BELOW = 4, 0b1110, 0b0110
#: A longer chunk is cut after each so many words: one word said over and over gives equal chunks wherever it starts.
MOST_WORDS = 16
#: Words of consecutive repeated chunks that make a passage, and words that a removed stretch of one has at least:
#: a common word or two inside a passage may have been elsewhere before.
PASSAGE_WORDS, STRETCH_WORDS = 18, 9
#: A pair's first word, words of its first chunk (at most MOST_WORDS) and words (at most twice that) travel as one number.
SIZE_BITS, PLACE_BITS = 6, 12

_BASE = 0x9E37_79B9_7F4A_7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int, _kept: dict = {}) -> np.ndarray:  # noqa: B006
    have = _kept.get(base)
    if have is None or len(have) < n:
        have = np.ones(max(n, 1 << 16), np.uint64)
        have[1:] = np.uint64(base)
        have = _kept[base] = np.multiply.accumulate(have)
    return have[:n]


def chunk(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, words and digest of each chunk of a text, given the hashes of its words (uint64)."""
    n = len(words)
    gear = np.zeros(n, np.uint64)
    for k in range(min(GEAR_WINDOW, n)):
        gear[k:] += words[: n - k] << np.uint64(k)
    ends = np.flatnonzero(gear & np.uint64(GEAR_MASK) < np.uint64(GEAR_BELOW)) + 1
    if not len(ends) or ends[-1] != n:
        ends = np.append(ends, n)
    starts = np.concatenate([[0], ends[:-1]])
    if (ends - starts).max() > MOST_WORDS:
        ends = np.unique(np.concatenate([ends, *(np.arange(a + MOST_WORDS, b, MOST_WORDS) for a, b in zip(starts, ends, strict=True) if b - a > MOST_WORDS)]))
        starts = np.concatenate([[0], ends[:-1]])
    # A chunk's digest is a polynomial in its words' hashes, from differences of prefix sums brought to one origin.
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * _powers(_BASE, n), dtype=np.uint64)])
    digest = (sums[ends] - sums[starts]) * _powers(_BASE_INVERSE, n + 1)[starts] + (ends - starts).astype(np.uint64)
    digest ^= digest >> np.uint64(31)
    digest *= np.uint64(0xBF58_476D_1CE4_E5B9)
    return starts, ends - starts, digest ^ (digest >> np.uint64(29))


def pairs(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First word, words of the first chunk, words and digest of each pair of neighbours; a lone chunk stands by itself."""
    starts, sizes, digest = chunk(words)
    if len(starts) == 1:
        return starts, sizes, sizes, digest
    both = (digest[:-1] * np.uint64(0x94D0_49BB_1331_11EB)) ^ digest[1:]
    both *= np.uint64(_BASE)
    return starts[:-1], sizes[:-1], sizes[:-1] + sizes[1:], both ^ (both >> np.uint64(32))


def _pairs(batches):
    digest = xxhash.xxh64_intdigest
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            cut = batch.slice(at, 512)
            cols: list[list] = [[], [], []]
            for order, text in zip(*(c.to_pylist() for c in cut.columns), strict=True):
                words = (text or "").encode().split()
                if not words:
                    continue
                starts, own, sizes, codes = pairs(np.array([digest(w) for w in words], np.uint64))
                for to, x in zip(cols, (codes.view(np.int64), np.full(len(codes), order), starts << PLACE_BITS | own << SIZE_BITS | sizes), strict=True):
                    to.append(x)
            if cols[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], ["digest", "order", "place"])


def _ordered(documents: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Texts by ``order``, a long that rises with (doc_id, row), nulls last, and the rows (order, _row).

    Where no doc_id is null or repeats, that is the doc_id itself and texts stay where they are; else rows are ranked.
    """
    ids = documents.select("_row", F.col("doc_id").cast("long").alias("doc_id"))
    if ids.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 OR doc_id IS NULL").isEmpty():
        return documents.select(F.col("doc_id").cast("long").alias("order"), "text"), ids.select(F.col("doc_id").alias("order"), "_row")
    by = [F.col("doc_id").isNull(), F.col("doc_id"), F.col("_row")]
    ranked = scratch.keep(ids.repartitionByRange(*by).sortWithinPartitions(*by).select("_row", F.monotonically_increasing_id().alias("order")))
    return scratch.keep(documents.select("_row", "text").join(ranked, "_row").select("order", "text")), ranked


def repeated_passages(documents: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """``documents`` (_row, doc_id, text) to spans (_row, start, n_words, removed), in words from 0.

    A span is part of a run of chunks that other rows have too, of PASSAGE_WORDS words or more in all; ``removed`` says
    whether it goes or stays. A chunk stays in the first row by (doc_id, row), null doc_ids last, so of repeated rows,
    or rows of one doc_id, the first keeps it. Repetition inside one row alone is none. Null and empty texts have no
    spans, and an empty table has no rows. Texts of any length are read whole.
    """
    ship(documents.sparkSession)
    scratch = scratch or Scratch(documents.sparkSession, "passages")
    texts, rows = _ordered(documents, scratch)
    chunks = texts.mapInArrow(_pairs, "digest long, order long, place long")
    many = chunks.groupBy("digest").agg(F.min("order").alias("first"), F.max("order").alias("last")).filter("first < last").select("digest", "first")
    # Written, so that the join reads two plain exchanges and a very common pair is dealt over several tasks.
    many = scratch.keep(many)
    scratch.sweep()
    found = chunks.join(many, "digest").select(F.col("order").alias("_row"), "place", (F.col("order") != F.col("first")).alias("removed"))
    size = F.lit((1 << SIZE_BITS) - 1)
    found = found.select("_row", F.shiftright("place", PLACE_BITS).alias("start"), F.shiftright("place", SIZE_BITS).bitwiseAND(size).alias("own"), F.col("place").bitwiseAND(size).alias("n"), "removed")
    order = Window.partitionBy("_row").orderBy("start")
    ends = F.lag(F.col("start") + F.col("n")).over(order)
    apart = (~F.coalesce(F.col("start") < ends, F.lit(False))).cast("int")
    runs = found.withColumn("_cut", apart).withColumn("_run", F.sum("_cut").over(order))
    run = Window.partitionBy("_row", "_run")
    runs = runs.withColumn("_words", F.max(F.col("start") + F.col("n")).over(run) - F.min("start").over(run)).filter(F.col("_words") >= PASSAGE_WORDS)
    # A pair answers for its first chunk; the last of a run for both.
    runs = runs.withColumn("n", F.when(F.lead("start").over(run.orderBy("start")).isNull(), F.col("n")).otherwise(F.col("own")))
    stretches = _joined(runs.select("_row", "_run", "start", "n", "removed"))
    firm = stretches.withColumn("removed", F.col("removed") & (F.col("n") >= STRETCH_WORDS))
    spans = _joined(firm).select(F.col("_row").alias("order"), F.col("start").cast("int").alias("start"), F.col("n").cast("int").alias("n_words"), "removed")
    return spans.join(rows, "order").select("_row", "start", "n_words", "removed")


def _joined(spans: DataFrame) -> DataFrame:
    """Neighbours of a run with the same verdict as one span."""
    order = Window.partitionBy("_row", "_run").orderBy("start")
    turn = (~F.coalesce(F.lag("removed").over(order) == F.col("removed"), F.lit(False))).cast("int")
    named = spans.withColumn("_turn", turn).withColumn("_span", F.sum("_turn").over(order))
    return named.groupBy("_row", "_run", "_span").agg(F.min("start").alias("start"), F.sum("n").alias("n"), F.first("removed").alias("removed"))


def passage_digest(documents: DataFrame) -> DataFrame:
    """The repeated passages by doc_id: first word, words, and whether the occurrence is removed or the one that stays.

    Nulls, empties, repeats, ties and long texts: as in ``repeated_passages``. Other columns are not read.
    """
    scratch = Scratch(documents.sparkSession, "passages")
    docs = with_row_id(documents.select("doc_id", "text"), scratch)
    return repeated_passages(docs, scratch).join(docs.select("_row", "doc_id"), "_row").select("doc_id", "start", "n_words", "removed")


def drop_repeated_passages(documents: DataFrame) -> DataFrame:
    """``documents`` with removed passages cut out of the texts, each with the white space after it; all rows stay.

    Null texts stay null; the rest as in ``repeated_passages``. Columns of any name pass through unchanged.
    """
    scratch = Scratch(documents.sparkSession, "passages")
    docs = boxed(documents, scratch)
    spans = repeated_passages(docs.select("_row", "_doc.doc_id", "_doc.text"), scratch).filter("removed").groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("start", "n_words"))).alias("_spans"))
    joined, whole = docs.join(spans, "_row", "left"), F.col("_doc.text")
    pieces = F.regexp_extract_all(whole, F.lit(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"), F.lit(0))
    gone = F.flatten(F.transform("_spans", lambda s: F.sequence(s["start"], s["start"] + s["n_words"] - 1)))
    marks = F.map_from_arrays(gone, gone)
    numbered = F.transform(pieces, lambda x, i: F.struct(i.alias("i"), x.alias("x")))
    left = F.array_join(F.transform(F.filter(numbered, lambda s: ~F.map_contains_key(marks, s["i"])), lambda s: s["x"]), "")
    text = F.when(F.col("_spans").isNull(), whole).otherwise(F.concat(F.regexp_extract(whole, r"^[\x20\x09-\x0D]*", 0), left))
    return unboxed(joined, documents, {"text": text})
