"""Best-fit packing of token pieces into fixed-length sequences by hierarchical residual packing.

Narrow items (ids and lengths, never texts) are dealt into groups of bounded size. Each group packs its items best
fit, longest first, and emits the bins that are nearly full. Underfull bins then travel as single items up a tree:
each round merges several groups and packs their bins best fit again, until one group is left.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm import bpe
from weftline.llm.scratch import Scratch, ship

#: Items of a leaf group, groups merged into one by a round, and the free part of a bin below which it is emitted.
LEAF_ITEMS, FAN_IN, NEARLY_FULL = 50_000, 16, 1 / 128

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item, and the fill of each bin: longest first, into the fullest bin with room."""
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, fills = 0, []
    where, offset = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    size = sizes.tolist()
    for i in np.argsort(-sizes, kind="stable").tolist():
        s = size[i]
        fits = mask >> s
        if fits:
            room = s + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                mask ^= 1 << room
        else:
            b, room = len(fills), capacity
            fills.append(0)
        where[i], offset[i] = b, capacity - room
        fills[b] += s
        if room > s:
            by_room[room - s].append(b)
            mask |= 1 << (room - s)
    return where, offset, np.asarray(fills, np.int64)


def _pack_groups(capacity: int, level: int, groups: int):
    """A group's rows are items; rows that share ``_bin`` are one item. Sets _bin, _offset, _fill and _done anew."""
    slack = int(capacity * NEARLY_FULL)

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        group = int(pdf["_group"].iloc[0])
        pdf = pdf.sort_values(["_bin", "_offset"], kind="stable").reset_index(drop=True)
        codes, _ = pd.factorize(pdf["_bin"])
        fills = np.bincount(codes, weights=pdf["length"]).astype(np.int64)
        where, base, filled = best_fit(fills, capacity)
        pdf["_offset"] += base[codes]
        bins = where[codes]
        pdf["_bin"] = (level << 58) + (group << 32) + bins
        done = capacity - filled <= slack
        # After best fit a group has at most one bin that is half empty or more, so all groups have at most
        # ``groups`` of them, and no more than that many fuller bins can take part in a merge: the emptiest serve best.
        full = np.flatnonzero(~done & (2 * filled > capacity))
        done[full[np.argsort(filled[full], kind="stable")[groups:]]] = True
        pdf["_done"] = done[bins] | (groups == 1)
        pdf["_group"] = group // FAN_IN
        return pdf

    return pack


def pack_items(items: DataFrame, capacity: int = 1024, scratch: Scratch | None = None) -> DataFrame:
    """``items`` (with a ``length`` of 1 to capacity) plus ``sequence_id`` and ``offset``, both long.

    Items of full length have a sequence of their own. Repeated rows are separate items; ties in length go in scan
    order. A null length, or one out of range, raises. An empty table gives no rows. Columns named sequence_id or
    offset are replaced.
    """
    spark = items.sparkSession
    ship(spark)
    scratch = scratch or Scratch(spark, "packing")
    items = items.drop("sequence_id", "offset")
    cols = items.columns
    ok = F.col("length").isNotNull() & F.col("length").between(1, capacity)
    items = scratch.keep(items.withColumn("length", F.when(ok, F.col("length")).otherwise(F.raise_error(F.lit("length out of range")).cast("long"))).withColumn("_item", F.monotonically_increasing_id()))
    whole = items.filter(F.col("length") == capacity).select(*cols, (-1 - F.col("_item")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    groups = max(1, math.ceil(items.filter(F.col("length") < capacity).count() / LEAF_ITEMS))
    todo = items.filter(F.col("length") < capacity).select(
        *cols, F.pmod(F.xxhash64("_item"), F.lit(groups)).alias("_group"), F.col("_item").alias("_bin"), F.lit(0).cast("long").alias("_offset"), F.lit(False).alias("_done")
    )
    out, level = [whole], 0
    while True:
        packed = scratch.keep(todo.groupBy("_group").applyInPandas(_pack_groups(capacity, level, groups), todo.schema))
        out.append(packed.filter("_done").select(*cols, F.col("_bin").alias("sequence_id"), F.col("_offset").alias("offset")))
        if groups == 1:
            break
        todo, groups, level = packed.filter("NOT _done"), math.ceil(groups / FAN_IN), level + 1
    result = out[0]
    for part in out[1:]:
        result = result.unionByName(part)
    return result


def _pieces_of(content: str, capacity: int, end_id: int):
    end = int(end_id).to_bytes(4, "little")

    def cut(batches):
        enc = bpe.encoder(content)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
                rows: list[list] = [[], [], [], [], []]
                for doc_id, code in zip(ids, enc.encode([t or "" for t in texts]), strict=True):
                    code += end
                    n = len(code) // 4
                    start, length = 0, (n - 1) % capacity + 1
                    piece = 0
                    while start < n:
                        for to, x in zip(rows, (doc_id, piece, start, length, zlib.crc32(code[4 * start : 4 * (start + length)])), strict=True):
                            to.append(x)
                        start, length, piece = start + length, capacity, piece + 1
                yield pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return cut


def token_pieces(documents: DataFrame, vocab_path: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """One row per piece of each document's ids (text by the tokenizer, then the end id).

    Only documents of more than ``capacity`` ids are cut; all pieces but the first then have that length. A null or
    empty text is the end id alone. A null doc_id is kept.
    """
    ship(documents.sparkSession)
    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(_pieces_of(bpe.vocabulary(vocab_path), capacity, end_id), PIECES)


def pack_documents(documents: DataFrame, vocab_path: str | None = None, capacity: int = 1024, end_id: int = 2, scratch: Scratch | None = None) -> DataFrame:
    """Pieces of all documents with the sequence and the offset at which each stands.

    A null or empty text is the end id alone; null and repeated doc_ids are kept, repeated rows are packed each; texts of
    any length are cut whole; an empty table gives no rows. Other columns are not read.
    """
    import public_tokenizers

    pieces = token_pieces(documents, vocab_path or public_tokenizers.path("byte_bpe_50k.json"), capacity, end_id)
    return pack_items(pieces, capacity, scratch)
