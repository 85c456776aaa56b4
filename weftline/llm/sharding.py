"""Balanced contiguous shards by global prefix sums of byte sizes.

Rows are ordered by key; a range exchange of narrow rows (never the texts) gives ordered partitions; per-partition
totals give each partition its base; a running sum inside each partition gives every row its global byte position,
and equal targets cut the line of positions into shards. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.scratch import Scratch


def byte_size(text, overhead: int = 8):
    """UTF-8 bytes of the text (null: none) plus a fixed number for the record."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(overhead)).cast("long")


def shard_by_bytes(df: DataFrame, num_shards: int, size: str, order_by: list[str], scratch: Scratch | None = None) -> DataFrame:
    """``df`` plus ``shard`` (int, 0 to num_shards - 1) and ``slot`` (long, gapless from 0 within a shard).

    Rows stand in the order of ``order_by`` (nulls first, as Spark sorts); rows that tie in all of it stand in scan
    order, so even a key that holds a third of all rows is dealt over several partitions. A row belongs to the shard
    in which the middle of its bytes lies, so shards hold near equal bytes: each is off by at most one row's size.
    Every column of ``df`` goes through the exchange, so select narrow columns first and join wide ones afterwards.
    Null or negative sizes count as 0. If all sizes are 0, rows are dealt by count. An empty table gives no rows.
    Columns of ``df`` named shard or slot are replaced.
    """
    spark = df.sparkSession
    scratch = scratch or Scratch(spark, "shards")
    df = df.drop("shard", "slot")
    cols = df.columns
    narrow = df.select("*", F.greatest(F.coalesce(F.col(size), F.lit(0)), F.lit(0)).cast("long").alias("_bytes"), F.monotonically_increasing_id().alias("_tie"))
    order = [*order_by, "_tie"]
    ranged = scratch.keep(narrow.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    # One row per partition of the range exchange: as many as there are tasks, however many rows the table has.
    totals = ranged.groupBy("_part").agg(F.sum("_bytes").alias("_b"), F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(
        "_part",
        F.coalesce(F.sum("_b").over(before), F.lit(0)).alias("_base_bytes"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base_rows"),
        F.sum("_b").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_all_bytes"),
        F.sum("_n").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_all_rows"),
    )
    here = Window.partitionBy("_part").orderBy(*order)
    placed = (
        ranged.withColumn("_upto", F.sum("_bytes").over(here.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_at", F.row_number().over(here) - 1)
        .join(bases, "_part")
        .withColumn("_row", F.col("_base_rows") + F.col("_at"))
        # Twice the middle of the row's bytes, in whole numbers: 2 * (bytes before it) + its own.
        .withColumn("_mid2", 2 * (F.col("_base_bytes") + F.col("_upto")) - F.col("_bytes"))
        .withColumn(
            "shard",
            F.least(
                F.lit(num_shards - 1),
                F.when(F.col("_all_bytes") > 0, F.expr(f"CAST(_mid2 AS DECIMAL(28,0)) * {num_shards} div (2 * CAST(_all_bytes AS DECIMAL(28,0)))"))
                .otherwise(F.floor(F.col("_row") * num_shards / F.col("_all_rows"))),
            ).cast("int"),
        )
        .select(*cols, "shard", "_row")
    )
    placed = scratch.keep(placed)
    scratch.drop(ranged)
    starts = placed.groupBy("shard").agg(F.min("_row").alias("_first"))  # num_shards rows
    return placed.join(F.broadcast(starts), "shard").select(*cols, "shard", (F.col("_row") - F.col("_first")).cast("long").alias("slot"))


def write_shards(df: DataFrame, path: str) -> None:
    """Writes each shard of a sharded frame to its own folder, in slot order."""
    df.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def shard_documents(documents: DataFrame, num_shards: int = 24, scratch: Scratch | None = None) -> DataFrame:
    """The digest of a byte-balanced sharding of documents: one narrow row per document.

    A null or empty text is 8 bytes, so sizes are never all zero; documents stand in order of doc_id, nulls first;
    repeated rows each have a slot; texts of any length are measured whole; an empty table gives no rows. Other columns
    are not read.
    """
    narrow = documents.select("doc_id", byte_size(F.col("text")).alias("size"), F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"))
    out = shard_by_bytes(narrow, num_shards, "size", ["doc_id", "text_crc32", "size"], scratch)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: CRC-32 in SQL: the table from its polynomial (a fixed value), then one step per byte.
_CRC_TABLE = "SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce([i::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v FROM range(256) r(i))"
_CRC = "xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(len(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)), lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295)"

#: The digest of shard_documents with 24 shards, for DuckDB.
ORACLE_SQL = f"""WITH tab AS MATERIALIZED ({_CRC_TABLE}),
    d AS MATERIALIZED (
      SELECT doc_id, coalesce(strlen(text), 0) + 8 AS size, {_CRC} AS text_crc32 FROM (SELECT doc_id, text, hex(encode(coalesce(text, ''))) AS h FROM documents), tab
    ), p AS (
      SELECT *, row_number() OVER o AS pos, 2 * sum(size) OVER (o ROWS UNBOUNDED PRECEDING) - size AS mid2, sum(size) OVER () AS whole
      FROM d WINDOW o AS (ORDER BY doc_id NULLS FIRST, text_crc32, size)
    ), s AS (SELECT *, least(23, (mid2::HUGEINT * 24) // (2 * whole)::HUGEINT)::INTEGER AS shard FROM p)
    SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'bytes' AS law, shard,
      (row_number() OVER (PARTITION BY shard ORDER BY pos) - 1)::BIGINT AS slot, NULL::INTEGER AS grown_shard
    FROM s"""
