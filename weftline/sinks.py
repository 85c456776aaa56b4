"""Writers for the layouts that jobs leave behind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_tsv(df: DataFrame, path: str, header: bool = False, mode: str = "overwrite", sep: str = "\t") -> None:
    df.write.mode(mode).csv(path, sep=sep, header=header)


def write_named(outputs: dict[str, DataFrame], path: str, mode: str = "overwrite") -> None:
    """Each frame to its own folder. Give frames of one written parent, so that it is computed once."""
    for name, df in outputs.items():
        df.write.mode(mode).parquet(f"{path}/{name}")


def write_by_kind(df: DataFrame, kind: str, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).partitionBy(kind).parquet(path)


def write_sorted(df: DataFrame, key: str, path: str, mode: str = "overwrite") -> None:
    """Range-partitioned and sorted by key, as bulk loads of ordered stores want it."""
    df.repartitionByRange(key).sortWithinPartitions(key).write.mode(mode).parquet(path)


def apply_changes(state: DataFrame, changes: DataFrame, key: str = "row_key", value: str = "value") -> DataFrame:
    """``state`` (key, value) after ``changes`` (key, op put or delete, value), at most one change per key."""
    joined = state.join(changes.select(key, F.col("op").alias("_op"), F.col(value).alias("_new")), key, "full_outer")
    kept = joined.filter(~F.col("_op").eqNullSafe("delete"))
    return kept.select(key, F.when(F.col("_op") == "put", F.col("_new")).otherwise(F.col(value)).alias(value))


def write_vw(df: DataFrame, line: Column, path: str, mode: str = "overwrite") -> None:
    df.select(line.alias("value")).write.mode(mode).text(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A json object per row and line, nulls left out; a dictionary is a frame of its keys and values."""
    df.write.mode(mode).json(path)
