"""Train, validation and test parts of a table, the same in every run and on every cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def place(key: Column, seed: int = 0) -> Column:
    """A number in [0, 1) by the md5 of a key, so that any engine deals rows alike. A null key counts as an empty text."""
    code = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(code, 1, 8), 16, 10).cast("long") / float(1 << 32)


def split(df: DataFrame, key: str, share: float, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Rows whose key falls within ``share``, and the others. With a group's name as key, groups stay whole."""
    at = place(F.col(key), seed)
    return df.filter(at < share), df.filter(at >= share)


def tagged(frames: dict[str, DataFrame], tag: str = "part") -> DataFrame:
    """The rows of all frames under their common columns, with the frame's name; a column that one lacks is null."""
    every = [df.withColumn(tag, F.lit(name)) for name, df in frames.items()]
    out = every[0]
    for df in every[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def without(df: DataFrame, held_out: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` without the rows whose keys are held out; null keys are equal to each other."""
    out = held_out.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return df.join(out, same, "left_anti")
