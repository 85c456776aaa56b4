"""Single cells of a table of keys and values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.sinks import apply_changes


def get(table: DataFrame, key, row_key: str = "row_key") -> DataFrame:
    """The rows of a key: none if it is unknown or null. The condition reaches the scan."""
    return table.filter(F.col(row_key) == F.lit(key))


def put(table: DataFrame, key, value, row_key: str = "row_key", column: str = "value") -> DataFrame:
    """``table`` (key, value) with one cell set."""
    kinds = dict(table.dtypes)
    one = table.sparkSession.range(1).select(F.lit(key).cast(kinds[row_key]).alias(row_key), F.lit("put").alias("op"), F.lit(value).cast(kinds[column]).alias(column))
    return apply_changes(table, one, row_key, column)
