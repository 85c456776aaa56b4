"""Fixed-width weather lines and extremes per key and day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: 9999.9 degrees Fahrenheit in Celsius, which stands for a missing reading.
MISSING_C = 5537.72


def _celsius(line: Column, at: int) -> Column:
    f = F.regexp_replace(F.trim(F.substring(line, at, 6)), r"\*$", "").cast("float")
    return ((f - F.lit(32.0).cast("float")) * F.lit(5.0).cast("float") / F.lit(9.0).cast("float")).cast("float")


def parse_weather(lines: DataFrame, value: str = "value") -> DataFrame:
    """station, year, month, day, max_temp, min_temp (Celsius, single precision; null where missing)."""
    v = F.col(value)
    number = lambda at, n: F.substring(v, at, n).cast("int")
    present = lambda t: F.when(F.abs(t - MISSING_C) > 1, t)
    return lines.select(number(1, 6).alias("station"), number(15, 4).alias("year"), number(19, 2).alias("month"), number(21, 2).alias("day"), present(_celsius(v, 103)).alias("max_temp"), present(_celsius(v, 111)).alias("min_temp"))


def day_key(station: Column, month: Column, day: Column) -> Column:
    return F.format_string("%d:%02d.%02d", station, day, month)


def degrees(temperature: Column, number: Column) -> Column:
    """A temperature with one digit and a whole number, as ``21.4C (7)``; null if either is."""
    return F.when(temperature.isNotNull() & number.isNotNull(), F.format_string("%.1fC (%d)", temperature, number))


def extreme_by_key(df: DataFrame, keys: list[str], value: str, order: list[Column]) -> DataFrame:
    """The row of the greatest value per key, ties by ``order``; null values take no part."""
    w = Window.partitionBy(*keys).orderBy(F.desc(value), *order)
    return df.filter(F.col(value).isNotNull()).withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def located(rows: DataFrame, stations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with their station's place, and the rows whose station is unknown. ``stations``: station, lat, lon."""
    known = stations.filter("station <> 999999 AND lat IS NOT NULL AND lon IS NOT NULL")
    return rows.join(known, "station"), rows.join(known, "station", "left_anti")
