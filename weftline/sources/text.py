"""Text layouts on Spark's own readers."""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.text import key_value


def read_lines(spark: SparkSession, path: str | list[str], recursive: bool = False, pattern: str | None = None) -> DataFrame:
    """``value`` per line; gzip by name, folders, globs and, if asked, folders below."""
    reader = spark.read.option("recursiveFileLookup", str(recursive).lower())
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.text(path)


def read_key_values(spark: SparkSession, path: str) -> DataFrame:
    return read_lines(spark, path).select(key_value(F.col("value")).alias("_kv")).select("_kv.*")


def read_tsv(spark: SparkSession, path: str, schema: str, header: bool = False, sep: str = "\t", bad: str = "PERMISSIVE") -> DataFrame:
    """``bad``: PERMISSIVE (nulls), DROPMALFORMED or FAILFAST."""
    return spark.read.csv(path, schema=schema, sep=sep, header=header, mode=bad)


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """src, dst; comment and empty lines are left out."""
    parts = F.split("value", "\t", -1)
    return read_lines(spark, path).filter("value <> '' AND NOT startswith(value, '#')").select(parts[0].cast("long").alias("src"), parts[1].cast("long").alias("dst"))


def read_lists(spark: SparkSession, path: str, lists: list[str], sep: str = ";") -> DataFrame:
    """A file with a header line; all columns are text, those in ``lists`` arrays of the comma-separated parts (an empty field has none)."""
    rows = spark.read.csv(path, sep=sep, header=True)
    parts = lambda c: F.when(F.col(c).isNull(), F.array().cast("array<string>")).otherwise(F.split(c, ",", -1))
    return rows.select(*[parts(c).alias(c) if c in lists else F.col(c) for c in rows.columns])


def read_ratings(spark: SparkSession, path: str) -> DataFrame:
    """user, item (from 1 on, as the files have them) and rating; a line that is not three numbers raises."""
    return read_tsv(spark, path, "user long, item long, rating double", bad="FAILFAST")


def parse_svmlight(lines: DataFrame) -> DataFrame:
    """label, qid (null if there is none), features (map from number to value) of lines ``y qid:q i:v ... # note``."""
    words = F.filter(F.split(F.trim(F.regexp_replace("value", "#.*$", "")), r"\s+", -1), lambda w: w != "")
    pairs = F.filter(F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda w: ~w.startswith("qid:"))
    entry = lambda w: F.struct(F.split_part(w, F.lit(":"), F.lit(1)).cast("int").alias("key"), F.split_part(w, F.lit(":"), F.lit(2)).cast("double").alias("value"))
    return lines.filter(F.size(words) > 0).select(words[0].cast("double").alias("label"), F.nullif(F.regexp_extract("value", r"\bqid:(\d+)", 1), F.lit("")).cast("long").alias("qid"), F.map_from_entries(F.transform(pairs, entry)).alias("features"))


def dense(features: Column, n: int, first: int = 1) -> Column:
    """A map of features as an array of n numbers; absent ones are 0."""
    return F.transform(F.sequence(F.lit(first), F.lit(first + n - 1)), lambda i: F.coalesce(F.try_element_at(features, i), F.lit(0.0)))


def deflate(text: Column) -> Column:
    """Text to zlib streams; null stays null. Few rows at a time, since those of an Arrow batch may be of any size."""

    def encode(t: str | None) -> bytes | None:
        return None if t is None else zlib.compress(t.encode())

    return F.udf(encode, "binary", useArrow=False)(text)


def inflate(raw: Column) -> Column:
    """zlib streams to text; null stays null. Few rows at a time: a batch of small streams may hold very much text."""

    def decode(b: bytes | None) -> str | None:
        return None if b is None else zlib.decompress(b).decode("utf-8", "replace")

    return F.udf(decode, "string", useArrow=False)(raw)


def page_html(encoded: Column) -> Column:
    """Base64 of a zlib stream to html."""
    return inflate(F.unbase64(encoded))
