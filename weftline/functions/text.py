"""Column expressions for words, urls and log lines; all run inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

LETTERS = r"\p{L}+"
#: Fixed value: Latin and Cyrillic letters and digits, without the two letters that lie outside the ranges.
ALNUM_RU = "[A-Za-zА-Яа-я0-9]+"
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^:/?#]*)"
LINK = r"""(?is)<a[^>]+href=["']?([^"'\s>]+)["']?[^>]*>"""


def letters(text: Column) -> Column:
    """All runs of letters, lower-cased, repeats kept; null for null."""
    return F.regexp_extract_all(F.lower(text), F.lit(LETTERS), F.lit(0))


def alnum_words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(ALNUM_RU), F.lit(0))


def split_ws(text: Column) -> Column:
    """Split at each white-space character; empty strings inside and in front count, trailing ones do not."""
    return F.split(F.regexp_replace(text, r"\s+$", ""), r"\s", -1)


def without(words: Column, stop: list[str]) -> Column:
    """Words that are no stop words; order and repeats stay."""
    return F.filter(words, lambda w: ~w.isin(*stop)) if stop else words


def lemmas(words: Column, lemmatise: Callable[[list[str]], list[str]] | None = None) -> Column:
    """Each word's lemma by a function of many words, which a worker asks once per word and batch; by default the word."""
    if lemmatise is None:
        return words

    def work(values: pd.Series) -> pd.Series:
        known = sorted({w for v in values if v is not None for w in v})
        to = dict(zip(known, lemmatise(known), strict=True))
        return values.map(lambda v: None if v is None else [to[w] for w in v])

    return F.pandas_udf(work, "array<string>")(words)


def host(url: Column) -> Column:
    """Host as written; null where the text has no scheme."""
    return F.nullif(F.regexp_extract(url, HOST, 1), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host, at least ``/``."""
    rest = F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", "")
    return F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))


def strip_scheme(url: Column) -> Column:
    """Schemes go wherever they stand."""
    return F.replace(F.replace(url, F.lit("http://"), F.lit("")), F.lit("https://"), F.lit(""))


def normal_url(url: Column) -> Column:
    """Schemes and ``www.`` go wherever they stand, and one trailing slash."""
    return F.regexp_replace(F.replace(strip_scheme(url), F.lit("www."), F.lit("")), "/$", "")


def links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(LINK), F.lit(1))


def absolute(link: Column, base: Column) -> Column:
    return F.when(link.startswith("/"), F.concat(base, link)).otherwise(link)


def smoothed(a: Column, b: Column, alpha: float = 0.1) -> Column:
    return (a + alpha) / (b + 2 * alpha)


def key_value(line: Column) -> Column:
    """Key and value at the first tab; the value of a line without one is empty."""
    parts = F.split(line, "\t", 2)
    return F.struct(parts[0].alias("key"), F.coalesce(F.get(parts, F.lit(1)), F.lit("")).alias("value"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; null where a vector is null or zero."""
    return 1 - F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
