"""Word statistics and text relevance. Distinct-in-document happens before the explode, so shuffles carry counts only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.text import letters, split_ws

#: Words of all queries, repeats in different queries counted, up to which these are broadcast.
QUERY_WORDS = 1_000_000


def word_count(docs: DataFrame, words: Column, name: str = "cnt") -> DataFrame:
    return docs.select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias(name))


def document_frequency(docs: DataFrame, text: str = "text") -> DataFrame:
    return word_count(docs, F.array_distinct(letters(F.col(text))), "df")


def word_count_ws(docs: DataFrame, text: str = "text", drop_empty: bool = False) -> DataFrame:
    w = split_ws(F.col(text))
    return word_count(docs, F.filter(w, lambda x: x != "") if drop_empty else w)


def idf(docs: DataFrame, words: Column, n_docs: int | None = None) -> DataFrame:
    """word, df, idf = log2(N / df); N is counted unless given. The count joins as a single broadcast row."""
    df = word_count(docs, F.array_distinct(words), "df")
    n = F.lit(n_docs).alias("n") if n_docs else F.count("*").alias("n")
    total = docs.agg(n)
    return df.crossJoin(F.broadcast(total)).select("word", "df", F.log2(F.col("n") / F.col("df")).alias("idf"))


def term_frequency(docs: DataFrame, key: str, words: Column) -> DataFrame:
    return docs.select(key, F.explode(words).alias("word")).groupBy(key, "word").agg(F.count("*").alias("tf"))


def first_per_key(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """One row per key, the first in a total order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("_n = 1").drop("_n")


def with_idf(words: DataFrame, idf: DataFrame) -> DataFrame:
    """``words`` (word, ...) with the idf of each; a word that ``idf`` (word, idf) does not know has 0."""
    return words.join(idf.select("word", "idf"), "word", "left").na.fill(0.0, ["idf"])


def relevance(docs: DataFrame, queries: DataFrame, key: str, words: Column, query_words: Column, k: float = 2.0, b: float = 0.75, average: float | None = None) -> DataFrame:
    """query_id, key, tf_idf, bm25 for every document that shares a word with a query.

    Term frequency is divided by the document's length in both measures. Words without an idf weigh 0. ``queries``
    (query_id, ...) may have any size: their words and the weights, a row per different word, are joined, and broadcast
    where they are ``QUERY_WORDS`` at most. Documents are dealt by key before their words are counted,
    so that neither counts nor sums per document move again where the words' weights are small enough to broadcast.
    """
    q = queries.select("query_id", F.explode(F.array_distinct(query_words)).alias("word"))
    few = q.limit(QUERY_WORDS + 1).count() <= QUERY_WORDS
    here = F.broadcast if few else (lambda df: df)  # sizes that show only once the other side has moved come too late
    measured = lambda d: d.select(key, F.size(words).alias("length"), words.alias("_words"))
    n = measured(docs.repartition(key))
    stats = measured(docs).agg(F.avg("length").alias("_mean"), F.count("*").alias("_n"))
    wanted = q.select("word").distinct()
    hits = n.select(key, "length", F.explode("_words").alias("word")).join(here(wanted), "word", "left_semi").groupBy(key, "length", "word").agg(F.count("*").alias("tf"))
    weight = here(hits.groupBy("word").agg(F.count("*").alias("df")))
    mean = F.lit(float(average)) if average else F.col("_mean")
    tf = F.col("tf") / F.col("length")
    scored = (
        hits.join(weight, "word").crossJoin(F.broadcast(stats)).join(here(q), "word")
        .withColumn("_idf", F.log2(F.col("_n") / F.col("df")))
        .withColumn("_tf_idf", tf * F.col("_idf"))
        .withColumn("_bm25", F.col("_idf") * tf * (k + 1) / (tf + k * (1 - b + b * F.col("length") / mean)))
    )
    return scored.groupBy("query_id", key).agg(F.sum("_tf_idf").alias("tf_idf"), F.sum("_bm25").alias("bm25"))
