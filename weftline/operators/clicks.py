"""Click models over search sessions (query, shown array, clicked array), at any grain in one aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.text import host, normal_url, strip_scheme

#: Weights of positions in the position-based model; the last one holds for all further positions.
POSITION_WEIGHTS = [0.41, 0.16, 0.11, 0.08, 0.06, 0.05, 0.04, 0.03, 0.025, 0.025]
BUCKETS = 5


def parse_sessions(lines: DataFrame, strip_www: bool = True) -> DataFrame:
    """Log lines ``query@geo TAB shown,... TAB clicked,...`` to query, geo, shown, clicked; others are dropped.

    Empty fields at a line's end do not count as fields, so a line without clicks has too few.
    """
    parts = F.split(F.regexp_replace("value", r"\t+$", ""), "\t", -1)
    clean = normal_url if strip_www else strip_scheme
    urls = lambda i: F.transform(F.split(F.get(parts, F.lit(i)), ",", -1), clean)
    rows = lines.filter(F.size(parts) >= 3)
    return rows.select(F.trim(F.split_part(parts[0], F.lit("@"), F.lit(1))).alias("query"), F.split_part(parts[0], F.lit("@"), F.lit(2)).alias("geo"), urls(1).alias("shown"), urls(2).alias("clicked")).filter("clicked[0] <> ''")


def positions(sessions: DataFrame, keys: list[str]) -> DataFrame:
    """A row per shown url: keys, pos (from 0), url, click, min_click, last_click.

    A click on a url that was not shown counts as one on position 0; of a url shown twice the first takes the click.
    ``last_click`` belongs to the last click listed. Sessions without a click are dropped.
    """
    at = F.transform("clicked", lambda c: F.greatest(F.array_position("shown", c) - 1, F.lit(0)).cast("int"))
    found = sessions.filter(F.size("clicked") > 0).withColumn("_at", at)
    rows = found.select(*keys, "_at", F.posexplode("shown").alias("pos", "url"))
    return rows.select(*keys, "pos", "url", F.array_contains("_at", F.col("pos")).alias("click"), F.array_min("_at").alias("min_click"), F.element_at("_at", -1).alias("last_click"))


def click_stats(shown: DataFrame, keys: list[str], models: bool = True) -> DataFrame:
    """Counts per ``keys``: shows, clicks, the first positions', satisfied, aver_pos and, with ``models``, those of the
    position-based, cascade and dynamic Bayesian models."""

    def count(condition) -> F.Column:
        return F.coalesce(F.sum(condition.cast("long")), F.lit(0))

    pos, click = F.col("pos"), F.col("click")
    aggs = [F.count("*").alias("shows"), count(click).alias("clicks")]
    aggs += [count(pos == i).alias(f"pos{i + 1}_shows") for i in range(BUCKETS)]
    aggs += [count((pos == i) & click).alias(f"pos{i + 1}_clicks") for i in range(BUCKETS)]
    last = pos == F.col("last_click")
    if models:
        weight = F.element_at(F.array(*[F.lit(w) for w in POSITION_WEIGHTS]), F.least(pos, F.lit(len(POSITION_WEIGHTS) - 1)) + 1)
        aggs += [
            F.sum(weight).alias("pos_based_shows"),
            count(pos <= F.col("min_click")).alias("cascade_shows"),
            count(pos == F.col("min_click")).alias("cascade_clicks"),
            count(pos <= F.col("last_click")).alias("dbn_shows"),
            count(click & (pos <= F.col("last_click"))).alias("dbn_clicks"),
            count(last).alias("dbn_satisfied"),
        ]
    else:
        aggs.append(count(last).alias("satisfied"))
    aggs.append((F.sum(pos) / F.count("*")).alias("aver_pos"))
    return shown.groupBy(*keys).agg(*aggs)


def with_host(shown: DataFrame) -> DataFrame:
    return shown.withColumn("host", host(F.col("url"))).filter("host IS NOT NULL")


def resolve(shown: DataFrame, urls: DataFrame, queries: DataFrame) -> DataFrame:
    """Texts to ids: ``urls`` (url, url_id) inner, ``queries`` (query, query_id) left, so an unknown query keeps its row
    for the global statistics. Dictionaries are joined by size: the optimizer broadcasts small ones."""
    return shown.join(urls, "url").join(queries, "query", "left")


def split_outputs(stats: DataFrame, train: DataFrame, test: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Query-level statistics of the train pairs and of the test pairs."""
    return stats.join(train.select(*keys).distinct(), keys, "left_semi"), stats.join(test.select(*keys).distinct(), keys, "left_semi")
