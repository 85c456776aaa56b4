"""Hosts, search queries per host, robots rules and the link graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.text import absolute, host, links, url_path


def host_count(urls: DataFrame, url: str = "url") -> DataFrame:
    return urls.select(host(F.col(url)).alias("host")).filter("host IS NOT NULL").groupBy("host").agg(F.count("*").alias("cnt"))


def host_share(urls: DataFrame, url: str = "url") -> DataFrame:
    """host, cnt, percent of all. The total joins as one row, so no window gathers the hosts in one task."""
    counts = host_count(urls, url)
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("cnt").alias("_all")))).select("host", "cnt", (100.0 * F.col("cnt") / F.col("_all")).alias("percent"))


def host_query_count(clicks: DataFrame) -> DataFrame:
    """``clicks`` (query, url) to host, query, cnt; rows without a host are left out."""
    return clicks.select(host(F.col("url")).alias("host"), "query").filter("host IS NOT NULL AND query IS NOT NULL").groupBy("host", "query").agg(F.count("*").alias("cnt"))


def top_query(clicks: DataFrame, min_clicks: int = 1) -> DataFrame:
    """The most clicked query of each host (ties: the first in order), if it has ``min_clicks``."""
    order = Window.partitionBy("host").orderBy(F.desc("cnt"), "query")
    return host_query_count(clicks).withColumn("_n", F.row_number().over(order)).filter((F.col("_n") == 1) & (F.col("cnt") >= min_clicks)).drop("_n")


def compile_rules(rules: Column) -> Column:
    """Lines of ``Disallow: `` rules as structs (start, needle, end); a line of another form raises. Null or empty: none.

    ``/x`` matches at the start, ``*x`` anywhere, ``x$`` at the end with the dollar sign as an ordinary character;
    in the first two a ``$`` at the end asks for the end instead.
    """
    lines = F.filter(F.split(F.coalesce(rules, F.lit("")), "\n", -1), lambda x: x != "")

    def one(line: Column) -> Column:
        rule = F.substr(line, F.lit(11))
        start, free = rule.startswith("/"), rule.startswith("*")
        end = (start | free) & rule.endswith("$")
        body = F.when(free, F.substr(rule, F.lit(2))).otherwise(rule)
        bad = ~line.startswith("Disallow: ") | ~(start | free | rule.endswith("$"))
        needle = F.when(bad, F.raise_error(F.concat(F.lit("bad robots rule: "), line)).cast("string")).when(end, F.substr(body, F.lit(1), F.length(body) - 1)).otherwise(body)
        return F.struct(start.alias("start"), needle.alias("needle"), (end | ~(start | free)).alias("end"))

    return F.transform(lines, one)


def allowed(compiled: Column, target: Column) -> Column:
    """Whether no rule matches the target, to which a slash is put in front if it has none."""
    t = F.when(target.startswith("/"), target).otherwise(F.concat(F.lit("/"), target))

    def hit(r: Column) -> Column:
        at_start, at_end = t.startswith(r["needle"]), t.endswith(r["needle"])
        return F.when(r["start"] & r["end"], t == r["needle"]).when(r["start"], at_start).when(r["end"], at_end).otherwise(t.contains(r["needle"]))

    return ~F.exists(compiled, hit)


def robots_decisions(pages: DataFrame, sites: DataFrame, target: str = "path") -> DataFrame:
    """``pages`` (url, disabled, ...) with ``is_disabled``; ``sites`` (site, robots) joins by host, none allows all.

    ``target`` is what rules look at: the path, as robots rules mean it, or the whole url.
    """
    rules = sites.select(F.col("site").alias("_site"), compile_rules(F.col("robots")).alias("_rules"))
    joined = pages.join(rules, host(F.col("url")) == F.col("_site"), "left")
    what = url_path(F.col("url")) if target == "path" else F.col("url")
    return joined.withColumn("is_disabled", ~allowed(F.coalesce("_rules", F.expr("cast(array() as array<struct<start:boolean,needle:string,end:boolean>>)")), what)).drop("_site", "_rules")


def robots_changes(pages: DataFrame, sites: DataFrame, target: str = "path") -> DataFrame:
    """Rows (row_key, op, value) that bring the ``disabled`` cell up to date; unchanged pages have none."""
    found = robots_decisions(pages, sites, target).withColumn("_was", F.col("disabled").isNotNull())
    changed = found.filter(F.col("_was") != F.col("is_disabled"))
    return changed.select(F.md5("url").alias("row_key"), F.when(F.col("is_disabled"), F.lit("put")).otherwise("delete").alias("op"), F.when(F.col("is_disabled"), F.lit("Y")).alias("value"))


def extract_links(pages: DataFrame, key: str, html: str = "html", base: Column | None = None) -> DataFrame:
    """One row per link; a link that starts with a slash gets the base (that of the page's url) in front."""
    site = base if base is not None else F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", 0)
    return pages.select(key, site.alias("_base"), F.explode(links(F.col(html))).alias("_l")).select(key, absolute(F.col("_l"), F.col("_base")).alias("link"))


def link_graph(found: DataFrame, urls: DataFrame, key: str) -> DataFrame:
    """Distinct edges (src, dst) between known documents; ``urls`` has id and url."""
    return found.join(urls, found["link"] == urls["url"]).select(F.col(key).alias("src"), F.col("id").alias("dst")).distinct()
