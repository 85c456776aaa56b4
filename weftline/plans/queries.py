"""Registered queries over the driver tables, and the SQL that says the same for DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.operators import clicks, extremes, graph, learning, ranking, splits, text_stats, web
from weftline.plans.registry import ORACLE, QUERIES, query  # noqa: F401
from weftline.shared import new_folder
from weftline.sources import binary
from weftline.sources import text as text_source
from weftline.tables import table

# Words

_SPLIT = r"unnest(string_split_regex(regexp_replace(text, '\s+$', ''), '\s'))"


@query(
    "df_count",
    """SELECT word, count(*) AS df FROM (
         SELECT unnest(list_distinct(regexp_extract_all(lower(text), '\\p{L}+'))) AS word FROM documents
       ) GROUP BY word""",
)
def df_count(spark, sf_dir):
    return text_stats.document_frequency(table(spark, sf_dir, "documents"))


@query("word_count_ws", f"SELECT word, count(*) AS cnt FROM (SELECT {_SPLIT} AS word FROM documents) GROUP BY word")
def word_count_ws(spark, sf_dir):
    return text_stats.word_count_ws(table(spark, sf_dir, "documents"))


@query("word_count_nonempty", f"SELECT word, count(*) AS cnt FROM (SELECT {_SPLIT} AS word FROM documents) WHERE word <> '' GROUP BY word")
def word_count_nonempty(spark, sf_dir):
    return text_stats.word_count_ws(table(spark, sf_dir, "documents"), drop_empty=True)


@query("word_count_letters", r"SELECT word, count(*) AS cnt FROM (SELECT unnest(regexp_extract_all(lower(text), '\p{L}+')) AS word FROM documents) GROUP BY word")
def word_count_letters(spark, sf_dir):
    return text_stats.word_count(table(spark, sf_dir, "documents"), T.letters(F.col("text")))


@query("alnum_words", "SELECT word, count(*) AS cnt FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-zА-Яа-я0-9]+')) AS word FROM documents) GROUP BY word")
def alnum_words(spark, sf_dir):
    return text_stats.word_count(table(spark, sf_dir, "documents"), T.alnum_words(F.col("text")))


_LETTER_DF = r"SELECT word, count(*) AS df FROM (SELECT unnest(list_distinct(regexp_extract_all(lower(text), '\p{L}+'))) AS word FROM documents) GROUP BY word"


@query("global_idf", f"SELECT word, df, round(log2((SELECT count(*) FROM documents)::DOUBLE / df), 8) AS idf FROM ({_LETTER_DF})")
def global_idf(spark, sf_dir):
    return text_stats.idf(table(spark, sf_dir, "documents"), T.letters(F.col("text"))).withColumn("idf", F.round("idf", 8))


@query("term_frequency", r"SELECT doc_id, word, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '\p{L}+')) AS word FROM documents) GROUP BY ALL")
def term_frequency(spark, sf_dir):
    return text_stats.term_frequency(table(spark, sf_dir, "documents"), "doc_id", T.letters(F.col("text")))


_RELEVANCE = """WITH d AS (SELECT doc_id, string_split(lower(text), ' ') AS ws FROM documents),
  q AS (SELECT DISTINCT item_id AS query_id, unnest(string_split(lower(text), ' ')) AS word FROM benchmark),
  s AS (SELECT avg(len(ws))::DOUBLE AS mean, count(*)::DOUBLE AS n FROM d),
  t AS (SELECT doc_id, length, word, count(*) AS tf FROM (SELECT doc_id, len(ws) AS length, unnest(ws) AS word FROM d) WHERE word IN (SELECT word FROM q) GROUP BY ALL),
  w AS (SELECT word, count(*) AS df FROM t GROUP BY word),
  x AS (SELECT query_id, doc_id, log2(n / df) AS idf, tf::DOUBLE / length AS f, length / mean AS l FROM t JOIN w USING (word) JOIN q USING (word), s)
"""


def _relevance(spark, sf_dir):
    """Queries are the whole texts of the benchmark's items."""
    d, b = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "query_id")
    words = F.split(F.lower("text"), " ", -1)
    return text_stats.relevance(d, b, "doc_id", words, words)


@query("tf_idf", _RELEVANCE + "SELECT query_id, doc_id, round(sum(f * idf), 8) AS tf_idf FROM x GROUP BY ALL")
def tf_idf(spark, sf_dir):
    return _relevance(spark, sf_dir).select("query_id", "doc_id", F.round("tf_idf", 8).alias("tf_idf"))


@query("bm25", _RELEVANCE + "SELECT query_id, doc_id, round(sum(idf * f * 3 / (f + 2 * (0.25 + 0.75 * l))), 8) AS bm25 FROM x GROUP BY ALL")
def bm25(spark, sf_dir):
    return _relevance(spark, sf_dir).select("query_id", "doc_id", F.round("bm25", 8).alias("bm25"))


@query(
    "cosine_distance",
    """SELECT a.vec_id AS a_id, b.vec_id AS b_id, round(1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS distance
       FROM embeddings a JOIN embeddings b ON a.vec_id = b.vec_id - b.vec_id % 50 WHERE a.vec_id <> b.vec_id""",
)
def cosine_distance(spark, sf_dir):
    """Distances of given pairs (a query and a title found for it): each vector with the first of its block of fifty."""
    e = table(spark, sf_dir, "embeddings")
    q = e.select(F.col("vec_id").alias("a_id"), F.col("embedding").alias("_q"))
    pairs = e.join(q, F.col("a_id") == F.col("vec_id") - F.col("vec_id") % 50).filter("a_id <> vec_id")
    return pairs.select("a_id", F.col("vec_id").alias("b_id"), F.round(T.cosine_distance(F.col("_q"), F.col("embedding")), 6).alias("distance"))


# Hosts and links

_HOST = r"nullif(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^:/?#]*)', 1), '')"
_PATH = r"regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*', '')"
_CLICK = f"SELECT {_HOST} AS host, split_part({_PATH}, '/', 2) AS query FROM pages"


def _clicks(spark, sf_dir):
    """Pages stand for clicks: the query is the first part of the path."""
    return table(spark, sf_dir, "pages").select("url", F.split_part(T.url_path(F.col("url")), F.lit("/"), F.lit(2)).alias("query"))


@query("host_count", f"SELECT host, count(*) AS cnt FROM ({_CLICK}) WHERE host IS NOT NULL GROUP BY host")
def host_count(spark, sf_dir):
    return web.host_count(table(spark, sf_dir, "pages"))


@query("host_share", f"SELECT host, count(*) AS cnt, round(100.0 * count(*) / sum(count(*)) OVER (), 8)::DOUBLE AS percent FROM ({_CLICK}) WHERE host IS NOT NULL GROUP BY host")
def host_share(spark, sf_dir):
    return web.host_share(table(spark, sf_dir, "pages")).withColumn("percent", F.round("percent", 8))


@query("host_query_count", f"SELECT host, query, count(*) AS cnt FROM ({_CLICK}) WHERE host IS NOT NULL GROUP BY ALL")
def host_query_count(spark, sf_dir):
    return web.host_query_count(_clicks(spark, sf_dir))


@query(
    "seo_top_query",
    f"""SELECT host, query, cnt FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY cnt DESC, query) AS n
        FROM (SELECT host, query, count(*) AS cnt FROM ({_CLICK}) WHERE host IS NOT NULL GROUP BY ALL)) WHERE n = 1 AND cnt >= 2""",
)
def seo_top_query(spark, sf_dir):
    return web.top_query(_clicks(spark, sf_dir), 2)


_LINKS = r"""SELECT page_id, CASE WHEN l LIKE '/%' THEN base || l ELSE l END AS link FROM (
  SELECT page_id, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*') AS base,
  unnest(regexp_extract_all(html, '<a[^>]+href=["'']?([^"''\s>]+)["'']?[^>]*>', 1, 'is')) AS l FROM pages)"""


@query("extract_links", _LINKS)
def extract_links(spark, sf_dir):
    return web.extract_links(table(spark, sf_dir, "pages"), "page_id")


@query("link_graph_edges", f"WITH l AS ({_LINKS}) SELECT DISTINCT page_id AS src, md5(link) AS dst FROM l")
def link_graph_edges(spark, sf_dir):
    """Every link text is a known url."""
    found = web.extract_links(table(spark, sf_dir, "pages"), "page_id")
    return web.link_graph(found, found.select(F.col("link").alias("url"), F.md5("link").alias("id")).distinct(), "page_id")


@query("links_of_packed_pages", _LINKS)
def links_of_packed_pages(spark, sf_dir):
    """Html that comes as base64 of a zlib stream."""
    packed = table(spark, sf_dir, "pages").select("page_id", "url", F.base64(text_source.deflate(F.col("html"))).alias("_packed"))
    return web.extract_links(packed.withColumn("html", text_source.page_html(F.col("_packed"))), "page_id")


#: Rules of the four kinds for hosts by their name's last characters, as (SQL condition on host, rules).
_RULES = [("host LIKE '%.com'", "Disallow: /en\nDisallow: *1$"), ("host LIKE '%.org'", "Disallow: *a*\nDisallow: /fr/"), ("host LIKE '%.net'", "Disallow: /de$\nDisallow: */page"), ("host LIKE '%e%'", "Disallow: 7$")]


def _sites(spark, sf_dir):
    hosts = table(spark, sf_dir, "pages").select(T.host(F.col("url")).alias("host")).filter("host IS NOT NULL").distinct()
    robots = F.lit(None).cast("string")
    for cond, rules in reversed(_RULES):
        robots = F.when(F.expr(cond), F.lit(rules)).otherwise(robots)
    return hosts.select(F.col("host").alias("site"), robots.alias("robots"))


def _robots_sql() -> str:
    path = f"(CASE WHEN {_PATH} LIKE '/%' THEN {_PATH} ELSE '/' || {_PATH} END)"
    tests = [
        f"(starts_with({path}, '/en') OR ends_with({path}, '1'))",
        f"(contains({path}, 'a*') OR starts_with({path}, '/fr/'))",
        f"({path} = '/de' OR contains({path}, '/page'))",
        f"ends_with({path}, '7$')",
    ]
    verdict = "CASE " + " ".join(f"WHEN {cond} THEN {test}" for (cond, _), test in zip(_RULES, tests, strict=True)) + " ELSE false END"
    return f"SELECT page_id, url, page_id % 3 = 0 AS was, coalesce({verdict}, false) AS is_disabled FROM (SELECT *, {_HOST} AS host FROM pages)"


def _crawled(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", "url", F.when(F.col("page_id") % 3 == 0, F.lit("Y")).alias("disabled"))


@query("robots_decision", f"SELECT page_id, is_disabled FROM ({_robots_sql()})")
def robots_decision(spark, sf_dir):
    return web.robots_decisions(_crawled(spark, sf_dir), _sites(spark, sf_dir)).select("page_id", "is_disabled")


@query("robots_changeset", f"SELECT md5(url) AS row_key, CASE WHEN is_disabled THEN 'put' ELSE 'delete' END AS op, CASE WHEN is_disabled THEN 'Y' END AS value FROM ({_robots_sql()}) WHERE was <> is_disabled")
def robots_changeset(spark, sf_dir):
    return web.robots_changes(_crawled(spark, sf_dir), _sites(spark, sf_dir))


# Graphs

_EDGES = "e AS (SELECT l_suppkey AS src, l_partkey AS dst FROM lineitem), v AS (SELECT src AS id FROM e UNION SELECT dst FROM e), d AS (SELECT src, count(*)::DOUBLE AS degree FROM e GROUP BY src)"


def _edges(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"))


@query("vertex_set", f"WITH {_EDGES} SELECT id FROM v")
def vertex_set(spark, sf_dir):
    return graph.vertices(_edges(spark, sf_dir))


@query("out_degree", f"WITH {_EDGES} SELECT src, degree::BIGINT AS degree FROM d")
def out_degree(spark, sf_dir):
    return graph.out_degree(_edges(spark, sf_dir))


@query("dangling_vertices", f"WITH {_EDGES} SELECT id FROM v WHERE id NOT IN (SELECT src FROM d)")
def dangling_vertices(spark, sf_dir):
    return graph.dangling(_edges(spark, sf_dir))


def _pagerank_sql(own: bool, steps: int = 3) -> str:
    sql = f"WITH {_EDGES}, n AS (SELECT count(*)::DOUBLE AS n FROM v), h AS (SELECT id, id NOT IN (SELECT src FROM d) AS hangs FROM v), r0 AS (SELECT id, hangs, 1 / n AS rank FROM h, n)"
    for i in range(steps):
        share = "m / n" if own else "(m - CASE WHEN hangs THEN rank ELSE 0 END) / CASE WHEN hangs THEN n - 1 ELSE n - 1 END"
        sql += f""", s{i} AS (SELECT dst, sum(rank / degree) AS got FROM e JOIN r{i} ON src = id JOIN d USING (src) GROUP BY dst),
          m{i} AS (SELECT coalesce(sum(rank) FILTER (hangs), 0) AS m FROM r{i}),
          r{i + 1} AS (SELECT id, hangs, 0.1 / n + 0.9 * (coalesce(got, 0) + {share}) AS rank FROM r{i} LEFT JOIN s{i} ON id = dst, m{i}, n)"""
    return sql + f" SELECT id, round(rank, 10) AS rank FROM r{steps}"


def _rounded_rank(df):
    return df.withColumn("rank", F.round("rank", 10))


@query("pagerank_uniform", _pagerank_sql(True))
def pagerank_uniform(spark, sf_dir):
    return _rounded_rank(graph.pagerank(_edges(spark, sf_dir), 0.9, 3))


@query("pagerank_excl_self", _pagerank_sql(False))
def pagerank_excl_self(spark, sf_dir):
    return _rounded_rank(graph.pagerank(_edges(spark, sf_dir), 0.9, 3, dangling_self=False))


@query("pagerank_sorted", _pagerank_sql(True) + " ORDER BY rank DESC, id")
def pagerank_sorted(spark, sf_dir):
    return _rounded_rank(graph.pagerank(_edges(spark, sf_dir), 0.9, 3)).orderBy(F.desc("rank"), "id")


@query("pagerank_six_steps", _pagerank_sql(True, 6))
def pagerank_six_steps(spark, sf_dir):
    return _rounded_rank(graph.pagerank(_edges(spark, sf_dir), 0.9, 6))


def _early_sql(most: int, tolerance: float) -> str:
    """The ranks of the first step in which all move by less than the tolerance, and the step."""
    head, _ = _pagerank_sql(True, most).rsplit(" SELECT id", 1)
    moves = ", ".join(f"x{i} AS (SELECT {i} AS step, bool_and(abs(b.rank - a.rank) < {tolerance} * a.rank) AS still FROM r{i - 1} a JOIN r{i} b USING (id))" for i in range(1, most + 1))
    every = " UNION ALL ".join(f"SELECT * FROM x{i}" for i in range(1, most + 1))
    ranks = " UNION ALL ".join(f"SELECT {i} AS step, id, rank FROM r{i}" for i in range(1, most + 1))
    return f"{head}, {moves}, z AS (SELECT coalesce(min(step) FILTER (still), {most})::INTEGER AS steps FROM ({every})) SELECT id, round(rank, 10) AS rank, steps FROM ({ranks}), z WHERE step = steps"


@query("pagerank_early_stop", _early_sql(8, 0.1))
def pagerank_early_stop(spark, sf_dir):
    ranks, made = graph.pagerank_counted(_edges(spark, sf_dir), 0.9, 8, tolerance=0.1)
    return _rounded_rank(ranks).withColumn("steps", F.lit(made))


def _hits_sql(what: str, steps: int = 3) -> str:
    sql = f"WITH {_EDGES}, r0 AS (SELECT id, 1e-7::DOUBLE AS authority, 1e-7::DOUBLE AS hub FROM v)"
    for i in range(steps):
        sql += f""", a{i} AS (SELECT dst, sum(hub) AS s FROM e JOIN r{i} ON src = id GROUP BY dst), h{i} AS (SELECT src, sum(authority) AS s FROM e JOIN r{i} ON dst = id GROUP BY src),
          r{i + 1} AS (SELECT id, coalesce(a{i}.s, 0) AS authority, coalesce(h{i}.s, 0) AS hub FROM v LEFT JOIN a{i} ON id = dst LEFT JOIN h{i} ON id = src)"""
    return sql + f" SELECT id, round({what} / sum({what}) OVER (), 12) AS {what} FROM r{steps} ORDER BY {what} DESC, id"


def _hits(spark, sf_dir, what):
    found = graph.hits(_edges(spark, sf_dir), 3, normalize=True)
    return found.select("id", F.round(what, 12).alias(what)).orderBy(F.desc(what), "id")


@query("hits_authority", _hits_sql("authority"))
def hits_authority(spark, sf_dir):
    return _hits(spark, sf_dir, "authority")


@query("hits_hub", _hits_sql("hub"))
def hits_hub(spark, sf_dir):
    return _hits(spark, sf_dir, "hub")


# Click models; a session is a user's day

_SESSIONS = """s AS (SELECT user_id AS query, CAST(ts AS DATE) AS day, list(k ORDER BY ts, event_id) AS shown, list(k ORDER BY ts, event_id) FILTER (event_type = 'click') AS clicked
    FROM (SELECT *, json_extract_string(props, '$.k') AS k FROM events) GROUP BY ALL HAVING count(*) FILTER (event_type = 'click') > 0),
  c AS (SELECT query, day, shown, list_transform(clicked, lambda x: greatest(list_position(shown, x) - 1, 0)) AS cp FROM s),
  p AS (SELECT query, day, url, pos, list_contains(cp, pos) AS click, list_min(cp)::INT AS min_click, cp[-1]::INT AS last_click
    FROM (SELECT query, day, cp, unnest(shown) AS url, (unnest(range(len(shown))))::INT AS pos FROM c))"""


def _stats_sql(keys: str, source: str = "p", models: bool = True) -> str:
    weights = "[" + ", ".join(map(str, clicks.POSITION_WEIGHTS)) + "]"
    cols = ["count(*) AS shows", "count(*) FILTER (click) AS clicks"]
    cols += [f"count(*) FILTER (pos = {i}) AS pos{i + 1}_shows" for i in range(5)]
    cols += [f"count(*) FILTER (pos = {i} AND click) AS pos{i + 1}_clicks" for i in range(5)]
    if models:
        cols += [
            f"round(sum({weights}[least(pos, 9) + 1]::DOUBLE), 6) AS pos_based_shows", "count(*) FILTER (pos <= min_click) AS cascade_shows", "count(*) FILTER (pos = min_click) AS cascade_clicks",
            "count(*) FILTER (pos <= last_click) AS dbn_shows", "count(*) FILTER (click AND pos <= last_click) AS dbn_clicks", "count(*) FILTER (pos = last_click) AS dbn_satisfied",
        ]
    else:
        cols.append("count(*) FILTER (pos = last_click) AS satisfied")
    cols.append("round(sum(pos)::DOUBLE / count(*), 8) AS aver_pos")
    return f"SELECT {keys}, {', '.join(cols)} FROM {source} GROUP BY {keys}"


def sessions(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("_k", F.get_json_object("props", "$.k"))
    listed = F.sort_array(F.collect_list(F.struct("ts", "event_id", "_k", (F.col("event_type") == "click").alias("_c"))))
    s = e.groupBy(F.col("user_id").alias("query"), F.to_date("ts").alias("day")).agg(listed.alias("_l"))
    return s.select("query", "day", F.transform("_l", lambda x: x["_k"]).alias("shown"), F.transform(F.filter("_l", lambda x: x["_c"]), lambda x: x["_k"]).alias("clicked"))


def _shown(spark, sf_dir):
    return clicks.positions(sessions(spark, sf_dir), ["query", "day"])


def _stats(df, keys, models=True):
    out = clicks.click_stats(df, keys, models).withColumn("aver_pos", F.round("aver_pos", 8))
    return out.withColumn("pos_based_shows", F.round("pos_based_shows", 6)) if models else out


@query("session_positions", f"WITH {_SESSIONS} SELECT * FROM p")
def session_positions(spark, sf_dir):
    return _shown(spark, sf_dir)


@query("ctr_global", f"WITH {_SESSIONS} {_stats_sql('url', models=False)}")
def ctr_global(spark, sf_dir):
    return _stats(_shown(spark, sf_dir), ["url"], False)


@query("ctr_query_url", f"WITH {_SESSIONS} {_stats_sql('query, url', models=False)}")
def ctr_query_url(spark, sf_dir):
    return _stats(_shown(spark, sf_dir), ["query", "url"], False)


@query("click_models_global", f"WITH {_SESSIONS} {_stats_sql('url')}")
def click_models_global(spark, sf_dir):
    return _stats(_shown(spark, sf_dir), ["url"])


@query("click_models_query", f"WITH {_SESSIONS} {_stats_sql('query, url')}")
def click_models_query(spark, sf_dir):
    return _stats(_shown(spark, sf_dir), ["query", "url"])


@query("click_models_host", f"WITH {_SESSIONS}, ph AS (SELECT *, 'h' || url::INT % 7 AS host FROM p) {_stats_sql('host', 'ph')}")
def click_models_host(spark, sf_dir):
    named = _shown(spark, sf_dir).withColumn("url", F.concat(F.lit("http://h"), F.col("url").cast("int") % 7, F.lit("/"), F.col("url")))
    return _stats(clicks.with_host(named), ["host"])


def _split_query(spark, sf_dir, low, high):
    pairs = _shown(spark, sf_dir).select("query", "url").distinct()
    part = lambda a, b: pairs.filter(((F.col("query") * 31 + F.col("url").cast("int")) % 10).between(a, b))
    train, test = clicks.split_outputs(_stats(_shown(spark, sf_dir), ["query", "url"]), part(0, 4), part(5, 7), ["query", "url"])
    return train if low == 0 else test


@query("click_split_train", f"WITH {_SESSIONS} SELECT * FROM ({_stats_sql('query, url')}) WHERE (query * 31 + url::INT) % 10 BETWEEN 0 AND 4")
def click_split_train(spark, sf_dir):
    return _split_query(spark, sf_dir, 0, 4)


@query("click_split_test", f"WITH {_SESSIONS} SELECT * FROM ({_stats_sql('query, url')}) WHERE (query * 31 + url::INT) % 10 BETWEEN 5 AND 7")
def click_split_test(spark, sf_dir):
    return _split_query(spark, sf_dir, 5, 7)


_RATIOS = ["ctr", "smooth_ctr", *[f"ctr_pos{i}" for i in range(1, 6)], "cascade_ctr", "dbn_attract", "dbn_satisfy"]


def _ratio_sql(keys: str, source: str) -> str:
    ratio = {"ctr": "clicks / shows", "smooth_ctr": "(clicks + 0.1::DOUBLE) / (shows + 0.2::DOUBLE)", "cascade_ctr": "cascade_clicks / nullif(cascade_shows, 0)", "dbn_attract": "(dbn_clicks + 0.1::DOUBLE) / (dbn_shows + 0.2::DOUBLE)", "dbn_satisfy": "(dbn_satisfied + 0.1::DOUBLE) / (dbn_clicks + 0.2::DOUBLE)"}
    ratio |= {f"ctr_pos{i}": f"pos{i}_clicks / nullif(pos{i}_shows, 0)" for i in range(1, 6)}
    return f"SELECT {keys}, " + ", ".join(f"round(({ratio[r]})::DOUBLE, 8) AS {r}" for r in _RATIOS) + f" FROM ({source})"


def _ratios(df, keys):
    return ranking.ratio_features(clicks.click_stats(df, keys)).select(*keys, *[F.round(r, 8).alias(r) for r in _RATIOS])


@query("ctr_features", f"WITH {_SESSIONS} {_ratio_sql('url', _stats_sql('url'))}")
def ctr_features(spark, sf_dir):
    return _ratios(_shown(spark, sf_dir), ["url"])


_ASSEMBLY = f"""WITH {_SESSIONS}, q AS ({_ratio_sql('query, url', _stats_sql('query, url'))}), u AS ({_ratio_sql('url', _stats_sql('url'))}),
  b AS (SELECT DISTINCT user_id AS query, json_extract_string(props, '$.k') AS url FROM events),
  f AS (SELECT b.query, b.url, {", ".join(f"q.{r} AS q_{r}" for r in _RATIOS)}, {", ".join(f"u.{r} AS u_{r}" for r in _RATIOS)}
    FROM b LEFT JOIN q ON b.query = q.query AND b.url = q.url LEFT JOIN u ON b.url = u.url)"""


def _assembled(spark, sf_dir):
    shown = _shown(spark, sf_dir)
    base = table(spark, sf_dir, "events").select(F.col("user_id").alias("query"), F.get_json_object("props", "$.k").alias("url")).distinct()
    return ranking.assemble(base, [(_ratios(shown, ["query", "url"]), ["query", "url"], "q_"), (_ratios(shown, ["url"]), ["url"], "u_")])


@query("feature_assembly", f"{_ASSEMBLY} SELECT * FROM f")
def feature_assembly(spark, sf_dir):
    return _assembled(spark, sf_dir)


_FILLED = " + ".join(f"({p}_{r} IS NOT NULL)::INT" for p in "qu" for r in _RATIOS)


@query("drop_thresh", f"{_ASSEMBLY} SELECT * FROM f WHERE {_FILLED} + 2 >= 18")
def drop_thresh(spark, sf_dir):
    return _assembled(spark, sf_dir).na.drop(thresh=18)


_TOP = f"{_ASSEMBLY}, t AS (SELECT query, url, row_number() OVER (PARTITION BY query ORDER BY q_ctr DESC, url)::INT AS place FROM f WHERE q_ctr > 0.3), t5 AS (SELECT * FROM t WHERE place <= 5)"


def _top(spark, sf_dir):
    return ranking.top_k(_assembled(spark, sf_dir).filter("q_ctr > 0.3"), "query", "q_ctr", "url").select("query", "url", "place")


@query("top5_per_query", f"{_TOP} SELECT * FROM t5")
def top5_per_query(spark, sf_dir):
    return _top(spark, sf_dir)


@query(
    "top5_padded",
    f"""{_TOP}, g AS (SELECT b.query, count(t5.url) AS n FROM (SELECT DISTINCT query FROM b) b LEFT JOIN t5 USING (query) GROUP BY ALL),
      a AS (SELECT DISTINCT url FROM b),
      x AS (SELECT g.query, a.url, (n + row_number() OVER (PARTITION BY g.query ORDER BY a.url))::INT AS place FROM g, a WHERE n < 5 AND NOT EXISTS (SELECT 1 FROM t5 WHERE t5.query = g.query AND t5.url = a.url))
      SELECT * FROM t5 UNION ALL SELECT * FROM x WHERE place <= 5""",
)
def top5_padded(spark, sf_dir):
    every = _assembled(spark, sf_dir)
    return ranking.pad_top_k(_top(spark, sf_dir), every, every, "query", "url")


# Extremes, keys, metrics

@query(
    "extremes_by_day",
    """SELECT key, o_totalprice, year FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY o_totalprice DESC, year, o_orderkey) AS n FROM (
       SELECT o_custkey || ':' || strftime(o_orderdate, '%d.%m') AS key, o_totalprice, year(o_orderdate)::INT AS year, o_orderkey FROM orders)) WHERE n = 1""",
)
def extremes_by_day(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(extremes.day_key(F.col("o_custkey"), F.month("o_orderdate"), F.day("o_orderdate")).alias("key"), "o_totalprice", F.year("o_orderdate").alias("year"), "o_orderkey")
    return extremes.extreme_by_key(o, ["key"], "o_totalprice", [F.col("year"), F.col("o_orderkey")]).drop("o_orderkey")


@query("first_per_key", f"SELECT host, page_id, url FROM (SELECT *, {_HOST} AS host, row_number() OVER (PARTITION BY {_HOST} ORDER BY page_id) AS n FROM pages) WHERE n = 1 AND host IS NOT NULL")
def first_per_key(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select(T.host(F.col("url")).alias("host"), "page_id", "url").filter("host IS NOT NULL")
    return text_stats.first_per_key(p, "host", [F.col("page_id")])


_RANKED = "SELECT o_custkey AS q, o_orderkey AS d, (o_orderkey * 7919 % 1000) / 100.0::DOUBLE AS s, (o_orderkey % 5)::INT AS y FROM orders"


def _ranked(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("q"), F.col("o_orderkey").alias("d"), (F.col("o_orderkey") * 7919 % 1000 / 100.0).alias("s"), (F.col("o_orderkey") % 5).cast("int").alias("y"))


@query(
    "dcg_at_5",
    f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY s DESC, d) AS p, row_number() OVER (PARTITION BY q ORDER BY y DESC, d) AS i FROM ({_RANKED}))
        SELECT q, round(coalesce(sum((pow(2, y) - 1) / ln(p + 1.0)) FILTER (p <= 5), 0), 8) AS dcg, round(coalesce(sum((pow(2, y) - 1) / ln(i + 1.0)) FILTER (i <= 5), 0), 8) AS idcg FROM r GROUP BY q""",
)
def dcg_at_5(spark, sf_dir):
    return ranking.dcg(_ranked(spark, sf_dir), "q", "s", "y", "d", 5).select("q", F.round("dcg", 8).alias("dcg"), F.round("idcg", 8).alias("idcg"))


@query(
    "lambda_gradients",
    f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY s DESC, d) AS p, row_number() OVER (PARTITION BY q ORDER BY y DESC, d) AS i, pow(2, y) - 1 AS g FROM ({_RANKED})),
        m AS (SELECT *, sum(g / log2(i + 1)) OVER (PARTITION BY q) AS ideal FROM r),
        l AS (SELECT a.q, a.d AS a, b.d AS b, 1 / (1 + exp(greatest(least(a.s - b.s, 50), -50))) AS rho, abs((a.g - b.g) * (1 / log2(a.p + 1) - 1 / log2(b.p + 1))) / a.ideal AS delta FROM m a JOIN m b ON a.q = b.q AND a.y > b.y),
        x AS (SELECT q, a AS d, rho * delta AS g, rho * (1 - rho) * delta AS h FROM l UNION ALL SELECT q, b, -rho * delta, rho * (1 - rho) * delta FROM l)
        SELECT q, d, round(sum(g), 8) + 0.0 AS grad, round(sum(h), 8) AS hess FROM x GROUP BY ALL""",
)
def lambda_gradients(spark, sf_dir):
    return ranking.lambda_gradients(_ranked(spark, sf_dir), "q", "d", "s", "y").select("q", "d", (F.round("grad", 8) + 0.0).alias("grad"), F.round("hess", 8).alias("hess"))


@query(
    "lambda_gradients_top5",
    f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY s DESC, d) AS p, row_number() OVER (PARTITION BY q ORDER BY y DESC, d) AS i, pow(2, y) - 1 AS g FROM ({_RANKED})),
        m AS (SELECT *, coalesce(nullif(sum(CASE WHEN i <= 5 THEN g / ln(i + 1.0) ELSE 0 END) OVER (PARTITION BY q), 0), 1) AS ideal, CASE WHEN p <= 5 THEN 1 / log2(p + 1) ELSE 0 END AS w FROM r),
        l AS (SELECT a.q, a.d, sign(a.y - b.y) AS way, 1 / (1 + exp(least(abs(a.s - b.s), 50))) AS rho, abs((a.g - b.g) * (a.w - b.w)) / a.ideal AS delta FROM m a JOIN m b ON a.q = b.q AND a.d <> b.d),
        x AS (SELECT q, d, sum(way * rho * delta) AS g, sum(rho * (1 - rho) * delta) AS h FROM l GROUP BY ALL)
        SELECT r.q, r.d, round(coalesce(x.g, 0), 8) + 0.0 AS grad, round(CASE WHEN coalesce(x.h, 0) = 0 THEN 1 ELSE x.h END, 8) AS hess FROM r LEFT JOIN x ON r.q = x.q AND r.d = x.d""",
)
def lambda_gradients_top5(spark, sf_dir):
    found = ranking.lambda_gradients(_ranked(spark, sf_dir), "q", "d", "s", "y", absolute=True, top=5, unit_hessian=True)
    return found.select("q", "d", (F.round("grad", 8) + 0.0).alias("grad"), F.round("hess", 8).alias("hess"))


@query("mse", f"SELECT round(avg(pow(s - y, 2)), 8) AS mse FROM ({_RANKED})")
def mse(spark, sf_dir):
    return ranking.mse(_ranked(spark, sf_dir), "y", "s").select(F.round("mse", 8).alias("mse"))


@query("rmse", f"SELECT round(sqrt(avg(pow(s - y, 2))), 8) AS rmse FROM ({_RANKED})")
def rmse(spark, sf_dir):
    return ranking.rmse(_ranked(spark, sf_dir), "y", "s").select(F.round("rmse", 8).alias("rmse"))


@query("log_loss", f"WITH r AS (SELECT (y > 2)::INT AS t, (s + 0.5) / 11 AS p FROM ({_RANKED})) SELECT round(-avg(t * ln(p) + (1 - t) * ln(1 - p)), 8) AS log_loss FROM r")
def log_loss(spark, sf_dir):
    r = _ranked(spark, sf_dir).select((F.col("y") > 2).cast("int").alias("t"), ((F.col("s") + 0.5) / 11).alias("p"))
    return ranking.log_loss(r, "t", "p").select(F.round("log_loss", 8).alias("log_loss"))


@query("svmlight_rows", f"SELECT y::DOUBLE AS label, q::BIGINT AS qid, [s, 0, d % 7]::DOUBLE[] AS features FROM ({_RANKED})")
def svmlight_rows(spark, sf_dir):
    """Ranking rows written as text lines and parsed again; the second feature is never said."""
    line = F.concat_ws(" ", F.col("y"), F.concat(F.lit("qid:"), "q"), F.concat(F.lit("1:"), "s"), F.concat(F.lit("3:"), F.col("d") % 7), F.lit("# a note"))
    parsed = text_source.parse_svmlight(_ranked(spark, sf_dir).select(line.alias("value")))
    return parsed.select("label", "qid", text_source.dense(F.col("features"), 3).alias("features"))


_LOG_SQL = f"""WITH {_SESSIONS} SELECT 'q ' || query AS query, c_custkey AS query_id, url || '.com' AS url, md5(url || '.com') AS url_id, count(*) AS shows, count(*) FILTER (click) AS clicks
    FROM p LEFT JOIN customer ON c_custkey = query GROUP BY ALL"""


@query("session_log", _LOG_SQL)
def session_log(spark, sf_dir):
    """Sessions written as log lines, parsed with their urls brought to normal form, and resolved: urls are all known, queries in part."""
    s = sessions(spark, sf_dir)
    urls = lambda c: F.array_join(F.transform(c, lambda k: F.concat(F.lit("http://www."), k, F.lit(".com/"))), ",")
    lines = s.select(F.concat(F.lit("q "), "query", F.lit("@7\t"), urls("shown"), F.lit("\t"), urls("clicked")).alias("value"))
    shown = clicks.positions(clicks.parse_sessions(lines), ["query"])
    known = shown.select("url", F.md5("url").alias("url_id")).distinct()
    queries = table(spark, sf_dir, "customer").select(F.concat(F.lit("q "), "c_custkey").alias("query"), F.col("c_custkey").alias("query_id"))
    found = clicks.resolve(shown, known, queries)
    return found.groupBy("query", "query_id", "url", "url_id").agg(F.count("*").alias("shows"), F.count_if("click").alias("clicks"))


@query("rows_sorted", f"SELECT q, d, s FROM ({_RANKED}) ORDER BY q, s DESC, d")
def rows_sorted(spark, sf_dir):
    return _ranked(spark, sf_dir).select("q", "d", "s").orderBy("q", F.desc("s"), "d")


@query("degrees", f"SELECT d, printf('%.1fC (%d)', s + 0.043, y) AS said FROM ({_RANKED})")
def degrees(spark, sf_dir):
    return _ranked(spark, sf_dir).select("d", extremes.degrees(F.col("s") + 0.043, F.col("y")).alias("said"))


@query("events_of_a_day", "SELECT event_id, ts FROM events WHERE strftime(ts, '%d.%m') = (SELECT strftime(min(ts), '%d.%m') FROM events)")
def events_of_a_day(spark, sf_dir):
    """Events of the day and month that the first one has."""
    e = table(spark, sf_dir, "events")
    first = e.agg(F.date_format(F.min("ts"), "dd.MM").alias("_day"))
    return e.join(F.broadcast(first), F.date_format("ts", "dd.MM") == F.col("_day")).select("event_id", "ts")  # one row


_STOP = ["the", "of", "in", "and", "de", "la", "der", "die"]


@query("word_count_no_stop", f"SELECT word, count(*) AS cnt FROM (SELECT unnest(regexp_extract_all(lower(text), '\\p{{L}}+')) AS word FROM documents) WHERE word NOT IN ({', '.join(repr(w) for w in _STOP)}) GROUP BY word")
def word_count_no_stop(spark, sf_dir):
    return text_stats.word_count(table(spark, sf_dir, "documents"), T.without(T.letters(F.col("text")), _STOP))


# Learning

_RATINGS = "r AS (SELECT o_custkey AS user, l_partkey AS item, least(5, greatest(1, ceil(l_quantity / 10)))::DOUBLE AS rating FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


def ratings(spark, sf_dir):
    j = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return j.select(F.col("o_custkey").alias("user"), F.col("l_partkey").alias("item"), F.least(F.lit(5), F.greatest(F.lit(1), F.ceil(F.col("l_quantity") / 10))).cast("double").alias("rating"))


@query(
    "rating_biases",
    f"""WITH {_RATINGS}, c AS (SELECT user, item, rating - (SELECT avg(rating) FROM r) AS c FROM r), u AS (SELECT user, avg(c) AS b FROM c GROUP BY user)
        SELECT 'user' AS kind, user AS id, round(b, 8) + 0.0 AS bias FROM u UNION ALL SELECT 'item', item, round(avg(c - b), 8) + 0.0 FROM c JOIN u USING (user) GROUP BY item""",
)
def rating_biases(spark, sf_dir):
    return learning.biases(ratings(spark, sf_dir)).withColumn("bias", F.round("bias", 8) + 0.0)


@query("matrix_size", f"WITH {_RATINGS} SELECT max(user) AS users, max(item) AS items FROM r")
def matrix_size(spark, sf_dir):
    return ratings(spark, sf_dir).agg(F.max("user").alias("users"), F.max("item").alias("items"))


@query("confidence_weights", f"WITH {_RATINGS} SELECT user, item, round(1 + 40 * ln(1 + sum(rating) / 0.5), 8) AS weight FROM r GROUP BY ALL")
def confidence_weights(spark, sf_dir):
    return learning.confidence(ratings(spark, sf_dir), 40.0, 0.5).select("user", "item", F.round("weight", 8).alias("weight"))


@query(
    "hashed_tokens",
    """SELECT event_id, CASE WHEN event_type = 'purchase' THEN 1 ELSE -1 END AS label, ['C1_' || event_type, 'C2_' || user_id, 'CG1_0_' || json_extract_string(props, '$.k')] AS tokens FROM events""",
)
def hashed_tokens(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", (F.col("event_type") == "purchase").cast("int").alias("y"), "event_type", "user_id", F.array(F.get_json_object("props", "$.k")).alias("k"))
    return e.select("event_id", learning.signed_label(F.col("y")).alias("label"), learning.tokens(["event_type", "user_id"], ["k"]).alias("tokens"))


_SPLIT_SQL = """WITH x AS (SELECT 'p_size' AS feature, p_size::DOUBLE AS value, p_retailprice AS y FROM part UNION ALL SELECT 'brand', CAST(regexp_extract(p_brand, '[0-9]+') AS DOUBLE), p_retailprice FROM part),
  b AS (SELECT feature, value, count(*) AS n, sum(y) AS s FROM x GROUP BY ALL),
  c AS (SELECT feature, value, lead(value) OVER w AS nxt, sum(n) OVER w AS nl, sum(s) OVER w AS sl, sum(n) OVER (PARTITION BY feature) AS nt, sum(s) OVER (PARTITION BY feature) AS st FROM b WINDOW w AS (PARTITION BY feature ORDER BY value)),
  g AS (SELECT feature, (value + nxt) / 2 AS threshold, sl * sl / nl + (st - sl) * (st - sl) / (nt - nl) - st * st / nt AS gain FROM c WHERE nxt IS NOT NULL AND nl >= 2 AND nt - nl >= 2)
  SELECT feature, threshold, round(gain, 2) AS gain FROM (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY gain DESC, threshold) AS i FROM g) WHERE i = 1"""


def _parts(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), F.regexp_extract("p_brand", "[0-9]+", 0).cast("double").alias("brand"), "p_retailprice")


@query("cart_split_search", _SPLIT_SQL)
def cart_split_search(spark, sf_dir):
    return learning.best_splits(_parts(spark, sf_dir), ["p_size", "brand"], "p_retailprice", 2).withColumn("gain", F.round("gain", 2))


#: Thresholds to choose from, so that SQL can name them.
_STEPS = {"p_size": [5.0, 10.0, 15.0, 20.0, 25.0, 30.0, 35.0, 40.0, 45.0], "brand": [13.0, 21.0, 24.0, 31.0, 35.0, 42.0, 51.0]}


def _trees_sql(key: str, data: str, thresholds: dict[str, list[float]], start: str, slopes: str, series: list[tuple[int, float]], lam: float = 1.0) -> str:
    """Boosted trees on two features (a and b of ``data``) written out: per level the sums of each node, feature and
    threshold, and the best split. ``series``: depth and rate of each tree. ``slopes``: g and h for the rows of {s}."""
    grid = ", ".join(f"({k}, {e}::DOUBLE)" for k, q in enumerate(thresholds.values()) for e in q)
    sql = f"""WITH d AS MATERIALIZED ({data}),
      grid AS (SELECT * FROM (VALUES {grid}) AS t(f, e)), s0 AS MATERIALIZED (SELECT d.*, ({start})::DOUBLE AS s FROM d)"""
    for r, (depth, rate) in enumerate(series):
        sql += f", n{r}_0 AS MATERIALIZED (SELECT *, 0 AS node FROM ({slopes.format(s=f's{r}')}))"
        for k in range(depth):
            sql += f""", c{r}_{k} AS (SELECT node, f, e, sum(g) FILTER (v < e) AS gl, sum(h) FILTER (v < e) AS hl, sum(g) AS gt, sum(h) AS ht, count(*) FILTER (v < e) AS nl, count(*) AS nt
                FROM (SELECT n.*, f, e, CASE WHEN f = 0 THEN a ELSE b END AS v FROM n{r}_{k} n, grid WHERE node >= {2**k - 1}) GROUP BY node, f, e),
              b{r}_{k} AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY gain DESC, f, e) AS i
                FROM (SELECT *, gl * gl / (hl + {lam}) + (gt - gl) * (gt - gl) / (ht - hl + {lam}) - gt * gt / (ht + {lam}) AS gain FROM c{r}_{k} WHERE nl > 0 AND nl < nt)) WHERE i = 1 AND gain > 1e-12),
              n{r}_{k + 1} AS MATERIALIZED (SELECT {key}, a, b, y, s, CASE WHEN x.node IS NULL THEN n.node WHEN CASE WHEN f = 0 THEN a ELSE b END >= e THEN 2 * n.node + 2 ELSE 2 * n.node + 1 END AS node, n.g, n.h
                FROM n{r}_{k} n LEFT JOIN b{r}_{k} x ON n.node = x.node)"""
        sql += f", s{r + 1} AS MATERIALIZED (SELECT {key}, a, b, y, s + {rate} * -(sum(g) OVER w) / (sum(h) OVER w + {lam}) AS s FROM n{r}_{depth} WINDOW w AS (PARTITION BY node))"
    return sql


def _part_trees_sql(target: str, loss: str, rounds: int, depth: int, rate: float = 0.3) -> str:
    data = f"SELECT p_partkey, p_size::DOUBLE AS a, CAST(regexp_extract(p_brand, '[0-9]+') AS DOUBLE) AS b, ({target})::DOUBLE AS y FROM part"
    start = "avg(y)" if loss == "squared" else "ln(avg(y) / (1 - avg(y)))"
    g, h = ("s - y", "1.0::DOUBLE") if loss == "squared" else ("1 / (1 + exp(-s)) - y", "(1 / (1 + exp(-s))) * (1 - 1 / (1 + exp(-s)))")
    return _trees_sql("p_partkey", data, _STEPS, f"SELECT {start} FROM d", f"SELECT *, {g} AS g, {h} AS h FROM {{s}}", [(depth, rate)] * rounds)


def _boosted_sql(target: str, loss: str, rounds: int, depth: int) -> str:
    return _part_trees_sql(target, loss, rounds, depth) + f" SELECT p_partkey, round({'s' if loss == 'squared' else '1 / (1 + exp(-s))'}, 6) AS prediction FROM s{rounds}"


@query("gbdt_predict", _boosted_sql("p_retailprice", "squared", 3, 3))
def gbdt_predict(spark, sf_dir):
    d = _parts(spark, sf_dir)
    found = learning.boost(d, ["p_size", "brand"], "p_retailprice", "squared", rounds=3, depth=3, edges=_STEPS).predict(d)
    return found.select("p_partkey", F.round("prediction", 6).alias("prediction"))


@query("newton_boost_predict", _boosted_sql("p_retailprice * 100 % 7 < 3", "logistic", 3, 3))
def newton_boost_predict(spark, sf_dir):
    d = _parts(spark, sf_dir).withColumn("y", (F.col("p_retailprice") * 100 % 7 < 3).cast("double"))
    found = learning.boost(d, ["p_size", "brand"], "y", "logistic", rounds=3, depth=3, edges=_STEPS).predict(d)
    return found.select("p_partkey", F.round("prediction", 6).alias("prediction"))


def _importance_sql(rounds: int, depth: int) -> str:
    gains = " UNION ALL ".join(f"SELECT f, gain FROM b{r}_{k}" for r in range(rounds) for k in range(depth))
    named = "CASE f WHEN 0 THEN 'p_size' ELSE 'brand' END"
    return _part_trees_sql("p_retailprice", "squared", rounds, depth) + f" SELECT {named} AS feature, round(sum(gain) / sum(sum(gain)) OVER (), 8) AS share FROM ({gains}) GROUP BY f ORDER BY share DESC"


@query("feature_importance", _importance_sql(3, 3))
def feature_importance(spark, sf_dir):
    """Each feature's share of the gain of a boosted model's splits, greatest first."""
    d = _parts(spark, sf_dir)
    found = learning.boost(d, ["p_size", "brand"], "p_retailprice", "squared", rounds=3, depth=3, edges=_STEPS).importance()
    return spark.createDataFrame([(f, float(g)) for f, g in found.items()], "feature string, share double").select("feature", F.round("share", 8).alias("share")).orderBy(F.desc("share"))


#: Thresholds of the two features of the ranked rows.
_RANK_STEPS = {"f1": [1.005 + i for i in range(9)], "f2": [2.5, 4.5, 6.5]}
_SLOPES = """SELECT t.*, coalesce(-x.g, 0) AS g, coalesce(x.h, 0) AS h FROM {s} t LEFT JOIN (
    WITH r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY s DESC, d) AS p, row_number() OVER (PARTITION BY q ORDER BY y DESC, d) AS i, pow(2, y) - 1 AS gain FROM {s}),
    m AS (SELECT *, sum(gain / log2(i + 1)) OVER (PARTITION BY q) AS ideal FROM r),
    l AS (SELECT u.q, u.d AS u, v.d AS v, 1 / (1 + exp(greatest(least(u.s - v.s, 50), -50))) AS rho, abs((u.gain - v.gain) * (1 / log2(u.p + 1) - 1 / log2(v.p + 1))) / u.ideal AS delta FROM m u JOIN m v ON u.q = v.q AND u.y > v.y)
    SELECT q, d, sum(g) AS g, sum(h) AS h FROM (SELECT q, u AS d, rho * delta AS g, rho * (1 - rho) * delta AS h FROM l UNION ALL SELECT q, v, -rho * delta, rho * (1 - rho) * delta FROM l) GROUP BY q, d) x ON t.q = x.q AND t.d = x.d"""


@query(
    "ranking_boosters",
    _trees_sql("q, d", f"SELECT q, d, s AS a, (d % 10)::DOUBLE AS b, y::DOUBLE AS y FROM ({_RANKED})", _RANK_STEPS, "0", _SLOPES, [(1, 0.85), (2, 0.85**2)])
    + " SELECT q, d, round(s, 6) + 0.0 AS prediction FROM s2",
)
def ranking_boosters(spark, sf_dir):
    """A series of ranking boosters, each going on from the one before, deeper and at a lower rate."""
    d = _ranked(spark, sf_dir).select("q", "d", F.col("s").alias("f1"), (F.col("d") % 10).cast("double").alias("f2"), "y")
    model = None
    for i in range(1, 3):
        model = learning.boost(d, ["f1", "f2"], "y", "lambda", rounds=1, depth=i, rate=0.85**i, group="q", item="d", warm=model, edges=_RANK_STEPS)
    return model.predict(d).select("q", "d", (F.round("prediction", 6) + 0.0).alias("prediction"))


@query("lambdamart_rank")
def lambdamart_rank(spark, sf_dir):
    d = _ranked(spark, sf_dir).withColumn("f1", F.col("s")).withColumn("f2", (F.col("d") % 10).cast("double"))
    model = learning.boost(d, ["f1", "f2"], "y", "lambda", rounds=2, depth=2, group="q", item="d")
    return ranking.top_k(model.predict(d), "q", "prediction", "d", 1 << 30).select("q", "d", "place")


def _ials_sql(rounds: int, step: float = 1.7, lam: float = 5.0, alpha: float = 40.0, eps: float = 0.13, fade: float = 0.85) -> str:
    """One factor beside the bias: each half round solves two equations per row by determinants."""
    sql = f"""WITH {_RATINGS}, k AS MATERIALIZED (SELECT user, item, avg(rating) AS rating FROM r GROUP BY ALL), m AS (SELECT avg(rating) AS m FROM k),
      ub AS (SELECT user, avg(rating - m) AS ub FROM k, m GROUP BY user), ib AS (SELECT item, avg(rating - m - ub) AS ib FROM k JOIN ub USING (user), m GROUP BY item),
      x AS MATERIALIZED (SELECT user, item, rating, ub, ib, {alpha} * ln(1 + rating / {eps}) AS c1, {fade} * (m + ub + ib) AS q FROM k JOIN ub USING (user) JOIN ib USING (item), m),
      item0 AS (SELECT item, ib AS b0, ib AS b, sin(item * {step}) AS v FROM ib)"""
    turn = 0
    for _ in range(rounds):
        for side, other, own0 in (("user", "item", "ub"), ("item", "user", "ib")):
            have = f"{other}{turn if side == 'user' else turn + 1}"
            now = f"{side}{turn + 1}"
            sql += f""", w{now} AS (SELECT count(*)::DOUBLE AS g00, sum(v) AS g01, sum(v * v) AS g11, sum({fade} * b0 - b) AS t0, sum(({fade} * b0 - b) * v) AS t1 FROM {have}),
              p{now} AS (SELECT {side}, any_value({own0}) AS b0, count(*) * {lam} AS l, sum(c1) AS a00, sum(c1 * v) AS a01, sum(c1 * v * v) AS a11, sum((1 + c1) * (rating - b) - (q - b)) AS b0_, sum(((1 + c1) * (rating - b) - (q - b)) * v) AS b1_ FROM x JOIN {have} USING ({other}) GROUP BY {side}),
              e{now} AS (SELECT {side}, b0, g00 + a00 + l AS a, g01 + a01 AS c, g11 + a11 + l AS d, b0_ + {fade} * (m + b0) * g00 + t0 AS e, b1_ + {fade} * (m + b0) * g01 + t1 AS f FROM p{now}, w{now}, m),
              {now} AS MATERIALIZED (SELECT {side}, b0, (e * d - c * f) / (a * d - c * c) AS b, (a * f - c * e) / (a * d - c * c) AS v FROM e{now})"""
        turn += 1
    return sql + f" SELECT x.user, x.item, round(least(5, greatest(1, u.b + i.b + u.v * i.v)), 6) AS prediction FROM x JOIN user{turn} u USING (user) JOIN item{turn} i USING (item)"


@query("ials_predict", _ials_sql(2))
def ials_predict(spark, sf_dir):
    found = learning.ials(ratings(spark, sf_dir), rank=1, rounds=2, start=lambda key, i: F.sin(key * 1.7))
    return found.select("user", "item", F.round("prediction", 6).alias("prediction"))


@query(
    "ials_bag",
    f"SELECT user, item, round(avg(prediction), 7) AS prediction FROM (({_ials_sql(1)}) UNION ALL ({_ials_sql(1, 0.9)})) GROUP BY ALL",
)
def ials_bag(spark, sf_dir):
    """The mean of two factorisations that differ in what they start from."""
    found = learning.ials_series(ratings(spark, sf_dir), [lambda key, i, step=step: F.sin(key * step) for step in (1.7, 0.9)], rank=1, rounds=1)
    mean = F.aggregate(F.transform("predictions", lambda p: F.round(p, 6)), F.lit(0.0), lambda s, p: s + p) / F.size("predictions")
    return found.select("user", "item", F.round(mean, 7).alias("prediction"))


@query("hashed_logit_predict")
def hashed_logit_predict(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", (F.col("event_type") == "purchase").cast("double").alias("y"), F.hour("ts").alias("hour"), "user_id", F.array(F.get_json_object("props", "$.k")).alias("k"))
    return learning.hashed_logit(e, ["hour", "user_id"], ["k"], "y", interactions=[("hour", "user_id"), ("hour", "user_id", "k")]).select("event_id", "prediction")


_PLACE = "('0x' || substr(md5('7|' || coalesce({}::VARCHAR, '')), 1, 8))::BIGINT / 4294967296.0"


@query("row_split", f"SELECT o_orderkey, CASE WHEN {_PLACE.format('o_orderkey')} < 0.8 THEN 'train' ELSE 'valid' END AS part FROM orders")
def row_split(spark, sf_dir):
    train, valid = splits.split(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 0.8, seed=7)
    return splits.tagged({"train": train, "valid": valid})


@query("group_split", f"SELECT o_custkey, count(*) AS n, CASE WHEN {_PLACE.format('o_custkey')} < 0.5 THEN 'train' ELSE 'valid' END AS part FROM orders GROUP BY o_custkey")
def group_split(spark, sf_dir):
    train, valid = splits.split(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_custkey", 0.5, seed=7)
    return splits.tagged({"train": train, "valid": valid}).groupBy("o_custkey", "part").agg(F.count("*").alias("n"))


@query("train_without_validation", f"SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE {_PLACE.format('o_orderkey')} >= 0.98)")
def train_without_validation(spark, sf_dir):
    """Orders of customers of whom none is held out."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return splits.without(o, splits.split(o, "o_orderkey", 0.98, seed=7)[1], ["o_custkey"])


# Sources and the streaming extension


@query("pkz_roundtrip", "SELECT md5(text) AS digest, count(*) AS cnt FROM documents GROUP BY ALL")
def pkz_roundtrip(spark, sf_dir):
    """Documents through packed files and back."""
    binary.register(spark)
    path = new_folder(spark, "pkz")
    binary.write_pkz(table(spark, sf_dir, "documents"), path)
    return spark.read.format("pkz").load(path).groupBy(F.md5("document").alias("digest")).agg(F.count("*").alias("cnt"))


@query("fixed_records", "SELECT CAST(page_id AS VARCHAR) AS page, md5(url) AS digest FROM pages")
def fixed_records(spark, sf_dir):
    """Records of 52 bytes: a number and a digest."""
    binary.register(spark)
    path = new_folder(spark, "fixed")
    binary.write_fixed(table(spark, sf_dir, "pages").select(F.concat(F.lpad(F.col("page_id").cast("string"), 20, " "), F.md5("url")).cast("binary").alias("record")), path)
    text = F.col("record").cast("string")
    return spark.read.format("fixed_records").option("recordBytes", 52).load(path).select(F.trim(F.substring(text, 1, 20)).alias("page"), F.substring(text, 21, 32).alias("digest"))


@query("windowed_counts", "SELECT date_trunc('hour', ts) AS window_start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS window_end, event_type, count(*) AS cnt FROM events GROUP BY ALL")
def windowed_counts(spark, sf_dir):
    from weftline.streaming.clicks import windowed_counts as counts

    return counts(table(spark, sf_dir, "events"), ["event_type"])


from weftline.plans import layouts  # noqa: E402, F401  (registers its queries)
