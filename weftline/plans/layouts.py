"""Registered queries that go through the text and binary layouts, single cells and word vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline import sinks
from weftline.functions import text as T
from weftline.operators import embeddings, extremes, keyed, learning, text_stats
from weftline.plans.registry import query
from weftline.shared import new_folder
from weftline.sources import binary
from weftline.sources import text as source
from weftline.tables import table

_PROP = "json_extract_string(props, '$.k')"


# Text layouts


@query("key_value_lines", "SELECT c_custkey::VARCHAR AS key, c_name || chr(9) || c_mktsegment AS value FROM customer")
def key_value_lines(spark, sf_dir):
    """Lines of a key, a tab and a value that has one itself."""
    path = new_folder(spark, "lines")
    c = table(spark, sf_dir, "customer").select(F.concat_ws("\t", "c_custkey", "c_name", "c_mktsegment").alias("value"))
    c.write.option("compression", "gzip").text(path)
    return source.read_key_values(spark, path)


@query("edge_lines", "SELECT l_suppkey AS src, l_partkey AS dst FROM lineitem")
def edge_lines(spark, sf_dir):
    """A text graph with comment and empty lines between its edges."""
    path = new_folder(spark, "edges")
    edges = table(spark, sf_dir, "lineitem").select(F.concat_ws("\t", "l_suppkey", "l_partkey").alias("value"))
    notes = table(spark, sf_dir, "nation").select(F.explode(F.array(F.concat(F.lit("# "), "n_name"), F.lit(""))).alias("value"))
    edges.unionByName(notes).write.text(path)
    return source.read_edges(spark, path)


@query("submission_lines", "SELECT o_custkey AS query, o_orderkey AS document, o_totalprice AS score FROM orders")
def submission_lines(spark, sf_dir):
    """Comma-separated lines with a header, read with names of our own."""
    path = new_folder(spark, "submission")
    sinks.write_tsv(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), path, header=True, sep=",")
    return source.read_tsv(spark, path, "query long, document long, score double", header=True, sep=",")


_LISTS = f"SELECT user_id::VARCHAR AS C1, event_type AS C2, list_sort(list({_PROP})) AS CG1 FROM events GROUP BY ALL"


def _lists(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("C1"), F.col("event_type").alias("C2"), F.get_json_object("props", "$.k").alias("k"))
    return e.groupBy("C1", "C2").agg(F.sort_array(F.collect_list("k")).alias("CG1"))


@query("list_columns", _LISTS)
def list_columns(spark, sf_dir):
    """A semicolon-separated file with a header and comma lists inside."""
    path = new_folder(spark, "lists")
    sinks.write_tsv(_lists(spark, sf_dir).withColumn("CG1", F.array_join("CG1", ",")), path, header=True, sep=";")
    return source.read_lists(spark, path, ["CG1"])


@query(
    "namespace_lines",
    f"""SELECT CASE WHEN C2 = 'purchase' THEN '1' ELSE '-1' END || ' |c C1_' || C1 || ' C2_' || C2 || ' |l ' || array_to_string(list_transform(CG1, lambda k: 'CG1_0_' || k), ' ') || ' |m' AS value FROM ({_LISTS})""",
)
def namespace_lines(spark, sf_dir):
    """Lines of the text format of online linear learners: a label and tokens by namespace, of which one is empty."""
    path = new_folder(spark, "spaces")
    label = learning.signed_label((F.col("C2") == "purchase").cast("int"))
    spaces = {"c": learning.tokens(["C1", "C2"], []), "l": learning.tokens([], ["CG1"]), "m": F.array().cast("array<string>")}
    sinks.write_vw(_lists(spark, sf_dir), learning.vw_spaces(label, spaces), path)
    return source.read_lines(spark, path)


@query("rating_lines", "SELECT o_custkey AS user, l_partkey AS item, l_quantity::DOUBLE AS rating FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def rating_lines(spark, sf_dir):
    path = new_folder(spark, "ratings")
    j = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    sinks.write_tsv(j.select("o_custkey", "l_partkey", F.col("l_quantity").cast("double")), path)
    return source.read_ratings(spark, path)


def _idf(spark, sf_dir):
    return text_stats.idf(table(spark, sf_dir, "documents"), T.letters(F.col("text")))


@query("idf_dump", "SELECT word, round(log2((SELECT count(*) FROM documents)::DOUBLE / count(*)), 8) AS idf FROM (SELECT unnest(list_distinct(regexp_extract_all(lower(text), '\\p{L}+'))) AS word FROM documents) GROUP BY word")
def idf_dump(spark, sf_dir):
    """A dictionary as json and back."""
    path = new_folder(spark, "idf")
    sinks.write_json(_idf(spark, sf_dir).select("word", F.round("idf", 8).alias("idf")), path)
    return spark.read.schema("word string, idf double").json(path)


@query(
    "idf_of_queries",
    """WITH d AS (SELECT word, count(*) AS df FROM (SELECT unnest(list_distinct(regexp_extract_all(lower(text), '\\p{L}+'))) AS word FROM documents) GROUP BY word),
       q AS (SELECT item_id, unnest(list_distinct(string_split(text, ' '))) AS word FROM benchmark)
       SELECT item_id, word, round(coalesce(log2((SELECT count(*) FROM documents)::DOUBLE / df), 0), 8) AS idf FROM q LEFT JOIN d USING (word)""",
)
def idf_of_queries(spark, sf_dir):
    """Words as they stand in the benchmark's texts; those with a capital letter or a mark are unknown."""
    q = table(spark, sf_dir, "benchmark").select("item_id", F.explode(F.array_distinct(F.split("text", " ", -1))).alias("word"))
    found = text_stats.with_idf(q, _idf(spark, sf_dir))
    return found.select("item_id", "word", F.round("idf", 8).alias("idf"))


# Weather lines

_FAHRENHEIT = "((o_orderkey * 37 % 1800)::DOUBLE / 10 - 60)"
_CELSIUS = "({}::DECIMAL(6,1)::FLOAT - 32::FLOAT) * 5::FLOAT / 9::FLOAT"


def _weather(spark, sf_dir):
    """Fixed-width lines of orders: the customer is the station, every seventeenth greatest temperature is missing."""
    high = F.col("o_orderkey") * 37 % 1800 / 10 - 60
    shown = F.format_string("%6.1f", F.when(F.col("o_orderkey") % 17 == 0, F.lit(9999.9)).otherwise(high))
    head = F.rpad(F.concat(F.format_string("%06d", "o_custkey"), F.lit(" 99999  "), F.date_format("o_orderdate", "yyyyMMdd")), 102, " ")
    return table(spark, sf_dir, "orders").select(F.concat(head, shown, F.lit("* "), F.format_string("%6.1f", high - 20), F.lit("*")).alias("value"))


def _stations(spark, sf_dir):
    """Every customer of a nation but the first is a known station, at a place of its nation's number."""
    path = new_folder(spark, "stations")
    c = table(spark, sf_dir, "customer")
    sinks.write_tsv(c.select("c_custkey", F.when(F.col("c_nationkey") > 0, F.col("c_nationkey") + 0.5), F.lit(7.25)), path, header=True, sep=",")
    return source.read_tsv(spark, path, "station int, lat double, lon double", header=True, sep=",")


_WEATHER = f"""SELECT o_custkey::INTEGER AS station, year(o_orderdate)::INTEGER AS year, month(o_orderdate)::INTEGER AS month, day(o_orderdate)::INTEGER AS day,
    CASE WHEN o_orderkey % 17 <> 0 THEN {_CELSIUS.format(_FAHRENHEIT)} END AS max_temp, {_CELSIUS.format('(' + _FAHRENHEIT + ' - 20)')} AS min_temp FROM orders"""


def _shortened(df):
    return df.withColumn("max_temp", F.round(F.col("max_temp").cast("double"), 3) + 0.0).withColumn("min_temp", F.round(F.col("min_temp").cast("double"), 3) + 0.0)


_SHORT = "round(max_temp::DOUBLE, 3) + 0.0 AS max_temp, round(min_temp::DOUBLE, 3) + 0.0 AS min_temp"


@query("weather_lines", f"SELECT station, year, month, day, {_SHORT} FROM ({_WEATHER})")
def weather_lines(spark, sf_dir):
    return _shortened(extremes.parse_weather(_weather(spark, sf_dir)))


@query("weather_located", f"SELECT station, year, month, day, {_SHORT}, c_nationkey + 0.5::DOUBLE AS lat, 7.25::DOUBLE AS lon FROM ({_WEATHER}) JOIN customer ON c_custkey = station WHERE c_nationkey > 0")
def weather_located(spark, sf_dir):
    return _shortened(extremes.located(extremes.parse_weather(_weather(spark, sf_dir)), _stations(spark, sf_dir))[0])


@query("weather_misses", f"SELECT station, count(*) AS lines FROM ({_WEATHER}) WHERE station NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey > 0) GROUP BY station")
def weather_misses(spark, sf_dir):
    """Stations of unknown place."""
    return extremes.located(extremes.parse_weather(_weather(spark, sf_dir)), _stations(spark, sf_dir))[1].groupBy("station").agg(F.count("*").alias("lines"))


# Binary messages, outputs, cells


@query("message_stream", "SELECT url, CASE WHEN page_id % 2 = 0 THEN html END AS body, CASE WHEN page_id % 3 = 0 THEN page_id::VARCHAR END AS text FROM pages")
def message_stream(spark, sf_dir):
    """Length-prefixed messages with absent fields."""
    binary.register(spark)
    path = new_folder(spark, "messages")
    p = table(spark, sf_dir, "pages")
    binary.write_messages(p.select("url", F.when(F.col("page_id") % 2 == 0, F.col("html")).alias("body"), F.when(F.col("page_id") % 3 == 0, F.col("page_id").cast("string")).alias("text")), path)
    return spark.read.format("record_stream").load(path)


@query("named_outputs", "SELECT CASE WHEN c_acctbal < 0 THEN 'debt' ELSE 'credit' END AS output, c_custkey, c_acctbal FROM customer")
def named_outputs(spark, sf_dir):
    path = new_folder(spark, "named")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    sinks.write_named({"debt": c.filter("c_acctbal < 0"), "credit": c.filter("c_acctbal >= 0")}, path)
    parts = [spark.read.parquet(f"{path}/{name}").select(F.lit(name).alias("output"), "*") for name in ("debt", "credit")]
    return parts[0].unionByName(parts[1])


@query("outputs_by_kind", "SELECT event_type, event_id FROM events")
def outputs_by_kind(spark, sf_dir):
    path = new_folder(spark, "kinds")
    sinks.write_by_kind(table(spark, sf_dir, "events").select("event_type", "event_id"), "event_type", path)
    return spark.read.parquet(path)


@query("bulk_load", "SELECT c_name AS row_key, c_acctbal AS value FROM customer")
def bulk_load(spark, sf_dir):
    path = new_folder(spark, "bulk")
    sinks.write_sorted(table(spark, sf_dir, "customer").select(F.col("c_name").alias("row_key"), F.col("c_acctbal").alias("value")), "row_key", path)
    return spark.read.parquet(path)


_CELLS = "SELECT c_custkey AS row_key, c_mktsegment AS value FROM customer"


def _cells(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("row_key"), F.col("c_mktsegment").alias("value"))


@query(
    "changed_cells",
    f"SELECT row_key, CASE WHEN row_key % 3 = 1 THEN 'new' ELSE value END AS value FROM ({_CELLS}) WHERE row_key % 3 <> 0 UNION ALL SELECT s_suppkey + 1000000, s_name FROM supplier",
)
def changed_cells(spark, sf_dir):
    """A change set of puts on known and on new keys, and of deletes."""
    cells = _cells(spark, sf_dir)
    old = cells.filter("row_key % 3 < 2").select("row_key", F.when(F.col("row_key") % 3 == 1, "put").otherwise("delete").alias("op"), F.lit("new").alias("value"))
    fresh = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") + 1000000).alias("row_key"), F.lit("put").alias("op"), F.col("s_name").alias("value"))
    return sinks.apply_changes(cells, old.unionByName(fresh))


@query("cell_get", f"SELECT * FROM ({_CELLS}) WHERE row_key = 42")
def cell_get(spark, sf_dir):
    return keyed.get(_cells(spark, sf_dir), 42)


@query("cell_put", f"SELECT row_key, CASE WHEN row_key = 42 THEN 'set' ELSE value END AS value FROM ({_CELLS})")
def cell_put(spark, sf_dir):
    return keyed.put(_cells(spark, sf_dir), 42, "set")


# Word vectors

_WORDS = "ws AS (SELECT 'w' || vec_id AS word, embedding::DOUBLE[] AS v FROM embeddings)"
_PAIRS = f"{_WORDS}, l AS (SELECT o_custkey AS pair_id, 'w' || l_partkey AS a, 'w' || (l_suppkey * 7) AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


def _vectors(spark, sf_dir):
    """Vectors stand for those of words."""
    return table(spark, sf_dir, "embeddings").select(F.concat(F.lit("w"), "vec_id").alias("word"), F.col("embedding").alias("vector"))


def _word_pairs(spark, sf_dir):
    j = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    keys = j.groupBy(F.col("o_custkey").alias("pair_id")).agg(F.collect_list("l_partkey").alias("a"), F.collect_list(F.col("l_suppkey") * 7).alias("b"))
    return keys.select("pair_id", *[F.transform(side, lambda k: F.concat(F.lit("w"), k.cast("string"))).alias(side) for side in "ab"])


def _mean_sql(side: str) -> str:
    return f"m{side} AS (SELECT pair_id, list(x ORDER BY i) AS v FROM (SELECT pair_id, i, avg(x) AS x FROM (SELECT pair_id, generate_subscripts(v, 1) AS i, unnest(v) AS x FROM l JOIN ws ON word = {side}) GROUP BY ALL) GROUP BY pair_id)"


@query(
    "word_list_similarity",
    f"""WITH {_PAIRS}, {_mean_sql('a')}, {_mean_sql('b')}
        SELECT pair_id, round(coalesce(list_cosine_similarity(ma.v, mb.v), 0), 6) AS similarity FROM (SELECT DISTINCT pair_id FROM l) LEFT JOIN ma USING (pair_id) LEFT JOIN mb USING (pair_id)""",
)
def word_list_similarity(spark, sf_dir):
    """Words of a customer's parts against those of the suppliers; some are unknown."""
    return embeddings.n_similarity(_word_pairs(spark, sf_dir), _vectors(spark, sf_dir)).withColumn("similarity", F.round("similarity", 6))


@query(
    "word_movers_from_one",
    f"""WITH {_PAIRS}, x AS (SELECT pair_id, avg(list_distance(one.v, ws.v)) AS distance FROM l JOIN ws ON word = b JOIN ws one ON one.word = 'w' || pair_id GROUP BY pair_id)
        SELECT pair_id, round(coalesce(distance, 1000000), 5) AS distance FROM (SELECT DISTINCT pair_id FROM l) LEFT JOIN x USING (pair_id)""",
)
def word_movers_from_one(spark, sf_dir):
    """From a single word all goes to the words of the other side, so that SQL can say the distance."""
    one = _word_pairs(spark, sf_dir).withColumn("a", F.array(F.concat(F.lit("w"), "pair_id")))
    return embeddings.word_movers_distance(one, _vectors(spark, sf_dir)).withColumn("distance", F.round("distance", 5))


@query("urls_in_normal_form", "SELECT page_id, regexp_replace(replace(replace(replace(url, 'http://', ''), 'https://', ''), 'www.', ''), '/$', '') AS url FROM pages")
def urls_in_normal_form(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.normal_url(F.col("url")).alias("url"))
