import pytest
from compare import connect, rows_of
from conftest import SMALL

from weftline.plans.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(spark, name):
    df, want = QUERIES[name](spark, SMALL), connect(SMALL).sql(ORACLE[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows_of(df.collect(), df.columns) == rows_of(want.fetchall(), want.columns)


def test_entry_imports(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns == ["word", "df"]


def test_whole_query_texts_are_scored(spark):
    """A document that shares no more than the last word with an item has a row."""
    docs, items = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "benchmark"))
    last = items.selectExpr("item_id AS query_id", "element_at(split(lower(text), ' ', -1), -1) AS word")
    want = docs.selectExpr("doc_id", "explode(array_distinct(split(lower(text), ' ', -1))) AS word").join(last, "word").select("query_id", "doc_id").distinct()
    assert want.count() > 0
    for name in ("bm25", "tf_idf"):
        assert want.join(QUERIES[name](spark, SMALL), ["query_id", "doc_id"], "left_anti").count() == 0


def test_every_link_is_an_edge(spark):
    edges = QUERIES["link_graph_edges"](spark, SMALL)
    links = QUERIES["extract_links"](spark, SMALL).selectExpr("page_id AS src", "md5(link) AS dst").distinct()
    assert edges.count() == links.count() > 0
    assert links.join(edges, ["src", "dst"], "left_anti").count() == 0


def test_unknown_urls_are_dropped(spark):
    from weftline.operators.web import link_graph

    found = spark.createDataFrame([(1, "a"), (1, "a"), (1, "x"), (2, "b")], "page_id int, link string")
    urls = spark.createDataFrame([("a", 10), ("b", 20), ("c", 30)], "url string, id int")
    assert sorted(map(tuple, link_graph(found, urls, "page_id").collect())) == [(1, 10), (2, 20)]
