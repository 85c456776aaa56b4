import duckdb
from compare import connect, rows_of
from conftest import SMALL

import corpus_pipeline
from weftline.llm.queries import ORACLE, QUERIES


def test_quality_equals_sql(spark):
    df, want = QUERIES["op9_quality"](spark, SMALL), connect(SMALL).sql(ORACLE["op9_quality"])
    assert rows_of(df.collect(), df.columns) == rows_of(want.fetchall(), want.columns)


def test_all_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    cols, left = docs.columns, docs
    good = {r.doc_id for r in QUERIES["op9_quality"](spark, SMALL).filter("kept").collect()}
    counts = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        left = stage(spark, left, SMALL)
        if i < 4:
            assert left.columns == cols
        left = spark.createDataFrame(left.toArrow())
        counts.append(left.count())
        if i == 0:
            assert {r.doc_id for r in left.select("doc_id").collect()} == good
    assert counts[0] == counts[1] >= counts[2] > 0
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, SMALL)
        assert empty.count() == 0


def test_sql_is_valid():
    assert duckdb.connect() and corpus_pipeline.ORACLE_SQL is None
