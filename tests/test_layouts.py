import pytest
from pyspark.sql import functions as F

from weftline.operators import keyed, learning, text_stats
from weftline.sources import binary
from weftline.sources import text as source


def test_lists_of_a_file(spark, tmp_path):
    (tmp_path / "x.csv").write_text("id;a;b\n1;x,y;\n2;;z\n3;,q;w\n")
    got = [tuple(r) for r in source.read_lists(spark, str(tmp_path), ["a", "b"]).orderBy("id").collect()]
    assert got == [("1", ["x", "y"], []), ("2", [], ["z"]), ("3", ["", "q"], ["w"])]


def test_ratings_of_a_file(spark, tmp_path):
    (tmp_path / "good").write_text("1\t2\t3.5\n2\t1\t5\n")
    (tmp_path / "bad").write_text("1\tx\t3.5\n")
    assert sorted(map(tuple, source.read_ratings(spark, str(tmp_path / "good")).collect())) == [(1, 2, 3.5), (2, 1, 5.0)]
    with pytest.raises(Exception):
        source.read_ratings(spark, str(tmp_path / "bad")).collect()


def test_namespaces(spark):
    df = spark.createDataFrame([(1, ["a", "b"], []), (-1, [], None)], "y int, p array<string>, q array<string>")
    got = [r.line for r in df.select(learning.vw_spaces(F.col("y"), {"p": F.col("p"), "q": F.col("q")}).alias("line")).collect()]
    assert got == ["1 |p a b |q", "-1 |p |q"]


def test_single_cells(spark):
    t = spark.createDataFrame([("a", 1), ("b", None), (None, 3)], "row_key string, value int")
    assert [r.value for r in keyed.get(t, "a").collect()] == [1]
    assert keyed.get(t, "x").count() == keyed.get(t, None).count() == 0
    after = lambda k, v: sorted(((r.row_key, r.value) for r in keyed.put(t, k, v).collect()), key=str)
    assert after("b", 7) == sorted([("a", 1), ("b", 7), (None, 3)], key=str)
    assert after("c", 9) == sorted([("a", 1), ("b", None), ("c", 9), (None, 3)], key=str)


def test_unknown_words_weigh_nothing(spark):
    words = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "i int, word string")
    idf = spark.createDataFrame([("a", 1.5, 4)], "word string, idf double, df long")
    assert sorted((r.i, r.idf) for r in text_stats.with_idf(words, idf).collect()) == [(1, 1.5), (2, 0.0), (3, 0.0)]


def test_messages_of_several_files(spark, tmp_path):
    binary.register(spark)
    rows = [("u1", "b" * 300, "t"), ("u2", None, None), ("u3", "", "é")]
    df = spark.createDataFrame(rows, "url string, body string, text string").repartition(2)
    assert binary.write_messages(df, str(tmp_path / "m")) == 3
    got = spark.read.format("record_stream").load(str(tmp_path / "m")).orderBy("url").collect()
    assert [tuple(r) for r in got] == rows
