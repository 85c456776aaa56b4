from conftest import SMALL

from weftline.streaming.clicks import windowed_counts


def test_stream_equals_batch(spark, tmp_path):
    batch = spark.read.parquet(f"{SMALL}/events.parquet")
    src = tmp_path / "in"
    batch.write.parquet(str(src))
    stream = windowed_counts(spark.readStream.schema(batch.schema).parquet(str(src)), ["event_type"], late="1000 days")
    q = stream.writeStream.format("memory").queryName("windowed").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("windowed").collect())) == sorted(map(tuple, windowed_counts(batch, ["event_type"]).collect()))
