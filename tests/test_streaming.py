from marlstone.streaming.events import read_stream, windowed_counts


def test_windowed_counts_equal_the_batch_result(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.write.parquet(f"{tmp_path}/in")
    stream = windowed_counts(read_stream(spark, f"{tmp_path}/in", events.schema), "6 hours")
    query = stream.writeStream.format("memory").queryName("counted").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(map(tuple, spark.table("counted").collect())) == sorted(map(tuple, windowed_counts(events, "6 hours").collect()))
