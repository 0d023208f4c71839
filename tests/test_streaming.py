from rillflow.streaming.gauges import readings, window_levels


def test_stream_equals_batch(spark, small, tmp_path):
    events = spark.read.parquet(f"{small}/events.parquet")
    events.orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = window_levels(readings(spark, str(tmp_path / "in"), events.schema))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("levels").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("levels").collect())) == sorted(map(tuple, window_levels(events).collect()))
