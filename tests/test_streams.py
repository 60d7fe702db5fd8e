from graphloom.streaming import ingest, windows


def test_streamed_windows_equal_the_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    q = windows.tumbling(stream).writeStream.format("memory").queryName("tumbled").outputMode("complete").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("tumbled").collect())) == sorted(map(tuple, windows.tumbling(events).collect()))


def test_ingest_hands_on_only_what_changed(spark, tmp_path):
    seen, schema = [], "path string, content string"

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in")
        ingest.ingest(stream, f"{tmp_path}/manifest", lambda df: seen.extend(sorted(tuple(r) for r in df.collect())), f"{tmp_path}/c").awaitTermination()

    write = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
    write([("a", "1"), ("b", "1")])
    run()
    write([("a", "1"), ("b", "2"), ("c", "1")])
    run()
    assert sorted(seen) == [("a", "1"), ("b", "1"), ("b", "2"), ("c", "1")]
