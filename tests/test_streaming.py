from pyspark.sql import functions as F

from talklake.streaming.jobs import attempts_stream, deduplicated_stream, sessions_stream

SCHEMA = "stream_id string, attempt int, seq int, type string, id string, start double, text string, at timestamp"


def drain(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return [tuple(r) for r in df.sparkSession.table(name).collect()]


def test_streams(spark, tmp_path):
    seg, done = "transcript.text.segment", "transcript.text.done"
    rows = [
        ("a", 1, 0, seg, "1", 0.0, "hi "), ("a", 1, 1, seg, "2", 1.0, "you"), ("a", 1, 1, seg, "2", 1.0, "you"), ("a", 1, 2, "transcript.text.delta", None, None, None), ("a", 1, 3, done, None, None, "hi you"),
        ("b", 1, 0, seg, "1", 5.0, "x"), ("b", 1, 1, seg, "2", 1.0, "y"), ("b", 1, 2, done, None, None, "xy"), ("c", 1, 0, seg, "1", 5.0, "x"),
        ("d", 1, 0, seg, "1", 5.0, "x"), ("d", 1, 1, done, None, None, "other"),
    ]
    df = spark.createDataFrame([(*r, None) for r in rows], SCHEMA).withColumn("at", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("seq") * 400))
    path = str(tmp_path / "in")
    df.coalesce(1).write.parquet(path)
    read = lambda: spark.readStream.schema(SCHEMA).parquet(path)
    assert sorted(drain(attempts_stream(read()), "attempts")) == [("a", 1, 2, "complete"), ("b", 1, 2, "not_in_order"), ("d", 1, 1, "text_differs")]
    assert len(drain(deduplicated_stream(read().where("id is not null"), ["stream_id", "id"], "at"), "once")) == 6  # six different (stream, id)
    got = drain(sessions_stream(read(), "stream_id", "at"), "sess", "append")
    batch = df.groupBy("stream_id", F.session_window("at", "10 minutes")).count().count()
    assert len(got) <= batch
