"""Streams through files, and the batch forms of the same operators."""

from pyspark.sql import functions as F

from trellis.streaming import joins, views, windows


def test_tumbling_windows_of_a_stream(spark, tmp_path):
    rows = [("a", "2024-01-01 00:00:01", 1), ("a", "2024-01-01 00:00:09", 2), ("a", "2024-01-01 00:00:12", 3), ("b", "2024-01-01 00:02:00", 4)]
    df = spark.createDataFrame(rows, "key string, t string, v int").select("key", F.to_timestamp("t").alias("event_time"), "v")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    out = windows.tumbling(stream, "10 seconds", ["key"], {"total": F.sum("v")})
    query = out.writeStream.outputMode("append").format("memory").queryName("tumbling").option("checkpointLocation", f"{tmp_path}/c").start()
    query.processAllAvailable()
    query.stop()
    got = sorted((r.key, str(r.window_start)[-8:], r.window_count, r.total) for r in spark.table("tumbling").collect())
    assert got == [("a", "00:00:00", 2, 3), ("a", "00:00:10", 1, 3)]  # b's window is still open
    batch = windows.sliding(df, "10 seconds", "5 seconds", ["key"]).where("key = 'a'")
    assert sorted(r.window_count for r in batch.collect()) == [1, 1, 2, 2]
    assert sorted(r.window_count for r in windows.session(df, "5 seconds", ["key"]).collect()) == [1, 1, 2]


def test_stream_table_join_and_latest(spark):
    stream = spark.createDataFrame([(1, "x"), (9, "y")], "k long, name string")
    table = spark.createDataFrame([(1, "n", 7)], "id long, name string, extra int")
    got = sorted(map(tuple, joins.stream_table_join(stream, table, "k", "id").collect()))
    assert got == [(1, "n", 7, True), (9, "y", None, False)]
    changes = spark.createDataFrame([(1, 1, "old"), (1, 2, "new"), (2, 1, None)], "k long, t long, v string")
    assert sorted(map(tuple, joins.latest(changes, "k", "t").collect())) == [(1, 2, "new"), (2, 1, None)]


def test_incremental_view(spark, tmp_path):
    seen = []
    view = views.IncrementalView(str(tmp_path), "k", "t", lambda log, i: seen.append(sorted((r.change_type, r.k) for r in log.collect())))
    batch = lambda *rows: spark.createDataFrame(list(rows), "k long, t long, v string, record_type string")
    view.apply(batch((1, 1, "a", "INSERT"), (2, 1, "b", "INSERT")), 0)
    view.apply(batch((1, 2, "c", "UPDATE"), (2, 2, None, "DELETE")), 1)
    view.apply(batch((1, 2, "c", "UPDATE"), (2, 2, None, "DELETE")), 1)
    assert seen == [[("INSERT", 1), ("INSERT", 2)], [("DELETE", 2), ("UPDATE", 1)], [("DELETE", 2), ("UPDATE", 1)]]
    assert [(r.k, r.v) for r in view.query(spark, "k > 0").collect()] == [(1, "c")]
