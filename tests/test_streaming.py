"""Windows over a stream give the same counts as over the table."""

from driftline.streaming import windows


def test_tumbling_stream(spark, tmp_path):
    rows = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    folder = str(tmp_path / "in")
    rows.repartition(3).write.parquet(folder)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    q = windows.tumbling_counts(stream, "6 hours").writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    key = lambda r: (r.start, r.event_type, r.n)
    assert sorted(map(key, spark.table("counts").collect())) == sorted(map(key, windows.tumbling_counts(rows, "6 hours").collect()))


def test_late_rows_are_let_go(spark, tmp_path):
    import datetime as dt

    def put(k, hours):
        t0 = dt.datetime(2024, 1, 1)
        spark.createDataFrame([(t0 + dt.timedelta(hours=h), "view") for h in hours], "ts timestamp, event_type string").coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/{k}"))

    put(0, [0, 1])
    schema = spark.read.parquet(str(tmp_path / "in/0")).schema
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    q = windows.tumbling_counts(stream, "2 hours", "1 hour").writeStream.format("memory").queryName("late").outputMode("append").option("checkpointLocation", str(tmp_path / "cp2")).start()
    q.processAllAvailable()
    put(1, [10])
    q.processAllAvailable()
    put(2, [0, 20])
    q.processAllAvailable()
    q.stop()
    got = {r.start.hour: r.n for r in spark.table("late").collect()}
    assert got[0] == 2  # the row that came after its window had closed is not counted


def test_sliding_windows_count_each_row_twice(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    total = sum(r.n for r in windows.sliding_counts(rows, "2 hours", "1 hour").collect())
    assert total == 2 * rows.count()
