"""Windows over a stream of files against the same windows over the whole table."""

from pyspark.sql import functions as F

from courierlake.streaming.incremental import event_counts, sessions

SF = "/root/testdata/sf0.001"


def streamed(spark, make, name, path, schema, files):
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
    query = make(rows).writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name)


def test_windows(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    path = str(tmp_path / "events")
    events.repartition(3).write.parquet(path)
    # the files are not in order of time: sessions come in one batch, or events behind the watermark would be left out
    for name, make, files in (("counts", event_counts, 1), ("sessions", sessions, 9)):
        want, got = make(events), streamed(spark, make, f"streamed_{name}", path, events.schema, files)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
        assert got.agg(F.sum("count")).first()[0] == events.count()


def test_session_gap(spark):
    rows = [("2024-01-01 00:00:00", 1), ("2024-01-01 00:29:00", 1), ("2024-01-01 01:10:00", 1), ("2024-01-01 00:10:00", 2)]
    events = spark.createDataFrame(rows, "ts string, user_id long")
    assert sorted((r["user_id"], r["count"]) for r in sessions(events).collect()) == [(1, 1), (1, 2), (2, 1)]
