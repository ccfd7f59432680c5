"""Stateful streams against the whole table: late, replayed and too late input."""

import random
from collections import Counter

from pyspark.sql import functions as F

from courierlake.operators.extensions import reply_latency
from courierlake.streaming import stateful

EMAILS = "id long, x_gm_thrid long, from_email string, internaldate_epoch long"
DAY = 86_400


def written(spark, path, frames, schema):
    """Each list of rows as one file, in the order given."""
    for i, rows in enumerate(frames):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return path


def run(spark, df, name, tmp_path, mode="append"):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
    query.awaitTermination()
    dropped = sum(o["numRowsDroppedByWatermark"] for p in query.recentProgress for o in p["stateOperators"])
    return spark.table(name), dropped


def stream(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(path)


def test_reply_latency(spark, tmp_path):
    stateful.state_store(spark)
    rng = random.Random(1)
    mails = [(i, rng.choice([None, 0, *range(1, 9)]), rng.choice([None, "a@x", "b@x", "c@x"]), 1_700_000_000 + i * 600 + rng.randrange(3) * 600) for i in range(400)]
    want = reply_latency(spark.createDataFrame(mails, EMAILS), limit=1000)
    late = sorted(mails, key=lambda m: m[3] + rng.randrange(DAY // 2))  # out of order by up to half a day
    parts = [late[i : i + 100] for i in range(0, 400, 100)]
    frames = [parts[0], parts[1], parts[1][:50] + parts[2], parts[3], [(10_000, 99, "z@x", 1_800_000_000)], [(10_001, 99, "z@x", 1_800_000_000 + 5 * DAY)]]
    path = written(spark, str(tmp_path / "mail"), frames, EMAILS)
    got, _ = run(spark, stateful.reply_latencies(stream(spark, path, EMAILS)), "latencies", tmp_path)
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect())) and want.count() > 100


EVENTS = "event_id long, ts timestamp, event_type string"


def moments(rng, n, start=1_700_000_000):
    return [(i, start + i * 300 + rng.randrange(1200), rng.choice(["view", "click"])) for i in range(n)]


def test_duplicates_and_sliding_windows(spark, tmp_path):
    import datetime

    rng = random.Random(2)
    rows = [(i, datetime.datetime.fromtimestamp(at, datetime.UTC), kind) for i, at, kind in moments(rng, 300)]
    shuffled = sorted(rows, key=lambda r: r[1].timestamp() + rng.randrange(DAY // 3))
    parts = [shuffled[i : i + 75] for i in range(0, 300, 75)]
    end = datetime.datetime.fromtimestamp(1_700_000_000 + 60 * DAY, datetime.UTC)
    frames = [parts[0], parts[0][:30] + parts[1], parts[2], parts[2] + parts[3], [(9999, end, "end")], [(5, rows[5][1], rows[5][2])], [(9998, end + datetime.timedelta(days=9), "end")]]
    path = written(spark, str(tmp_path / "events"), frames, EVENTS)
    once, dropped = run(spark, stateful.deduplicated(stream(spark, path, EVENTS)), "once", tmp_path)
    whole = spark.createDataFrame(rows, EVENTS)
    real = once.where("event_type != 'end'")
    assert Counter(map(tuple, real.collect())) == Counter(map(tuple, stateful.deduplicated(whole.unionByName(whole)).collect()))
    assert dropped == 1  # the row that comes sixty days late
    windows, late = run(spark, stateful.sliding_counts(stateful.deduplicated(stream(spark, path, EVENTS)), late=None), "slides", tmp_path)
    want = stateful.sliding_counts(whole)
    assert Counter(map(tuple, windows.where("event_type != 'end'").collect())) == Counter(map(tuple, want.collect()))
    assert want.agg(F.sum("count")).first()[0] == 4 * 300 and late >= 1
