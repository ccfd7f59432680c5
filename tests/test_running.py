"""Windows over split keys against Spark's own windows."""

import random
from collections import Counter

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from courierlake.operators import running


@pytest.fixture(scope="module")
def rows(spark):
    """With few rows the adaptive planner would join all parts into one."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    rng = random.Random(1)
    made = [(rng.choice(["hot"] * 6 + ["a", "b", None]), rng.randrange(400), i, rng.choice([None, *range(50)])) for i in range(1500)] + [("one", 5, 9000, 7)]
    yield spark.createDataFrame(made, "k string, at long, id long, v long").repartition(5)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_running(spark, rows):
    got = running.running(rows, "k", ("at", "id"), "v")
    w = Window.partitionBy("k").orderBy("at", "id")
    v = F.coalesce("v", F.lit(0))
    want = rows.select("*", F.sum(v).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.sum(v).over(w.rowsBetween(-2, 0)), F.row_number().over(w), F.ntile(4).over(w))
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))
    parts = running.parted(rows, "k", "at", "id").groupBy("k").agg(F.count_distinct("_part").alias("n"))
    assert parts.where("k = 'hot'").first()["n"] > 1
    assert running.running(rows.limit(0), "k", ("at", "id"), "v").count() == 0


def test_asof(spark, rows):
    right = rows.where("id % 3 = 0").select("k", "at", F.col("v").alias("seen"))
    left = rows.where("id % 3 = 1").select("k", "at", "id")
    known = [tuple(r) for r in right.collect()]
    want = Counter()
    for k, at, i in map(tuple, left.collect()):
        before = [(t, s) for key, t, s in known if key == k and t <= at and s is not None]
        want[k, at, i, max(before)[1] if before else None] += 1
    assert Counter(map(tuple, running.asof_join(left, right, "k", "at", "seen").collect())) == want
