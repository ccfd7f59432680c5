"""Windows over the rows of a key in order, for keys that may hold any share of the rows.

Spark's own window takes each key's rows through one task. Here rows are dealt
by range of (key, order), so a hot key spreads over many tasks; each part of a
key says what it hands on (how many rows, their sum, its last values), what
comes before a part is folded from those, one row for each part, and a
window within the part adds it. The dealt rows are checkpointed, so that both
passes see the same parts, whatever is computed again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import scratch_dir


def checkpointed(df: DataFrame) -> DataFrame:
    """df from the shared folder, without its lineage."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(scratch_dir(df.sparkSession))
    return df.checkpoint()


def parted(rows: DataFrame, by: str, *order: Column | str) -> DataFrame:
    """Rows with _part: parts of a key hold its rows in order, and go up with it."""
    dealt = rows.repartitionByRange(by, *order).withColumn("_part", F.spark_partition_id())
    return checkpointed(dealt)


def handed_on(parts: DataFrame, by: str, start: Column, step: Callable[[Column, Column], Column]) -> DataFrame:
    """by, _part and _before: what step() makes of start and all earlier parts of the key. parts: by, _part and what each hands on, a row each."""
    listed = parts.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("_part", *(c for c in parts.columns if c not in (by, "_part"))))).alias("parts"))
    # as many parts as tasks at most
    states = F.aggregate("parts", F.array(start), lambda out, x: F.concat(out, F.array(step(F.element_at(out, -1), x))))
    zipped = F.transform("parts", lambda x, i: F.struct(x["_part"].alias("_part"), F.get(states, i).alias("_before")))
    return listed.select(by, F.explode(zipped).alias("x")).select(by, "x._part", "x._before")


def with_before(dealt: DataFrame, side: DataFrame, by: str) -> DataFrame:
    """dealt with the other columns of side, by key (a null one too) and part."""
    side = side.withColumnRenamed(by, "_by").withColumnRenamed("_part", "_of")
    return dealt.join(side, dealt[by].eqNullSafe(side["_by"]) & (dealt["_part"] == side["_of"])).drop("_by", "_of")


def running(rows: DataFrame, by: str, order: tuple[str, ...], value: str, tiles: int = 4) -> DataFrame:
    """rows with running (sum of value up to the row), last_three (with the two rows before), position (from 1) and tile of `tiles`."""
    kind = "struct<n:bigint,sum:bigint,tail:array<bigint>>"
    dealt = parted(rows, by, *order)
    own = Window.partitionBy(by, "_part").orderBy(*order)
    last = F.row_number().over(Window.partitionBy(by, "_part").orderBy(*(F.desc(c) for c in order)))
    tails = dealt.select(by, "_part", F.col(value).cast("long").alias("v"), last.alias("back")).where("back <= 2")
    tails = tails.groupBy(by, "_part").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("back")).alias("at"), "v"))), lambda x: x["v"]).alias("tail"))
    parts = dealt.groupBy(by, "_part").agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col(value).cast("long")), F.lit(0)).alias("sum"))
    parts = with_before(parts, tails, by)
    start = F.struct(F.lit(0), F.lit(0), F.array()).cast(kind)

    def step(now: Column, x: Column) -> Column:
        tail = F.concat(now["tail"], x["tail"])
        return F.struct(now["n"] + x["n"], now["sum"] + x["sum"], F.slice(tail, F.greatest(F.size(tail) - 1, F.lit(1)), F.lit(2))).cast(kind)

    before = handed_on(parts, by, start, step)
    total = parts.groupBy(by).agg(F.sum("n").alias("_total")).withColumnRenamed(by, "_by")
    before = before.join(total, before[by].eqNullSafe(total["_by"])).drop("_by")
    out = with_before(dealt, before, by)
    k, tail = F.row_number().over(own), F.col("_before.tail")

    def earlier(n: int) -> Column:
        # beyond the part's first row the value is one that was handed on
        return F.coalesce(F.when(F.col("_k") > n, F.lag(F.col(value).cast("long"), n).over(own)).otherwise(F.get(tail, F.size(tail) - n + F.col("_k") - 1)), F.lit(0))

    out = out.withColumn("_k", k)
    at = F.col("_before.n") + F.col("_k")
    small, more = F.expr(f"_total div {tiles}"), F.col("_total") % tiles
    edge = more * (small + 1)
    tile = F.when(at <= edge, F.floor((at - 1) / (small + 1)) + 1).otherwise(more + F.floor((at - edge - 1) / small) + 1)
    return out.select(
        *rows.columns,
        (F.col("_before.sum") + F.coalesce(F.sum(F.col(value).cast("long")).over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow)), F.lit(0))).alias("running"),
        (F.coalesce(F.col(value).cast("long"), F.lit(0)) + earlier(1) + earlier(2)).alias("last_three"),
        at.alias("position"),
        tile.cast("int").alias("tile"),
    )


def asof_join(left: DataFrame, right: DataFrame, by: str, at: str, value: str) -> DataFrame:
    """left with the `value` of the latest row of right that has the same `by` and is not later than `at` (null: none).

    No pair is made: a union, and within each part of a key the last value seen,
    or the one that earlier parts hand on. Of rows of right at one time the
    greatest value counts.
    """
    kind = right.schema[value].dataType
    both = left.select("*", F.lit(None).cast(kind).alias("_seen"), F.lit(1).alias("_side"))
    known = right.select(F.col(by), F.col(at), F.col(value).alias("_seen"), F.lit(0).alias("_side"))
    order = (at, "_side", F.asc_nulls_first("_seen"))
    dealt = parted(both.unionByName(known, allowMissingColumns=True), by, at, "_side", "_seen")
    own = Window.partitionBy(by, "_part").orderBy(*order)
    parts = dealt.groupBy(by, "_part").agg(F.max(F.when(F.expr("_side = 0 and _seen is not null"), F.struct(F.col(at).alias("at"), "_seen"))).alias("_last"))
    parts = parts.select(by, "_part", F.col("_last._seen").alias("_last"))
    before = handed_on(parts, by, F.lit(None).cast(kind), lambda now, x: F.coalesce(x["_last"], now))
    last = F.last("_seen", ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    name = value if value not in left.columns else f"{value}_before"
    found = with_before(dealt, before, by).withColumn(name, F.coalesce(last, F.col("_before")))
    return found.where("_side = 1").select(*left.columns, name)
