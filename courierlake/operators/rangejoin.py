"""Joins on ranges of two large tables, by bins and an equality join.

A range goes to the bins it touches on a level of its own: bins of level n are
2**n wide, and a range's level is the least at which it touches two bins at
most. A point goes to its bin on every level that ranges use, at most 64. A point
in a range shares exactly one bin with it, so no pair is found twice and none
has to be made distinct; the exact condition is tested on pairs of one bin.
Whatever the lengths of ranges, a range is at most two rows and no row meets all
others. Bins are hash-joined from plain tables, so that a hot one (a day with a
third of all rows) is split by the adaptive planner.

Where pairs are only counted, points and ranges with the same ends and groups are
one row with a number each before they meet (paired_counts). Pairs of days then grow
with the calendar and not with the product of the tables.

Two ranges overlap if the start of one lies in the other: the starts of the
left in ranges of the right, and the starts of the right in ranges of the left
that begin before it, are all pairs once each.

Defined results: ends are included; nulls and ranges that end before they start
meet nothing; equal rows are joined each; empty tables give no pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEVELS = 64


def level_of(low: Column, high: Column) -> Column:
    """The least n with at most one multiple of 2**n in (low, high]: two bins at most."""
    # as many bits as the length has; one level less would still do where a bin's edge is near, which only costs rows
    length = high - low
    return F.when(length <= 0, 0).otherwise(F.length(F.bin(length))).cast("int")


def with_bins(ranges: DataFrame, low: str, high: str) -> DataFrame:
    """Rows of ranges with level and bin, once for each bin touched."""
    known = ranges.where(F.col(low).isNotNull() & F.col(high).isNotNull() & (F.col(low) <= F.col(high))).withColumn("_level", level_of(F.col(low), F.col(high)))
    first, last = F.expr(f"shiftright(`{low}`, _level)"), F.expr(f"shiftright(`{high}`, _level)")
    return known.withColumn("_bin", F.explode(F.sequence(first, last)))


def points_in_ranges(points: DataFrame, ranges: DataFrame, at: str, low: str, high: str, after_start: bool = False) -> DataFrame:
    """Each row of points with each row of ranges that `low` <= `at` <= `high` holds for (whole numbers; columns must differ).

    after_start: without points at the start of the range.
    """
    dealt = with_bins(ranges, low, high)
    levels = sorted(r["_level"] for r in dealt.select("_level").distinct().collect())  # at most LEVELS
    if not levels:
        return points.join(dealt.drop("_level", "_bin"), F.lit(False))
    placed = points.where(F.col(at).isNotNull()).withColumn("_level", F.explode(F.array(*map(F.lit, levels))))
    placed = placed.withColumn("_bin", F.expr(f"shiftright(`{at}`, _level)"))
    inside = (F.col(at) > F.col(low) if after_start else F.col(at) >= F.col(low)) & (F.col(at) <= F.col(high))
    # merged at every size: a side that fits a broadcast today may not tomorrow, and a merge can be split
    return placed.hint("merge").join(dealt, ["_level", "_bin"]).where(inside).drop("_level", "_bin")


def overlaps(left: DataFrame, right: DataFrame, left_ends: tuple[str, str], right_ends: tuple[str, str]) -> DataFrame:
    """Each row of left with each row of right whose range it overlaps."""
    (a, z), (b, y) = left_ends, right_ends
    sound_left, sound_right = left.where(F.col(a) <= F.col(z)), right.where(F.col(b) <= F.col(y))
    one = points_in_ranges(sound_left, sound_right, a, b, y)
    two = points_in_ranges(sound_right, sound_left, b, a, z, after_start=True)
    return one.unionByName(two.select(*one.columns))


def paired_counts(points: DataFrame, ranges: DataFrame, at: str, low: str, high: str, point_group: str, range_group: str) -> DataFrame:
    """How many pairs points_in_ranges() has for each group of points and of ranges: the two columns and pairs."""
    # ends that hold nothing first, as null keys and empty ranges would be groups too
    ones = points.where(F.col(at).isNotNull()).groupBy(at, point_group).agg(F.count("*").alias("_points"))
    some = ranges.where(F.col(low) <= F.col(high)).groupBy(low, high, range_group).agg(F.count("*").alias("_ranges"))
    return points_in_ranges(ones, some, at, low, high).groupBy(point_group, range_group).agg(F.sum(F.col("_points") * F.col("_ranges")).alias("pairs"))


def overlap_counts(left: DataFrame, right: DataFrame, left_ends: tuple[str, str], right_ends: tuple[str, str], key: str, value: str) -> DataFrame:
    """For each key of left with a pair of overlaps(): key, its pairs, and the least value of right in them."""
    ends = [*left_ends]
    ones = right.where(F.col(right_ends[0]) <= F.col(right_ends[1])).groupBy(*right_ends).agg(F.count("*").alias("_rows"), F.min(value).alias("_least"))
    met = overlaps(left.select(*ends).distinct(), ones, left_ends, right_ends).groupBy(*ends).agg(F.sum("_rows").alias("_rows"), F.min("_least").alias("_least"))
    return left.join(met, ends).groupBy(key).agg(F.sum("_rows").alias("pairs"), F.min("_least").alias("least"))
