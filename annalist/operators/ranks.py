"""Ranks and running sums over whole tables without a task that sees all rows.

Rows are dealt by ranges of their order and sorted in each range, which is written once. The sums of the ranges, one row
for each, are added up on the driver; a row's place is its range's start and its own place in the range.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from annalist.storage import written

_PLACE_BITS = 33  # of monotonically_increasing_id: the place in a partition, below the partition's number


def _ranges(df: DataFrame, order: list[Column]) -> DataFrame:
    """``df`` written in ranges of ``order``, with each row's range and its place in it, from 0."""
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    placed = dealt.withColumn("_id", F.monotonically_increasing_id())
    return written(placed, "ranges").select("*", F.shiftright("_id", _PLACE_BITS).alias("_range"), F.col("_id").bitwiseAND((1 << _PLACE_BITS) - 1).alias("_place")).drop("_id")


def _with_starts(placed: DataFrame, value: Column) -> DataFrame:
    """``placed`` with ``_start``: the sum of ``value`` over all earlier ranges. The driver holds one row for each range."""
    sums = sorted((r[0], r[1] or 0) for r in placed.groupBy("_range").agg(F.sum(value)).collect())
    starts = [(r, int(s)) for (r, _), s in zip(sums, accumulate((v for _, v in sums), initial=0))]
    table = placed.sparkSession.createDataFrame(starts, "_range long, _start long")
    return placed.join(F.broadcast(table), "_range")


def global_rank(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """``df`` with the place of each row in ``order``, from 1; rows that are equal in it have places of their own."""
    placed = _with_starts(_ranges(df, order), F.lit(1))
    return placed.withColumn(name, F.col("_start") + F.col("_place") + 1).drop("_range", "_start", "_place")


def group_rank(df: DataFrame, by: str, order: list[Column], name: str = "rank") -> DataFrame:
    """``df`` with the place of each row among those with its value of ``by``, from 1, however many they are; a null is a value."""
    ranked = global_rank(df, [F.asc_nulls_first(by), *order], "_rank")
    first = ranked.groupBy(F.col(by).alias("_by")).agg(F.min("_rank").alias("_first"))
    return ranked.join(first, F.col(by).eqNullSafe(F.col("_by"))).withColumn(name, F.col("_rank") - F.col("_first") + 1).drop("_by", "_first", "_rank")


def running_sum(df: DataFrame, order: list[Column], value: str, name: str = "sum") -> DataFrame:
    """``df`` with the sum of ``value`` (whole numbers, a null counts as 0) over all rows up to this one in ``order``."""
    amount = F.coalesce(F.col(value), F.lit(0)).cast("long")
    placed = _with_starts(_ranges(df, order), amount)
    own = F.sum(amount).over(W.partitionBy("_range").orderBy("_place").rowsBetween(W.unboundedPreceding, 0))
    return placed.withColumn(name, F.col("_start") + own).drop("_range", "_start", "_place")
