"""Ranks and percentiles within few large groups, without a task that holds a group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.session import materialize


def cumulative_counts(rows: DataFrame, group: str, value: str) -> DataFrame:
    """(group, value, n, before): for each distinct value of a group its number of rows and that of rows with lesser values.

    Values are counted before they are shuffled, then dealt by ranges of (group, value); a range's counts are summed within
    it, and the sums of the ranges before it (a row a range and group) are added. Null values are in no group.
    """
    counted = rows.where(F.col(value).isNotNull()).groupBy(F.col(group).alias("g"), F.col(value).alias("v")).agg(F.count("*").alias("n"))
    dealt = materialize(counted.repartitionByRange("g", "v").withColumn("part", F.spark_partition_id()), "ranks")
    sums = dealt.groupBy("g", "part").agg(F.sum("n").alias("there"))
    line = Window.partitionBy("g").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(F.col("g").alias("og"), F.col("part").alias("op"), F.coalesce(F.sum("there").over(line), F.lit(0)).alias("offset"))
    within = Window.partitionBy("g", "part").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    run = dealt.withColumn("own", F.coalesce(F.sum("n").over(within), F.lit(0)))
    placed = run.join(offsets, F.col("g").eqNullSafe(F.col("og")) & (F.col("part") == F.col("op")))
    return placed.select(F.col("g").alias(group), F.col("v").alias(value), "n", (F.col("own") + F.col("offset")).alias("before"))


def percentiles(counts: DataFrame, group: str, value: str, shares: dict[str, float]) -> DataFrame:
    """(group, <name>...): the value at the nearest rank, ceil(share * n), of each group of cumulative_counts."""
    total = counts.groupBy(F.col(group).alias("tg")).agg(F.sum("n").alias("total"))
    placed = counts.join(total, F.col(group).eqNullSafe(F.col("tg")))
    at = lambda share: F.greatest(F.lit(1), F.ceil(F.lit(share) * F.col("total")))
    here = lambda share: F.max(F.when((F.col("before") < at(share)) & (at(share) <= F.col("before") + F.col("n")), F.col(value)))
    return placed.groupBy(group).agg(*[here(s).alias(n) for n, s in shares.items()])
