"""Sinks: keyed upserts, replaced partitions, appended logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def upsert(current: DataFrame, changes: DataFrame, key: str, order: str) -> DataFrame:
    """current with the last change (by `order`) of each key in place of its row; new keys are added.

    Of changes with one order the one whose row has the greatest hash counts, so the same changes give the same row each
    time. A null order is the least. A null key is added, never replaced.
    """
    tie = F.xxhash64(*[F.to_json(F.struct(*changes.columns))])
    last = Window.partitionBy(key).orderBy(F.desc(order), F.desc(tie), F.desc(F.to_json(F.struct(*changes.columns))))
    newest = changes.withColumn("__rn", F.row_number().over(last)).where("__rn = 1").drop("__rn")
    return current.join(newest.select(key), key, "left_anti").unionByName(newest)


def append_by_month(rows: DataFrame, ts: str, folder: str) -> None:
    """Appends rows as JSON lines, a folder a month."""
    rows.withColumn("month", F.date_format(ts, "yyyy-MM")).write.mode("append").partitionBy("month").json(folder)


def replace_partitions(rows: DataFrame, partition: str, folder: str) -> None:
    """Replaces the partitions that rows have, and leaves the others."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(folder)


def export_json(rows: DataFrame, key: str, folder: str) -> None:
    """Rows in the order of their key, as JSON lines."""
    rows.orderBy(key).write.mode("overwrite").json(folder)
