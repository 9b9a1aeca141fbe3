"""All pairs of the rows of a group, dealt out by pairs of blocks, so that no task meets a whole group."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a block; most partitions that pairs of blocks are dealt to.
BLOCK, MOST_PARTITIONS = 2000, 2000


def block_pairs(rows: DataFrame, groups: DataFrame, block: int = BLOCK) -> DataFrame:
    """(group, a, b, x_..., y_...): every two ids a < b of rows (group, id, ...) of one group, once, with the other columns of both.

    Which of x and y belongs to a is left open, so these are for conditions that hold either way. groups: (group, size), the
    number of rows of a group. A group is dealt into blocks of about `block` rows by a hash of the id, and each two blocks
    (and a block with itself) meet in one place, so a row is sent once a block of its group. Nothing is written: conditions
    that follow are tested where the pairs are made.
    """
    sized = groups.select("group", F.ceil(F.col("size") / block).cast("long").alias("blocks"))
    places = sized.agg(F.sum(F.col("blocks") * (F.col("blocks") + 1) / 2)).first()[0] or 0
    parts = min(MOST_PARTITIONS, max(1, math.ceil(places)))
    dealt = rows.join(sized, "group").withColumn("at", F.pmod(F.xxhash64("id"), "blocks"))
    side = lambda s, place, other, others: dealt.select("group", F.col("at").alias(place), F.explode(others).alias(other), *[F.col(c).alias(f"{s}_{c}") for c in rows.columns if c != "group"]).repartition(parts, "group", "i", "j")
    met = side("x", "i", "j", F.sequence("at", F.col("blocks") - 1)).join(side("y", "j", "i", F.sequence(F.lit(0).cast("long"), "at")), ["group", "i", "j"])
    met = met.where("(i < j AND x_id <> y_id) OR x_id < y_id")
    return met.select("group", F.least("x_id", "y_id").alias("a"), F.greatest("x_id", "y_id").alias("b"), *[f"{s}_{c}" for s in "xy" for c in rows.columns if c not in ("group", "id")])
