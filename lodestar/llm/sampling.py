"""Held-out rows, and bounded samples to fit classifiers on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(key: Column) -> Column:
    """Whether crc32 of the key as text leaves 1 when divided by 3; a null key is not held out."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def stratified(rows: DataFrame, label: str, key: str, most: int, labels: int = 200) -> DataFrame:
    """About `most` rows of each of the most frequent labels, or all where there are fewer; a row stays by a hash of its key.

    At most labels * most * 1.25 rows, whatever the size of the table; the same rows each time.
    """
    counts = rows.where(F.col(label).isNotNull()).groupBy(label).count().orderBy(F.desc("count"), label).limit(labels).collect()
    if not counts:
        return rows.limit(0)
    share = F.create_map(*[x for r in counts for x in (F.lit(r[0]), F.lit(min(1.0, most / r[1])))])
    place = (F.pmod(F.xxhash64(F.lit("sample"), F.col(key)), F.lit(1 << 40)) / F.lit(float(1 << 40))).cast("double")
    return rows.where(place < share[F.col(label)]).limit(int(len(counts) * most * 1.25))
