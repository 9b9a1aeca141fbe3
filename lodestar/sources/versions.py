"""Tables with versions: a new version is written whole and then named, so that a reader sees the old one or the new one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def current_version(spark: SparkSession, folder: str) -> int | None:
    """The version that readers see; None before the first."""
    try:
        return spark.read.parquet(f"{folder}/names").agg(F.max("version")).first()[0]
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def read_current(spark: SparkSession, folder: str) -> DataFrame | None:
    version = current_version(spark, folder)
    return None if version is None else spark.read.parquet(f"{folder}/v{version}")


def publish(rows: DataFrame, folder: str) -> int:
    """Writes rows as the next version, then names it; returns its number. A write that fails names nothing and can be run again.

    There is one writer at a time; versions stay until someone removes their folders, so a running reader is never cut off.
    """
    spark = rows.sparkSession
    version = (current_version(spark, folder) or 0) + 1
    rows.write.mode("overwrite").parquet(f"{folder}/v{version}")
    spark.range(1).select(F.lit(version).alias("version")).coalesce(1).write.mode("append").parquet(f"{folder}/names")
    return version


def replace_documents(held: DataFrame, changed: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """held with all rows of the documents `changed` (key) taken out and rows (of these documents) put in.

    A changed document without rows is deleted; rows of documents that aren't in `changed` are left out. Null keys never match.
    """
    named = changed.select(key).where(F.col(key).isNotNull()).distinct()
    return held.join(named, key, "left_anti").unionByName(rows.join(named, key, "left_semi").select(*held.columns))


def generation(documents: DataFrame, columns: Sequence[str]) -> str:
    """A stamp of all rows of a corpus by the given columns: equal for equal rows in any order, with repeats counted."""
    each = F.xxhash64(*columns).cast("decimal(38,0)")
    other = F.xxhash64(F.lit("again"), *columns).cast("decimal(38,0)")
    return documents.agg(F.sha2(F.concat_ws(":", F.count("*").cast("string"), F.coalesce(F.sum(each), F.lit(0)).cast("string"), F.coalesce(F.sum(other), F.lit(0)).cast("string")), 256)).first()[0]


def fresh(stamp: Column, at: Column, wanted: str, now: str, ttl_seconds: int) -> Column:
    """Whether a cached row is of the wanted generation and no older than its time to live; nothing from the future is."""
    moment = F.lit(now).cast("timestamp")
    return F.coalesce((stamp == wanted) & (at <= moment) & (at >= moment - F.make_dt_interval(secs=F.lit(ttl_seconds))), F.lit(False))


def probe(requests: DataFrame, cache: DataFrame, wanted: str, now: str, ttl_seconds: int) -> DataFrame:
    """requests (key) with the newest fresh cached row's `at` and `outcome`, null where none is, and `hit`.

    cache: (key, generation, at, outcome); of rows equally new the greatest outcome counts.
    """
    held = cache.where(fresh(F.col("generation"), F.col("at"), wanted, now, ttl_seconds))
    newest = held.groupBy("key").agg(F.max(F.struct("at", "outcome")).alias("c"))
    return requests.select("key").distinct().join(newest, "key", "left").select("key", F.col("c.at").alias("at"), F.col("c.outcome").alias("outcome"), F.col("c").isNotNull().alias("hit"))


def write_back(cache: DataFrame, outcomes: DataFrame, wanted: str, now: str, ttl_seconds: int) -> DataFrame:
    """cache without its stale rows and those of the keys that outcomes (key, outcome) has anew, and these, stamped."""
    kept = cache.where(fresh(F.col("generation"), F.col("at"), wanted, now, ttl_seconds)).join(outcomes.select("key").distinct(), "key", "left_anti")
    added = outcomes.groupBy("key").agg(F.max("outcome").alias("outcome")).select("key", F.lit(wanted).alias("generation"), F.lit(now).cast("timestamp").alias("at"), "outcome")
    return kept.select("key", "generation", "at", "outcome").unionByName(added)
