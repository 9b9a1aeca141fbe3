"""Structured Streaming: incremental index by content hash, idempotent ingest, windowed counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.registry import query
from lodestar.session import scratch

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def index_stream(stream: DataFrame, target: str, checkpoint: str) -> None:
    """Appends (path, hash, words) of files whose content hash the index lacks; one pass over what is there, then it ends.

    A batch that is run again after a failure finds its rows by hash, and so adds none twice.
    """

    def step(batch: DataFrame, number: int) -> None:
        rows = batch.select("path", F.sha2("content", 256).alias("hash"), F.size(F.split(F.trim(F.col("content").cast("string")), r"\s+")).alias("words")).dropDuplicates(["hash"])
        try:
            known = batch.sparkSession.read.parquet(target).select("hash")
        except Exception as e:  # the first batch finds no index
            if "PATH_NOT_FOUND" not in str(e):
                raise
            known = None
        (rows.join(known, "hash", "left_anti") if known is not None else rows).write.mode("append").parquet(target)

    stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def first_of_key(stream: DataFrame, key: str, ts: str, late: str = "1 day") -> DataFrame:
    """The first row of each key within the time that rows may be late."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def debounced(stream: DataFrame, key: str, ts: str, quiet: str, late: str = "0 seconds") -> DataFrame:
    """(key, since, last, changes, due) of every burst of changes of a key that has settled: none followed within `quiet`.

    A change that follows sooner puts the burst off; one exactly `quiet` later begins another. The stream's watermark is the
    clock: a burst comes out once, when the watermark passes last + quiet, and pending ones are kept in the state store, so
    a restart goes on where it stopped. Repeated changes count as changes; those later than `late` come too late.
    """
    marked = stream.withWatermark(ts, late)
    bursts = marked.groupBy(F.session_window(ts, quiet).alias("w"), F.col(key)).agg(F.min(ts).alias("since"), F.max(ts).alias("last"), F.count("*").alias("changes"))
    return bursts.select(key, "since", "last", "changes", F.col("w.end").alias("due"))


def hand_over(due: DataFrame, target: str, checkpoint: str) -> None:
    """Writes what is due, a folder a batch, until the stream's present end. A batch that is run again replaces its folder."""

    def step(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    due.writeStream.outputMode("append").foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


@query(
    "debounced_changes",
    """WITH e AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL '6 hours' THEN 0 ELSE 1 END AS fresh FROM events),
    b AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS burst FROM e)
    SELECT user_id, min(ts) AS since, max(ts) AS last, count(*) AS changes, max(ts) + INTERVAL '6 hours' AS due FROM b GROUP BY user_id, burst HAVING max(ts) + INTERVAL '6 hours' <= (SELECT max(ts) FROM events)""",
)
def debounced_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bursts of each user's events that six quiet hours have ended; those still open at the last event are pending."""
    source = spark.readStream.schema(EVENTS).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    rows = source.select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    target = scratch(spark, "debounced")
    hand_over(debounced(rows, "user_id", "ts", "6 hours"), target, scratch(spark, "debounced-state"))
    return spark.read.parquet(target).select("user_id", "since", "last", "changes", "due")


@query("stream_hourly", "SELECT date_trunc('hour', ts)::TIMESTAMP AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by hour and kind of the event stream, read to its end, with a watermark that bounds the state."""
    source = spark.readStream.schema(EVENTS).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    rows = source.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "40 days")
    hourly = rows.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    out = hourly.select(F.col("w.start").alias("hour"), "event_type", "n", "total")
    target = scratch(spark, "hourly")

    def step(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(target)

    out.writeStream.outputMode("complete").foreachBatch(step).option("checkpointLocation", scratch(spark, "hourly-state")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(target)
