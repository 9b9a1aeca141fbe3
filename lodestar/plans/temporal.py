"""Time: sessions, bursts, period rollups, timelines, cadences."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.functions.scalars import proximity
from lodestar.plans.folds import events
from lodestar.registry import query, table

_GAP = 6 * 3600
_SESSIONS = f"""o AS (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events),
s AS (SELECT *, sum(CASE WHEN before IS NULL OR epoch(ts) - epoch(before) > {_GAP} THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS phase FROM o),"""


@query("sessions_gap", f"WITH {_SESSIONS} x AS (SELECT 1) SELECT user_id, CAST(phase AS BIGINT) AS phase, min(ts) AS since, max(ts) AS until, count(*) AS n FROM s GROUP BY ALL")
def sessions_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phases of a key's events: a new one after a gap of over six hours."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = (F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(order))) / 1e6
    marked = events(spark, sf_dir).withColumn("new", F.when(gap.isNull() | (gap > _GAP), 1).otherwise(0))
    phased = marked.withColumn("phase", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return phased.groupBy("user_id", "phase").agg(F.min("ts").alias("since"), F.max("ts").alias("until"), F.count("*").alias("n"))


@query(
    "bursts",
    """WITH RECURSIVE e AS (SELECT user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
    b AS (SELECT user_id, rn AS first, ts AS since, (SELECT max(rn) FROM e x WHERE x.user_id = e.user_id AND epoch(x.ts) - epoch(e.ts) <= 7200) AS last FROM e),
    g AS (SELECT user_id, first, last, since FROM b WHERE first = 1 UNION ALL SELECT b.user_id, b.first, b.last, b.since FROM g JOIN b ON b.user_id = g.user_id AND b.first = g.last + 1)
    SELECT user_id, since, CAST(last - first + 1 AS BIGINT) AS n FROM g WHERE last - first + 1 >= 3""",
)
def bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy bursts: events within two hours of a burst's first one; the next burst starts after it. Three events or more.

    The greedy walk depends on order, so each key's times are walked once in their sorted stream; a task holds one batch.
    """
    rows = events(spark, sf_dir).select("user_id", F.unix_micros("ts").alias("us"), "event_id")
    sorted_rows = rows.repartition("user_id").sortWithinPartitions("user_id", "us", "event_id")

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        user, first, n = None, 0, 0
        for frame in frames:
            out = []
            for u, us in zip(frame["user_id"], frame["us"], strict=True):
                if u != user or us - first > 7_200_000_000:
                    if n >= 3:
                        out.append((user, first, n))
                    user, first, n = u, us, 0
                n += 1
            yield pd.DataFrame(out, columns=["user_id", "us", "n"]).astype("int64")
        if n >= 3:
            yield pd.DataFrame([(user, first, n)], columns=["user_id", "us", "n"]).astype("int64")

    found = sorted_rows.mapInPandas(walk, "user_id long, us long, n long")
    return found.select("user_id", F.timestamp_micros("us").alias("since"), "n")


@query(
    "daily_brief",
    "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, count(DISTINCT user_id) AS users, round(sum(value), 4) AS total FROM events GROUP BY ALL",
)
def daily_brief(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.round(F.sum("value"), 4).alias("total"))


@query(
    "weekly_synthesis",
    """SELECT event_type, count(*) AS n, count(*) FILTER (WHERE event_type = 'signup' AND value > 50) AS promotions, count(*) FILTER (WHERE event_type = 'error') AS retirements FROM events
    WHERE ts >= TIMESTAMP '2024-01-21' AND ts < TIMESTAMP '2024-01-28' GROUP BY event_type""",
)
def weekly_synthesis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seven days before a week's end, the end itself left out."""
    week = events(spark, sf_dir).where("ts >= TIMESTAMP '2024-01-21' AND ts < TIMESTAMP '2024-01-28'")
    return week.groupBy("event_type").agg(F.count("*").alias("n"), F.count(F.when((F.col("event_type") == "signup") & (F.col("value") > 50), 1)).alias("promotions"), F.count(F.when(F.col("event_type") == "error", 1)).alias("retirements"))


@query("monthly_review", "SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS month, o_orderstatus AS status, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ALL")
def monthly_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(F.date_trunc("month", "o_orderdate").cast("timestamp").alias("month"), F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("activity_timeline", "SELECT event_id, event_type, ts FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20' AND event_type IN ('purchase', 'signup') ORDER BY ts DESC, event_id LIMIT 50")
def activity_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Since is inclusive, until is not; the fifty newest."""
    rows = events(spark, sf_dir).where("ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20' AND event_type IN ('purchase', 'signup')")
    return rows.select("event_id", "event_type", "ts").orderBy(F.desc("ts"), "event_id").limit(50)


@query(
    "vault_delta",
    """SELECT count(*) FILTER (WHERE event_type = 'signup') AS promotions, count(*) FILTER (WHERE event_type = 'error') AS retirements, count(*) FILTER (WHERE event_type = 'click') AS feedback,
    count(*) FILTER (WHERE event_type = 'purchase' AND value >= 50) AS applied, count(*) FILTER (WHERE event_type = 'purchase' AND value < 50) AS violated FROM events WHERE ts >= TIMESTAMP '2024-01-15'""",
)
def vault_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    when = lambda c: F.count(F.when(F.expr(c), 1))
    return events(spark, sf_dir).where("ts >= TIMESTAMP '2024-01-15'").agg(
        when("event_type = 'signup'").alias("promotions"), when("event_type = 'error'").alias("retirements"), when("event_type = 'click'").alias("feedback"), when("event_type = 'purchase' AND value >= 50").alias("applied"), when("event_type = 'purchase' AND value < 50").alias("violated")
    )


@query(
    "belief_evolution",
    """WITH d AS (SELECT user_id, ts, event_id, CASE WHEN value >= 75 THEN 'confirmed' WHEN value >= 25 THEN 'tentative' ELSE 'retired' END AS status FROM events WHERE event_type = 'signup'),
    c AS (SELECT *, lag(status) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM d) SELECT user_id, ts, before, status FROM c WHERE before IS DISTINCT FROM status""",
)
def belief_evolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of status by key."""
    status = F.when(F.col("value") >= 75, "confirmed").when(F.col("value") >= 25, "tentative").otherwise("retired")
    d = events(spark, sf_dir).where("event_type = 'signup'").select("user_id", "ts", "event_id", status.alias("status"))
    c = d.withColumn("before", F.lag("status").over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    return c.where(~F.col("before").eqNullSafe(F.col("status"))).select("user_id", "ts", "before", "status")


@query("stale_watch", "SELECT user_id, CAST(floor((epoch(TIMESTAMP '2024-02-01') - epoch(max(ts))) / 86400) AS BIGINT) AS age_days FROM events WHERE event_type = 'purchase' GROUP BY user_id HAVING age_days >= 3")
def stale_watch(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = events(spark, sf_dir).where("event_type = 'purchase'").groupBy("user_id").agg(F.max("ts").alias("last"))
    age = F.floor((F.unix_timestamp(F.lit("2024-02-01").cast("timestamp")) - F.unix_micros("last") / 1e6) / 86400)
    return last.select("user_id", age.cast("long").alias("age_days")).where("age_days >= 3")


@query(
    "obligations",
    "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) + INTERVAL 3 MONTH AS DATE) AS due, date_diff('day', DATE '1998-01-01', CAST(CAST(o_orderdate AS DATE) + INTERVAL 3 MONTH AS DATE)) AS days, CAST(CAST(o_orderdate AS DATE) + INTERVAL 3 MONTH AS DATE) < DATE '1998-01-01' AS overdue FROM orders WHERE o_orderstatus = 'O'",
)
def obligations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Due dates three calendar months on, days until due, and whether overdue at the clock."""
    due = F.add_months(F.to_date("o_orderdate"), 3)
    clock = F.lit("1998-01-01").cast("date")
    return table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select("o_orderkey", due.alias("due"), F.datediff(due, clock).cast("long").alias("days"), (due < clock).alias("overdue"))


@query(
    "temporal_proximity",
    "SELECT event_id, round(greatest(0.0, 1 - greatest(epoch(TIMESTAMP '2024-01-10') - epoch(ts), epoch(ts) - epoch(TIMESTAMP '2024-01-12'), 0) / 86400.0 / 8), 6) AS proximity FROM events WHERE event_type = 'purchase'",
)
def temporal_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """1 inside a window, falling to 0 over the week after or before."""
    at = F.unix_micros("ts") / 1e6
    lo, hi = F.lit(1704844800), F.lit(1705017600)
    return events(spark, sf_dir).where("event_type = 'purchase'").select("event_id", F.round(proximity(at, lo, hi), 6).alias("proximity"))


@query(
    "relative_age",
    """WITH a AS (SELECT event_id, epoch(TIMESTAMP '2024-02-01') - epoch(ts) AS s FROM events)
    SELECT event_id, CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN CAST(floor(s / 60) AS BIGINT) || 'm' WHEN s < 86400 THEN CAST(floor(s / 3600) AS BIGINT) || 'h' WHEN s < 604800 THEN CAST(floor(s / 86400) AS BIGINT) || 'd' ELSE CAST(floor(s / 604800) AS BIGINT) || 'w' END AS age FROM a""",
)
def relative_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.unix_timestamp(F.lit("2024-02-01").cast("timestamp")) - F.unix_micros("ts") / 1e6
    part = lambda n, unit: F.concat(F.floor(s / n).cast("long").cast("string"), F.lit(unit))
    age = F.when(s < 60, "just now").when(s < 3600, part(60, "m")).when(s < 86400, part(3600, "h")).when(s < 604800, part(86400, "d")).otherwise(part(604800, "w"))
    return events(spark, sf_dir).select("event_id", age.alias("age"))


@query("daily_window", "SELECT event_id FROM events WHERE hour(ts) >= 22 OR hour(ts) < 6")
def daily_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours from 22 to 6, past midnight; the end is left out."""
    return events(spark, sf_dir).where((F.hour("ts") >= 22) | (F.hour("ts") < 6)).select("event_id")


@query(
    "agenda_conflicts",
    """WITH m AS (SELECT o_custkey AS who, o_orderkey AS id, o_orderdate AS since, o_orderdate + INTERVAL 20 DAY AS until FROM orders)
    SELECT who, id, CAST(meets AS BIGINT) AS meets FROM (SELECT who, id, (SELECT count(*) FROM m b WHERE b.who = a.who AND b.id <> a.id AND b.since < a.until AND a.since < b.until) AS meets FROM m a) WHERE meets > 0""",
)
def agenda_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many other spans of the same owner each span meets: starts before its end, less ends by its start, less itself.

    Two running counts over the owner's sorted bounds give that without pairing spans.
    """
    spans = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("who"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("timestamp").alias("since"))
    spans = spans.withColumn("until", F.expr("since + INTERVAL 20 DAYS"))
    order = Window.partitionBy("who").orderBy("at")
    bound = lambda c, s, e, own: spans.select("who", "id", F.col(c).alias("at"), F.lit(s).alias("s"), F.lit(e).alias("e"), F.lit(own).alias("own"))
    bounds = bound("since", 1, 0, "since").unionByName(bound("until", 0, 1, "until"))
    begun = F.coalesce(F.sum("s").over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow)) - F.sum("s").over(Window.partitionBy("who", "at")), F.lit(0))  # starts before `at`
    ended = F.sum("e").over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow))  # ends by `at`
    told = bounds.withColumn("begun", begun).withColumn("ended", ended)
    each = told.groupBy("who", "id").agg(F.max(F.when(F.col("own") == "until", F.col("begun"))).alias("begun"), F.max(F.when(F.col("own") == "since", F.col("ended"))).alias("ended"))
    return each.select("who", "id", (F.col("begun") - F.col("ended") - 1).alias("meets")).where("meets > 0")


@query(
    "chain_verify",
    """WITH c AS (SELECT event_id, user_id, sha256(user_id || ':' || event_id) AS hash, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS prev FROM events)
    SELECT user_id, count(*) AS n, count(*) FILTER (WHERE prev IS NOT NULL AND event_id - prev > 400) AS gaps, min(hash) AS least FROM c GROUP BY user_id""",
)
def chain_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ledger by key in sequence order: rows, gaps in the sequence, and a hash."""
    order = Window.partitionBy("user_id").orderBy("event_id")
    hashed = F.sha2(F.concat_ws(":", F.col("user_id").cast("string"), F.col("event_id").cast("string")), 256)
    c = events(spark, sf_dir).select("user_id", "event_id", hashed.alias("hash"), F.lag("event_id").over(order).alias("prev"))
    return c.groupBy("user_id").agg(F.count("*").alias("n"), F.count(F.when(F.col("event_id") - F.col("prev") > 400, 1)).alias("gaps"), F.min("hash").alias("least"))


@query(
    "rollup_ladder",
    "WITH n AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id) SELECT user_id, n, n // 20 AS fact_rollups, (n // 20) // 5 AS identity_rollups, n % 20 AS pending FROM n",
)
def rollup_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each rung fires: twenty rows make a fact, five facts an identity."""
    n = events(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("n"))
    return n.select("user_id", "n", F.floor(F.col("n") / 20).cast("long").alias("fact_rollups"), F.floor(F.floor(F.col("n") / 20) / 5).cast("long").alias("identity_rollups"), (F.col("n") % 20).alias("pending"))


@query(
    "event_correlation",
    """WITH p AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), e AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'error')
    SELECT p.event_id AS event_id, arg_max(e.event_id, (e.ts, e.event_id)) AS error_id FROM p JOIN e ON e.user_id = p.user_id AND e.ts <= p.ts GROUP BY p.event_id""",
)
def event_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As-of: the last error of the same key before each purchase, by one running maximum, without a join."""
    e = events(spark, sf_dir).where("event_type IN ('purchase', 'error')")
    order = Window.partitionBy("user_id").orderBy("ts").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.max(F.when(F.col("event_type") == "error", F.struct("ts", "event_id"))).over(order)
    return e.withColumn("error_id", last["event_id"]).where("event_type = 'purchase' AND error_id IS NOT NULL").select("event_id", "error_id")
