"""Folds of event logs: usage, activation, claims, learning, telemetry."""

from __future__ import annotations

import functools
import math
import operator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.functions.scalars import clamp01, half_life, usage_decay, weibull_recency, wilson_lower
from lodestar.operators.blocks import block_pairs
from lodestar.operators.ranks import cumulative_counts, percentiles
from lodestar.registry import query, table
from lodestar.session import materialize

#: The clock of every fold: events end on 2024-01-30.
NOW = "2024-02-01 00:00:00"
_AGE = f"(epoch(TIMESTAMP '{NOW}') - epoch(ts)) / 86400.0"


def age_days(ts: Column) -> Column:
    return (F.unix_timestamp(F.lit(NOW).cast("timestamp")) - F.unix_micros(ts.cast("timestamp")) / 1e6) / 86400.0


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query(
    "activation",
    f"SELECT user_id, least(1.0, 0.1 * count(*)) AS strength, max(ts) AS last_access, round(least(1.0, 0.1 * count(*)) * pow(2.0, -min({_AGE}) / 60), 6) AS effective FROM events GROUP BY user_id",
)
def activation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strength (a tenth an access, at most 1), last access, and strength halved every 60 days since."""
    strength = F.least(F.lit(1.0), F.count("*") * 0.1)
    out = events(spark, sf_dir).groupBy("user_id").agg(strength.alias("strength"), F.max("ts").alias("last_access"))
    return out.withColumn("effective", F.round(half_life(F.col("strength"), age_days(F.col("last_access")), 60), 6))


@query(
    "co_access",
    """WITH b AS (SELECT DISTINCT CAST(ts AS DATE) AS day, event_type, user_id FROM events WHERE event_type = 'purchase'),
    p AS (SELECT a.user_id AS a, b.user_id AS b, count(*) AS n FROM b a JOIN b ON a.day = b.day AND a.user_id < b.user_id GROUP BY ALL)
    SELECT a, b, n, least(0.03, 0.005 * n) AS boost FROM p WHERE n >= 3""",
)
def co_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs that were accessed on the same day three times or more; the pair's boost is capped.

    A user's days are bits of words of 63, rarest day first. Users of fewer than three days are in no pair. Two users who share three days
    must share one that isn't among the last two of either; so pairs meet on these days and count on the first that they
    share. If those meetings are more than all pairs of users, as with few days, each pair meets once instead. Either way a
    pair is tested where it is made, and only the result leaves that place.
    """
    baskets = events(spark, sf_dir).where("event_type = 'purchase'").select(F.to_date("ts").alias("day"), "user_id").distinct()
    baskets = materialize(baskets.where("day IS NOT NULL AND user_id IS NOT NULL"), "co-access")
    sizes = baskets.groupBy("day").agg(F.count("*").alias("size"))
    order = materialize(sizes.select("day", (F.row_number().over(Window.orderBy("size", "day")) - 1).cast("long").alias("bit")), "co-access-days")  # one row a day
    words = [f"w{k}" for k in range(math.ceil(order.count() / 63))]
    bits = [F.expr(f"bit_or(CASE WHEN bit DIV 63 = {k} THEN shiftleft(1L, CAST(bit % 63 AS INT)) ELSE 0L END) AS w{k}") for k in range(len(words))]
    users = baskets.join(order, "day").groupBy(F.col("user_id").alias("id")).agg(F.sort_array(F.collect_list("bit")).alias("bits"), *bits).where(F.size("bits") >= 3)
    users = materialize(users, "co-access-users")
    by_day = users.select(F.explode(F.slice("bits", F.lit(1), F.size("bits") - 2)).alias("group"), "id", *words)
    days = materialize(by_day.groupBy("group").agg(F.count("*").alias("size")), "co-access-meetings")
    everyone = users.agg(F.lit(0).cast("long").alias("group"), F.count("*").alias("size"))
    if (days.agg(F.sum(F.col("size").cast("double") ** 2)).first()[0] or 0) < everyone.first()["size"] ** 2:
        shared = [F.expr(f"x_{w} & y_{w}") for w in words]
        before = [F.when(F.col("group") >= 63 * k + 63, shared[k]).when(F.col("group") >= 63 * k, shared[k].bitwiseAND(F.expr(f"shiftleft(1L, CAST(group - {63 * k} AS INT)) - 1"))).otherwise(0) == 0 for k in range(len(words))]
        pairs = block_pairs(by_day, days).where(functools.reduce(operator.and_, before, F.lit(True)))
    else:
        pairs = block_pairs(users.select(F.lit(0).cast("long").alias("group"), "id", *words), everyone)
    n = functools.reduce(operator.add, [F.expr(f"bit_count(x_{w} & y_{w})") for w in words], F.lit(0)).cast("long")
    return pairs.select("a", "b", n.alias("n")).where("n >= 3").withColumn("boost", F.least(F.lit(0.03), F.col("n") * 0.005))


@query("usage_decay", f"SELECT user_id, count(*) AS n, round(least(1.0, greatest(0.0, pow(0.5, greatest(min({_AGE}), 0.0) / 30) * (1 + 0.25 * ln(1 + count(*))))), 6) AS weight FROM events GROUP BY user_id")
def usage_decay_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight of a source by how often and how lately it was used."""
    out = events(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("n"), F.min(age_days(F.col("ts"))).alias("age"))
    return out.select("user_id", "n", F.round(usage_decay(F.col("n"), F.col("age")), 6).alias("weight"))


@query(
    "recency_weibull",
    f"WITH r AS (SELECT user_id, 0.05 * exp(-pow(greatest(min({_AGE}), 0.0) / 30, 0.8)) AS b FROM events WHERE event_type = 'purchase' GROUP BY user_id) SELECT user_id, round(CASE WHEN b < 0.0005 THEN 0.0 ELSE b END, 6) AS boost FROM r",
)
def recency(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = events(spark, sf_dir).where("event_type = 'purchase'").groupBy("user_id").agg(F.min(age_days(F.col("ts"))).alias("age"))
    return out.select("user_id", F.round(weibull_recency(F.col("age")), 6).alias("boost"))


@query(
    "reuse_rates",
    """SELECT user_id, count(*) FILTER (WHERE event_type = 'purchase') AS used, count(*) FILTER (WHERE event_type = 'view') AS ignored, count(*) FILTER (WHERE event_type = 'error') AS contradicted,
    round(least(1.0, greatest(0.0, (count(*) FILTER (WHERE event_type = 'purchase') - count(*) FILTER (WHERE event_type = 'error')) / count(*) FILTER (WHERE event_type IN ('purchase', 'view', 'error')))), 6) AS score
    FROM events WHERE event_type IN ('purchase', 'view', 'error') GROUP BY user_id""",
)
def reuse_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Used, ignored and contradicted by key, and their score."""
    kind = lambda k: F.count(F.when(F.col("event_type") == k, 1))
    out = events(spark, sf_dir).where(F.col("event_type").isin("purchase", "view", "error")).groupBy("user_id")
    out = out.agg(kind("purchase").alias("used"), kind("view").alias("ignored"), kind("error").alias("contradicted"), F.count("*").alias("n"))
    return out.withColumn("score", F.round(clamp01((F.col("used") - F.col("contradicted")) / F.col("n")), 6)).drop("n")


@query(
    "latency_percentiles",
    """SELECT event_type, count(*) AS n, round(min(value), 6) AS low, round(max(value), 6) AS high, round(avg(value), 1) AS mean,
    quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99 FROM events GROUP BY event_type""",
)
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest-rank percentiles of a measure by kind; no task holds the values of a kind."""
    rows = events(spark, sf_dir).select("event_type", "value")
    found = percentiles(cumulative_counts(rows, "event_type", "value"), "event_type", "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    sizes = rows.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.min("value"), 6).alias("low"), F.round(F.max("value"), 6).alias("high"), F.round(F.avg("value"), 1).alias("mean"))
    return sizes.join(found, "event_type", "left").select("event_type", "n", "low", "high", "mean", "p50", "p95", "p99")


@query(
    "demand_gaps",
    """WITH d AS (SELECT event_type AS terms, CAST(floor(value / 10) AS BIGINT) AS results, value, ts, user_id FROM events),
    g AS (SELECT terms, user_id, count(*) AS occurrences, sum(results) AS results, count(*) FILTER (WHERE results = 0) AS empty, avg(least(1.0, value / 100)) AS coverage, min(ts) AS first_seen, max(ts) AS last_seen FROM d GROUP BY ALL)
    SELECT terms, user_id, occurrences, results, empty, round(coverage, 6) AS coverage, first_seen, last_seen, round(occurrences * (1 - (coverage + (1 - empty / occurrences)) / 2), 6) AS demand FROM g WHERE occurrences >= 2""",
)
def demand_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is asked for again and again and how badly it is met: asks times what coverage and non-empty share lack."""
    d = events(spark, sf_dir).select(F.col("event_type").alias("terms"), "user_id", F.floor(F.col("value") / 10).cast("long").alias("r"), "value", "ts")
    g = d.groupBy("terms", "user_id").agg(
        F.count("*").alias("occurrences"), F.sum("r").alias("results"), F.count(F.when(F.col("r") == 0, 1)).alias("empty"), F.avg(F.least(F.lit(1.0), F.col("value") / 100)).alias("c"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen")
    )
    met = (F.col("c") + (1 - F.col("empty") / F.col("occurrences"))) / 2
    return g.where("occurrences >= 2").withColumn("demand", F.round(F.col("occurrences") * (1 - met), 6)).withColumn("coverage", F.round("c", 6)).drop("c")


@query(
    "unmet_recall",
    "SELECT event_type AS terms, count(*) AS n, count(DISTINCT user_id) AS askers FROM events WHERE value < 10 GROUP BY event_type",
)
def unmet_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    weak = events(spark, sf_dir).where("value < 10")
    return weak.groupBy(F.col("event_type").alias("terms")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("askers"))


@query(
    "telemetry_facets",
    """SELECT coalesce(event_type, 'all') AS mode, CASE WHEN GROUPING(CAST(ts AS DATE)) = 1 THEN 'all' ELSE strftime(CAST(ts AS DATE), '%Y-%m-%d') END AS day, count(*) AS n, count(*) FILTER (WHERE value < 1) AS empty_runs
    FROM events GROUP BY GROUPING SETS ((event_type), (event_type, CAST(ts AS DATE)), ())""",
)
def telemetry_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by kind, by kind and day, and in all, in one pass."""
    rows = events(spark, sf_dir).select("event_type", F.date_format("ts", "yyyy-MM-dd").alias("d"), "value")
    sets = rows.groupingSets([[F.col("event_type")], [F.col("event_type"), F.col("d")], []], F.col("event_type"), F.col("d"))
    out = sets.agg(F.count("*").alias("n"), F.count(F.when(F.col("value") < 1, 1)).alias("empty_runs"))
    return out.select(F.coalesce("event_type", F.lit("all")).alias("mode"), F.coalesce("d", F.lit("all")).alias("day"), "n", "empty_runs")


@query(
    "token_impact",
    "SELECT event_type, round(sum(value - 50), 4) AS net, round(sum(CASE WHEN value < 50 THEN 50 - value ELSE 0 END), 4) AS saved, round(sum(CASE WHEN value > 50 THEN value - 50 ELSE 0 END), 4) AS added FROM events GROUP BY event_type",
)
def token_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Net, saved and added, from signed differences."""
    delta = F.col("value") - 50
    return events(spark, sf_dir).groupBy("event_type").agg(F.round(F.sum(delta), 4).alias("net"), F.round(F.sum(F.greatest(-delta, F.lit(0.0))), 4).alias("saved"), F.round(F.sum(F.greatest(delta, F.lit(0.0))), 4).alias("added"))


@query(
    "cost_meter",
    """WITH t AS (SELECT count(*) FILTER (WHERE event_type IN ('purchase', 'signup')) AS writes, count(*) FILTER (WHERE event_type IN ('view', 'click')) AS reads FROM events)
    SELECT writes, reads, round(writes / nullif(reads, 0), 2) AS ratio, writes > reads AS write_heavy FROM t""",
)
def cost_meter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes to reads."""
    kinds = lambda *k: F.count(F.when(F.col("event_type").isin(*k), 1))
    out = events(spark, sf_dir).agg(kinds("purchase", "signup").alias("writes"), kinds("view", "click").alias("reads"))
    return out.select("writes", "reads", F.round(F.try_divide(F.col("writes"), F.nullif("reads", F.lit(0))), 2).alias("ratio"), (F.col("writes") > F.col("reads")).alias("write_heavy"))


@query(
    "trend_label",
    f"""WITH t AS (SELECT user_id, count(*) FILTER (WHERE {_AGE} <= 7) AS recent, count(*) FILTER (WHERE {_AGE} > 7 AND {_AGE} <= 21) AS prior, min({_AGE}) AS last_age, max({_AGE}) AS first_age FROM events GROUP BY user_id)
    SELECT user_id, recent, prior, CASE WHEN first_age <= 14 THEN 'new' WHEN last_age > 14 THEN 'stale' WHEN recent * 2 > prior THEN 'strengthening' WHEN recent * 2 < prior THEN 'weakening' ELSE 'stable' END AS trend FROM t""",
)
def trend_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compares the last week with the two before."""
    age = age_days(F.col("ts"))
    t = events(spark, sf_dir).groupBy("user_id").agg(F.count(F.when(age <= 7, 1)).alias("recent"), F.count(F.when((age > 7) & (age <= 21), 1)).alias("prior"), F.min(age).alias("l"), F.max(age).alias("f"))
    label = F.when(F.col("f") <= 14, "new").when(F.col("l") > 14, "stale").when(F.col("recent") * 2 > F.col("prior"), "strengthening").when(F.col("recent") * 2 < F.col("prior"), "weakening").otherwise("stable")
    return t.select("user_id", "recent", "prior", label.alias("trend"))


_CLAIMS = """claims AS (SELECT event_id, ts, user_id AS entity, event_type AS aspect, 'v' || CAST(floor(value / 25) AS BIGINT) AS value, CAST(event_id % 7 AS BIGINT) AS agent FROM events),
o AS (SELECT *, lag(value) OVER w AS before FROM claims WINDOW w AS (PARTITION BY entity, aspect ORDER BY ts, agent, value, event_id)),
r AS (SELECT *, sum(CASE WHEN before IS NULL OR before <> value THEN 1 ELSE 0 END) OVER (PARTITION BY entity, aspect ORDER BY ts, agent, value, event_id ROWS UNBOUNDED PRECEDING) AS run FROM o),
versions AS (SELECT entity, aspect, run, any_value(value) AS value, min(ts) AS since, max(ts) AS until, count(*) AS mentions, count(DISTINCT agent) AS sources, min(agent) AS a0 FROM r GROUP BY entity, aspect, run),"""


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select(
        "event_id", "ts", F.col("user_id").alias("entity"), F.col("event_type").alias("aspect"), F.concat(F.lit("v"), F.floor(F.col("value") / 25).cast("long").cast("string")).alias("value"), (F.col("event_id") % 7).alias("agent")
    )


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of equal values of a slot (entity, aspect) in the order (ts, agent, value)."""
    order = Window.partitionBy("entity", "aspect").orderBy("ts", "agent", "value", "event_id")
    before = F.lag("value").over(order)
    marked = claims(spark, sf_dir).withColumn("new", F.when(before.isNull() | (before != F.col("value")), 1).otherwise(0))
    runs = marked.withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("entity", "aspect", "run").agg(F.first("value").alias("value"), F.min("ts").alias("since"), F.max("ts").alias("until"), F.count("*").alias("mentions"), F.countDistinct("agent").alias("sources"), F.min("agent").alias("a0"))


@query(
    "truth_fold",
    f"WITH {_CLAIMS} n AS (SELECT *, row_number() OVER (PARTITION BY entity, aspect ORDER BY run DESC) AS age FROM versions) SELECT entity, aspect, value, since, until, mentions, sources, CAST(age - 1 AS BIGINT) AS version_age FROM n WHERE age <= 20",
)
def truth_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The current value of each slot (version_age 0) and its history, newest first, at most twenty."""
    newest = Window.partitionBy("entity", "aspect").orderBy(F.desc("run"))
    out = versions(spark, sf_dir).withColumn("age", F.row_number().over(newest)).where("age <= 20")
    return out.select("entity", "aspect", "value", "since", "until", "mentions", "sources", (F.col("age") - 1).cast("long").alias("version_age"))


@query(
    "truth_conflicts",
    f"""WITH {_CLAIMS} n AS (SELECT *, max(run) OVER (PARTITION BY entity, aspect) AS last FROM versions),
    c AS (SELECT * FROM n WHERE run = last), h AS (SELECT * FROM n WHERE run < last)
    SELECT c.entity, c.aspect, c.value, count(*) AS rivals FROM c JOIN h ON c.entity = h.entity AND c.aspect = h.aspect AND h.value <> c.value AND h.a0 <> c.a0 AND epoch(c.since) - epoch(h.until) <= 30 * 86400 GROUP BY ALL""",
)
def truth_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slots whose current value has a rival of another source within thirty days."""
    v = versions(spark, sf_dir).withColumn("last", F.max("run").over(Window.partitionBy("entity", "aspect")))
    now = v.where("run = last").select("entity", "aspect", "value", "since", "a0")
    then = v.where("run < last").select("entity", "aspect", F.col("value").alias("hv"), "until", F.col("a0").alias("ha"))
    close = F.unix_micros("since") / 1e6 - F.unix_micros("until") / 1e6 <= 30 * 86400
    return now.join(then, ["entity", "aspect"]).where((F.col("hv") != F.col("value")) & (F.col("ha") != F.col("a0")) & close).groupBy("entity", "aspect", "value").agg(F.count("*").alias("rivals"))


@query(
    "grounding",
    f"""WITH {_CLAIMS} cur AS (SELECT entity, aspect, arg_max(value, run) AS value FROM versions GROUP BY ALL),
    m AS (SELECT c.entity, c.aspect, agent, count(*) FILTER (WHERE claims.value = c.value) AS yes, count(*) FILTER (WHERE claims.value <> c.value) AS no FROM cur c JOIN claims USING (entity, aspect) GROUP BY ALL),
    s AS (SELECT entity, aspect, sum(CASE WHEN yes > 0 THEN 1 + 0.5 * (1 - 1.0 / yes) ELSE 0 END) AS support, sum(CASE WHEN no > 0 THEN 1 + 0.5 * (1 - 1.0 / no) ELSE 0 END) AS against FROM m GROUP BY ALL)
    SELECT entity, aspect, round((support - against) / (support + against) * least(1.0, (support + against) / 2), 6) AS score FROM s""",
)
def grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balance of sources for and against the current value; a source that repeats itself counts at most half again."""
    c = claims(spark, sf_dir)
    current = versions(spark, sf_dir).groupBy("entity", "aspect").agg(F.max_by("value", "run").alias("current"))
    by_source = c.join(current, ["entity", "aspect"]).groupBy("entity", "aspect", "agent").agg(F.count(F.when(F.col("value") == F.col("current"), 1)).alias("yes"), F.count(F.when(F.col("value") != F.col("current"), 1)).alias("no"))
    weight = lambda n: F.when(F.col(n) > 0, 1 + 0.5 * (1 - 1.0 / F.greatest(F.col(n), F.lit(1)))).otherwise(0.0)
    s = by_source.groupBy("entity", "aspect").agg(F.sum(weight("yes")).alias("s"), F.sum(weight("no")).alias("a"))
    total = F.col("s") + F.col("a")
    return s.select("entity", "aspect", F.round((F.col("s") - F.col("a")) / total * F.least(F.lit(1.0), total / 2), 6).alias("score"))


@query(
    "agent_collisions",
    """WITH w AS (SELECT l_partkey AS entity, count(DISTINCT l_suppkey) AS agents, count(DISTINCT l_orderkey) AS sources, max(l_shipdate) AS last FROM lineitem GROUP BY l_partkey)
    SELECT entity, agents, sources, last FROM w WHERE agents >= 2 AND sources >= 2 ORDER BY last DESC, entity LIMIT 20""",
)
def agent_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities that several agents claim from several sources; the twenty newest."""
    out = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("entity")).agg(F.countDistinct("l_suppkey").alias("agents"), F.countDistinct("l_orderkey").alias("sources"), F.max("l_shipdate").alias("last"))
    return out.where("agents >= 2 AND sources >= 2").orderBy(F.desc("last"), "entity").limit(20)


@query(
    "quantity_sum",
    "SELECT l_linestatus AS action, l_returnflag AS unit, round(sum(l_quantity), 4) AS total, count(*) AS n FROM lineitem GROUP BY ALL",
)
def quantity_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums by the exact (action, unit)."""
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_linestatus").alias("action"), F.col("l_returnflag").alias("unit")).agg(F.round(F.sum("l_quantity"), 4).alias("total"), F.count("*").alias("n"))


@query(
    "topic_fold",
    """WITH s AS (SELECT lang AS topic, source AS scope, count(*) FILTER (WHERE quality = 1) AS pos, count(*) FILTER (WHERE quality = 0) AS neg FROM documents JOIN labels USING (doc_id) GROUP BY ALL)
    SELECT topic, scope, pos, neg, CASE WHEN pos >= neg THEN 'positive' ELSE 'negative' END AS dominant, CASE WHEN greatest(pos, neg) - least(pos, neg) >= 3 THEN 'promote' WHEN pos > 0 AND neg > 0 THEN 'cancelled' ELSE 'wait' END AS outcome FROM s""",
)
def topic_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signed signals by topic and scope: a majority of three or more makes a rule."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("topic"), F.col("source").alias("scope"))
    s = d.join(table(spark, sf_dir, "labels"), "doc_id").groupBy("topic", "scope").agg(F.count(F.when(F.col("quality") == 1, 1)).alias("pos"), F.count(F.when(F.col("quality") == 0, 1)).alias("neg"))
    margin = F.abs(F.col("pos") - F.col("neg"))
    return s.withColumn("dominant", F.when(F.col("pos") >= F.col("neg"), "positive").otherwise("negative")).withColumn(
        "outcome", F.when(margin >= 3, "promote").when((F.col("pos") > 0) & (F.col("neg") > 0), "cancelled").otherwise("wait")
    )


_WILSON = "greatest(0.0, (applied / n + 3.8416 / (2 * n) - 1.96 * sqrt((applied / n * (1 - applied / n) + 3.8416 / (4 * n)) / n)) / (1 + 3.8416 / n))"


@query(
    "wilson_confidence",
    f"""WITH s AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE quality = 1) AS applied FROM documents JOIN labels USING (doc_id) GROUP BY source),
    w AS (SELECT source, applied, n - applied AS violated, round({_WILSON}, 4) AS confidence FROM s)
    SELECT *, CASE WHEN confidence >= 0.75 THEN 'high' WHEN confidence >= 0.4 THEN 'medium' ELSE 'low' END AS band FROM w""",
)
def wilson_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lower bound of the share of good evidence, and its band."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id")
    s = d.groupBy("source").agg(F.count(F.when(F.col("quality") == 1, 1)).alias("applied"), F.count(F.when(F.coalesce("quality", F.lit(0)) != 1, 1)).alias("violated"))
    c = s.withColumn("confidence", F.round(wilson_lower(F.col("applied"), F.col("violated")), 4))
    return c.withColumn("band", F.when(F.col("confidence") >= 0.75, "high").when(F.col("confidence") >= 0.4, "medium").otherwise("low"))


@query(
    "vitals_entropy",
    "WITH c AS (SELECT source, count(*) AS n FROM documents GROUP BY source), p AS (SELECT n / sum(n) OVER () AS p, count(*) OVER () AS k FROM c) SELECT round(sum(-p * log2(p)) / nullif(log2(max(k)), 0), 2) AS entropy, max(k) AS scopes FROM p",
)
def vitals_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How evenly documents spread over sources: 1 for perfectly."""
    counts = table(spark, sf_dir, "documents").groupBy("source").count()
    total = counts.agg(F.sum("count").alias("all"), F.count("*").alias("k"))
    p = F.col("count") / F.col("all")
    return counts.crossJoin(F.broadcast(total)).agg(F.round(F.sum(-p * F.log2(p)) / F.nullif(F.log2(F.max("k")), F.lit(0.0)), 2).alias("entropy"), F.max("k").alias("scopes"))


@query(
    "learned_weights",
    """WITH e AS (SELECT event_id, CASE WHEN event_type IN ('purchase', 'signup') THEN 1 ELSE -1 END AS sign, value AS k, abs(100 - value) AS s, CAST(user_id AS DOUBLE) AS t FROM events WHERE event_type <> 'view'),
    n AS (SELECT sign, k / (k + s + t) AS k, s / (k + s + t) AS s, t / (k + s + t) AS t FROM e WHERE k + s + t > 0)
    SELECT round(least(1.2, greatest(0.8, 1 + 0.5 * avg(sign * k))), 6) AS keyword, round(least(1.2, greatest(0.8, 1 + 0.5 * avg(sign * s))), 6) AS semantic, round(least(1.2, greatest(0.8, 1 + 0.5 * avg(sign * t))), 6) AS entity FROM n""",
)
def learned_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of three signals from signed feedback: each event's contributions as shares, their signed mean, clamped."""
    sign = F.when(F.col("event_type").isin("purchase", "signup"), 1).otherwise(-1)
    parts = {"keyword": F.col("value"), "semantic": F.abs(100 - F.col("value")), "entity": F.col("user_id").cast("double")}
    total = parts["keyword"] + parts["semantic"] + parts["entity"]
    rows = events(spark, sf_dir).where((F.col("event_type") != "view") & (total > 0))
    return rows.agg(*[F.round(F.least(F.lit(1.2), F.greatest(F.lit(0.8), 1 + 0.5 * F.avg(sign * p / total))), 6).alias(n) for n, p in parts.items()])


@query(
    "reinforce_strength",
    "SELECT user_id, least(1.0, count(DISTINCT event_id) / 5.0) AS strength FROM events WHERE event_type = 'signup' GROUP BY user_id",
)
def reinforce_strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct reinforcements by key, saturating at five."""
    return events(spark, sf_dir).where("event_type = 'signup'").groupBy("user_id").agg(F.least(F.lit(1.0), F.countDistinct("event_id") / 5.0).alias("strength"))


@query(
    "lessons",
    f"""WITH e AS (SELECT user_id, event_type IN ('purchase', 'signup') AS good, pow(0.5, greatest({_AGE}, 0) / 30) AS mass, event_id FROM events),
    s AS (SELECT user_id, sum(mass) FILTER (WHERE good) AS up, sum(mass) FILTER (WHERE NOT good) AS down, count(DISTINCT event_id) FILTER (WHERE good) AS artifacts FROM e GROUP BY user_id)
    SELECT user_id, round(coalesce(up, 0), 6) AS up, round(coalesce(down, 0), 6) AS down, artifacts FROM s ORDER BY round(greatest(coalesce(up, 0), coalesce(down, 0)), 6) DESC, user_id LIMIT 25""",
)
def lessons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decayed evidence for and against, the 25 keys of the greatest mass."""
    good, mass = F.col("event_type").isin("purchase", "signup"), F.pow(F.lit(0.5), F.greatest(age_days(F.col("ts")), F.lit(0.0)) / 30)
    s = events(spark, sf_dir).groupBy("user_id").agg(F.round(F.sum(F.when(good, mass).otherwise(0.0)), 6).alias("up"), F.round(F.sum(F.when(~good, mass).otherwise(0.0)), 6).alias("down"), F.countDistinct(F.when(good, F.col("event_id"))).alias("artifacts"))
    return s.orderBy(F.desc(F.greatest("up", "down")), "user_id").limit(25)


@query(
    "most_applied",
    f"SELECT user_id, count(*) AS applied FROM events WHERE event_type = 'purchase' AND {_AGE} <= 14 GROUP BY user_id ORDER BY applied DESC, user_id LIMIT 10",
)
def most_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten keys applied most in the last fortnight."""
    recent = events(spark, sf_dir).where((F.col("event_type") == "purchase") & (age_days(F.col("ts")) <= 14))
    return recent.groupBy("user_id").agg(F.count("*").alias("applied")).orderBy(F.desc("applied"), "user_id").limit(10)


@query(
    "recurrence_cadence",
    "SELECT user_id, count(*) AS n, CASE WHEN count(*) < 2 THEN NULL ELSE round((epoch(max(ts)) - epoch(min(ts))) / 86400.0 / (count(*) - 1), 1) END AS mean_days FROM events WHERE event_type = 'signup' GROUP BY user_id",
)
def recurrence_cadence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean days between supports."""
    span = (F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / 1e6 / 86400.0
    out = events(spark, sf_dir).where("event_type = 'signup'").groupBy("user_id").agg(F.count("*").alias("n"), span.alias("span"))
    return out.select("user_id", "n", F.when(F.col("n") >= 2, F.round(F.col("span") / F.greatest(F.col("n") - 1, F.lit(1)), 1)).alias("mean_days"))


@query(
    "idempotency_ledger",
    """WITH k AS (SELECT user_id || ':' || strftime(ts, '%Y-%m-%d') || ':' || event_type AS key, md5(CAST(floor(value / 50) AS BIGINT)::VARCHAR) AS hash, ts, event_id FROM events),
    f AS (SELECT *, first_value(hash) OVER (PARTITION BY key ORDER BY ts, event_id) AS first, row_number() OVER (PARTITION BY key ORDER BY ts, event_id) AS rn FROM k)
    SELECT CASE WHEN rn = 1 THEN 'stored' WHEN hash = first THEN 'duplicate_match' ELSE 'payload_mismatch' END AS outcome, count(*) AS n FROM f GROUP BY 1""",
)
def idempotency_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First payload of a key wins; later ones match it or not."""
    key = F.concat_ws(":", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd"), "event_type")
    rows = events(spark, sf_dir).select(key.alias("key"), F.md5(F.floor(F.col("value") / 50).cast("long").cast("string").cast("binary")).alias("hash"), "ts", "event_id")
    order = Window.partitionBy("key").orderBy("ts", "event_id")
    told = rows.withColumn("first", F.first("hash").over(order)).withColumn("rn", F.row_number().over(order))
    outcome = F.when(F.col("rn") == 1, "stored").when(F.col("hash") == F.col("first"), "duplicate_match").otherwise("payload_mismatch")
    return told.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


@query(
    "recent_turns",
    "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn <= 3",
)
def recent_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three newest turns of each session."""
    newest = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return table(spark, sf_dir, "conversations").withColumn("rn", F.row_number().over(newest)).where("rn <= 3").select("conv_id", "turn", "role")


@query(
    "evidence_newest",
    """SELECT user_id, class, event_id FROM (SELECT user_id, CASE WHEN event_type IN ('purchase', 'signup') THEN 'applied' ELSE 'violated' END AS class, event_id,
    row_number() OVER (PARTITION BY user_id, event_type IN ('purchase', 'signup') ORDER BY ts DESC, event_id) AS rn FROM events) WHERE rn <= CASE class WHEN 'applied' THEN 5 ELSE 3 END""",
)
def evidence_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By key, the newest five pieces of evidence for and the newest three against."""
    kind = F.when(F.col("event_type").isin("purchase", "signup"), "applied").otherwise("violated")
    newest = Window.partitionBy("user_id", "class").orderBy(F.desc("ts"), "event_id")
    return events(spark, sf_dir).withColumn("class", kind).withColumn("rn", F.row_number().over(newest)).where(F.col("rn") <= F.when(F.col("class") == "applied", 5).otherwise(3)).select("user_id", "class", "event_id")


@query(
    "retention_sweep",
    f"SELECT count(*) AS kept FROM (SELECT row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS rn, {_AGE} AS age FROM events) WHERE rn <= 40 AND age <= 21",
)
def retention_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that an age limit and a newest-40 cap by key keep."""
    newest = Window.partitionBy("user_id").orderBy(F.desc("ts"), "event_id")
    return events(spark, sf_dir).withColumn("rn", F.row_number().over(newest)).where((F.col("rn") <= 40) & (age_days(F.col("ts")) <= 21)).agg(F.count("*").alias("kept"))


@query(
    "signal_signs",
    "SELECT source, sum(CASE WHEN quality = 1 THEN 1 ELSE 0 END)::BIGINT AS pos, sum(CASE WHEN quality = 0 THEN 1 ELSE 0 END)::BIGINT AS neg FROM documents JOIN labels USING (doc_id) GROUP BY source",
)
def signal_signs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id")
    return d.groupBy("source").agg(F.count(F.when(F.col("quality") == 1, 1)).alias("pos"), F.count(F.when(F.col("quality") == 0, 1)).alias("neg"))
