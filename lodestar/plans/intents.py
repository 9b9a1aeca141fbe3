"""Windows that queries declare and validity that notes state, over texts written from the orders table."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.operators import temporal
from lodestar.registry import query, table

NOW = dt.datetime(2001, 6, 15, 12, 0)
_NOW = "TIMESTAMP '2001-06-15 12:00:00'"
#: A query for every order, in one of twelve forms, of its date, priority and numbers; the SQL builds it from the same parts.
_DATE = "substr(CAST(o_orderdate AS VARCHAR), 1, 10)"
_ASKED = f"""CASE o_orderkey % 12 WHEN 0 THEN 'what of ' || lower(o_orderpriority) || ' on ' || {_DATE} || ' ?' WHEN 1 THEN 'since:' || {_DATE} || ' orders' WHEN 2 THEN 'orders until:' || {_DATE} || 'T10:30Z now' WHEN 3 THEN 'SINCE:' || o_custkey % 400 || 'd until:2h'
  WHEN 4 THEN 'from ' || {_DATE} || 'T06:00:00.250+02:00 to 2001-02-31 or 2001-02-28' WHEN 5 THEN 'until:today ' || o_orderpriority WHEN 6 THEN 'x' || {_DATE} || '-5 none' WHEN 7 THEN 'since:2001-01-01 until:' || {_DATE}
  WHEN 8 THEN 'week since:' || o_custkey % 60 || 'W since:9d' WHEN 9 THEN 'a' || chr(10) || 'until:' || substr({_DATE}, 1, 7) || '-31' WHEN 10 THEN 'plain ' || o_orderpriority ELSE 'between ' || {_DATE} || 'T01:02+0130 and ' || {_DATE} END"""


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query, text) for every order."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("query"), F.expr(_ASKED.replace("VARCHAR", "STRING")).alias("text"))


@query(
    "temporal_intents",
    f"""WITH o AS (SELECT o_orderkey AS query, o_orderkey % 12 AS form, o_custkey AS c, CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) AS day, {_DATE} AS d FROM orders),
    ends AS (SELECT query, form, CASE form WHEN 0 THEN day WHEN 1 THEN day WHEN 3 THEN {_NOW} - to_days(CAST(c % 400 AS INT)) WHEN 4 THEN least(day + INTERVAL '4 hours 250 milliseconds', TIMESTAMP '2001-02-28') WHEN 7 THEN TIMESTAMP '2001-01-01'
        WHEN 8 THEN {_NOW} - to_days(CAST(7 * (c % 60) AS INT)) WHEN 11 THEN least(day, day - INTERVAL '28 minutes') END AS a,
      CASE form WHEN 0 THEN day + INTERVAL '1 day' - INTERVAL '1 millisecond' WHEN 2 THEN day + INTERVAL '10 hours 30 minutes' WHEN 3 THEN {_NOW} - INTERVAL '2 hours' WHEN 4 THEN greatest(day + INTERVAL '4 hours 250 milliseconds', TIMESTAMP '2001-02-28 23:59:59.999')
        WHEN 7 THEN day + INTERVAL '1 day' - INTERVAL '1 millisecond' WHEN 9 THEN TRY_CAST(substr(d, 1, 7) || '-31' AS TIMESTAMP) + INTERVAL '1 day' - INTERVAL '1 millisecond' WHEN 11 THEN day + INTERVAL '1 day' - INTERVAL '1 millisecond' END AS b FROM o),
    bad AS (SELECT *, form = 5 OR (form = 9 AND b IS NULL) OR (form IN (3, 7) AND a > b) AS rejected FROM ends WHERE form NOT IN (6, 10))
    SELECT query, CASE WHEN NOT rejected THEN epoch_ms(a) END AS since, CASE WHEN NOT rejected THEN epoch_ms(b) END AS until, rejected, NOT rejected AND coalesce(b < {_NOW} - INTERVAL '7 days', FALSE) AS historical,
      CASE WHEN NOT rejected AND b < {_NOW} - INTERVAL '7 days' THEN 0.5 ELSE 1.0 END AS damping FROM bad""",
)
def temporal_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The window of every query that declares one."""
    told = asked(spark, sf_dir).select("query", temporal.temporal_intent(F.col("text"), NOW).alias("w")).where("w IS NOT NULL")
    return told.select("query", "w.since", "w.until", "w.rejected", "w.historical", "w.damping")


@query(
    "directives_stripped",
    f"""WITH o AS (SELECT o_orderkey AS query, o_orderkey % 12 AS form, o_orderpriority AS p, {_ASKED} AS text FROM orders)
    SELECT query, CASE form WHEN 1 THEN 'orders' WHEN 2 THEN 'orders now' WHEN 3 THEN '' WHEN 5 THEN p WHEN 7 THEN '' WHEN 8 THEN 'week' WHEN 9 THEN 'a' ELSE text END AS residual FROM o""",
)
def directives_stripped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every query to look for."""
    return asked(spark, sf_dir).select("query", temporal.without_directives(F.col("text")).alias("residual"))


_STATED = f"""CASE o_orderkey % 7 WHEN 0 THEN 'valid ' || {_DATE} || '/2002-01-31 only' WHEN 1 THEN 'from ' || {_DATE} || ' for P' || (1 + o_custkey % 3) || 'Y' || o_custkey % 14 || 'M' WHEN 2 THEN 'P' || o_custkey % 5 || 'W' || o_custkey % 40 || 'D from now'
  WHEN 3 THEN 'on ' || {_DATE} || ' P and P1Y' WHEN 4 THEN 'on ' || {_DATE} WHEN 5 THEN 'XP1Y 12001-01-01' ELSE 'P1M ' || substr({_DATE}, 1, 8) || '31' END"""


@query(
    "stated_validity",
    f"""WITH o AS (SELECT o_orderkey AS note, o_orderkey % 7 AS form, o_custkey AS c, CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) AS day, TRY_CAST(substr({_DATE}, 1, 8) || '31' AS TIMESTAMP) AS last FROM orders),
    m AS (SELECT *, date_trunc('month', day) + to_years(CAST(1 + c % 3 AS INT)) AS y FROM o),
    v AS (SELECT note, form, CASE form WHEN 2 THEN CASE WHEN c % 5 > 0 OR c % 40 > 0 THEN {_NOW} END WHEN 6 THEN last ELSE day END AS a,
      CASE form WHEN 0 THEN TIMESTAMP '2002-01-31' WHEN 1 THEN date_trunc('month', y + (day - date_trunc('month', day))) + to_months(CAST(c % 14 AS INT)) + ((y + (day - date_trunc('month', day))) - date_trunc('month', y + (day - date_trunc('month', day))))
        WHEN 2 THEN CASE WHEN c % 5 > 0 OR c % 40 > 0 THEN {_NOW} + to_days(CAST(7 * (c % 5) + c % 40 AS INT)) END WHEN 6 THEN date_trunc('month', last) + INTERVAL '1 month' + (last - date_trunc('month', last)) END AS b FROM m WHERE form <> 5)
    SELECT note, a AS valid_from, b AS valid_until FROM v WHERE form <> 2 OR a IS NOT NULL""",
)
def stated_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The validity that a note on every order states, where it states one."""
    notes = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("note"), F.expr(_STATED.replace("VARCHAR", "STRING")).alias("text"))
    told = notes.select("note", temporal.validity(F.col("text"), NOW).alias("v")).where("v IS NOT NULL")
    return told.select("note", "v.valid_from", "v.valid_until")
