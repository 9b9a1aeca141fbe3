"""Claims of the orders table: each order claims something about its customer until a later one replaces it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.operators import claims
from lodestar.registry import query, table

_CLAIMS = """ordered AS (SELECT *, lead(o_orderkey) OVER w AS later, lag(o_orderkey) OVER w AS earlier, lag(o_orderpriority) OVER w AS before, first_value(o_orderkey) OVER w AS first FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
    claims AS (SELECT 'o' || o_orderkey AS id, o_custkey AS topic, CASE WHEN o_orderstatus = 'F' AND later IS NOT NULL THEN 'o' || later WHEN o_orderstatus = 'P' AND later IS NOT NULL THEN 'gone' || later WHEN later IS NULL AND o_custkey % 3 = 0 AND first <> o_orderkey THEN 'o' || first END AS next,
      CASE WHEN before <> o_orderpriority THEN ['o' || earlier, 'o' || first] END AS contradicts, o_orderdate AS valid_from, CASE WHEN o_orderstatus = 'O' THEN o_orderdate + INTERVAL '400 days' END AS valid_until, o_totalprice < 20000 AS tombstoned FROM ordered)"""


def order_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, topic, superseded_by, contradicts, valid_from, valid_until, tombstoned); links are written as notes write them."""
    line = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    rows = table(spark, sf_dir, "orders").withColumns({"later": F.lead("o_orderkey").over(line), "earlier": F.lag("o_orderkey").over(line), "before": F.lag("o_orderpriority").over(line), "first": F.first("o_orderkey").over(line)})
    link = "CASE WHEN o_orderstatus = 'F' AND later IS NOT NULL THEN '[[orders/o' || later || '.md|next]]' WHEN o_orderstatus = 'P' AND later IS NOT NULL THEN 'gone' || later WHEN later IS NULL AND o_custkey % 3 = 0 AND first <> o_orderkey THEN ' o' || first || '.MD ' END"
    return rows.select(
        F.expr("'o' || o_orderkey").alias("id"), F.col("o_custkey").alias("topic"), claims.claim_key(F.expr(link)).alias("superseded_by"),
        F.expr("CASE WHEN before <> o_orderpriority THEN array('o' || earlier, 'o' || first) END").alias("contradicts"), F.col("o_orderdate").cast("timestamp").alias("valid_from"),
        F.expr("CASE WHEN o_orderstatus = 'O' THEN CAST(o_orderdate AS timestamp) + INTERVAL 400 DAYS END").alias("valid_until"), (F.col("o_totalprice") < 20000).alias("tombstoned"),
    )


@query("claims_at", f"WITH {_CLAIMS} SELECT topic, count(*) AS n, min(id) AS least FROM claims WHERE valid_from <= TIMESTAMP '1998-03-01' AND (valid_until IS NULL OR valid_until > TIMESTAMP '1998-03-01') AND NOT tombstoned GROUP BY topic")
def claims_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many claims on each customer hold at an instant."""
    return claims.true_at(order_claims(spark, sf_dir), "1998-03-01").groupBy("topic").agg(F.count("*").alias("n"), F.min("id").alias("least"))


@query(
    "claim_successors",
    f"""WITH RECURSIVE {_CLAIMS}, walk AS (SELECT id, id AS at_, [id] AS seen, FALSE AS ended, FALSE AS cycle, TRUE AS resolved FROM claims
      UNION ALL SELECT w.id, CASE WHEN c.id IS NULL OR c.next IS NULL OR list_contains(seen, c.next) THEN at_ ELSE c.next END, CASE WHEN c.next IS NULL OR list_contains(seen, c.next) THEN seen ELSE list_append(seen, c.next) END,
        c.id IS NULL OR c.next IS NULL OR list_contains(seen, c.next), coalesce(list_contains(seen, c.next), FALSE), c.id IS NOT NULL FROM walk w LEFT JOIN claims c ON c.id = w.at_ WHERE NOT ended)
    SELECT id, at_ AS tip, len(seen) - 1 AS steps, cycle, resolved FROM walk WHERE ended""",
)
def claim_successors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What replaced every claim in the end, with cycles and links to nothing."""
    return claims.replaced_by(order_claims(spark, sf_dir)).select("id", "tip", "steps", "cycle", "resolved")


@query("claim_contests", f"WITH {_CLAIMS}, s AS (SELECT id, unnest(contradicts) AS other FROM claims), b AS (SELECT id, other FROM s UNION SELECT other, id FROM s) SELECT id, other FROM b WHERE id <> other AND other IN (SELECT id FROM claims)")
def claim_contests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What contests every claim, whichever side declared it."""
    return claims.contested_by(order_claims(spark, sf_dir))
