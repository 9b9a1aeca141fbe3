"""Claims that replace and contest each other: what is true at an instant, what replaced a claim, what contests it."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.operators.components import connect
from lodestar.operators.graph import chain_tips
from lodestar.operators.predicates import valid_at
from lodestar.session import materialize


def claim_key(link: Column) -> Column:
    """The id that a link names: without double brackets, alias, folders and .md; null if nothing is left."""
    bare = F.trim(F.regexp_replace(F.trim(link), r"^\[\[([^\]]+)\]\]$", "$1"))
    leaf = F.regexp_extract(F.trim(F.regexp_extract(bare, r"^([^|]*)", 1)), r"([^/\\]*)$", 1)
    return F.nullif(F.regexp_replace(leaf, r"(?i)\.md$", ""), F.lit(""))


def true_at(claims: DataFrame, instant: str) -> DataFrame:
    """The claims (valid_from, valid_until, tombstoned) that hold at an instant: begun, not ended, and no tombstone."""
    return claims.where(valid_at(F.col("valid_from"), F.col("valid_until"), instant) & ~F.coalesce("tombstoned", F.lit(False)))


def replaced_by(claims: DataFrame) -> DataFrame:
    """(id, tip, steps, cycle, resolved) of every claim (id, superseded_by): the end of its chain of successors.

    A chain ends at a claim without a successor; at a successor that is no claim, which is then the tip and unresolved; or,
    on a cycle, at the last claim before one that the walk has met. Claims follow their successors by doubling, about
    log2(n) rounds; what hasn't ended by then runs into a cycle, whose claims are those that such walks end on. An id with
    several rows follows the least successor. Each round is written to the shared folder.
    """
    own = claims.where("id IS NOT NULL").groupBy("id").agg(F.min("superseded_by").alias("next"))
    own = materialize(own, "claims")
    links = own.where("next IS NOT NULL").select(F.col("id").alias("node"), "next")
    known = own.select(F.col("id").alias("tip"), F.lit(True).alias("there"), F.col("next").isNotNull().alias("on"))
    rounds = math.ceil(math.log2(own.count() + 2)) + 1
    ended = materialize(chain_tips(links, rounds).join(known, "tip", "left").select("node", "tip", "hops", F.coalesce("there", F.lit(False)).alias("resolved"), F.coalesce("on", F.lit(False)).alias("on")), "claim-chains")
    straight = ended.where("NOT on").select(F.col("node").alias("id"), "tip", F.col("hops").alias("steps"), F.lit(False).alias("cycle"), "resolved")
    endless = ended.where("on")
    ring = materialize(endless.select(F.col("tip").alias("node")).distinct().join(links, "node"), "claim-rings")  # every claim on a cycle, and its successor
    parts = connect(ring.select(F.col("node").alias("u"), F.col("next").alias("v")))
    sizes = parts.groupBy("root").agg(F.count("*").alias("size"))
    of = ring.join(parts.withColumnRenamed("u", "node"), "node", "left").join(sizes, "root", "left").select(F.col("next").alias("entry"), F.col("node").alias("last"), F.coalesce("size", F.lit(1)).alias("size"))
    tails = endless.select("node").join(links, "node").join(ring.select("node"), "node", "left_anti")
    ways = chain_tips(tails, rounds).where("hops > 0").select(F.col("node").alias("id"), F.col("tip").alias("entry"), "hops") if tails.limit(1).count() else tails.select(F.col("node").alias("id"), F.col("next").alias("entry"), F.lit(0).cast("long").alias("hops"))
    into = ways.unionByName(ring.select(F.col("node").alias("id"), F.col("node").alias("entry"), F.lit(0).cast("long").alias("hops")))
    round_ = into.join(of, "entry").select("id", F.col("last").alias("tip"), (F.col("hops") + F.col("size") - 1).alias("steps"), F.lit(True).alias("cycle"), F.lit(True).alias("resolved"))
    alone = own.where("next IS NULL").select("id", F.col("id").alias("tip"), F.lit(0).cast("long").alias("steps"), F.lit(False).alias("cycle"), F.lit(True).alias("resolved"))
    return straight.join(own.where("next IS NOT NULL").select("id"), "id", "left_semi").unionByName(round_).unionByName(alone)


def contested_by(claims: DataFrame) -> DataFrame:
    """(id, other): pairs of claims (id, contradicts array<string>) of which either declares that it contradicts the other, both ways."""
    said = claims.where("id IS NOT NULL").select("id", F.explode("contradicts").alias("other")).where("other IS NOT NULL AND id <> other")
    both = said.unionByName(said.select(F.col("other").alias("id"), F.col("id").alias("other"))).distinct()
    there = claims.select("id").where("id IS NOT NULL").distinct()
    return both.join(there, "id", "left_semi").join(there.withColumnRenamed("id", "other"), "other", "left_semi").select("id", "other")
