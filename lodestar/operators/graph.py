"""Graphs of edges as joins: reachability, label propagation, pointer chasing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.session import materialize


def undirected(edges: DataFrame) -> DataFrame:
    """Distinct (u, v) in both directions, without self-loops."""
    both = edges.where("u <> v").select("u", "v").unionByName(edges.where("u <> v").select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.distinct()


def fan_out(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(seed, node, hop): nodes within `depth` steps of each seed with their first depth; a seed reaches itself at 0."""
    reached = seeds.select("seed", F.col("seed").alias("node"), F.lit(0).alias("hop"))
    frontier = reached
    for hop in range(1, depth + 1):
        step = frontier.join(edges, frontier["node"] == edges["u"]).select("seed", F.col("v").alias("node")).distinct().withColumn("hop", F.lit(hop))
        frontier = step.join(reached.select("seed", "node"), ["seed", "node"], "left_anti")
        reached = reached.unionByName(frontier)
    return reached


def propagate_labels(edges: DataFrame, rounds: int) -> DataFrame:
    """(node, label) after rounds of synchronous label propagation: the most frequent label of the neighbours, the least on ties.

    A node's own label has no vote. Each round is written to the shared folder.
    """
    both = materialize(undirected(edges), "label-edges")
    labels = both.select(F.col("u").alias("node"), F.col("u").alias("label")).distinct()
    best = Window.partitionBy("node").orderBy(F.desc("n"), "label")
    for _ in range(rounds):
        votes = both.join(labels.withColumnRenamed("node", "v"), "v").groupBy(F.col("u").alias("node"), "label").agg(F.count("*").alias("n"))
        labels = materialize(votes.withColumn("rn", F.row_number().over(best)).where("rn = 1").select("node", "label"), "labels")
    return labels


def chain_tips(links: DataFrame, rounds: int | None = None) -> DataFrame:
    """(node, tip, hops) for links (node, next): follows next by doubling, until every tip is a node without a link.

    A node without a link is its own tip. A cycle has no tip and raises ValueError. With `rounds`, 2^rounds steps at most.
    Each round is written to the shared folder; a chain of n links takes about log2(n) rounds.
    """
    nodes = links.select("node").union(links.select("next")).distinct()
    jump = nodes.join(links, "node", "left").select("node", F.coalesce("next", "node").alias("tip"), F.when(F.col("next").isNull(), 0).otherwise(1).cast("long").alias("hops"))
    jump = materialize(jump, "chain")
    total, done = jump.count(), 0
    while rounds is None or done < rounds:
        further = jump.select(F.col("node").alias("tip"), F.col("tip").alias("t2"), F.col("hops").alias("h2"))
        jump = materialize(jump.join(further, "tip").select("node", F.col("t2").alias("tip"), (F.col("hops") + F.col("h2")).alias("hops"), (F.col("h2") > 0).alias("moved")), "chain")
        done += 1
        if jump.where("moved").limit(1).count() == 0:
            break
        if rounds is None and 2 ** (done - 1) > total:
            raise ValueError("the links form a cycle")
    return jump.select("node", "tip", "hops")
