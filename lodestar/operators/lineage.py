"""Lineage of derived items: all sources behind an item, whatever the number of parents, and cycles where there shouldn't be any."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.session import materialize

MOST_DEPTH = 8


def trace(parents: DataFrame, starts: DataFrame, most_depth: int = MOST_DEPTH) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, summary) behind each of starts (start), over parents (child, parent, relation, pos).

    nodes: (start, node, depth), each with its least depth, the start itself at 0. edges: (start, child, parent, relation)
    out of every node above the last depth, the first relation by pos where an item names a parent twice. summary: (start,
    nodes, edges, depth, truncated), truncated if a node at the last depth has a parent that isn't there. Steps stop when no
    start has new nodes, so a cycle ends as any other graph does. Self-references and null ends are no edges. Only new
    nodes are joined with the edges at each step; every step is written to the shared folder.
    """
    own = parents.where("child IS NOT NULL AND parent IS NOT NULL AND child <> parent")
    own = materialize(own.groupBy("child", "parent").agg(F.min_by("relation", F.struct("pos", "relation")).alias("relation")), "lineage-edges")
    front = materialize(starts.select("start").distinct().select("start", F.col("start").alias("node")), "lineage")
    nodes, edges, depth = front.withColumn("depth", F.lit(0).cast("long")), None, 0
    while depth < most_depth:
        depth += 1
        step = materialize(front.join(own, F.col("node") == F.col("child")).select("start", "child", "parent", "relation"), "lineage")
        edges = step if edges is None else edges.unionByName(step)
        new = step.select("start", F.col("parent").alias("node")).distinct().join(nodes.select("start", "node"), ["start", "node"], "left_anti")
        front = materialize(new, "lineage")
        if not front.limit(1).count():
            break
        nodes = nodes.unionByName(front.withColumn("depth", F.lit(depth).cast("long")))
    edges = front.select("start", F.col("node").alias("child"), F.col("node").alias("parent"), F.lit("").alias("relation")).limit(0) if edges is None else edges
    beyond = front.join(own, F.col("node") == F.col("child")).select("start", F.col("parent").alias("node")).distinct().join(nodes.select("start", "node"), ["start", "node"], "left_anti")
    cut = beyond.select("start").distinct().withColumn("cut", F.lit(True))
    counts = nodes.groupBy("start").agg(F.count("*").alias("nodes"), F.max("depth").alias("depth")).join(edges.groupBy("start").agg(F.count("*").alias("edges")), "start", "left").join(cut, "start", "left")
    summary = counts.select("start", "nodes", F.coalesce("edges", F.lit(0)).cast("long").alias("edges"), "depth", F.coalesce("cut", F.lit(False)).alias("truncated"))
    return nodes, edges, summary


def origins(nodes: DataFrame, parents: DataFrame) -> DataFrame:
    """The rows of a trace's nodes that have no parent: where a lineage begins."""
    named = parents.where("parent IS NOT NULL AND child <> parent").select(F.col("child").alias("node")).distinct()
    return nodes.join(named, "node", "left_anti").select("start", "node", "depth")


def cyclic_core(parents: DataFrame) -> DataFrame:
    """(node) of every node on a cycle or between two: what is left when nodes without a parent or without a child are taken
    away, again and again. Empty for a sound lineage. Each round is written to the shared folder."""
    rest = materialize(parents.where("child IS NOT NULL AND parent IS NOT NULL").select("child", "parent").distinct(), "core")
    left = rest.count()
    while left:
        has_child, has_parent = rest.select(F.col("parent").alias("child")).distinct(), rest.select(F.col("child").alias("parent")).distinct()
        rest = materialize(rest.join(has_child, "child", "left_semi").join(has_parent, "parent", "left_semi"), "core")
        before, left = left, rest.count()
        if left == before:
            break
    return rest.select(F.col("child").alias("node")).union(rest.select("parent")).distinct()
