"""Connected components of a graph of edges, as joins and groupings."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.session import materialize

#: Rounds at most; edges that one task unites at once.
ROUNDS, EDGES = 60, 16_384


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _stars(pairs: DataFrame) -> DataFrame:
    return pairs.select("u", F.col("v").alias("root")).unionByName(pairs.select(F.col("v").alias("u"), F.col("v").alias("root")).distinct())


def _unite(edges: int):
    """(u, v) with v the least node that u is tied to by the edges at hand, so many at once; those of u = v are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict = {}

        def find(x):
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = x = parent.setdefault(up, up)
            return x

        def told(schema: pa.Schema) -> pa.RecordBatch:
            tied = [(x, root) for x in list(parent) if (root := find(x)) != x]
            return pa.RecordBatch.from_arrays([pa.array([t[k] for t in tied], schema.field(k).type) for k in (0, 1)], ["u", "v"])

        seen = 0
        for batch in batches:
            for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = find(u), find(v)
                if a != b:
                    parent[max(a, b)] = min(a, b)
            seen += batch.num_rows
            if seen >= edges:
                yield told(batch.schema)
                parent.clear()
                seen = 0
            schema = batch.schema
        if parent:
            yield told(schema)

    return run


def thinned(edges: DataFrame, at_once: int = 16 * EDGES) -> DataFrame:
    """Edges (u, v) that tie the same nodes together: each task keeps a star for each part of every `at_once` edges it reads.

    For dense graphs whose edges are written by places: these shrink before anything is shuffled.
    """
    pairs = edges.where("u <> v").select("u", "v")
    return pairs.mapInArrow(_unite(at_once), pairs.schema)


def connect(edges: DataFrame, at_once: int = EDGES) -> DataFrame:
    """(u, root) for every node of edges (u, v), which are numbers or strings: root is the least node of its component.

    First each task unites the edges that it holds, `at_once` of them, and tells a star for each part; if that were all
    edges, it is done. If not, every round ties the neighbours of a node that are larger than it to the least of them (large
    star), then those that are smaller (small star), until nothing changes or the edges left are few enough for that; each
    round is written to the shared folder, so a lost executor costs one round. The number of rounds grows with the logarithm
    of the longest path. Nothing is collected but a checksum, and no task holds more than `at_once` edges and a batch.
    """
    pairs = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    pairs = materialize(pairs, "components")
    before = _state(pairs)
    for k in range(ROUNDS):
        few = before[0] <= at_once
        if few or k == 0:
            pairs = materialize(pairs.coalesce(max(1, math.ceil(before[0] / at_once))).mapInArrow(_unite(math.inf if few else at_once), pairs.schema), "components")
        if few:
            return _stars(pairs)
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u")
        ties = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        pairs = materialize(lowest.select("u", F.col("m").alias("v")).unionByName(ties).where("u <> v").distinct(), "components")
        now = _state(pairs)
        if now == before:
            return _stars(pairs)
        before = now
    raise RuntimeError("the components did not settle")
