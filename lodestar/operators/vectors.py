"""Exact searches for near vectors, by blocks of probes and blocks of vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.operators.lexical import top

#: Probes and vectors that one task holds; small tables are cut into SPREAD blocks of vectors.
PROBES, VECTORS, SPREAD, SMALL = 4096, 5000, 8, 250


def _compared(k: int | None, least: float | None):
    """The pairs of one block: each probe's k best vectors, or all of at least a score."""

    def run(table: pa.Table) -> pa.Table:
        probes, vectors = (table.filter(pc.equal(table["side"], s)) for s in (0, 1))
        names, docs = probes["node"].to_numpy(), vectors["node"].to_numpy()
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        if len(names) and len(docs):
            a, b = (np.asarray(pc.list_flatten(t["embedding"].combine_chunks()), np.float64).reshape(len(t), -1) for t in (probes, vectors))
            order = np.argsort(docs, kind="stable")  # ties go to the lower doc
            docs, b = docs[order], b[order]
            for lo in range(0, len(names), 256):
                scores = np.round(a[lo : lo + 256] @ b.T, 6)
                scores[names[lo : lo + 256, None] == docs[None, :]] = -np.inf
                if k is None:
                    i, j = np.nonzero(scores >= least)
                else:
                    j = np.argsort(-scores, axis=1, kind="stable")[:, :k]
                    i, j = np.repeat(np.arange(len(j)), j.shape[1]), j.ravel()
                    there = scores[i, j] > -np.inf
                    i, j = i[there], j[there]
                found.append((names[lo + i], docs[j], scores[i, j]))
        q, d, s = (np.concatenate(x) for x in zip(*found, strict=True))
        return pa.table({"query": pa.array(q, pa.int64()), "doc": pa.array(d, pa.int64()), "score": pa.array(s, pa.float64())})

    return run


def _pairs(probes: DataFrame, vectors: DataFrame, k: int | None, least: float | None, block: int, rows: int) -> DataFrame:
    asked = probes.where("probe IS NOT NULL AND query IS NOT NULL").select(F.col("query").cast("long").alias("node"), F.col("probe").alias("embedding"))
    held = vectors.where("embedding IS NOT NULL AND doc IS NOT NULL").select(F.col("doc").cast("long").alias("node"), "embedding")
    n = held.count()
    across, down = max(1, -(-asked.count() // block)), max(1, -(-n // rows), min(SPREAD, n // SMALL))
    cell = lambda df, count: F.pmod(F.xxhash64("node"), F.lit(count)).cast("int")  # noqa: E731, ARG005
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    first = asked.select("node", "embedding", cell(asked, across).alias("x"), every(down).alias("y"), F.lit(0).alias("side"))
    second = held.select("node", "embedding", every(across).alias("x"), cell(held, down).alias("y"), F.lit(1).alias("side"))
    return first.unionByName(second).groupBy("x", "y").applyInArrow(_compared(k, least), "query long, doc long, score double")


def knn(probes: DataFrame, vectors: DataFrame, k: int, block: int = PROBES, rows: int = VECTORS) -> DataFrame:
    """(query, doc, score, rank): the k vectors (doc, embedding) of the largest dot product with each probe (query, probe), exactly, itself left out.

    One shuffle deals every block of about `block` probes with every block of about `rows` vectors to a task, which keeps
    the k best a probe; so pairs are never made, nothing goes through the driver, and no task holds more than two blocks.
    Scores are rounded to six places, ties go to the lower doc. Null vectors and ids are in no pair. Vectors have one length.
    """
    return top(_pairs(probes, vectors, k, None, block, rows), "query", "score", "doc", k)


def within(probes: DataFrame, vectors: DataFrame, least: float, block: int = PROBES, rows: int = VECTORS) -> DataFrame:
    """(query, doc, score): all vectors whose dot product with a probe is at least `least`, itself left out; dealt as by knn."""
    return _pairs(probes, vectors, None, least, block, rows)
