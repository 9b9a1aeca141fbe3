"""Walks over sorted rows: hash chains and their check, and packing to a budget. A task streams its partition, a row of state a key."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROOT = "0" * 64


def _sorted(rows: DataFrame, key: str, order: list) -> DataFrame:
    return rows.repartition(key).sortWithinPartitions(key, *order)


def hash_chain(rows: DataFrame, key: str, order: str, payload: str) -> DataFrame:
    """rows (key, order, payload as text) with seq, prev_hash and hash: sha256 of the hash before, a colon and the payload.

    Rows of a key form one chain in order; its first prev_hash is 64 zeros. A null payload is empty. Keys are dealt to
    tasks and streamed in order, so a long chain costs time in one task, not memory.
    """

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, seq, last = None, 0, ROOT
        for frame in frames:
            seqs, prevs, hashes = [], [], []
            for k, p in zip(frame["k"].tolist(), frame["p"].tolist(), strict=True):
                if (k,) != current:
                    current, seq, last = (k,), 0, ROOT
                seq += 1
                seqs.append(seq)
                prevs.append(last)
                last = hashlib.sha256(f"{last}:{p}".encode()).hexdigest()
                hashes.append(last)
            yield frame.assign(seq=seqs, prev_hash=prevs, hash=hashes)

    slim = rows.select(F.col(key).alias("k"), F.col(order).alias("o"), F.coalesce(F.col(payload), F.lit("")).alias("p"))
    schema = T.StructType([*slim.schema.fields, T.StructField("seq", T.LongType()), T.StructField("prev_hash", T.StringType()), T.StructField("hash", T.StringType())])
    return _sorted(slim, "k", ["o", "p"]).mapInPandas(walk, schema).toDF(key, order, payload, "seq", "prev_hash", "hash")


def chain_breaks(ledger: DataFrame, key: str, payload: str) -> DataFrame:
    """(key, rows, breaks, first_break, kind) of each chain: where a number is missing, a link doesn't match, or a payload was changed.

    ledger: key, seq, prev_hash, hash, payload. Every row is compared with the one before it, by one window.
    """
    order = Window.partitionBy(key).orderBy("seq")
    before = F.lag("hash").over(order)
    gap = F.col("seq") != F.coalesce(F.lag("seq").over(order), F.lit(0)) + 1
    link = F.col("prev_hash") != F.coalesce(before, F.lit(ROOT))
    body = F.col("hash") != F.sha2(F.concat(F.col("prev_hash"), F.lit(":"), F.coalesce(F.col(payload), F.lit(""))), 256)
    told = ledger.withColumn("kind", F.when(gap, "gap").when(link, "link").when(body, "payload"))
    first = F.min(F.when(F.col("kind").isNotNull(), F.struct("seq", "kind")))
    return told.groupBy(key).agg(F.count("*").alias("rows"), F.count("kind").alias("breaks"), first.alias("f")).select(key, "rows", "breaks", F.col("f.seq").alias("first_break"), F.col("f.kind").alias("kind"))


def budget_walk(rows: DataFrame, key: str, order: list[str | Column], size: str, budget: int) -> DataFrame:
    """The rows of each key in order that fit a budget; one that would overflow is skipped, not the rest. Null sizes are 0."""
    place = {c: i for i, c in enumerate(rows.columns)}

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, used = None, 0
        for frame in frames:
            kept = []
            for k, n in zip(frame.iloc[:, place[key]].tolist(), frame.iloc[:, place[size]].fillna(0).tolist(), strict=True):
                if (k,) != current:
                    current, used = (k,), 0
                kept.append(used + n <= budget)
                used += n if kept[-1] else 0
            yield frame[kept]

    return _sorted(rows, key, order).mapInPandas(walk, rows.schema)
