"""Versions, caches, upserts, and debounced streams: ties, restarts, late and repeated changes, empty tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lodestar.sources import sinks, versions
from lodestar.streaming import ingest


def test_versions(spark, tmp_path):
    folder = str(tmp_path / "t")
    assert versions.current_version(spark, folder) is None and versions.read_current(spark, folder) is None
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "n")], "doc long, chunk string")
    assert versions.publish(rows, folder) == 1
    old = versions.read_current(spark, folder)
    changed = spark.createDataFrame([(1,), (3,), (None,), (1,)], "doc long")
    new = spark.createDataFrame([(3, "d"), (3, "e"), (4, "stray")], "doc long, chunk string")
    assert versions.publish(versions.replace_documents(old, changed, new, "doc"), folder) == 2
    assert sorted((r.doc or 0, r.chunk) for r in versions.read_current(spark, folder).collect()) == [(0, "n"), (2, "c"), (3, "d"), (3, "e")]
    assert old.count() == 4  # a reader of the version before isn't cut off
    with pytest.raises(Exception, match="ARITHMETIC|DIVIDE"):
        versions.publish(rows.withColumn("doc", F.col("doc") / F.lit(0)), folder)
    assert versions.current_version(spark, folder) == 2


def test_generation(spark):
    rows = [(1, "a"), (2, None), (1, "a")]
    frame = lambda r: spark.createDataFrame(r, "p long, h string")
    stamp = versions.generation(frame(rows), ["p", "h"])
    assert stamp == versions.generation(frame(rows[::-1]).repartition(3), ["p", "h"])
    assert len({stamp, versions.generation(frame(rows[:2]), ["p", "h"]), versions.generation(frame([]), ["p", "h"]), versions.generation(frame([(1, "b"), (2, None), (1, "a")]), ["p", "h"])}) == 4


def test_cache(spark):
    at = lambda h: dt.datetime(2024, 1, 1, h)
    cache = spark.createDataFrame([("a", "g", at(10), "old"), ("a", "g", at(11), "x"), ("a", "g", at(11), "y"), ("b", "other", at(11), "z"), ("c", "g", at(1), "stale"), ("d", "g", at(13), "future"), ("e", "g", at(10), "edge"), (None, "g", at(11), "n")], "key string, generation string, at timestamp, outcome string")
    requests = spark.createDataFrame([(k,) for k in "abcdefa"], "key string")
    got = {r.key: (r.outcome, r.hit) for r in versions.probe(requests, cache, "g", "2024-01-01 12:00:00", 7200).collect()}
    assert got == {"a": ("y", True), "b": (None, False), "c": (None, False), "d": (None, False), "e": ("edge", True), "f": (None, False)}
    done = versions.write_back(cache, spark.createDataFrame([("a", "new"), ("f", "1"), ("f", "2")], "key string, outcome string"), "g", "2024-01-01 12:00:00", 7200)
    assert sorted((r.key or "", r.outcome) for r in done.collect()) == [("", "n"), ("a", "new"), ("e", "edge"), ("f", "2")]
    assert versions.probe(requests.limit(0), cache, "g", "2024-01-01", 1).count() == 0


def test_upsert_is_the_same_each_time(spark):
    current = spark.createDataFrame([(1, "a", 0), (2, "b", 0), (None, "n", 0)], "k long, v string, o int")
    changes = spark.createDataFrame([(1, f"t{i}", 5) for i in range(20)] + [(1, "older", 4), (3, "new", None), (3, "last", 1)], "k long, v string, o int")
    runs = [sorted((r.k or 0, r.v) for r in sinks.upsert(current, changes.repartition(n), "k", "o").collect()) for n in (1, 3, 7)]
    assert runs[0] == runs[1] == runs[2] and [x for x in runs[0] if x[0] != 1] == [(0, "n"), (2, "b"), (3, "last")]
    assert sinks.upsert(current, changes.limit(0), "k", "o").count() == 3


def test_debounce_goes_on_after_a_restart(spark, tmp_path):
    source, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    t = lambda minutes: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minutes)

    def step(rows):
        spark.createDataFrame([(k, t(m)) for k, m in rows], "path string, at timestamp").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("path string, at timestamp").parquet(source)
        ingest.hand_over(ingest.debounced(stream, "path", "at", "10 minutes"), target, state)
        return sorted((r.path, int((r.since - t(0)).total_seconds() // 60), int((r.last - t(0)).total_seconds() // 60), r.changes) for r in spark.read.parquet(target).collect())

    first = step([("a", 0), ("a", 5), ("a", 5), ("b", 3), ("c", 14)])
    assert first == [("b", 3, 3, 1)]  # a may still change until minute 15
    second = step([("a", 14), ("b", 13), ("late", 1), ("d", 24)])  # a is put off; b begins anew; one is too late
    assert second == [("a", 0, 14, 4), ("b", 3, 3, 1), ("b", 13, 13, 1), ("c", 14, 14, 1)]
    assert step([("e", 60)]) == sorted([*second, ("d", 24, 24, 1)])
