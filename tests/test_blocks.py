"""Pairs by blocks, and co-access by them: few days and many, hot days, no candidate written."""

import datetime
import itertools
import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from lodestar.operators.blocks import block_pairs
from lodestar.plans.folds import co_access


def test_block_pairs(spark):
    rows = [(g, i, g * 100 + i) for g, n in ((0, 30), (1, 1), (2, 7)) for i in range(n)]
    groups = spark.createDataFrame([(0, 30), (1, 1), (2, 7)], "group long, size long")
    want = sorted((g, a, b) for g, n in ((0, 30), (2, 7)) for a, b in itertools.combinations(range(n), 2))
    for block in (1, 4, 1000):
        got = block_pairs(spark.createDataFrame(rows, "group long, id long, v long"), groups, block).collect()
        assert sorted((r.group, r.a, r.b) for r in got) == want
        assert all({r.x_v, r.y_v} == {r.group * 100 + r.a, r.group * 100 + r.b} for r in got)
    assert block_pairs(spark.createDataFrame([], "group long, id long"), groups.limit(0)).count() == 0


@pytest.mark.parametrize(("users", "days", "least", "most"), [(40, 10, 2, 10), (60, 200, 2, 8), (3, 200, 70, 190), (0, 1, 0, 0)])
def test_co_access(spark, tmp_path, users, days, least, most):
    rng = random.Random(users)
    held = {u: set(rng.sample(range(days), rng.randint(least, most))) | ({7} if rng.random() < 0.8 and days > 7 else set()) for u in range(users)}
    if days == 200 and users == 60:
        held |= {u: set(range(150, 156)) | {u % 7} for u in range(40, 60)}
    rows = [(datetime.datetime(2020, 1, 1, 5) + datetime.timedelta(days=d, hours=rng.randint(0, 5)), u, kind) for u, ds in held.items() for d in ds for kind in ("purchase", "purchase", "view")] + [(None, 1, "purchase")]
    names = ["ts", "user_id", "event_type"]
    columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.timestamp("us"), pa.int64(), pa.string()))]
    pq.write_table(pa.table(columns, names), f"{tmp_path}/events.parquet")
    want = {(a, b): len(held[a] & held[b]) for a, b in itertools.combinations(range(users), 2) if len(held[a] & held[b]) >= 3}
    found = co_access(spark, str(tmp_path))
    got = [tuple(r) for r in found.collect()]
    assert {(a, b): n for a, b, n, _ in got} == want and len(got) == len(want)
    assert all(boost == min(0.03, 0.005 * n) for _, _, n, boost in got)
    assert "Aggregate" not in found._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]  # pairs are tested where they are made, not gathered first
