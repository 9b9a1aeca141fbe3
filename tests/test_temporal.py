"""Windows and validity that texts state: forms, impossible days, precedence, nulls."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lodestar.operators import temporal

NOW = dt.datetime(2024, 3, 5, 12)


def ms(text):
    return int(dt.datetime.fromisoformat(text).replace(tzinfo=dt.UTC).timestamp() * 1000)


END = 86_400_000 - 1
INTENTS = {
    None: None, "": None, "plain words": None, "12024-01-01 and 2024-01-01-x 2024-01-017": None, "2024-02-30": None, "xsince:2024-01-01T": (ms("2024-01-01"), ms("2024-01-01") + END, True, False),
    "on 2024-01-02?": (ms("2024-01-02"), ms("2024-01-02") + END, True, False),
    "2024-03-04 2024-02-30 2024-01-02T10:00": (ms("2024-01-02 10:00"), ms("2024-03-04") + END, False, False),
    "since:2024-03-01 2020-01-01": (ms("2024-03-01"), None, False, False),
    "UNTIL:36h x Since:2W since:junk": (ms("2024-02-20 12:00"), ms("2024-03-04 00:00"), False, False),
    "since:today": (None, None, False, True), "until:last week": (None, None, False, True), "since:2024-02-30": (None, None, False, True),
    "since:2024-03-02 until:2024-03-01": (None, None, False, True), "since:2024-03-01 until:2024-03-01": (ms("2024-03-01"), ms("2024-03-01") + END, False, False),
    "until:2024-02-27T11:59:59.5z": (None, ms("2024-02-27 11:59:59.500"), True, False), "until:2024-02-27T12:00+00:00": (None, ms("2024-02-27 12:00"), False, False),
}


def test_intents(spark):
    got = {r.t: r.w for r in spark.createDataFrame([(t,) for t in INTENTS], "t string").select("t", temporal.temporal_intent(F.col("t"), NOW).alias("w")).collect()}
    assert {t: w and (w.since, w.until, w.historical, w.rejected) for t, w in got.items()} == INTENTS
    assert all(w is None or w.damping == (0.5 if w.historical else 1.0) for w in got.values())


@pytest.mark.parametrize(("text", "want"), [("a since:2d  b", "a b"), ("since:x until:y", ""), ("keep  both", "keep  both"), ("asince:1d", "asince:1d"), (None, None)])
def test_directives(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(temporal.without_directives(F.col("t"))).first()[0] == want


VALID = {
    None: None, "": None, "P": None, "soon": None, "XP1Y": None, "P1Yx": None, "P0D": None,
    "2024-01-01/2024-06-30 P1Y": ("2024-01-01", "2024-06-30"), "from 2024-01-31 for P1M": ("2024-01-31", "2024-03-02"), "2024-02-29 P1Y": ("2024-02-29", "2025-03-01"),
    "P2W3D": ("2024-03-05 12:00", "2024-03-22 12:00"), "P1Y2M": ("2024-03-05 12:00", "2025-05-05 12:00"), "on 2024-01-01": ("2024-01-01", None), "P 2024-01-01 P1Y": ("2024-01-01", None), "2024-02-30": (None, None),
}


def test_validity(spark):
    got = {r.t: r.v for r in spark.createDataFrame([(t,) for t in VALID], "t string").select("t", temporal.validity(F.col("t"), NOW).alias("v")).collect()}
    at = lambda x: x and dt.datetime.fromisoformat(x)
    assert {t: v and (v.valid_from, v.valid_until) for t, v in got.items()} == {t: v and (at(v[0]), at(v[1])) for t, v in VALID.items()}
