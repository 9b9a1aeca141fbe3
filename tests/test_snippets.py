"""Rerank, spans and windows against plain versions: empty and null texts, ties, short texts, marks."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lodestar.operators import snippets


def plain_rerank(query, text):
    words = lambda t: re.findall(r"[^\W_]{2,}", (t or "").lower())
    q, d = list(dict.fromkeys(words(query))), words(text)
    found = [t for t in q if t in d]
    if not found:
        return 0.0
    share, spots = len(found) / len(q), [d.index(t) for t in found]
    near = min(1.0, len(found) / (max(spots) - min(spots) + 1)) if len(found) > 1 else share
    return 0.6 * share + 0.25 * near + 0.15 * sum(min(3, d.count(t)) for t in q) / (3 * len(q))


def test_rerank(spark):
    rng = random.Random(3)
    words = ["fox", "Dog", "été", "a", "b2", "x_y", "cat"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(None, "fox"), ("", "fox"), ("fox", None), ("a", "a a"), ("fox dog", "")] + [(text(rng.randint(1, 4)), text(rng.randint(0, 12))) for _ in range(200)]
    got = spark.createDataFrame([(i, q, t) for i, (q, t) in enumerate(rows)], "i long, q string, t string").select("i", snippets.rerank_score(F.col("q"), F.col("t")).alias("s"))
    scores = {r.i: r.s for r in got.collect()}
    assert [scores[i] for i in range(len(rows))] == pytest.approx([plain_rerank(*r) for r in rows])


def test_windows_and_spans(spark):
    one = lambda c, t: spark.createDataFrame([(t,)], "t string").select(c.alias("x")).first()[0]
    terms = F.array(F.lit("dog"), F.lit("fox"))
    assert [one(snippets.match_offset(F.col("t"), terms), t) for t in ("A FOX and dog", "none", "", None)] == [2, -1, -1, -1]
    assert one(snippets.match_offset(F.col("t"), F.array().cast("array<string>")), "fox") == -1
    cut = lambda t, at, n: one(snippets.snippet(F.col("t"), F.lit(at), n), t)
    assert [cut("0123456789", 9, 4), cut("0123456789", 1, 4), cut("0123456789", -1, 4), cut("012", 2, 4), cut("0123456789", 6, 6), cut("", -1, 4)] == ["…789", "0123…", "0123…", "012", "…3456789"[:7] + "…", ""]
    subject = F.array(F.lit("red"), F.lit("fox"))
    text = "The red hen. A red fox\nfox red fox! Red? 赤。 end"
    assert one(snippets.best_span(F.col("t"), subject), text) == "A red fox"
    assert [one(snippets.best_span(F.col("t"), subject), t) for t in (" none here. at all ", "", None, " \n ")] == ["none here.", "", "", ""]
