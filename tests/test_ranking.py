"""Ranking, pages, coverage and the second pass on small tables: ties, nulls, empty pools, caps."""

import math

import pytest
from pyspark.sql import functions as F

from lodestar.operators import assembly, coverage
from lodestar.operators.lexical import index_terms, query_terms


def pool_of(spark, rows, more="", **columns):
    return spark.createDataFrame(rows, "query long, doc long, keyword double, semantic double" + more)


def by_doc(frame):
    return {(r.query, r.doc): r for r in frame.collect()}


def test_a_pool_without_signals_is_the_weighted_sum(spark):
    got = by_doc(assembly.score(pool_of(spark, [(1, 1, 1.0, 0.5), (1, 2, 0.0, 0.0), (1, 3, 2.0, 2.0)])))
    assert [got[1, d].score for d in (1, 2, 3)] == [0.8, 0.0, 1.0]  # clamped
    assert got[1, 1].reasons == ["keyword 1.000", "semantic 0.500"] and got[1, 2].reasons == []
    assert got[1, 1].temporal is None and got[1, 1].tier_mul == 1.0
    assert assembly.score(pool_of(spark, [])).count() == 0


def test_layers_and_their_caps(spark):
    rows = [
        (1, 1, 0.5, 0.5, "core", "stale", 0.0, 9.0, 5.0, 9, ["a", "b"]),
        (1, 2, 0.5, 0.5, "peripheral", "odd", 400.0, None, None, None, ["b"]),
        (1, 3, 0.5, 0.5, None, None, None, 0.5, 0.5, 1, []),
        (1, 4, 0.5, 0.5, None, None, None, 0.0, 0.0, 0, ["a", "b"]),
        (2, 1, 0.5, 0.5, None, None, None, 0.0, 0.0, 0, ["a"]),
    ]
    pool = pool_of(spark, rows, ", tier string, trend string, age_days double, activation double, reuse double, entities long, tags array<string>")
    links = spark.createDataFrame([(1, 3), (2, 3), (4, 3), (3, 3), (99, 3), (3, 1)], "source long, target long")
    companions = spark.createDataFrame([(2, 1, 3), (2, 3, 50), (2, 77, 9), (2, 2, 9), (3, 4, 1)], "doc long, other long, n long")
    got = by_doc(assembly.score(pool, links=links, companions=companions))
    one = got[1, 1]
    assert one.score == pytest.approx(0.5 * 1.4 * 0.85 + 0.02 + 0.02 + 0.05 + 0.04 + 0.04 + 0.06)
    assert (one.link, one.recency, one.entity, one.activated, one.reused) == pytest.approx((0.04, 0.05, 0.04, 0.04, 0.06))
    assert got[1, 2].trend_mul == 1.0 and got[1, 2].recency == 0.0 and got[1, 2].companion == 0.03  # capped; own and absent ones don't count
    assert got[1, 3].link == pytest.approx(0.03) and got[1, 3].companion == pytest.approx(0.005) and got[1, 3].tier_mul == 1.0
    assert got[1, 4].link == pytest.approx(0.02) and got[2, 1].link == 0.0  # other pools don't count


def test_windows(spark):
    day = 86400.0
    rows = [(1, d, 0.0, 0.0, e, 10 * day, u, 0.5, 0.0) for d, e, u in [(1, 12 * day, 20 * day), (2, 6 * day, 20 * day), (3, 2.9 * day, 20 * day), (4, None, 20 * day), (5, 99 * day, None)]] + [(2, 1, 0.0, 0.0, day, None, None, 1.0, 0.0)]
    got = by_doc(assembly.score(pool_of(spark, rows, ", event double, since double, until double, damping double, age_days double")))
    assert [got[1, d].temporal for d in (1, 2, 3, 4, 5)] == pytest.approx([0.06, 0.03, 0.0, 0.0, 0.06])
    assert got[2, 1].temporal is None and got[1, 1].recency == pytest.approx(0.025) and got[2, 1].recency == pytest.approx(0.05)


def test_fusion_by_rank(spark):
    rows = [(1, 1, 1.0, 0.0, 1, None), (1, 2, 0.5, 0.9, 2, 1), (1, 3, 0.0, 0.5, None, 2), (2, 9, 0.0, 0.0, None, 1)]
    pool = pool_of(spark, rows, ", keyword_rank int, semantic_rank int")
    got = by_doc(assembly.score(pool, assembly.Weights(fusion="rrf")))
    raw = {1: 1 / 61, 2: 1 / 62 + 1 / 61, 3: 1 / 62}
    assert [got[1, d].relevance for d in raw] == pytest.approx([(x - raw[3]) / (raw[2] - raw[3]) for x in raw.values()])
    assert got[2, 9].relevance == 1.0
    with pytest.raises(ValueError):
        assembly.score(pool, assembly.Weights(fusion="rrf", keyword_mul=0.0))


def page(spark, rows, **options):
    frame = spark.createDataFrame(rows, "query long, doc long, score double, content string, visible boolean")
    done = assembly.assemble(frame, options.pop("limit", 2), content="content", visible="visible", **options)
    return [(r.query, r.doc, r.position, r.duplicates, r.widened) for r in done.orderBy("query", "position").collect()]


def test_pages_widen_only_where_filters_left_them_short(spark):
    rows = [(1, 1, 0.9, "a", True), (1, 2, 0.8, "a", True), (1, 3, 0.7, None, False), (1, 4, 0.6, None, None), (1, 5, 0.5, "a", True)]
    rows += [(2, 1, 0.9, "a", True), (2, 2, 0.8, "b", True), (2, 3, 0.7, "a", True)]  # full: not widened, copies beyond the cap aren't folded
    rows += [(3, 1, 0.9, None, False)]  # the pool ran out
    rows += [(4, 2, 0.5, None, True), (4, 1, 0.5, None, True), (4, 3, 0.5, None, True)]  # ties by doc
    assert page(spark, rows) == [(1, 1, 1, 2, True), (1, 4, 2, 0, True), (2, 1, 1, 0, False), (2, 2, 2, 0, False), (4, 1, 1, 0, False), (4, 2, 2, 0, False)]


def test_the_floor_alone_does_not_widen(spark):
    rows = [(1, 1, 0.9, None, True), (1, 2, 0.1, None, True), (1, 3, 0.1, None, True)]
    assert page(spark, rows, floor=0.5) == [(1, 1, 1, 0, False)]
    assert page(spark, [], floor=0.5) == []


@pytest.fixture(scope="module")
def corpus(spark):
    texts = ["red apple pie", "green apple", "blue sky over the red sea", None, "apple apple zebra", "quince jam"] + [f"common filler number{i}" for i in range(60)]
    return spark.createDataFrame(list(enumerate(texts)), "doc long, text string")


def test_coverage_and_second_pass(spark, corpus):
    asked = spark.createDataFrame([(1, "apple zebra quince"), (2, "common filler"), (3, "nowhere apple"), (4, "missing"), (5, ""), (6, None)], "item long, text string")
    postings = index_terms(corpus, query_terms(asked, "item", "text"), "doc", "text")
    assert tuple(postings.corpus.first()) == (66, pytest.approx((3 + 2 + 6 + 0 + 3 + 2 + 180) / 66))
    assert {r.term: r.df for r in postings.frequencies().collect()} == {"apple": 3, "zebra": 1, "quince": 1, "common": 60, "filler": 60}
    terms = coverage.numbered_terms(asked, "item", F.array_distinct(F.split(F.lower("text"), " "))).where("term <> ''")
    first = spark.createDataFrame([(1, 0, 1), (1, 1, 2), (2, 7, 1)], "query long, doc long, rank int")
    report = coverage.term_coverage(terms, first, corpus, postings)
    rows = {(r.query, r.term): r for r in report.collect()}
    assert rows[1, "apple"].covered and not rows[1, "zebra"].covered and rows[1, "zebra"].rare and not rows[2, "common"].rare
    assert rows[1, "zebra"].idf == pytest.approx(math.log(1 + 66 / 2)) and rows[3, "nowhere"].df == 0
    done = {r.query: r for r in coverage.completeness(report).collect()}
    assert set(done) == {1, 2, 3, 4}
    assert done[1].verdict == "sparse" and done[1].retry == ["zebra", "quince"] and done[1].covered == ["apple"]
    assert done[2].coverage == 1.0 and done[2].retry == [] and done[4].missing == []
    hits = [(r.query, r.doc, r.position, r.kind) for r in coverage.second_pass(terms, first, report, postings, 5).orderBy("query", "position").collect()]
    assert hits[:4] == [(1, 0, 1, "first"), (1, 1, 2, "first"), (1, 5, 3, "targeted"), (1, 4, 4, "targeted")]
    assert [h for h in hits if h[0] == 2] == [(2, 7, 1, "first")]
    assert {h[3] for h in hits if h[0] == 3} == {"broadened"} and not [h for h in hits if h[0] == 4]  # one term: nothing to broaden
    union = [(r.query, r.term, r.doc, r.rank) for r in coverage.evidence_union(report, postings, per_query=3).orderBy("query", "pos", "rank").collect()]
    assert union == [(1, "zebra", 4, 1), (1, "quince", 5, 1), (3, "apple", 4, 1), (3, "apple", 1, 2)]


def test_postings_of_no_documents(spark, corpus):
    asked = spark.createDataFrame([(1, "apple")], "item long, text string")
    terms = query_terms(asked, "item", "text")
    empty = index_terms(corpus.limit(0), terms, "doc", "text")
    assert empty.bm25(terms).count() == 0
