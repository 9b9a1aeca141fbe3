"""How far results cover a query's terms, and the second pass that looks for the rare ones they miss."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.scalars import coverage_idf
from lodestar.operators.lexical import Postings

# Shares of a query's idf that count as complete and partial, and the share of documents of a rare term.
COMPLETE, PARTIAL, RARE_SHARE = 0.8, 0.4, 0.02
#: Records that the union of evidence takes for a term, and for a query.
PER_TERM, PER_QUERY = 2, 8


def numbered_terms(queries: DataFrame, key: str, terms) -> DataFrame:
    """(query, pos, term) of a column of term arrays, in their order; a query without terms has no row."""
    return queries.select(F.col(key).alias("query"), F.posexplode(terms).alias("pos", "term"))


def term_coverage(terms: DataFrame, pool: DataFrame, texts: DataFrame, postings: Postings) -> DataFrame:
    """(query, pos, term, df, idf, rare, covered) for every term of every query.

    A term is covered if a text of the query's pool (query, doc) holds it, whatever its case. Texts (doc, text) are read for
    the pools only. Rare terms are in at most RARE_SHARE of all documents, or in one.
    """
    asked = terms.groupBy("query").agg(F.collect_set("term").alias("terms"))
    read = pool.select("query", "doc").distinct().join(texts.select("doc", "text"), "doc").join(asked, "query")
    lowered = F.transform(F.array(F.lower("text")), lambda low: F.filter("terms", lambda t: F.contains(low, t)))  # lower once a text
    held = read.select("query", F.explode(F.flatten(lowered)).alias("term")).distinct().withColumn("held", F.lit(True))
    known = terms.join(postings.frequencies(), "term", "left").join(held, ["query", "term"], "left").crossJoin(F.broadcast(postings.corpus.select("n_docs")))  # corpus has one row
    df = F.coalesce("df", F.lit(0))
    rare = df <= F.greatest(F.lit(1), F.floor(RARE_SHARE * F.col("n_docs")))
    return known.select("query", "pos", "term", df.alias("df"), coverage_idf(df, F.col("n_docs")).alias("idf"), rare.alias("rare"), F.coalesce("held", F.lit(False)).alias("covered"))


def completeness(report: DataFrame) -> DataFrame:
    """(query, coverage, verdict, covered, missing, retry): the share of idf that is covered, and the terms by name.

    missing has the uncovered terms that some document holds; retry the uncovered rare terms of a query that isn't
    complete, the terms of its second pass. Terms are in the order of the query.
    """
    share = F.when(F.sum("idf") == 0, F.lit(1.0)).otherwise(F.sum(F.when(F.col("covered"), F.col("idf")).otherwise(0.0)) / F.sum("idf"))
    named = lambda c: F.transform(F.sort_array(F.collect_list(F.when(c, F.struct("pos", "term")))), lambda x: x["term"])
    found = report.groupBy("query").agg(
        F.round(share, 6).alias("coverage"),
        named(F.col("covered")).alias("covered"),
        named(~F.col("covered") & (F.col("df") > 0)).alias("missing"),
        named(~F.col("covered") & F.col("rare")).alias("rare"),
    )
    verdict = F.when(F.col("coverage") >= COMPLETE, "complete").when(F.col("coverage") >= PARTIAL, "partial").otherwise("sparse")
    none = F.array().cast("array<string>")
    return found.select("query", "coverage", verdict.alias("verdict"), "covered", "missing", F.when(F.col("coverage") < COMPLETE, F.col("rare")).otherwise(none).alias("retry"))


def second_pass(terms: DataFrame, first: DataFrame, report: DataFrame, postings: Postings, pool: int) -> DataFrame:
    """(query, doc, position, kind): first hits (query, doc, rank) in their places, then what one second pass adds.

    A query without first hits is asked again for any of its terms, if it has two ("broadened"); one whose hits leave rare
    terms uncovered is asked for these alone ("targeted"); up to `pool` documents each, those not yet there appended by
    score. Other queries cost nothing. Only queries with terms have rows.
    """
    there = first.select("query").distinct()
    empty = terms.join(there, "query", "left_anti")
    enough = empty.groupBy("query").agg(F.count("*").alias("n")).where("n > 1").select("query")
    broadened = empty.join(enough, "query", "left_semi").select("query", "term", F.lit("broadened").alias("kind"))
    targeted = completeness(report).join(there, "query", "left_semi").select("query", F.explode("retry").alias("term"), F.lit("targeted").alias("kind"))
    asked = broadened.unionByName(targeted)
    found = postings.bm25(asked.select("query", "term"))
    best = Window.partitionBy("query").orderBy(F.desc("score"), "doc")
    some = found.withColumn("rn", F.row_number().over(best)).where(F.col("rn") <= pool)
    new = some.join(first.select("query", "doc"), ["query", "doc"], "left_anti").join(asked.select("query", "kind").distinct(), "query")
    rows = first.select("query", "doc", F.col("rank").cast("long").alias("rank"), F.lit("first").alias("kind"), F.lit(0).alias("later")).unionByName(new.select("query", "doc", F.col("rn").cast("long").alias("rank"), "kind", F.lit(1).alias("later")))
    return rows.select("query", "doc", F.row_number().over(Window.partitionBy("query").orderBy("later", "rank", "doc")).cast("long").alias("position"), "kind")


def evidence_union(report: DataFrame, postings: Postings, per_term: int = PER_TERM, per_query: int = PER_QUERY) -> DataFrame:
    """(query, pos, term, doc, rank): for each uncovered term that some document holds its best documents, in the order of
    the terms, until a query has per_query. A term's best documents are looked up once, however many queries miss it."""
    missing = report.where("NOT covered AND df > 0").select("query", "pos", "term")
    alone = postings.bm25(missing.select(F.col("term").alias("query"), "term").distinct())
    best = Window.partitionBy("query").orderBy(F.desc("score"), "doc")
    top = alone.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= per_term).select(F.col("query").alias("term"), "doc", F.col("rank").cast("long").alias("rank"))
    order = Window.partitionBy("query").orderBy("pos", "rank")
    return missing.join(top, "term").withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_query).select("query", F.col("pos").cast("long").alias("pos"), "term", "doc", "rank")
