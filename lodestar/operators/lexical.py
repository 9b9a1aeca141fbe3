"""Term hits, document frequencies and BM25 as DataFrames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.scalars import significant_terms, word_list
from lodestar.session import materialize

K1, B = 1.2, 0.75


def query_terms(queries: DataFrame, key: str, text: str) -> DataFrame:
    """(query, term) for the significant terms of each query."""
    return queries.select(F.col(key).alias("query"), F.explode(significant_terms(F.col(text))).alias("term"))


@dataclass(frozen=True)
class Postings:
    """tf: (doc, term, tf, len) of every document that holds a term of some query, written once to the shared folder and
    read by all lanes. corpus: one row (n_docs, avg_len) over all documents."""

    tf: DataFrame
    corpus: DataFrame

    def frequencies(self) -> DataFrame:
        """(term, df): in how many documents each term is."""
        return self.tf.groupBy("term").agg(F.count("*").alias("df"))

    def bm25(self, queries: DataFrame, all_terms: bool = False) -> DataFrame:
        """(query, doc, score, matched): BM25 of every document with a term (query, term) of a query, or with all of them.

        idf = ln((N - n + .5) / (n + .5)), at least 1e-6.
        """
        idf = F.greatest(F.lit(1e-6), F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
        asked = queries.join(self.frequencies(), "term").crossJoin(F.broadcast(self.corpus)).withColumn("idf", idf)  # corpus has one row
        weight = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
        found = asked.join(self.tf, "term").groupBy("query", "doc").agg(F.round(F.sum(weight), 6).alias("score"), F.count("*").alias("matched"))
        if all_terms:
            found = found.join(queries.groupBy("query").agg(F.count("*").alias("wanted")), "query").where("matched = wanted").drop("wanted")
        return found


def index_terms(docs: DataFrame, terms: DataFrame, key: str, text: str) -> Postings:
    """Postings of the terms (term) over all documents; each text is tokenised once, and only these terms leave the scan.

    A null text is empty; rows of one key are different documents only if their keys are. The lengths of all documents go
    with the scan as counts, so that a document without any of the terms still counts.
    """
    wanted = terms.select("term").where("term IS NOT NULL").distinct().withColumn("asked", F.lit(True))
    words = docs.select(F.col(key).alias("doc"), word_list(F.coalesce(F.col(text), F.lit(""))).alias("w"))
    each = words.select("doc", F.size("w").alias("len"), F.posexplode_outer("w").alias("pos", "term"))
    # One row a document has its length: the first word's, or that of a document without words.
    sized = (F.coalesce("pos", F.lit(0)) == 0).alias("first")
    known = each.select("doc", "len", "term", sized).join(wanted, "term", "left").where("asked OR first")
    counted = known.groupBy("doc", "len", F.when(F.col("asked"), F.col("term")).alias("term")).agg(F.count(F.when(F.col("asked"), 1)).alias("tf"), F.count(F.when(F.col("first"), 1)).alias("docs"))
    rows = materialize(counted, "postings")
    corpus = rows.agg(F.sum("docs").alias("n_docs"), (F.sum(F.col("len").cast("double") * F.col("docs")) / F.sum("docs")).alias("avg_len"))
    return Postings(rows.where("term IS NOT NULL").select("doc", "term", "tf", "len"), corpus)


def bm25(docs: DataFrame, queries: DataFrame, key: str, text: str, all_terms: bool = False) -> DataFrame:
    """(query, doc, score, matched): BM25 of every document with a term of a query, or with all of them."""
    return index_terms(docs, queries, key, text).bm25(queries, all_terms)


def top(found: DataFrame, partition: str, score: str, tie: str, k: int) -> DataFrame:
    """The k best rows of each partition with their rank; ties by `tie`."""
    order = Window.partitionBy(partition).orderBy(F.desc(score), tie)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
