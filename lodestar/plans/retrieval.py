"""Retrieval: keyword and vector lanes, fusion, and ranking."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.functions.scalars import coverage_idf, dot, significant_terms
from lodestar.operators.components import connect
from lodestar.operators.lexical import bm25, index_terms, query_terms, top
from lodestar.operators.vectors import knn, within
from lodestar.registry import query, table
from lodestar.session import materialize

POOL, LIMIT = 50, 10
_TERMS = r"""
q AS (SELECT item_id AS query, unnest(list_distinct(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), lambda w: length(w) >= 3))) AS term FROM benchmark),
w AS (SELECT doc_id AS doc, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM documents),
corpus AS (SELECT count(*) AS n_docs, avg(len(w)) AS avg_len FROM w),
tf AS (SELECT doc, term, len, count(*) AS tf FROM (SELECT doc, len(w) AS len, unnest(w) AS term FROM w) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
"""
_BM25 = (
    _TERMS
    + """
scored AS (SELECT tf.term, doc, greatest(1e-6, ln((n_docs - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len / avg_len)) AS weight FROM tf JOIN df USING (term), corpus),
found AS (SELECT query, doc, round(sum(weight), 6) AS score, count(*) AS matched FROM q JOIN scored USING (term) GROUP BY ALL),
"""
)
_KW = "kw AS (SELECT query, doc, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM found QUALIFY rank <= 50),"
_SEM = """
sem AS (SELECT b.item_id AS query, e.vec_id AS doc, round(list_dot_product(list_transform(p.embedding, lambda x: x::DOUBLE), list_transform(e.embedding, lambda x: x::DOUBLE)), 6) AS score,
  row_number() OVER (PARTITION BY b.item_id ORDER BY round(list_dot_product(list_transform(p.embedding, lambda x: x::DOUBLE), list_transform(e.embedding, lambda x: x::DOUBLE)), 6) DESC, e.vec_id) AS rank
  FROM benchmark b JOIN embeddings p ON p.vec_id = b.item_id JOIN embeddings e ON e.vec_id <> p.vec_id QUALIFY rank <= 50),
"""
_NORM = """
nk AS (SELECT query, doc, CASE WHEN max(score) OVER p = min(score) OVER p THEN 1.0 ELSE (score - min(score) OVER p) / (max(score) OVER p - min(score) OVER p) END AS k FROM kw WINDOW p AS (PARTITION BY query)),
both_lanes AS (SELECT query, doc, coalesce(k, 0.0) AS keyword, greatest(0.0, coalesce(sem.score, 0.0)) AS semantic FROM nk FULL JOIN sem USING (query, doc)),
"""


def _lanes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(keyword lane, semantic lane): the pools of every benchmark query, with ranks."""
    docs, asked = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    keyword = top(bm25(docs, query_terms(asked, "item_id", "text"), "doc_id", "text"), "query", "score", "doc", POOL)
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    probes = asked.select(F.col("item_id").alias("query")).join(vectors.select(F.col("vec_id").alias("query"), F.col("embedding").alias("probe")), "query")
    semantic = knn(probes, vectors.withColumnRenamed("vec_id", "doc"), POOL)
    return keyword, semantic


def normalized(lane: DataFrame) -> DataFrame:
    """Scores of each query's pool as 0 to 1; 1 where all are equal."""
    pool = Window.partitionBy("query")
    low, high = F.min("score").over(pool), F.max("score").over(pool)
    return lane.withColumn("norm", F.when(high == low, F.lit(1.0)).otherwise((F.col("score") - low) / (high - low)))


@query("doc_freq", f"WITH {_TERMS} x AS (SELECT 1) SELECT term, df FROM df")
def doc_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In how many documents each term of the benchmark queries is."""
    return index_terms(table(spark, sf_dir, "documents"), query_terms(table(spark, sf_dir, "benchmark"), "item_id", "text"), "doc_id", "text").frequencies()


@query("bm25_topk", f"WITH {_BM25} x AS (SELECT 1) SELECT query, doc, score, matched, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM found QUALIFY rank <= 10")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of each benchmark query, any term."""
    found = bm25(table(spark, sf_dir, "documents"), query_terms(table(spark, sf_dir, "benchmark"), "item_id", "text"), "doc_id", "text")
    return top(found, "query", "score", "doc", LIMIT).withColumn("rank", F.col("rank").cast("long"))


@query(
    "bm25_all_terms",
    f"WITH {_BM25} wanted AS (SELECT query, count(*) AS n FROM q GROUP BY query) SELECT query, doc, score, matched, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM found JOIN wanted USING (query) WHERE matched = n QUALIFY rank <= 10",
)
def bm25_all_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents that have every term of a benchmark query."""
    found = bm25(table(spark, sf_dir, "documents"), query_terms(table(spark, sf_dir, "benchmark"), "item_id", "text"), "doc_id", "text", all_terms=True)
    return top(found, "query", "score", "doc", LIMIT).withColumn("rank", F.col("rank").cast("long"))


@query(
    "idf_coverage",
    f"""WITH {_BM25} {_KW}
    hit AS (SELECT DISTINCT kw.query, tf.term FROM kw JOIN tf USING (doc) JOIN q ON q.query = kw.query AND q.term = tf.term WHERE kw.rank <= 10),
    t AS (SELECT q.query, q.term, ln(1 + n_docs / (1 + coalesce(df, 0))) AS idf, hit.term IS NOT NULL AS covered FROM q LEFT JOIN df USING (term) LEFT JOIN hit ON hit.query = q.query AND hit.term = q.term, corpus),
    c AS (SELECT query, round(sum(CASE WHEN covered THEN idf ELSE 0 END) / sum(idf), 6) AS coverage, count(*) FILTER (WHERE NOT covered) AS missing FROM t GROUP BY query)
    SELECT query, coverage, missing, CASE WHEN coverage >= 0.8 THEN 'complete' WHEN coverage >= 0.4 THEN 'partial' ELSE 'sparse' END AS verdict FROM c""",
)
def idf_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each query's idf its ten best documents cover, and the verdict. All counts come from the postings."""
    terms = query_terms(table(spark, sf_dir, "benchmark"), "item_id", "text")
    postings = index_terms(table(spark, sf_dir, "documents"), terms, "doc_id", "text")
    best = top(postings.bm25(terms), "query", "score", "doc", LIMIT).select("query", "doc")
    hit = terms.join(best, "query").join(postings.tf.select("doc", "term"), ["doc", "term"], "left_semi").select("query", "term").distinct().withColumn("covered", F.lit(True))
    total = postings.corpus.select(F.col("n_docs").alias("n"))  # one row
    rated = terms.join(postings.frequencies(), "term", "left").join(hit, ["query", "term"], "left").crossJoin(F.broadcast(total)).withColumn("idf", coverage_idf(F.coalesce("df", F.lit(0)), F.col("n")))
    covered = F.coalesce("covered", F.lit(False))
    out = rated.groupBy("query").agg(F.round(F.sum(F.when(covered, F.col("idf")).otherwise(0.0)) / F.sum("idf"), 6).alias("coverage"), F.count(F.when(~covered, 1)).alias("missing"))
    return out.withColumn("verdict", F.when(F.col("coverage") >= 0.8, "complete").when(F.col("coverage") >= 0.4, "partial").otherwise("sparse"))


_DOT = "round(list_dot_product(list_transform(p.embedding, lambda x: x::DOUBLE), list_transform(e.embedding, lambda x: x::DOUBLE)), 6)"
_KNN = f"near AS (SELECT p.vec_id AS query, e.vec_id AS doc, {_DOT} AS score, row_number() OVER (PARTITION BY p.vec_id ORDER BY {_DOT} DESC, e.vec_id) AS rank FROM embeddings p JOIN embeddings e ON e.vec_id <> p.vec_id WHERE p.vec_id % 50 = 0)"


def _probes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The stated query set, vectors whose id is divisible by 50, and all vectors."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc"), "embedding", "label")
    return vectors.where(F.col("doc") % 50 == 0).select(F.col("doc").alias("query"), F.col("embedding").alias("probe")), vectors


@query("knn_topk", f"WITH {_KNN} SELECT query, doc, score, rank FROM near WHERE rank <= 10")
def knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of all vectors to each vector of the query set."""
    return knn(*_probes(spark, sf_dir), LIMIT).withColumn("rank", F.col("rank").cast("long"))


@query("near_dup_vectors", f"WITH {_KNN} SELECT query, doc, score FROM near WHERE score >= 0.97")
def near_dup_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors with a cosine of .97 or more to one of the query set (all vectors have unit length)."""
    return within(*_probes(spark, sf_dir), NEAR)


#: Least cosine of near-duplicate vectors; vectors that one task compares with as many others.
NEAR, VECTOR_BLOCK = 0.97, 2000


def _near_links(table: pa.Table) -> pa.Table:
    """(u, v) for one pair of blocks: each vector with the least of its component by the near pairs of first and second."""
    left, right = (table.filter(pc.equal(table["side"], s)) for s in (0, 1))
    u, v = (t["node"].to_numpy() for t in (left, right))
    found_u, found_v = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    if len(u) and len(v):
        a, b = (np.array(t["embedding"].to_pylist(), np.float64) for t in (left, right))
        for lo in range(0, len(u), 256):
            i, j = np.nonzero(np.round(a[lo : lo + 256] @ b.T, 6) >= NEAR)
            found_u.append(u[lo + i])
            found_v.append(v[j])
    nodes, at = np.unique(np.concatenate([*found_u, *found_v]), return_inverse=True)
    i, j = np.split(at, 2)
    label, before = np.arange(len(nodes)), None
    while before is None or (label != before).any():
        before = label.copy()
        np.minimum.at(label, i, before[j])
        np.minimum.at(label, j, before[i])
        label = label[label]
    tied = nodes[label] != nodes
    return pa.table({"u": pa.array(nodes[tied], pa.int64()), "v": pa.array(nodes[label][tied], pa.int64())})


def near_vector_groups(vectors: DataFrame, block: int = VECTOR_BLOCK) -> DataFrame:
    """(vec_id, group) of all rows (vec_id, embedding): the least id of its component by cosines of .97 or more.

    Exact over all pairs: equal vectors are one class, classes are dealt to blocks, every pair of blocks is compared by
    one task. The work grows with the square of the number of distinct vectors; no pair of equal vectors is made.
    """
    rows = vectors.where("vec_id IS NOT NULL AND embedding IS NOT NULL").select("vec_id", "embedding")
    classes = materialize(rows.groupBy("embedding").agg(F.min("vec_id").alias("node")), "vector-classes")
    blocks = max(1, -(-classes.count() // block))
    dealt = classes.select("node", "embedding", F.pmod(F.xxhash64("node"), F.lit(blocks)).cast("int").alias("b"))
    each = F.lit(blocks - 1)
    first = dealt.select("node", "embedding", F.col("b").alias("x"), F.explode(F.sequence(F.col("b"), each)).alias("y"), F.lit(0).alias("side"))
    second = dealt.select("node", "embedding", F.explode(F.sequence(F.lit(0), F.col("b"))).alias("x"), F.col("b").alias("y"), F.lit(1).alias("side"))
    links = first.unionByName(second).groupBy("x", "y").applyInArrow(_near_links, "u long, v long")
    roots = connect(links).select(F.col("u").alias("node"), "root")
    named = classes.join(roots, "node", "left").select("embedding", F.coalesce("root", "node").alias("group"))
    return rows.join(named, "embedding").select("vec_id", "group")


@query(
    "near_dup_vector_groups",
    f"""WITH RECURSIVE pairs AS MATERIALIZED (SELECT p.vec_id AS u, e.vec_id AS v FROM embeddings p JOIN embeddings e ON {_DOT} >= 0.97),
    reach AS (SELECT vec_id AS u, vec_id AS v FROM embeddings WHERE embedding IS NOT NULL UNION SELECT r.u, p.v FROM reach r JOIN pairs p ON p.u = r.v)
    SELECT u AS vec_id, min(v) AS "group" FROM reach GROUP BY u""",
)
def near_dup_vector_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector and its group of near-duplicates, over all pairs of vectors (near_dup_vectors has only the query set's)."""
    return near_vector_groups(table(spark, sf_dir, "embeddings"))


@query("novelty", f"WITH {_KNN} SELECT query, round(avg(sqrt(greatest(0.0, 2 - 2 * score))), 6) AS novelty FROM near WHERE rank <= 5 GROUP BY query")
def novelty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean distance to the five nearest other vectors."""
    near = knn(*_probes(spark, sf_dir), 5)
    return near.groupBy("query").agg(F.round(F.avg(F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("score")))), 6).alias("novelty"))


def _fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query, doc, keyword, semantic): both lanes as 0 to 1, 0 where a lane lacks a document."""
    keyword, semantic = _lanes(spark, sf_dir)
    joined = normalized(keyword).select("query", "doc", "norm").join(semantic.select("query", "doc", F.col("score").alias("s")), ["query", "doc"], "full_outer")
    return joined.select("query", "doc", F.coalesce("norm", F.lit(0.0)).alias("keyword"), F.greatest(F.lit(0.0), F.coalesce("s", F.lit(0.0))).alias("semantic"))


@query(
    "hybrid_linear",
    f"WITH {_BM25} {_KW} {_SEM} {_NORM} s AS (SELECT query, doc, round(0.6 * keyword + 0.4 * semantic, 6) AS score FROM both_lanes) SELECT query, doc, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM s QUALIFY rank <= 10",
)
def hybrid_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted sum of both lanes."""
    scored = _fused(spark, sf_dir).select("query", "doc", F.round(0.6 * F.col("keyword") + 0.4 * F.col("semantic"), 6).alias("score"))
    return top(scored, "query", "score", "doc", LIMIT).withColumn("rank", F.col("rank").cast("long"))


@query(
    "hybrid_rrf",
    f"WITH {_BM25} {_KW} {_SEM} u AS (SELECT query, doc, rank FROM kw UNION ALL SELECT query, doc, rank FROM sem), s AS (SELECT query, doc, round(sum(1.0 / (60 + rank)), 9) AS score FROM u GROUP BY ALL) SELECT query, doc, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM s QUALIFY rank <= 10",
)
def hybrid_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reciprocal rank fusion of both lanes."""
    keyword, semantic = _lanes(spark, sf_dir)
    ranks = keyword.select("query", "doc", "rank").unionByName(semantic.select("query", "doc", "rank"))
    scored = ranks.groupBy("query", "doc").agg(F.round(F.sum(1.0 / (60 + F.col("rank"))), 9).alias("score"))
    return top(scored, "query", "score", "doc", LIMIT).withColumn("rank", F.col("rank").cast("long"))


@query(
    "hybrid_search",
    f"""WITH {_BM25} {_KW} {_SEM} {_NORM}
    s AS (SELECT b.query, b.doc, md5(coalesce(d.text, '')) AS content, round(least(1.0, greatest(0.0, (0.6 * keyword + 0.4 * semantic) * CASE WHEN d.n_chars >= 2000 THEN 1.4 WHEN d.n_chars >= 200 THEN 1.0 ELSE 0.6 END)), 6) AS score
      FROM both_lanes b JOIN documents d ON d.doc_id = b.doc),
    f AS (SELECT *, row_number() OVER (PARTITION BY query, content ORDER BY score DESC, doc) AS copy, count(*) OVER (PARTITION BY query, content) - 1 AS duplicates FROM s)
    SELECT query, doc, score, duplicates, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM f WHERE copy = 1 QUALIFY rank <= 10""",
)
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both lanes, times the weight of a document's tier (by length here), copies merged into the first of them."""
    tier = F.when(F.col("n_chars") >= 2000, 1.4).when(F.col("n_chars") >= 200, 1.0).otherwise(0.6)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("content"), tier.alias("tier"))
    mixed = F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (0.6 * F.col("keyword") + 0.4 * F.col("semantic")) * F.col("tier"))), 6)
    scored = _fused(spark, sf_dir).join(docs, "doc").select("query", "doc", "content", mixed.alias("score"))
    copies = Window.partitionBy("query", "content")
    merged = scored.withColumn("copy", F.row_number().over(copies.orderBy(F.desc("score"), "doc"))).withColumn("duplicates", F.count("*").over(copies) - 1)
    return top(merged.where("copy = 1").drop("copy", "content"), "query", "score", "doc", LIMIT).withColumn("rank", F.col("rank").cast("long"))


@query(
    "benchmark_metrics",
    f"""WITH {_BM25} {_KW}
    want AS (SELECT b.item_id AS query, d.doc_id AS doc FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
    r AS (SELECT query, min(kw.rank) AS first FROM want JOIN kw USING (query, doc) GROUP BY query), a AS (SELECT DISTINCT query FROM want)
    SELECT count(*) AS queries, round(avg(CASE WHEN first <= 5 THEN 1.0 ELSE 0.0 END), 6) AS hit_at_5, round(avg(coalesce(1.0 / first, 0.0)), 6) AS mrr FROM a LEFT JOIN r USING (query)""",
)
def benchmark_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """hit@5 and mean reciprocal rank of the keyword lane, documents that hold a passage being the expected ones.

    Candidates must hold every term of the passage, so that the search for the passage itself sees few documents.
    """
    docs, asked = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    terms = query_terms(asked, "item_id", "text")
    found = bm25(docs, terms, "doc_id", "text")
    pool = top(found, "query", "score", "doc", POOL).select("query", "doc", "rank")
    wanted_terms = terms.groupBy("query").agg(F.count("*").alias("n"))
    maybe = found.join(wanted_terms, "query").where("matched = n").select("query", "doc")
    texts = maybe.join(docs.select(F.col("doc_id").alias("doc"), "text"), "doc").join(asked.select(F.col("item_id").alias("query"), F.col("text").alias("passage")), "query")
    want = texts.where(F.contains("text", "passage")).select("query", "doc")
    first = want.join(pool, ["query", "doc"]).groupBy("query").agg(F.min("rank").alias("first"))
    rated = want.select("query").distinct().join(first, "query", "left")
    return rated.agg(F.count("*").alias("queries"), F.round(F.avg(F.when(F.col("first") <= 5, 1.0).otherwise(0.0)), 6).alias("hit_at_5"), F.round(F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))), 6).alias("mrr"))


@query(
    "session_grep",
    "SELECT conv_id, turn, role, len(regexp_extract_all(lower(text), 'that')) AS hits FROM conversations WHERE contains(lower(text), 'that')",
)
def session_grep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns that hold a string, and how often."""
    turns = table(spark, sf_dir, "conversations")
    return turns.where(F.contains(F.lower("text"), F.lit("that"))).select("conv_id", "turn", "role", F.size(F.regexp_extract_all(F.lower("text"), F.lit("that"), F.lit(0))).cast("long").alias("hits"))


@query(
    "evidence_terms",
    r"""WITH q AS (SELECT item_id, list_distinct(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), lambda w: length(w) >= 3)) AS terms FROM benchmark)
    SELECT item_id, len(terms) AS n_terms, list_aggregate(list_sort(terms), 'string_agg', ' ') AS terms FROM q""",
)
def evidence_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The significant terms of each query, sorted."""
    terms = significant_terms(F.col("text"))
    return table(spark, sf_dir, "benchmark").select("item_id", F.size(terms).cast("long").alias("n_terms"), F.array_join(F.array_sort(terms), " ").alias("terms"))
