"""Hash chains, context packs, unions with priority, and counts over logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.operators import ledger
from lodestar.operators.lexical import bm25, query_terms, top
from lodestar.operators.vectors import knn
from lodestar.plans.retrieval import _BM25, _KNN, LIMIT, _probes
from lodestar.registry import query, table
from lodestar.sources import versions

_ROWS = "r AS (SELECT user_id, event_id, event_type || ':' || event_id AS payload, row_number() OVER (PARTITION BY user_id ORDER BY event_id, event_type || ':' || event_id) AS seq FROM events), "
_CHAIN = f"""{_ROWS} c AS (SELECT user_id, event_id, payload, seq, repeat('0', 64) AS prev_hash, sha256(repeat('0', 64) || ':' || payload) AS hash FROM r WHERE seq = 1
    UNION ALL SELECT r.user_id, r.event_id, r.payload, r.seq, c.hash, sha256(c.hash || ':' || r.payload) FROM c JOIN r ON r.user_id = c.user_id AND r.seq = c.seq + 1)"""


def _chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", F.concat("event_type", F.lit(":"), F.col("event_id").cast("string")).alias("payload"))
    return ledger.hash_chain(rows, "user_id", "event_id", "payload")


@query("hash_chain", f"WITH RECURSIVE {_CHAIN} SELECT user_id, event_id, payload, seq, prev_hash, hash FROM c")
def hash_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of each user as a chain: every hash covers the one before it."""
    return _chain(spark, sf_dir)


@query(
    "chain_breaks",
    f"""WITH RECURSIVE {_CHAIN}, t AS (SELECT user_id, seq, prev_hash, CASE WHEN event_id % 101 = 5 THEN md5(hash) ELSE hash END AS hash, CASE WHEN event_id % 97 = 13 THEN 'changed' ELSE payload END AS payload FROM c WHERE event_id % 103 <> 7),
    k AS (SELECT user_id, seq, CASE WHEN seq <> coalesce(lag(seq) OVER w, 0) + 1 THEN 'gap' WHEN prev_hash <> coalesce(lag(hash) OVER w, repeat('0', 64)) THEN 'link' WHEN hash <> sha256(prev_hash || ':' || payload) THEN 'payload' END AS kind FROM t WINDOW w AS (PARTITION BY user_id ORDER BY seq))
    SELECT user_id, count(*) AS rows, count(kind) AS breaks, min(seq) FILTER (WHERE kind IS NOT NULL) AS first_break, arg_min(kind, seq) FILTER (WHERE kind IS NOT NULL) AS kind FROM k GROUP BY user_id""",
)
def chain_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first break of every chain, after rows were dropped and hashes and payloads changed."""
    e = F.col("event_id")
    broken = _chain(spark, sf_dir).where(e % 103 != 7).withColumns({"hash": F.when(e % 101 == 5, F.md5("hash")).otherwise(F.col("hash")), "payload": F.when(e % 97 == 13, "changed").otherwise(F.col("payload"))})
    return ledger.chain_breaks(broken, "user_id", "payload")


@query(
    "context_pack",
    """WITH RECURSIVE r AS (SELECT source, doc_id, CAST(ceil(octet_length(encode(coalesce(text, ''))) / 4) AS BIGINT) AS tokens, row_number() OVER (PARTITION BY source ORDER BY coalesce(quality, 0) DESC, doc_id) AS rn FROM documents LEFT JOIN labels USING (doc_id) WHERE source IS NOT NULL),
    p AS (SELECT source, doc_id, tokens, rn, tokens <= 3000 AS kept, CASE WHEN tokens <= 3000 THEN tokens ELSE 0 END AS used FROM r WHERE rn = 1
      UNION ALL SELECT r.source, r.doc_id, r.tokens, r.rn, p.used + r.tokens <= 3000, p.used + CASE WHEN p.used + r.tokens <= 3000 THEN r.tokens ELSE 0 END FROM p JOIN r ON r.source = p.source AND r.rn = p.rn + 1)
    SELECT source, doc_id, tokens FROM p WHERE kept""",
)
def context_pack(spark: SparkSession, sf_dir: str, budget: int = 3000) -> DataFrame:
    """For each source the documents of the best quality, then the lowest id, that fit a budget of tokens."""
    tokens = F.ceil(F.octet_length(F.coalesce("text", F.lit(""))) / 4).cast("long")
    docs = table(spark, sf_dir, "documents").where("source IS NOT NULL").select("source", "doc_id", tokens.alias("tokens"))
    rows = docs.join(table(spark, sf_dir, "labels"), "doc_id", "left").select("source", "doc_id", "tokens", F.coalesce("quality", F.lit(0)).alias("quality"))
    return ledger.budget_walk(rows, "source", [F.desc("quality"), "doc_id"], "tokens", budget).drop("quality")


@query(
    "or_fallback",
    f"""WITH {_BM25} wanted AS (SELECT query, count(*) AS n FROM q GROUP BY query), strict AS (SELECT query, doc, score FROM found JOIN wanted USING (query) WHERE matched = n),
    u AS (SELECT query, doc, score, 'all' AS mode FROM strict UNION ALL SELECT query, doc, score, 'any' FROM found WHERE query NOT IN (SELECT query FROM strict) AND query IN (SELECT query FROM wanted WHERE n >= 2))
    SELECT query, doc, score, mode FROM u QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) <= 10""",
)
def or_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with all terms of a query; where there are none, those with any of its two or more terms. One scan for both."""
    terms = query_terms(table(spark, sf_dir, "benchmark"), "item_id", "text")
    found = bm25(table(spark, sf_dir, "documents"), terms, "doc_id", "text").join(terms.groupBy("query").agg(F.count("*").alias("n")), "query")
    full = F.max((F.col("matched") == F.col("n")).cast("int")).over(Window.partitionBy("query")) == 1
    kept = found.withColumn("full", full).where((F.col("full") & (F.col("matched") == F.col("n"))) | (~F.col("full") & (F.col("n") >= 2)))
    return top(kept.select("query", "doc", "score", F.when(F.col("full"), "all").otherwise("any").alias("mode")), "query", "score", "doc", LIMIT).drop("rank")


@query(
    "union_left_priority",
    "SELECT c_custkey AS id, c_acctbal AS score, 'first' AS lane FROM customer WHERE c_acctbal > 5000 UNION ALL SELECT s_suppkey, s_acctbal, 'second' FROM supplier WHERE s_suppkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)",
)
def union_left_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of one lane, and those of a second lane whose id the first lacks."""
    first = table(spark, sf_dir, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("score"), F.lit("first").alias("lane"))
    second = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("score"), F.lit("second").alias("lane"))
    return first.unionByName(second.join(first.select("id"), "id", "left_anti"))


@query("best_of_union", "WITH u AS (SELECT l_partkey AS id, l_quantity AS score, 'sold' AS lane FROM lineitem UNION ALL SELECT p_partkey, p_size::DOUBLE, 'listed' FROM part) SELECT id, max(score) AS score, arg_max(lane, (score, lane)) AS lane FROM u GROUP BY id")
def best_of_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best row of each id in the union of two lanes; a grouping, so nothing is sorted."""
    sold = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("id"), F.col("l_quantity").cast("double").alias("score"), F.lit("sold").alias("lane"))
    listed = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("score"), F.lit("listed").alias("lane"))
    return sold.unionByName(listed).groupBy("id").agg(F.max(F.struct("score", "lane")).alias("b")).select("id", "b.*")


@query("first_seen", "SELECT user_id, event_type, arg_min(event_id, (ts, event_id)) AS event_id FROM events GROUP BY ALL")
def first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first event of each kind of each user."""
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@query("latest_by_term", "WITH t AS (SELECT unnest(list_distinct(list_filter(regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+'), lambda w: length(w) >= 3))) AS term, conv_id, turn FROM conversations) SELECT term, max(CASE WHEN turn = 0 THEN 1e18 ELSE conv_id * 100.0 + turn END) AS latest FROM t GROUP BY term")
def latest_by_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When each term was last used; an unknown time, here of turn 0, counts as the latest."""
    words = F.array_distinct(F.filter(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), lambda w: F.length(w) >= 3))
    when = F.when(F.col("turn") != 0, F.col("conv_id") * 100.0 + F.col("turn"))
    return table(spark, sf_dir, "conversations").select(F.explode(words).alias("term"), when.alias("at")).groupBy("term").agg(F.max(F.coalesce("at", F.lit(1e18))).alias("latest"))


@query("window_tally", "SELECT count(*) FILTER (WHERE length(text) > 4 * 512) AS over_budget, count(*) FILTER (WHERE length(text) <= 4 * 512 AND octet_length(encode(text)) > 4 * 512) AS undecidable FROM documents")
def window_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts over a window of tokens by their characters, and those that are so only by their bytes."""
    over, wide = F.length("text") > 4 * 512, F.octet_length("text") > 4 * 512
    return table(spark, sf_dir, "documents").agg(F.count(F.when(over, 1)).alias("over_budget"), F.count(F.when(~over & wide, 1)).alias("undecidable"))


@query(
    "write_summary",
    "SELECT user_id, CASE WHEN event_type IN ('purchase', 'signup') THEN 'write' ELSE 'read' END AS verb, count(*) AS n, count(*) FILTER (WHERE value > 50) AS attributed, min(ts) AS first, max(ts) AS last FROM events GROUP BY 1, 2",
)
def write_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, attributed counts, first and last use of each verb of each user."""
    verb = F.when(F.col("event_type").isin("purchase", "signup"), "write").otherwise("read")
    return table(spark, sf_dir, "events").groupBy("user_id", verb.alias("verb")).agg(F.count("*").alias("n"), F.count(F.when(F.col("value") > 50, 1)).alias("attributed"), F.min("ts").alias("first"), F.max("ts").alias("last"))


@query(
    "ordered_merge",
    "WITH u AS (SELECT ts, 0 AS shard, event_id AS line FROM events WHERE event_type = 'error' UNION ALL SELECT o_orderdate, 1, o_orderkey FROM orders) SELECT ts, shard, line FROM u ORDER BY ts DESC, shard, line LIMIT 500",
)
def ordered_merge(spark: SparkSession, sf_dir: str, most: int = 500) -> DataFrame:
    """The newest rows of two logs in one total order: time, shard, line."""
    a = table(spark, sf_dir, "events").where("event_type = 'error'").select("ts", F.lit(0).alias("shard"), F.col("event_id").alias("line"))
    b = table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("timestamp").alias("ts"), F.lit(1).alias("shard"), F.col("o_orderkey").alias("line"))
    return a.withColumn("ts", F.col("ts").cast("timestamp")).unionByName(b).orderBy(F.desc("ts"), "shard", "line").limit(most)


@query("bridge_pairs", f"WITH {_KNN}, linked AS (SELECT DISTINCT a.vec_id AS query, b.vec_id AS doc FROM embeddings a JOIN embeddings b ON a.label = b.label AND b.vec_id BETWEEN a.vec_id - 200 AND a.vec_id + 200 WHERE a.vec_id % 50 = 0) SELECT query, doc, score FROM near ANTI JOIN linked USING (query, doc) WHERE rank <= 10")
def bridge_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near neighbours that no link joins yet; a link, here, is one label and ids at most 200 apart."""
    probes, vectors = _probes(spark, sf_dir)
    near = knn(probes, vectors, LIMIT).drop("rank")
    label = vectors.select("doc", "label")
    named = near.join(label, "doc").join(label.select(F.col("doc").alias("query"), F.col("label").alias("own")), "query")
    linked = F.coalesce((F.col("label") == F.col("own")) & (F.abs(F.col("doc") - F.col("query")) <= 200), F.lit(False))
    return named.where(~linked).select("query", "doc", "score")


@query("novelty_order", "SELECT user_id, novelty, row_number() OVER (ORDER BY novelty DESC NULLS LAST, user_id) AS place FROM (SELECT user_id, CASE WHEN user_id % 5 = 0 THEN NULL ELSE round(avg(value), 6) END AS novelty FROM events GROUP BY user_id) ORDER BY place LIMIT 100")
def novelty_order(spark: SparkSession, sf_dir: str, most: int = 100) -> DataFrame:
    """Users by novelty, unknown ones last, ties by id. Only the first hundred are numbered, so no window holds them all."""
    rated = table(spark, sf_dir, "events").groupBy("user_id").agg(F.when(F.col("user_id") % 5 != 0, F.round(F.avg("value"), 6)).alias("novelty"))
    order = [F.desc_nulls_last("novelty"), "user_id"]
    return rated.orderBy(*order).limit(most).withColumn("place", F.row_number().over(Window.orderBy(*order)))


@query(
    "cache_probe",
    """WITH c AS (SELECT event_type || '/' || user_id AS key, 'g' || event_id % 3 AS generation, ts AS seen, CAST(value AS VARCHAR) AS outcome FROM events),
    f AS (SELECT key, max({'seen': seen, 'outcome': outcome}) AS m FROM c WHERE generation = 'g1' AND seen <= TIMESTAMP '2024-01-25 12:00:00' AND seen >= TIMESTAMP '2024-01-20 12:00:00' GROUP BY key)
    SELECT k.key, m['seen'] AS "at", m['outcome'] AS outcome, m IS NOT NULL AS hit FROM (SELECT DISTINCT key FROM c) k LEFT JOIN f ON f.key = k.key""",
)
def cache_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which requests a cache of outcomes answers: of the wanted generation and at most five days old."""
    cache = table(spark, sf_dir, "events").select(F.concat_ws("/", "event_type", F.col("user_id").cast("string")).alias("key"), F.concat(F.lit("g"), (F.col("event_id") % 3).cast("string")).alias("generation"), F.col("ts").cast("timestamp").alias("at"), F.col("value").cast("string").alias("outcome"))
    return versions.probe(cache.select("key"), cache, "g1", "2024-01-25 12:00:00", 5 * 86400)
