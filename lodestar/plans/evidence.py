"""Evidence for results, typed relations, versions, query plans, receipts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.functions.scalars import significant_terms
from lodestar.operators.lexical import bm25, query_terms, top
from lodestar.operators.trigrams import most_shared
from lodestar.plans.folds import events
from lodestar.plans.retrieval import _BM25, _KW
from lodestar.registry import query, table


@query(
    "evidence_pack",
    f"""WITH {_BM25} {_KW} r AS (SELECT query, doc, rank FROM kw WHERE rank <= 10),
    m AS (SELECT r.query, r.doc, r.rank, q.term, tf.doc IS NOT NULL AS there FROM r JOIN q USING (query) LEFT JOIN tf ON tf.doc = r.doc AND tf.term = q.term)
    SELECT query, doc, rank, count(*) FILTER (WHERE there) AS matched, list_aggregate(list_sort(coalesce(list(term) FILTER (WHERE NOT there), [])), 'string_agg', ' ') AS missing, round(count(*) FILTER (WHERE there) / count(*), 6) AS coverage FROM m GROUP BY ALL""",
)
def evidence_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For the ten best documents of each query: which of its terms they lack, and their coverage."""
    docs, asked = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    best = top(bm25(docs, query_terms(asked, "item_id", "text"), "doc_id", "text"), "query", "score", "doc", 10).select("query", "doc", F.col("rank").cast("long").alias("rank"))
    words = docs.select(F.col("doc_id").alias("doc"), F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)).alias("w"))
    terms = asked.select(F.col("item_id").alias("query"), significant_terms(F.col("text")).alias("t"))
    both = best.join(words, "doc").join(terms, "query").withColumn("gone", F.array_except("t", "w"))
    n = F.size("t")
    missing = F.when(F.size("gone") > 0, F.array_join(F.array_sort("gone"), " "))
    return both.select("query", "doc", "rank", (n - F.size("gone")).cast("long").alias("matched"), missing.alias("missing"), F.round((n - F.size("gone")) / n, 6).alias("coverage"))


@query(
    "result_cards",
    """WITH h AS (SELECT conv_id, turn, regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g') AS t FROM conversations WHERE contains(lower(text), 'the '))
    SELECT conv_id, turn, substr(t, greatest(1, strpos(lower(t), 'the ') - 40), 120) AS snippet, length(t) > 120 AS clipped FROM h""",
)
def result_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """120 characters around the first match, white space collapsed."""
    hits = table(spark, sf_dir, "conversations").where(F.contains(F.lower("text"), F.lit("the "))).withColumn("t", F.regexp_replace("text", r"[ \t\n\r]+", " "))
    begin = F.greatest(F.lit(1), F.instr(F.lower("t"), "the ") - 40)
    return hits.select("conv_id", "turn", F.substring("t", begin, F.lit(120)).alias("snippet"), (F.length("t") > 120).alias("clipped"))


_SPELLED = ["lower(text) AS s", "length(text) AS n"]


@query(
    "trigram_candidates",
    """WITH q AS (SELECT DISTINCT item_id AS query, unnest(list_transform(range(1, length(text) - 1), lambda i: lower(text)[i:i + 2])) AS g FROM benchmark WHERE length(text) >= 3),
    d AS (SELECT DISTINCT conv_id, turn, g FROM (SELECT conv_id, turn, unnest(list_transform(range(1, length(text) - 1), lambda i: lower(text)[i:i + 2])) AS g FROM conversations) WHERE g IN (SELECT g FROM q)),
    m AS (SELECT query, conv_id, turn, count(*) AS shared FROM q JOIN d USING (g) GROUP BY ALL)
    SELECT query, conv_id, turn, shared, row_number() OVER (PARTITION BY query ORDER BY shared DESC, conv_id, turn) AS rank FROM m QUALIFY rank <= 5""",
)
def trigram_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five turns that share most trigrams with each whole query."""
    asked = table(spark, sf_dir, "benchmark").selectExpr("item_id AS query", *_SPELLED)
    return most_shared(asked, table(spark, sf_dir, "conversations").selectExpr("conv_id", "turn", *_SPELLED), 5)


@query(
    "trigram_term_candidates",
    r"""WITH t AS (SELECT DISTINCT item_id AS query, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS w FROM benchmark),
    q AS (SELECT DISTINCT query, unnest(list_transform(range(1, length(w) - 1), lambda i: w[i:i + 2])) AS g FROM t WHERE length(w) >= 3),
    d AS (SELECT DISTINCT conv_id, turn, g FROM (SELECT conv_id, turn, unnest(list_transform(range(1, length(text) - 1), lambda i: lower(text)[i:i + 2])) AS g FROM conversations) WHERE g IN (SELECT g FROM q)),
    m AS (SELECT query, conv_id, turn, count(*) AS shared FROM q JOIN d USING (g) GROUP BY ALL)
    SELECT query, conv_id, turn, shared, row_number() OVER (PARTITION BY query ORDER BY shared DESC, conv_id, turn) AS rank FROM m QUALIFY rank <= 5""",
)
def trigram_term_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five turns that share most trigrams with all terms of each query (trigram_candidates goes by the whole text, blanks included)."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), F.explode(words).alias("s")).withColumn("n", F.length("s"))
    return most_shared(asked, table(spark, sf_dir, "conversations").selectExpr("conv_id", "turn", *_SPELLED), 5)


@query(
    "query_intents",
    r"""WITH u AS (SELECT conv_id, turn, coalesce(text, '') AS t FROM conversations WHERE role = 'user'),
    n AS (SELECT *, len(regexp_extract_all(lower(t), '[\p{L}\p{N}]+')) AS tokens, len(regexp_extract_all(t, '[A-Z][a-z]+')) AS names FROM u)
    SELECT conv_id, turn, CASE WHEN regexp_matches(t, '["*]') THEN 'exact' WHEN tokens > 0 AND names * 2 >= tokens THEN 'entity' WHEN tokens >= 6 AND names * 5 < tokens THEN 'broad' ELSE 'neutral' END AS intent FROM n""",
)
def query_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact, entity, broad or neutral, by quotes, capitalised words and length."""
    u = table(spark, sf_dir, "conversations").where("role = 'user'").withColumn("t", F.coalesce("text", F.lit("")))
    n = u.withColumn("tokens", F.size(F.regexp_extract_all(F.lower("t"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))).withColumn("names", F.size(F.regexp_extract_all("t", F.lit("[A-Z][a-z]+"), F.lit(0))))
    intent = F.when(F.col("t").rlike('["*]'), "exact").when((F.col("tokens") > 0) & (F.col("names") * 2 >= F.col("tokens")), "entity").when((F.col("tokens") >= 6) & (F.col("names") * 5 < F.col("tokens")), "broad").otherwise("neutral")
    return n.select("conv_id", "turn", intent.alias("intent"))


@query(
    "surfacing_gate",
    r"""WITH u AS (SELECT conv_id, turn, trim(coalesce(text, '')) AS t, lag(trim(coalesce(text, ''))) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations WHERE role = 'user')
    SELECT conv_id, turn, CASE WHEN t = '' THEN 'empty' WHEN t = before THEN 'repeat' WHEN starts_with(t, '/') THEN 'command' WHEN regexp_matches(t, '^[a-z]+( -[a-z]+)+$') THEN 'shell' ELSE 'surface' END AS verdict FROM u""",
)
def surfacing_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a prompt should surface memory: not when empty, the same as the last, or a command."""
    u = table(spark, sf_dir, "conversations").where("role = 'user'").withColumn("t", F.trim(F.coalesce("text", F.lit(""))))
    before = F.lag("t").over(Window.partitionBy("conv_id").orderBy("turn"))
    verdict = F.when(F.col("t") == "", "empty").when(F.col("t") == F.col("before"), "repeat").when(F.col("t").startswith("/"), "command").when(F.col("t").rlike("^[a-z]+( -[a-z]+)+$"), "shell").otherwise("surface")
    return u.withColumn("before", before).select("conv_id", "turn", verdict.alias("verdict"))


@query(
    "scd2_versions",
    """WITH s AS (SELECT user_id, ts, event_id, CAST(floor(value / 25) AS BIGINT) AS band, lag(CAST(floor(value / 25) AS BIGINT)) OVER w AS before FROM events WHERE event_type = 'signup' WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    c AS (SELECT * FROM s WHERE before IS DISTINCT FROM band) SELECT user_id, band, ts AS valid_from, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS valid_until FROM c""",
)
def scd2_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions of a value: each change closes the one before and opens the next at one instant."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    s = events(spark, sf_dir).where("event_type = 'signup'").select("user_id", "ts", "event_id", F.floor(F.col("value") / 25).cast("long").alias("band"))
    c = s.withColumn("before", F.lag("band").over(order)).where(~F.col("before").eqNullSafe(F.col("band")))
    return c.select("user_id", "band", F.col("ts").alias("valid_from"), F.lead("ts").over(order).alias("valid_until"))


@query(
    "recurrence_fold",
    """WITH e AS (SELECT user_id, ts, event_id, event_type, max(CASE WHEN event_type = 'signup' AND value < 30 THEN ts END) OVER (PARTITION BY user_id) AS purge FROM events)
    SELECT user_id, count(*) FILTER (WHERE event_type = 'purchase') AS learned, count(*) FILTER (WHERE event_type = 'error') AS unlearned, greatest(0, count(*) FILTER (WHERE event_type = 'purchase') - count(*) FILTER (WHERE event_type = 'error')) AS support,
    CASE WHEN count(*) FILTER (WHERE event_type = 'purchase') - count(*) FILTER (WHERE event_type = 'error') >= 10 THEN 'committed' WHEN count(*) FILTER (WHERE event_type = 'purchase') - count(*) FILTER (WHERE event_type = 'error') >= 3 THEN 'recurring' ELSE 'seen' END AS commitment
    FROM e WHERE event_type IN ('purchase', 'error') AND (purge IS NULL OR ts > purge) GROUP BY user_id""",
)
def recurrence_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supports less withdrawals since the last purge of a key, and the commitment they make."""
    purge = F.max(F.when((F.col("event_type") == "signup") & (F.col("value") < 30), F.col("ts"))).over(Window.partitionBy("user_id"))
    kept = events(spark, sf_dir).withColumn("purge", purge).where("event_type IN ('purchase', 'error') AND (purge IS NULL OR ts > purge)")
    n = kept.groupBy("user_id").agg(F.count(F.when(F.col("event_type") == "purchase", 1)).alias("learned"), F.count(F.when(F.col("event_type") == "error", 1)).alias("unlearned"))
    net = F.col("learned") - F.col("unlearned")
    return n.withColumn("support", F.greatest(F.lit(0), net)).withColumn("commitment", F.when(net >= 10, "committed").when(net >= 3, "recurring").otherwise("seen"))


@query(
    "relation_polarity",
    """WITH d AS (SELECT doc_id, least(1.0, n_chars / 5000.0) AS score, md5(coalesce(text, '')) AS h FROM documents), s AS (SELECT *, max(doc_id) OVER (PARTITION BY h) AS tip, max(score) OVER (PARTITION BY h) AS best, count(*) OVER (PARTITION BY h) AS c FROM d)
    SELECT doc_id, round(CASE WHEN doc_id <> tip THEN score * 0.6 WHEN c > 1 THEN greatest(score, 0.9 * best) ELSE score END, 6) AS score, doc_id <> tip AS superseded FROM s""",
)
def relation_polarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A superseded row keeps .6 of its score; its successor has at least .9 of it."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.least(F.lit(1.0), F.col("n_chars") / 5000.0).alias("score"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("h"))
    group = d.groupBy("h").agg(F.max("doc_id").alias("tip"), F.max("score").alias("best"), F.count("*").alias("c"))
    j = d.join(group, "h")
    score = F.when(F.col("doc_id") != F.col("tip"), F.col("score") * 0.6).when(F.col("c") > 1, F.greatest("score", 0.9 * F.col("best"))).otherwise(F.col("score"))
    return j.select("doc_id", F.round(score, 6).alias("score"), (F.col("doc_id") != F.col("tip")).alias("superseded"))


@query(
    "relation_constraints",
    """WITH allowed(src, tgt) AS (VALUES ('user', 'assistant'), ('assistant', 'user'), ('system', 'user'))
    SELECT a.conv_id, a.turn, a.role AS src, b.role AS tgt, allowed.src IS NULL AS blocked FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 LEFT JOIN allowed ON allowed.src = a.role AND allowed.tgt = b.role""",
)
def relation_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between neighbouring turns that no declaration allows."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    allowed = spark.createDataFrame([("user", "assistant"), ("assistant", "user"), ("system", "user")], "src string, tgt string").withColumn("ok", F.lit(True))
    edges = turns.withColumnRenamed("role", "src").join(turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("role").alias("tgt")), ["conv_id", "turn"])
    return edges.join(F.broadcast(allowed), ["src", "tgt"], "left").select("conv_id", "turn", "src", "tgt", F.col("ok").isNull().alias("blocked"))


@query(
    "receipt_fold",
    """WITH r AS (SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 200)
    SELECT l_partkey AS item, count(*) AS injections, round(sum(l_quantity), 4) AS tokens, min(l_orderkey) AS first_receipt FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM r) AND l_returnflag <> 'R' GROUP BY l_partkey""",
)
def receipt_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Injections and tokens by item over the newest 200 receipts; withheld items are skipped."""
    newest = table(spark, sf_dir, "orders").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(200).select(F.col("o_orderkey").alias("l_orderkey"))
    items = table(spark, sf_dir, "lineitem").where("l_returnflag <> 'R'").join(newest, "l_orderkey", "left_semi")
    return items.groupBy(F.col("l_partkey").alias("item")).agg(F.count("*").alias("injections"), F.round(F.sum("l_quantity"), 4).alias("tokens"), F.min("l_orderkey").alias("first_receipt"))


@query(
    "foresight",
    """SELECT 'due' AS kind, o_orderkey AS id, CAST(o_orderdate AS DATE) + 90 AS at FROM orders WHERE CAST(o_orderdate AS DATE) + 90 BETWEEN DATE '1997-01-01' AND DATE '1997-01-14'
    UNION ALL SELECT 'commitment', l_orderkey * 10 + l_linenumber, CAST(l_shipdate AS DATE) FROM lineitem WHERE CAST(l_shipdate AS DATE) BETWEEN DATE '1997-01-01' AND DATE '1997-01-03'""",
)
def foresight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What falls due within a horizon, and what is open."""
    due = F.date_add(F.to_date("o_orderdate"), 90)
    a = table(spark, sf_dir, "orders").select(F.lit("due").alias("kind"), F.col("o_orderkey").alias("id"), due.alias("at")).where("at BETWEEN DATE '1997-01-01' AND DATE '1997-01-14'")
    b = table(spark, sf_dir, "lineitem").select(F.lit("commitment").alias("kind"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.to_date("l_shipdate").alias("at")).where("at BETWEEN DATE '1997-01-01' AND DATE '1997-01-03'")
    return a.unionByName(b)


@query(
    "contested_slots",
    """WITH s AS (SELECT o_custkey AS entity, o_orderpriority AS aspect, count(DISTINCT o_orderstatus) AS vals, count(*) AS n FROM orders GROUP BY ALL)
    SELECT aspect, count(*) AS slots, count(*) FILTER (WHERE vals > 1) AS contested, max(n) AS most FROM s GROUP BY aspect""",
)
def contested_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "orders").groupBy("o_custkey", F.col("o_orderpriority").alias("aspect")).agg(F.countDistinct("o_orderstatus").alias("v"), F.count("*").alias("n"))
    return s.groupBy("aspect").agg(F.count("*").alias("slots"), F.count(F.when(F.col("v") > 1, 1)).alias("contested"), F.max("n").alias("most"))
