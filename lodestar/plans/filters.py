"""Scans, predicates, policy filters, set operations and differences."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.functions.scalars import fold_overlap
from lodestar.operators import predicates
from lodestar.registry import query, table


@query("property_filter", "SELECT doc_id, lang, source FROM documents WHERE lang IN ('en', 'de') AND source IN ('src0', 'src1', 'src2')")
def property_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return docs.where(predicates.matches_properties({"lang": ["EN", "de"], "source": ["src0", "src1", "src2"]}))


@query(
    "policy_chain",
    """WITH r AS (SELECT doc_id, lang, source, n_chars, toxic, quality FROM documents LEFT JOIN labels USING (doc_id))
    SELECT doc_id, n_chars FROM r WHERE coalesce(toxic, 0) = 0 AND lang = 'en' AND n_chars BETWEEN 200 AND 20000 AND (source IS NULL OR source <> 'src3') AND (quality IS NULL OR quality = 1)""",
)
def policy_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status, property, size, owner and scope filters in order; an unlabelled row passes the last."""
    rows = table(spark, sf_dir, "documents").drop("text").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return predicates.apply_policy(rows, _policy()).where("rejected_by IS NULL").select("doc_id", "n_chars")


def _policy() -> list:
    return [
        ("status", F.coalesce(F.col("toxic"), F.lit(0)) == 0),
        ("property", F.col("lang") == "en"),
        ("size", F.col("n_chars").between(200, 20000)),
        ("owner", F.col("source").isNull() | (F.col("source") != "src3")),
        ("scope", F.col("quality").isNull() | (F.col("quality") == 1)),
    ]


@query(
    "policy_attribution",
    """SELECT CASE WHEN coalesce(toxic, 0) <> 0 THEN 'status' WHEN lang IS NULL OR lang <> 'en' THEN 'property' WHEN n_chars IS NULL OR NOT n_chars BETWEEN 200 AND 20000 THEN 'size' WHEN source = 'src3' THEN 'owner' WHEN quality <> 1 THEN 'scope' END AS rejected_by, count(*) AS n
    FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1""",
)
def policy_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows each step of the policy rejects, and how many are kept (null)."""
    rows = table(spark, sf_dir, "documents").drop("text").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return predicates.apply_policy(rows, _policy()).groupBy("rejected_by").agg(F.count("*").alias("n"))


@query("lexical_exclusion", "SELECT doc_id FROM documents WHERE NOT (contains(lower(coalesce(text, '')), 'idiot') OR contains(lower(coalesce(source, '')), 'idiot') OR contains(lower(coalesce(source, '')), 'src1'))")
def lexical_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drops rows whose text or source holds an excluded term."""
    return table(spark, sf_dir, "documents").where(~predicates.holds_term(["text", "source"], ["Idiot"]) & ~predicates.holds_term(["source"], ["src1"])).select("doc_id")


@query(
    "rank_adjust",
    """WITH r AS (SELECT doc_id, least(1.0, n_chars / 5000.0) AS score, coalesce(toxic, 0) = 1 AS out, CASE WHEN lang <> 'en' THEN 0.5 ELSE 1.0 END * CASE WHEN quality = 1 THEN 1.4 WHEN quality = 0 THEN 0.6 ELSE 1.0 END AS factor FROM documents LEFT JOIN labels USING (doc_id))
    SELECT doc_id, round(least(1.0, score * factor), 6) AS score, out AS excluded FROM r""",
)
def rank_adjust(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every adjuster keeps, multiplies or excludes; factors multiply, then the score is clamped."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    adjusters = [F.when(F.col("lang") != "en", 0.5).otherwise(1.0), F.when(F.col("quality") == 1, 1.4).when(F.col("quality") == 0, 0.6).otherwise(1.0)]
    factor = F.lit(1.0)
    for a in adjusters:
        factor = factor * a
    base = F.least(F.lit(1.0), F.col("n_chars") / 5000.0)
    return rows.select("doc_id", F.round(F.least(F.lit(1.0), base * factor), 6).alias("score"), (F.coalesce("toxic", F.lit(0)) == 1).alias("excluded"))


@query("time_range", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-13'")
def time_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inclusive at both ends; a date-only end means the end of that day."""
    return table(spark, sf_dir, "events").where(predicates.in_range(F.col("ts"), "2024-01-10", "2024-01-12")).select("event_id")


@query("asof_validity", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderdate <= TIMESTAMP '1996-06-01' AND CAST(o_orderdate AS DATE) + INTERVAL 60 DAY > TIMESTAMP '1996-06-01'")
def asof_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows valid at an instant: from the order's date for sixty days."""
    ends = F.expr("CAST(CAST(o_orderdate AS DATE) + INTERVAL 60 DAYS AS TIMESTAMP)")
    return table(spark, sf_dir, "orders").where(predicates.valid_at(F.col("o_orderdate"), ends, "1996-06-01")).select("o_orderkey", "o_orderstatus")


@query(
    "interval_overlap",
    """WITH w AS (SELECT l_orderkey, min(l_shipdate) AS since, max(l_shipdate) AS until FROM lineitem GROUP BY l_orderkey)
    SELECT l_orderkey FROM w WHERE since <= TIMESTAMP '1995-12-31' AND until >= TIMESTAMP '1995-06-01'""",
)
def interval_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose span of shipments meets a window."""
    w = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min("l_shipdate").alias("since"), F.max("l_shipdate").alias("until"))
    lo, hi = F.lit("1995-06-01").cast("timestamp"), F.lit("1995-12-31").cast("timestamp")
    return w.where(fold_overlap(F.col("since"), F.col("until"), lo, hi)).select("l_orderkey")


@query(
    "snapshot_diff",
    """WITH a AS (SELECT doc_id, md5(coalesce(text, '')) AS h FROM documents WHERE source <> 'src0'), b AS (SELECT doc_id, md5(CASE WHEN lang = 'fr' THEN upper(coalesce(text, '')) ELSE coalesce(text, '') END) AS h FROM documents WHERE source <> 'src1')
    SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'added' WHEN b.doc_id IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.doc_id = b.doc_id WHERE a.h IS DISTINCT FROM b.h""",
)
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Added, removed and changed keys between two versions; only hashes are joined."""
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    a = docs.where("source <> 'src0'").select("doc_id", F.md5(text.cast("binary")).alias("ha"))
    b = docs.where("source <> 'src1'").select("doc_id", F.md5(F.when(F.col("lang") == "fr", F.upper(text)).otherwise(text).cast("binary")).alias("hb"))
    change = F.when(F.col("ha").isNull(), "added").when(F.col("hb").isNull(), "removed").otherwise("changed")
    return a.join(b, "doc_id", "full_outer").where(~F.col("ha").eqNullSafe(F.col("hb"))).select("doc_id", change.alias("change"))


@query(
    "content_manifest",
    """WITH m AS (SELECT doc_id, md5(CASE WHEN doc_id % 3 = 0 THEN 'old' ELSE coalesce(text, '') END) AS h FROM documents WHERE lang <> 'es')
    SELECT CASE WHEN m.h IS NULL THEN 'new' WHEN m.h = md5(coalesce(d.text, '')) THEN 'unchanged' ELSE 'modified' END AS state, count(*) AS n FROM documents d LEFT JOIN m USING (doc_id) GROUP BY 1""",
)
def content_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New, modified and unchanged rows against a manifest of content hashes."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.coalesce("text", F.lit("")).alias("t"))
    manifest = docs.where("lang <> 'es'").select("doc_id", F.md5(F.when(F.col("doc_id") % 3 == 0, F.lit("old")).otherwise(F.col("t")).cast("binary")).alias("h"))
    live = docs.select("doc_id", F.md5(F.col("t").cast("binary")).alias("now"))
    state = F.when(F.col("h").isNull(), "new").when(F.col("h") == F.col("now"), "unchanged").otherwise("modified")
    return live.join(manifest, "doc_id", "left").groupBy(state.alias("state")).agg(F.count("*").alias("n"))


@query("missing_embeddings", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def missing_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without a vector."""
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id", "left_anti")


@query("store_counts", "SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM embeddings) AS embeddings, (SELECT count(*) FROM embeddings WHERE len(embedding) <> 64) AS stale")
def store_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").agg(F.count("*").alias("documents"))
    vectors = table(spark, sf_dir, "embeddings").agg(F.count("*").alias("embeddings"), F.count(F.when(F.size("embedding") != 64, 1)).alias("stale"))
    return docs.crossJoin(vectors)


@query("exact_dups", "SELECT min(doc_id) AS canonical, count(*) AS copies FROM documents GROUP BY md5(coalesce(text, '')) HAVING count(*) > 1")
def exact_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts and the first of each."""
    key = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    return table(spark, sf_dir, "documents").groupBy(key.alias("h")).agg(F.min("doc_id").alias("canonical"), F.count("*").alias("copies")).where("copies > 1").drop("h")


@query("dedup_index", "SELECT md5(coalesce(text, '')) AS hash, min(doc_id) AS first_id FROM documents GROUP BY 1")
def dedup_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy(F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("hash")).agg(F.min("doc_id").alias("first_id"))


@query(
    "origins_union",
    """WITH u AS (SELECT 'customer' AS origin, c_custkey AS id, c_acctbal AS score FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_acctbal FROM supplier)
    SELECT origin, id, score FROM u ORDER BY score DESC, origin, id LIMIT 50""",
)
def origins_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty best of several origins together, each with its label."""
    a = table(spark, sf_dir, "customer").select(F.lit("customer").alias("origin"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("score"))
    b = table(spark, sf_dir, "supplier").select(F.lit("supplier").alias("origin"), F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("score"))
    return a.unionByName(b).orderBy(F.desc("score"), "origin", "id").limit(50)


@query(
    "slot_distinct_topics",
    """WITH t AS (SELECT source AS agent, lang AS topic FROM documents GROUP BY ALL), c AS (SELECT topic, count(*) AS agents FROM t GROUP BY topic)
    SELECT topic, agents, CASE WHEN agents > 1 THEN 'shared' ELSE 'unique' END AS kind FROM c""",
)
def shared_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics that several agents share, and those of one alone."""
    c = table(spark, sf_dir, "documents").groupBy(F.col("lang").alias("topic")).agg(F.countDistinct("source").alias("agents"))
    return c.withColumn("kind", F.when(F.col("agents") > 1, "shared").otherwise("unique"))


@query(
    "source_dashboard",
    "SELECT source, lang, count(*) AS docs, count(*) FILTER (WHERE n_chars >= 1000) AS active, sum(n_chars)::BIGINT AS chars, count(DISTINCT text) AS texts FROM documents GROUP BY ALL",
)
def source_dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count("*").alias("docs"), F.count(F.when(F.col("n_chars") >= 1000, 1)).alias("active"), F.sum("n_chars").alias("chars"), F.countDistinct(F.xxhash64("text")).alias("texts"))


@query(
    "page_cursor",
    "SELECT event_id, ts FROM events ORDER BY ts, event_id LIMIT 100 OFFSET 200",
)
def page_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page of a total order."""
    return table(spark, sf_dir, "events").select("event_id", "ts").orderBy("ts", "event_id").offset(200).limit(100)


@query(
    "open_loops",
    """WITH o AS (SELECT user_id AS id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events WHERE event_type = 'signup'), c AS (SELECT DISTINCT user_id AS id FROM events WHERE event_type = 'purchase' AND value > 90)
    SELECT o.id, CASE WHEN rn > 1 THEN 'duplicate' WHEN c.id IS NULL THEN 'open' ELSE 'closed' END AS state FROM o LEFT JOIN c ON c.id = o.id
    UNION ALL SELECT id, 'orphan' FROM c WHERE id NOT IN (SELECT id FROM o)""",
)
def open_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Opens paired with closes: first opens, duplicates, closed ones, and closes without an open."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), "event_id", "event_type", "value", "ts")
    opens = e.where("event_type = 'signup'").withColumn("rn", F.row_number().over(Window.partitionBy("id").orderBy("ts", "event_id")))
    closes = e.where("event_type = 'purchase' AND value > 90").select("id").distinct()
    state = F.when(F.col("rn") > 1, "duplicate").when(F.col("closed").isNull(), "open").otherwise("closed")
    told = opens.join(closes.withColumn("closed", F.lit(1)), "id", "left").select("id", state.alias("state"))
    return told.unionByName(closes.join(opens, "id", "left_anti").withColumn("state", F.lit("orphan")))


@query("trailing_window", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-02-01' - INTERVAL 7 DAY AND ts <= TIMESTAMP '2024-02-01'")
def trailing_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of the last seven days."""
    return table(spark, sf_dir, "events").where(predicates.within_days(F.col("ts"), "2024-02-01", 7)).select("event_id")


@query("expiry_filter", "SELECT doc_id FROM (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN NULL WHEN doc_id % 4 = 1 THEN 'soon' ELSE '2024-0' || (1 + doc_id % 3) || '-15' END AS e FROM documents) WHERE e IS NULL OR e = 'soon' OR CAST(e AS TIMESTAMP) > TIMESTAMP '2024-02-01'")
def expiry_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that haven't expired; a text that is no date doesn't expire."""
    e = F.expr("CASE WHEN doc_id % 4 = 0 THEN NULL WHEN doc_id % 4 = 1 THEN 'soon' ELSE '2024-0' || (1 + doc_id % 3) || '-15' END")
    return table(spark, sf_dir, "documents").where(~predicates.expired(e, "2024-02-01")).select("doc_id")


@query("status_filter", "SELECT o_orderkey, lower(o_orderpriority) LIKE '1-%' OR lower(o_orderpriority) LIKE '5-%' AS terminal FROM orders WHERE o_orderstatus <> 'F'")
def status_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open orders, and whether their priority is one of a closed set, whatever its case."""
    orders = table(spark, sf_dir, "orders").where(~predicates.has_status(F.col("o_orderstatus"), ["f"]))
    return orders.select("o_orderkey", predicates.has_status(F.col("o_orderpriority"), ["1-urgent", "5-low"]).alias("terminal"))


@query(
    "trust_reasons",
    """SELECT doc_id, list_filter([CASE WHEN contains(lower(coalesce(text, '')), 'ignore') THEN 'marker' END, CASE WHEN toxic = 1 THEN 'quarantine' END, CASE WHEN source IN ('src3', 'src4') THEN 'source' END], lambda x: x IS NOT NULL) AS reasons FROM documents LEFT JOIN labels USING (doc_id)""",
)
def trust_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a document isn't trusted: a mark in its text, its label, its source; none for those that are."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    checks = {"marker": predicates.holds_term(["text"], ["ignore"]), "quarantine": F.col("toxic") == 1, "source": F.col("source").isin("src3", "src4")}
    return rows.select("doc_id", predicates.reasons(checks).alias("reasons"))


@query("visibility_filter", "SELECT event_id FROM events WHERE user_id = 7 OR lower(coalesce(event_type, 'public')) <> 'purchase'")
def visibility_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What user 7 may see: their own events and those that aren't purchases."""
    private = F.when(F.col("event_type") == "purchase", "private")
    return table(spark, sf_dir, "events").where(predicates.visible_to("7", F.col("user_id").cast("string"), private)).select("event_id")


_LITERALS = """(VALUES ('today', TIMESTAMP '2024-01-20', TIMESTAMP '2024-01-20 10:30:00'), ('yesterday', TIMESTAMP '2024-01-19', TIMESTAMP '2024-01-19 23:59:59.999'), ('last week', TIMESTAMP '2024-01-13 10:30:00', TIMESTAMP '2024-01-13 10:30:00'),
    ('last month', TIMESTAMP '2023-12-21 10:30:00', TIMESTAMP '2023-12-21 10:30:00'), ('36h', TIMESTAMP '2024-01-18 22:30:00', TIMESTAMP '2024-01-18 22:30:00'), ('2024-01-10', TIMESTAMP '2024-01-10', TIMESTAMP '2024-01-10 23:59:59.999')) t(literal, begin, done)"""


@query("time_literals", f"SELECT literal, (SELECT count(*) FROM events WHERE ts BETWEEN begin AND done) AS n, (SELECT count(*) FROM events WHERE ts >= begin AND ts <= TIMESTAMP '2024-01-20 10:30:00') AS since FROM {_LITERALS}")
def time_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events from the begin to the end that each time literal names, and from its begin until now: one scan for all of them."""
    now = dt.datetime(2024, 1, 20, 10, 30)
    within = lambda a, b: F.count(F.when(F.col("ts").between(F.lit(str(a)).cast("timestamp"), F.lit(str(b)).cast("timestamp")), 1))
    counts = []
    for literal in ("today", "yesterday", "last week", "last month", "36h", "2024-01-10"):
        begin, end = predicates.time_range(literal, literal, now)
        counts.append(F.struct(F.lit(literal).alias("literal"), within(begin, end).alias("n"), within(begin, now).alias("since")))
    return table(spark, sf_dir, "events").agg(F.array(*counts).alias("c")).select(F.explode("c").alias("c")).select("c.*")
