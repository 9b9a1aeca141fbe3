"""Health of a store: near copies, contradictions, gaps, trust, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.functions.scalars import word_set
from lodestar.operators.components import connect
from lodestar.operators.ranks import cumulative_counts
from lodestar.operators.similarity import similar_pairs
from lodestar.registry import query, table
from lodestar.session import materialize

_WORDS = r"list_distinct(list_filter(regexp_split_to_array(lower(t), '[^\p{L}\p{N}_-]+'), lambda w: length(w) > 1))"


_PAIRS = f"""d AS (SELECT min(conv_id * 100 + turn) AS id, role AS bucket, text AS t FROM conversations WHERE text IS NOT NULL GROUP BY role, text),
s AS (SELECT id, bucket, t, {_WORDS} AS w FROM d), p AS (SELECT a.id AS a, b.id AS b, a.t AS ta, b.t AS tb, len(list_intersect(a.w, b.w)) / nullif(len(list_distinct(list_concat(a.w, b.w))), 0) AS j FROM s a JOIN s b ON a.bucket = b.bucket AND a.id < b.id
AND len(a.w) * 0.6 <= len(b.w) AND len(b.w) * 0.6 <= len(a.w)),"""


_NEAR_TURNS = f"WITH {_PAIRS} x AS (SELECT 1) SELECT a, b, round(j, 6) AS similarity FROM p WHERE round(j, 6) >= 0.8"
_AGAINST = f"WITH {_PAIRS} x AS (SELECT 1) SELECT a, b, round(j, 6) AS similarity FROM p WHERE round(j, 6) >= 0.6 AND (len(list_intersect(regexp_split_to_array(lower(ta), '[^\\p{{L}}\\p{{N}}_-]+'), ['not', 'nicht', 'pas', 'no'])) > 0) <> (len(list_intersect(regexp_split_to_array(lower(tb), '[^\\p{{L}}\\p{{N}}_-]+'), ['not', 'nicht', 'pas', 'no'])) > 0)"


def _contradicting(rows: DataFrame) -> DataFrame:
    markers = F.array(*[F.lit(w) for w in ("not", "nicht", "pas", "no")])
    return similar_pairs(rows.withColumn("no", F.arrays_overlap("words", markers)), 0.6, across="no")


def _turn_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct turns by role: (id, bucket, text, words); a class's id is its least (conv_id, turn)."""
    rows = table(spark, sf_dir, "conversations").where("text IS NOT NULL")
    rows = rows.groupBy(F.coalesce("role", F.lit("")).alias("bucket"), "text").agg(F.min(F.struct("conv_id", "turn")).alias("id"))
    return rows.withColumn("words", word_set(F.col("text")))


def _flat(pairs: DataFrame, *more: Column) -> DataFrame:
    return pairs.select(*more, F.col("a.conv_id").alias("a_conv"), F.col("a.turn").alias("a_turn"), F.col("b.conv_id").alias("b_conv"), F.col("b.turn").alias("b_turn"), "similarity")


@query("turn_classes", "SELECT conv_id, turn, min(conv_id) OVER w AS rep_conv, first_value(turn) OVER (w ORDER BY conv_id, turn) AS rep_turn, count(*) OVER w AS members FROM conversations WHERE text IS NOT NULL WINDOW w AS (PARTITION BY coalesce(role, ''), text)")
def turn_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn with the first of the turns of its role and text, and their number: the members behind near_dup_turns."""
    rows = table(spark, sf_dir, "conversations").where("text IS NOT NULL")
    rows = rows.select("conv_id", "turn", F.sha2(F.concat(F.coalesce("role", F.lit("")), F.lit("|"), F.col("text")).cast("binary"), 256).alias("key"))
    reps = rows.groupBy("key").agg(F.min(F.struct("conv_id", "turn")).alias("rep"), F.count("*").alias("members"))
    return rows.join(reps, "key").select("conv_id", "turn", F.col("rep.conv_id").alias("rep_conv"), F.col("rep.turn").alias("rep_turn"), "members")


def _by_turn(sql: str) -> str:
    """The same SQL over classes named by (conv_id, turn)."""
    named = sql.replace("min(conv_id * 100 + turn) AS id, role AS bucket", "min({'conv_id': conv_id, 'turn': turn}) AS id, coalesce(role, '') AS bucket").replace("GROUP BY role, text", "GROUP BY coalesce(role, ''), text")
    return named.replace("SELECT a, b, round", "SELECT a['conv_id'] AS a_conv, a['turn'] AS a_turn, b['conv_id'] AS b_conv, b['turn'] AS b_turn, round")


@query("near_dup_turns", _by_turn(_NEAR_TURNS))
def near_dup_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of turns of one role whose words have a Jaccard similarity of .8 or more; classes of equal turns are named by
    their first (conv_id, turn), turn_classes has their members."""
    return _flat(similar_pairs(_turn_classes(spark, sf_dir), 0.8))


@query("turn_contradictions", _by_turn(_AGAINST))
def turn_contradictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of turns alike of which one negates and the other doesn't; classes as in near_dup_turns."""
    return _flat(_contradicting(_turn_classes(spark, sf_dir)))


_LINKED = _by_turn(_NEAR_TURNS).removeprefix("WITH ")
_NAMED = "SELECT conv_id, turn, min({'conv_id': conv_id, 'turn': turn}) OVER (PARTITION BY coalesce(role, ''), text) AS c FROM conversations WHERE text IS NOT NULL"


@query(
    "lexical_near_dups",
    f"""WITH RECURSIVE links AS MATERIALIZED (WITH {_LINKED}), ends AS (SELECT {{'conv_id': a_conv, 'turn': a_turn}} AS u, {{'conv_id': b_conv, 'turn': b_turn}} AS v FROM links), sym AS (SELECT u, v FROM ends UNION SELECT v, u FROM ends),
    named AS ({_NAMED}), reach AS (SELECT DISTINCT c AS u, c AS v FROM named UNION SELECT r.u, s.v FROM reach r JOIN sym s ON s.u = r.v), roots AS (SELECT u, min(v) AS root FROM reach GROUP BY u)
    SELECT conv_id, turn, root['conv_id'] AS group_conv, root['turn'] AS group_turn, (SELECT count(*) FROM sym WHERE sym.u = c) AS links FROM named JOIN roots ON roots.u = c""",
)
def lexical_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn with its group of near copies, by its first turn, and the number of other texts that it links to."""
    pairs = materialize(similar_pairs(_turn_classes(spark, sf_dir), 0.8).select("a", "b"), "turn-pairs")
    named = lambda c: F.format_string("%020d/%020d", F.col(f"{c}.conv_id"), F.col(f"{c}.turn"))
    roots = connect(pairs.select(named("a").alias("u"), named("b").alias("v")))
    degree = pairs.select(named("a").alias("u")).unionByName(pairs.select(named("b").alias("u"))).groupBy("u").agg(F.count("*").alias("links"))
    key = F.sha2(F.concat(F.coalesce("role", F.lit("")), F.lit("|"), F.col("text")).cast("binary"), 256)
    turns = table(spark, sf_dir, "conversations").where("text IS NOT NULL").select("conv_id", "turn", key.alias("key"))
    classes = turns.groupBy("key").agg(F.min(F.struct("conv_id", "turn")).alias("id"))
    known = classes.select("key", named("id").alias("u")).join(roots, "u", "left").join(degree, "u", "left")
    root = F.split(F.coalesce("root", "u"), "/")
    return turns.join(known, "key").select("conv_id", "turn", F.get(root, F.lit(0)).cast("long").alias("group_conv"), F.get(root, F.lit(1)).cast("long").alias("group_turn"), F.coalesce("links", F.lit(0)).alias("links"))


@query(
    "note_contradictions",
    f"""WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS bucket, text AS t FROM conversations WHERE text IS NOT NULL), c AS (SELECT *, row_number() OVER (PARTITION BY bucket, t ORDER BY conv_id NULLS FIRST, turn NULLS FIRST) AS nth FROM r),
    d AS (SELECT row_number() OVER (ORDER BY conv_id NULLS FIRST, turn NULLS FIRST, bucket, sha256(t)) AS id, conv_id, turn, bucket, t FROM c WHERE nth = 1),
    s AS (SELECT *, {_WORDS} AS w, len(list_intersect(regexp_split_to_array(lower(t), '[^\\p{{L}}\\p{{N}}_-]+'), ['not', 'nicht', 'pas', 'no'])) > 0 AS no FROM d),
    p AS (SELECT a, b, round(len(list_intersect(a.w, b.w)) / nullif(len(list_distinct(list_concat(a.w, b.w))), 0), 6) AS similarity FROM s a JOIN s b ON a.bucket = b.bucket AND a.id < b.id AND a.no <> b.no AND len(a.w) * 0.6 <= len(b.w) AND len(b.w) * 0.6 <= len(a.w)),
    f AS (SELECT * FROM p WHERE similarity >= 0.6), held AS (SELECT a.id AS id FROM f UNION SELECT b.id FROM f)
    SELECT 'pair' AS relation, a.conv_id AS a_conv, a.turn AS a_turn, b.conv_id AS b_conv, b.turn AS b_turn, similarity FROM f
    UNION ALL SELECT 'member', d.conv_id, d.turn, c.conv_id, c.turn, CAST(1 AS DOUBLE) FROM d JOIN c ON c.bucket = d.bucket AND c.t = d.t WHERE d.id IN (SELECT id FROM held)""",
)
def note_contradictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns alike of which one negates and the other doesn't, each pair with its similarity, and the members behind them.

    A row `pair` is of two texts, each named by its first (conv_id, turn), the lesser first. A row `member` is a turn (b)
    with the first one of its role and text (a), for every text that is in a pair, so that no copy is lost. Two texts that
    are first told at one (conv_id, turn) stay two: role and digest are part of a class's id.
    """
    turns = table(spark, sf_dir, "conversations").where("text IS NOT NULL").withColumn("bucket", F.coalesce("role", F.lit("")))
    turns = turns.select("conv_id", "turn", "bucket", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"), "text")
    classes = turns.groupBy("bucket", "digest").agg(F.min(F.struct("conv_id", "turn", "bucket", "digest")).alias("id"), F.first("text").alias("text"))
    classes = classes.select("id", "bucket", word_set(F.col("text")).alias("words"))
    pairs = materialize(_contradicting(classes), "contradictions")
    held = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct().select("id", "id.bucket", "id.digest")
    members = turns.drop("text").join(held, ["bucket", "digest"]).select(F.col("id").alias("a"), F.struct("conv_id", "turn").alias("b"), F.lit(1.0).alias("similarity"))
    return _flat(pairs, F.lit("pair").alias("relation")).unionByName(_flat(members, F.lit("member").alias("relation")))


@query(
    "concept_gaps",
    """WITH w AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '[A-Z][a-z]+')) AS term FROM documents), g AS (SELECT lower(term) AS term, count(DISTINCT doc_id) AS df FROM w GROUP BY 1), c AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[A-Za-z]+'))) AS term FROM benchmark)
    SELECT term, df FROM g WHERE df >= 20 AND term NOT IN (SELECT term FROM c)""",
)
def concept_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Capitalised terms of twenty documents or more that the benchmark texts don't cover."""
    terms = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit("[A-Z][a-z]+"), F.lit(0)), F.lower))).alias("term"))
    df = terms.groupBy("term").agg(F.count("*").alias("df")).where("df >= 20")
    covered = table(spark, sf_dir, "benchmark").select(F.explode(F.transform(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)), F.lower)).alias("term")).distinct()
    return df.join(covered, "term", "left_anti")


@query(
    "duplicate_candidates",
    """WITH k AS (SELECT doc_id, md5(coalesce(lang, '') || '|' || lower(trim(regexp_replace(string_split(coalesce(text, ''), chr(10))[1], '[ \\t\\r]+', ' ', 'g')))) AS key FROM documents)
    SELECT min(doc_id) AS canonical, count(*) AS members FROM k GROUP BY key HAVING count(*) >= 2""",
)
def duplicate_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of two or more rows of one language and title, which is the whole first line, normalised; the oldest is canonical."""
    title = F.lower(F.trim(F.regexp_replace(F.get(F.split(F.coalesce("text", F.lit("")), "\n"), F.lit(0)), r"[ \t\r]+", " ")))
    key = F.md5(F.concat(F.coalesce("lang", F.lit("")), F.lit("|"), title).cast("binary"))
    k = table(spark, sf_dir, "documents").select("doc_id", key.alias("key"))
    return k.groupBy("key").agg(F.min("doc_id").alias("canonical"), F.count("*").alias("members")).where("members >= 2").drop("key")


@query(
    "duplicate_documents",
    """WITH k AS (SELECT doc_id, md5(coalesce(lang, '') || '|' || lower(trim(regexp_replace(coalesce(text, ''), '[ \\t\\n\\r]+', ' ', 'g')))) AS key FROM documents)
    SELECT min(doc_id) AS canonical, count(*) AS members FROM k GROUP BY key HAVING count(*) >= 2""",
)
def duplicate_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of two or more rows of one language and whole normalised text (duplicate_candidates goes by the first line)."""
    whole = F.lower(F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[ \t\n\r]+", " ")))
    key = F.md5(F.concat(F.coalesce("lang", F.lit("")), F.lit("|"), whole).cast("binary"))
    k = table(spark, sf_dir, "documents").select("doc_id", key.alias("key"))
    return k.groupBy("key").agg(F.min("doc_id").alias("canonical"), F.count("*").alias("members")).where("members >= 2").drop("key")


@query(
    "retention_review",
    """WITH r AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'purchase') AS applied, count(*) FILTER (WHERE event_type = 'error') AS violated, (epoch(TIMESTAMP '2024-02-01') - epoch(max(ts))) / 86400 AS age FROM events GROUP BY user_id)
    SELECT user_id, applied, violated, CASE WHEN violated > applied THEN 'prune' WHEN applied = 0 AND age > 14 THEN 'park' WHEN violated * 3 > applied THEN 'improve' ELSE 'keep' END AS verdict FROM r""",
)
def retention_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keep, improve, park or prune, by counters and age."""
    from lodestar.plans.folds import age_days, events

    r = events(spark, sf_dir).groupBy("user_id").agg(F.count(F.when(F.col("event_type") == "purchase", 1)).alias("applied"), F.count(F.when(F.col("event_type") == "error", 1)).alias("violated"), F.min(age_days(F.col("ts"))).alias("age"))
    verdict = F.when(F.col("violated") > F.col("applied"), "prune").when((F.col("applied") == 0) & (F.col("age") > 14), "park").when(F.col("violated") * 3 > F.col("applied"), "improve").otherwise("keep")
    return r.select("user_id", "applied", "violated", verdict.alias("verdict"))


@query(
    "rule_quality",
    r"""WITH f AS (SELECT conv_id, turn, coalesce(text, '') AS t, list_filter(regexp_split_to_array(trim(coalesce(text, '')), '[ \t\n\r]+'), lambda w: w <> '') AS w FROM conversations WHERE role = 'system')
    SELECT conv_id, turn, len(w) AS words, CASE WHEN len(w) <= 1 THEN 'reject' WHEN length(t) > 280 OR NOT regexp_matches(t, '[0-9=<>]') THEN 'warn' ELSE 'accept' END AS verdict FROM f""",
)
def rule_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Empty or one-word rules are rejected; long ones and ones without a figure or operator get a warning."""
    f = table(spark, sf_dir, "conversations").where("role = 'system'").withColumn("t", F.coalesce("text", F.lit(""))).withColumn("w", F.filter(F.split(F.trim("t"), r"[ \t\n\r]+"), lambda w: w != ""))
    verdict = F.when(F.size("w") <= 1, "reject").when((F.length("t") > 280) | ~F.col("t").rlike("[0-9=<>]"), "warn").otherwise("accept")
    return f.select("conv_id", "turn", F.size("w").cast("long").alias("words"), verdict.alias("verdict"))


@query(
    "trust_verdict",
    """WITH s AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'error') AS errors, count(*) FILTER (WHERE event_type = 'view' AND value < 5) AS warnings, count(*) AS n FROM events GROUP BY user_id)
    SELECT user_id, errors, warnings, CASE WHEN errors * 4 > n THEN 'investigate' WHEN warnings >= 2 THEN 'watch' ELSE 'trust' END AS verdict FROM s""",
)
def trust_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    s = e.groupBy("user_id").agg(F.count(F.when(F.col("event_type") == "error", 1)).alias("errors"), F.count(F.when((F.col("event_type") == "view") & (F.col("value") < 5), 1)).alias("warnings"), F.count("*").alias("n"))
    return s.select("user_id", "errors", "warnings", F.when(F.col("errors") * 4 > F.col("n"), "investigate").when(F.col("warnings") >= 2, "watch").otherwise("trust").alias("verdict"))


@query(
    "never_recalled",
    "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL) AND c_acctbal > 0",
)
def never_recalled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of value that no one has asked for."""
    asked = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").where("c_acctbal > 0").join(asked, "c_custkey", "left_anti").select("c_custkey")


@query(
    "rank_correlation",
    """WITH v AS (SELECT l_linenumber AS lane, l_orderkey, l_quantity AS a, l_extendedprice AS b FROM lineitem),
    r AS (SELECT lane, rank() OVER (PARTITION BY lane ORDER BY a) + (count(*) OVER (PARTITION BY lane, a) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY lane ORDER BY b) + (count(*) OVER (PARTITION BY lane, b) - 1) / 2.0 AS rb FROM v)
    SELECT CAST(lane AS BIGINT) AS lane, round(corr(ra, rb), 4) AS rho FROM r GROUP BY lane""",
)
def rank_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spearman's rho of two scores, ties by their mean rank."""
    v = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").cast("long").alias("lane"), F.col("l_quantity").alias("a"), F.col("l_extendedprice").alias("b"))
    ranked = v
    for c in ("a", "b"):  # the mean rank of a value's rows, from counts of distinct values
        ranks = cumulative_counts(v, "lane", c).select("lane", c, (F.col("before") + (F.col("n") + 1) / 2).alias(f"r{c}"))
        ranked = ranked.join(ranks, ["lane", c])
    return ranked.groupBy("lane").agg(F.round(F.corr("ra", "rb"), 4).alias("rho"))


@query(
    "observed_use",
    """WITH u AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'user'), a AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'assistant'),
    p AS (SELECT u.conv_id, u.turn, len(list_intersect(list_distinct(regexp_extract_all(lower(u.text), '[\\p{L}\\p{N}]{4,}')), list_distinct(regexp_extract_all(lower(a.text), '[\\p{L}\\p{N}]{4,}')))) AS shared FROM u LEFT JOIN a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1)
    SELECT conv_id, turn, CASE WHEN coalesce(shared, 0) >= 2 THEN 'used' ELSE 'ignored' END AS verdict FROM p""",
)
def observed_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the answer to a turn takes up two of its longer words."""
    long_words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]{4,}"), F.lit(0)))
    turns = table(spark, sf_dir, "conversations")
    asked = turns.where("role = 'user'").select("conv_id", "turn", long_words.alias("w"))
    said = turns.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), long_words.alias("v"))
    shared = F.coalesce(F.size(F.array_intersect("w", "v")), F.lit(0))
    return asked.join(said, ["conv_id", "turn"], "left").select("conv_id", "turn", F.when(shared >= 2, "used").otherwise("ignored").alias("verdict"))
