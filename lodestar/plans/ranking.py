"""Ranking of hybrid pools by the whole formula, pages with widening, coverage reports and the second pass."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.functions.scalars import half_life, significant_terms, word_set
from lodestar.operators import snippets
from lodestar.operators.assembly import Weights, assemble, score
from lodestar.operators.coverage import completeness, evidence_union, numbered_terms, second_pass, term_coverage
from lodestar.operators.lexical import Postings, index_terms, query_terms, top
from lodestar.operators.vectors import knn
from lodestar.plans.retrieval import _BM25, _KW, _NORM, _SEM, _lanes, normalized
from lodestar.registry import query, table

NOW = "2001-12-01"
#: Sessions that read a document: the orders that have its part; its links: the suppliers of these parts.
_SIGNALS = f"""
uses AS (SELECT l_partkey AS doc, count(*) AS n, max(l_shipdate) AS last, count(*) FILTER (WHERE l_returnflag = 'A') AS good, count(*) FILTER (WHERE l_returnflag = 'R') AS bad FROM lineitem GROUP BY ALL),
links AS (SELECT DISTINCT l_partkey AS source, l_suppkey AS target FROM lineitem WHERE l_partkey <> l_suppkey),
visits AS (SELECT DISTINCT l_orderkey AS session, l_partkey AS doc FROM lineitem),
pool AS (SELECT b.query, b.doc, b.keyword, b.semantic, md5(coalesce(d.text, '')) AS content, list_value(d.source) AS tags, coalesce(l.quality = 1, TRUE) AS visible,
  CASE WHEN d.n_chars >= 2000 THEN 1.4 WHEN d.n_chars >= 200 THEN 1.0 ELSE 0.6 END AS tier_mul,
  CASE WHEN l.toxic = 1 THEN 0.85 WHEN l.quality = 1 THEN 1.05 WHEN l.quality = 0 THEN 0.93 ELSE 1.0 END AS trend_mul,
  epoch(TIMESTAMP '{NOW}' - u.last) / 86400.0 AS age, epoch(u.last) AS event, coalesce(u.n, 0) / 60.0 AS strength, CASE WHEN good + bad > 0 THEN good / (good + bad) ELSE 0 END AS reuse,
  len(list_intersect(list_distinct(regexp_extract_all(coalesce(d.text, ''), '\\b[A-Z][a-z]+')), list_distinct(regexp_extract_all(q.text, '\\b[A-Z][a-z]+')))) AS entities,
  CASE WHEN b.query % 4 = 0 THEN epoch(TIMESTAMP '1998-01-01') END AS since, CASE WHEN b.query % 4 = 0 THEN epoch(TIMESTAMP '1998-12-31') END AS until
  FROM both_lanes b JOIN documents d ON d.doc_id = b.doc JOIN benchmark q ON q.item_id = b.query LEFT JOIN uses u ON u.doc = b.doc LEFT JOIN labels l ON l.doc_id = b.doc),
linked AS (SELECT p.query, p.doc, count(DISTINCT l.source) AS n FROM pool p JOIN links l ON l.target = p.doc JOIN pool s ON s.query = p.query AND s.doc = l.source GROUP BY ALL),
tagged AS (SELECT p.query, p.doc, count(*) AS n FROM pool p JOIN pool s ON s.query = p.query AND s.doc <> p.doc AND s.tags = p.tags AND p.tags[1] IS NOT NULL GROUP BY ALL),
together AS (SELECT p.query, p.doc, count(*) AS n FROM pool p JOIN visits a ON a.doc = p.doc JOIN visits b ON b.session = a.session AND b.doc <> a.doc JOIN pool s ON s.query = p.query AND s.doc = b.doc GROUP BY ALL),
layers AS (SELECT p.*, least(0.05, least(0.03, 0.02 * coalesce(k.n, 0)) + least(0.02, 0.01 * coalesce(t.n, 0))) AS link,
  CASE WHEN age IS NULL OR 0.05 * exp(-pow(greatest(age, 0) / 30, 0.8)) < 0.0005 THEN 0 ELSE 0.05 * exp(-pow(greatest(age, 0) / 30, 0.8)) END * CASE WHEN since IS NULL THEN 1 ELSE 0.5 END AS recency,
  least(0.04, 0.02 * entities) AS entity, 0.04 * least(1, coalesce(strength * pow(2, -greatest(age, 0) / 30), 0)) AS activated, least(0.03, 0.005 * coalesce(c.n, 0)) AS companion, 0.06 * reuse AS reused,
  CASE WHEN since IS NOT NULL THEN CASE WHEN greatest(since - event, event - until, 0) > 7 * 86400 OR event IS NULL THEN 0 ELSE 0.06 * (1 - greatest(since - event, event - until, 0) / 86400.0 / 8) END END AS temporal
  FROM pool p LEFT JOIN linked k USING (query, doc) LEFT JOIN tagged t USING (query, doc) LEFT JOIN together c USING (query, doc)),
rated AS (SELECT *, round(least(1.0, greatest(0.0, (0.6 * keyword + 0.4 * semantic) * tier_mul * trend_mul + link + recency + entity + activated + companion + reused + coalesce(temporal, 0))), 6) AS score FROM layers),
"""
_RANKED = f"WITH {_BM25} {_KW} {_SEM} {_NORM} {_SIGNALS}"


def signals(spark: SparkSession, sf_dir: str, fusion: str = "linear") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pool, links, companions) of the benchmark's queries: both lanes' documents with all signals that the tables state."""
    keyword, semantic = _lanes(spark, sf_dir)
    lanes = (
        normalized(keyword).select("query", "doc", F.col("norm").alias("k"), F.col("rank").alias("keyword_rank"))
        .join(semantic.select("query", "doc", F.col("score").alias("s"), F.col("rank").alias("semantic_rank")), ["query", "doc"], "full_outer")
        .withColumns({"keyword": F.coalesce("k", F.lit(0.0)), "semantic": F.greatest(F.lit(0.0), F.coalesce("s", F.lit(0.0)))}).drop("k", "s")
    )
    items = table(spark, sf_dir, "lineitem")
    uses = items.groupBy(F.col("l_partkey").alias("doc")).agg(
        F.count("*").alias("n"), F.max("l_shipdate").alias("last"), F.count(F.when(F.col("l_returnflag") == "A", 1)).alias("good"), F.count(F.when(F.col("l_returnflag") == "R", 1)).alias("bad")
    )
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text", "source", "n_chars")
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), F.col("text").alias("asked"))
    marks = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("doc"), "quality", "toxic")
    seconds = lambda c: c.cast("timestamp").cast("double")
    age = (seconds(F.lit(NOW)) - seconds(F.col("last"))) / 86400
    names = lambda c: F.array_distinct(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"\b[A-Z][a-z]+"), F.lit(0)))
    historical = F.col("query") % 4 == 0
    pool = lanes.join(docs, "doc").join(asked, "query").join(uses, "doc", "left").join(marks, "doc", "left")
    rated = pool.select(
        "query", "doc", "keyword", "semantic", "keyword_rank", "semantic_rank", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("content"), F.array("source").alias("tags"),
        F.coalesce(F.col("quality") == 1, F.lit(True)).alias("visible"), F.when(F.col("n_chars") >= 2000, "core").when(F.col("n_chars") >= 200, "supporting").otherwise("peripheral").alias("tier"),
        F.when(F.col("toxic") == 1, "stale").when(F.col("quality") == 1, "strengthening").when(F.col("quality") == 0, "weakening").alias("trend"), age.alias("age_days"), seconds(F.col("last")).alias("event"),
        half_life(F.coalesce("n", F.lit(0)) / 60.0, age, 30.0).alias("activation"), F.when(F.col("good") + F.col("bad") > 0, F.col("good") / (F.col("good") + F.col("bad"))).alias("reuse"),
        F.size(F.array_intersect(names(F.col("text")), names(F.col("asked")))).cast("long").alias("entities"),
        F.when(historical, seconds(F.lit("1998-01-01"))).alias("since"), F.when(historical, seconds(F.lit("1998-12-31"))).alias("until"), F.when(historical, 0.5).otherwise(1.0).alias("damping"),
    )
    links = items.where("l_partkey <> l_suppkey").select(F.col("l_partkey").alias("source"), F.col("l_suppkey").alias("target")).distinct()
    visits = items.select(F.col("l_orderkey").alias("session"), F.col("l_partkey").alias("doc")).distinct()
    read = visits.join(rated.select("doc").distinct(), "doc", "left_semi")  # only pooled documents can be companions
    companions = read.join(read.withColumnRenamed("doc", "other"), "session").where("doc <> other").groupBy("doc", "other").agg(F.count("*").alias("n"))
    return rated, links, companions


_LAYERS = "query, doc, score, round(keyword, 6) AS keyword, round(semantic, 6) AS semantic, round(link, 6) AS link, round(recency, 6) AS recency, round(entity, 6) AS entity, round(activated, 6) AS activated, round(companion, 6) AS companion, round(reused, 6) AS reused, round(temporal, 6) AS temporal, tier_mul, trend_mul"


@query("ranked_search", f"{_RANKED} r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM rated) SELECT {_LAYERS}, rank FROM r WHERE rank <= 10")
def ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best of each pool by the whole formula, with what every layer gave."""
    pool, links, companions = signals(spark, sf_dir)
    layers = ["keyword", "semantic", "link", "recency", "entity", "activated", "companion", "reused", "temporal"]
    scored = score(pool, Weights(), links, companions).select("query", "doc", "score", *[F.round(c, 6).alias(c) for c in layers], "tier_mul", "trend_mul")
    return top(scored, "query", "score", "doc", 10).withColumn("rank", F.col("rank").cast("long"))


def _page_sql(source: str, limit: int, floor: float) -> str:
    """The page by its definition: the narrow cap's page, or where that rule asks for it the wide cap's."""
    return f"""rn AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rn FROM {source}),
    caps AS (SELECT * FROM (VALUES ({limit}), ({max(5 * limit, 50)})) c(cap)),
    taken AS (SELECT r.*, cap, row_number() OVER (PARTITION BY query, cap, content ORDER BY rn) AS copy, count(*) OVER (PARTITION BY query, cap, content) - 1 AS duplicates FROM rn r JOIN caps ON r.rn <= cap),
    sizes AS (SELECT query, count(*) AS taken, count(*) FILTER (WHERE copy > 1) AS folded, count(*) FILTER (WHERE copy = 1 AND score >= {floor}) AS before, count(*) FILTER (WHERE copy = 1 AND score >= {floor} AND visible) AS shown FROM taken WHERE cap = {limit} GROUP BY query),
    chosen AS (SELECT query, shown < {limit} AND taken >= {limit} AND (shown < before OR folded > 0) AS widened FROM sizes),
    page AS (SELECT t.query, t.doc, t.score, t.duplicates, c.widened, row_number() OVER (PARTITION BY t.query ORDER BY rn) AS position FROM taken t JOIN chosen c USING (query) WHERE copy = 1 AND score >= {floor} AND visible AND cap = CASE WHEN widened THEN {max(5 * limit, 50)} ELSE {limit} END)
    SELECT query, doc, score, duplicates, widened, position FROM page WHERE position <= {limit}"""


@query("assembled_pages", f"{_RANKED} {_page_sql('rated', 10, 0.3)}")
def assembled_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of ten: copies folded, a floor of .3, hidden documents out, and a second, wider pass for pages left short."""
    pool, links, companions = signals(spark, sf_dir)
    return assemble(score(pool, Weights(), links, companions), 10, 0.3, "content", "visible").select("query", "doc", "score", "duplicates", "widened", "position")


@query(
    "ranked_rrf",
    f"""{_RANKED} raw AS (SELECT l.*, coalesce(0.8 / (60 + kw.rank), 0) + coalesce(1.2 / (60 + sem.rank), 0) AS raw FROM layers l LEFT JOIN kw USING (query, doc) LEFT JOIN sem USING (query, doc)),
    fuse AS (SELECT *, CASE WHEN max(raw) OVER p = min(raw) OVER p THEN 1 ELSE (raw - min(raw) OVER p) / (max(raw) OVER p - min(raw) OVER p) END AS relevance FROM raw WINDOW p AS (PARTITION BY query)),
    s AS (SELECT query, doc, round(relevance, 6) AS relevance, round(least(1.0, greatest(0.0, relevance * tier_mul * trend_mul + link + recency + entity + activated + companion + reused + coalesce(temporal, 0))), 6) AS score FROM fuse)
    SELECT query, doc, relevance, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM s QUALIFY rank <= 10""",
)
def ranked_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ranked_search with lanes fused by rank, the semantic one counting half as much again as the keyword one."""
    pool, links, companions = signals(spark, sf_dir)
    scored = score(pool, Weights(fusion="rrf", keyword_mul=0.8, semantic_mul=1.2), links, companions)
    return top(scored.select("query", "doc", F.round("relevance", 6).alias("relevance"), "score"), "query", "score", "doc", 10).withColumn("rank", F.col("rank").cast("long"))


_POOL = f"""WITH {_BM25} {_SEM}
ordered AS (SELECT query, pos - 1 AS pos, term FROM (SELECT item_id AS query, unnest(t) AS term, generate_subscripts(t, 1) AS pos FROM (SELECT item_id, list_transform(list_sort(list_distinct(list_transform(list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+'), lambda w: length(w) >= 3), lambda w: {{'at': list_position(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+'), w), 'w': w}}))), lambda x: x.w) AS t FROM benchmark))),
both_hits AS (SELECT query, doc, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM found JOIN (SELECT query, count(*) AS wanted FROM q GROUP BY query) USING (query) WHERE matched = wanted QUALIFY rank <= 3),
near AS (SELECT query, doc, rank FROM sem WHERE rank <= 3),
first AS (SELECT query, doc, row_number() OVER (PARTITION BY query ORDER BY lane, rank) AS rank FROM (SELECT query, doc, rank, 0 AS lane FROM both_hits UNION ALL SELECT query, doc, rank, 1 FROM near ANTI JOIN both_hits USING (query, doc))),
report AS (SELECT o.query, o.pos, o.term, coalesce(df, 0) AS df, ln(1 + n_docs / (1 + coalesce(df, 0))) AS idf, coalesce(df, 0) <= greatest(1, floor(0.02 * n_docs)) AS rare,
  EXISTS (SELECT 1 FROM first f JOIN documents d ON d.doc_id = f.doc WHERE f.query = o.query AND contains(lower(d.text), o.term)) AS covered FROM ordered o LEFT JOIN df USING (term), corpus),
summary AS (SELECT query, round(CASE WHEN sum(idf) = 0 THEN 1 ELSE sum(CASE WHEN covered THEN idf ELSE 0 END) / sum(idf) END, 6) AS coverage FROM report GROUP BY query),
"""


def _first_pass(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, Postings]:
    """(terms, first hits, coverage report, postings): documents with all terms of a query, then near ones, three each."""
    docs, asked = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    postings = index_terms(docs, query_terms(asked, "item_id", "text"), "doc_id", "text")
    terms = numbered_terms(asked, "item_id", significant_terms(F.col("text")))
    strict = top(postings.bm25(terms.select("query", "term"), all_terms=True), "query", "score", "doc", 3)
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    probes = asked.select(F.col("item_id").alias("query")).join(vectors.select(F.col("vec_id").alias("query"), F.col("embedding").alias("probe")), "query")
    near = knn(probes, vectors.withColumnRenamed("vec_id", "doc"), 3)
    more = near.join(strict.select("query", "doc"), ["query", "doc"], "left_anti")
    lanes = strict.select("query", "doc", "rank", F.lit(0).alias("lane")).unionByName(more.select("query", "doc", "rank", F.lit(1).alias("lane")))
    first = lanes.select("query", "doc", F.row_number().over(Window.partitionBy("query").orderBy("lane", "rank")).alias("rank"))
    return terms, first, term_coverage(terms, first, docs.select(F.col("doc_id").alias("doc"), "text"), postings), postings


_LISTED = "coalesce(string_agg(term, ' ' ORDER BY pos) FILTER (WHERE {}), '')"


@query(
    "recall_completeness",
    f"{_POOL} x AS (SELECT 1) SELECT query, coverage, CASE WHEN coverage >= 0.8 THEN 'complete' WHEN coverage >= 0.4 THEN 'partial' ELSE 'sparse' END AS verdict, {_LISTED.format('covered')} AS covered, {_LISTED.format('NOT covered AND df > 0')} AS missing, {_LISTED.format('NOT covered AND rare AND coverage < 0.8')} AS retry FROM report JOIN summary USING (query) GROUP BY query, coverage",
)
def recall_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the first hits of each query cover, its verdict, and the terms that a second pass asks for."""
    _, _, report, _ = _first_pass(spark, sf_dir)
    return completeness(report).select("query", "coverage", "verdict", *[F.array_join(c, " ").alias(c) for c in ("covered", "missing", "retry")])


@query(
    "second_pass",
    f"""{_POOL} asked AS (SELECT query, term, 'targeted' AS kind FROM report JOIN summary USING (query) WHERE NOT covered AND rare AND coverage < 0.8 AND query IN (SELECT query FROM first)
      UNION ALL SELECT query, term, 'broadened' FROM ordered WHERE query NOT IN (SELECT query FROM first) AND query IN (SELECT query FROM ordered GROUP BY query HAVING count(*) > 1)),
    again AS (SELECT query, kind, doc, round(sum(weight), 6) AS score FROM asked JOIN scored USING (term) GROUP BY ALL),
    best AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM again QUALIFY rank <= 15),
    u AS (SELECT query, doc, rank, 'first' AS kind, 0 AS later FROM first UNION ALL SELECT query, doc, rank, kind, 1 FROM best ANTI JOIN first USING (query, doc))
    SELECT query, doc, row_number() OVER (PARTITION BY query ORDER BY later, rank, doc) AS position, kind FROM u""",
)
def second_pass_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First hits in their places, then up to fifteen documents of a second pass for rare terms that they miss."""
    terms, first, report, postings = _first_pass(spark, sf_dir)
    return second_pass(terms, first, report, postings, 15)


@query(
    "evidence_union",
    f"""{_POOL} missing AS (SELECT query, pos, term FROM report WHERE NOT covered AND df > 0),
    best AS (SELECT term, doc, row_number() OVER (PARTITION BY term ORDER BY round(weight, 6) DESC, doc) AS rank FROM scored QUALIFY rank <= 2),
    u AS (SELECT query, pos, term, doc, rank, row_number() OVER (PARTITION BY query ORDER BY pos, rank) AS n FROM missing JOIN best USING (term))
    SELECT query, pos, term, doc, rank FROM u WHERE n <= 8""",
)
def evidence_union_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each term that the first hits of a query miss two documents that hold it, up to eight a query."""
    _, _, report, postings = _first_pass(spark, sf_dir)
    return evidence_union(report, postings)


_RERANK = rf"""{_BM25} pool AS (SELECT query, doc, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM found QUALIFY rank <= 20),
    t AS (SELECT p.query, p.doc, p.rank, d.text, b.text AS asked, list_distinct(regexp_extract_all(lower(b.text), '[\p{{L}}\p{{N}}]{{2,}}')) AS q, regexp_extract_all(lower(coalesce(d.text, '')), '[\p{{L}}\p{{N}}]{{2,}}') AS w FROM pool p JOIN documents d ON d.doc_id = p.doc JOIN benchmark b ON b.item_id = p.query),
    s AS (SELECT *, list_filter(list_transform(q, lambda x: coalesce(list_position(w, x), 0)), lambda x: x > 0) AS spots, list_sum(list_transform(q, lambda x: least(3, len(list_filter(w, lambda y: y = x))))) AS often FROM t),
    r AS (SELECT *, round(CASE WHEN len(q) = 0 OR len(spots) = 0 THEN 0 ELSE least(1, 0.6 * len(spots) / len(q) + 0.25 * CASE WHEN len(spots) > 1 THEN least(1, len(spots) / (list_max(spots) - list_min(spots) + 1)) ELSE len(spots) / len(q) END + 0.15 * often / (3 * len(q))) END, 6) AS rerank FROM s)"""


def _reread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty best documents of each query with their texts and the rerank's score."""
    docs, asked = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    postings = index_terms(docs, query_terms(asked, "item_id", "text"), "doc_id", "text")
    pool = top(postings.bm25(query_terms(asked, "item_id", "text")), "query", "score", "doc", 20)
    texts = pool.join(docs.select(F.col("doc_id").alias("doc"), "text"), "doc").join(asked.select(F.col("item_id").alias("query"), F.col("text").alias("asked")), "query")
    return texts.withColumn("rerank", F.round(snippets.rerank_score(F.col("asked"), F.col("text")), 6))


@query("reranked_pool", f"WITH {_RERANK} SELECT query, doc, rerank, rank, row_number() OVER (PARTITION BY query ORDER BY rerank DESC, rank) AS position FROM r")
def reranked_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keyword pools in the order of the lexical rerank; documents of one score keep their order."""
    order = Window.partitionBy("query").orderBy(F.desc("rerank"), "rank")
    return _reread(spark, sf_dir).select("query", "doc", "rerank", F.col("rank").cast("long").alias("rank"), F.row_number().over(order).cast("long").alias("position"))


@query(
    "result_snippets",
    rf"""WITH {_RERANK}, best AS (SELECT * FROM r WHERE rank <= 5),
    terms AS (SELECT *, list_distinct(list_filter(regexp_extract_all(lower(asked), '[\p{{L}}\p{{N}}]+'), lambda x: length(x) >= 3)) AS ts, list_distinct(list_filter(regexp_split_to_array(lower(asked), '[^\p{{L}}\p{{N}}_-]+'), lambda x: length(x) > 1)) AS subject FROM best),
    placed AS (SELECT *, coalesce(list_min(list_filter(list_transform(ts, lambda x: strpos(lower(text), x)), lambda x: x > 0)) - 1, -1) AS start FROM terms),
    cut AS (SELECT *, CASE WHEN length(text) <= 160 OR start < 0 THEN 0 ELSE greatest(0, start - 80) END AS a,
      list_filter(list_transform(string_split_regex(replace(regexp_replace(text, '([.!?。！？])\s+', '\1' || chr(10), 'g'), chr(13), chr(10)), '\n+'), lambda x: trim(x)), lambda x: x <> '') AS spans FROM placed)
    SELECT query, doc, start AS match_at, CASE WHEN a > 0 THEN '…' ELSE '' END || substr(text, a + 1, 160) || CASE WHEN a + 160 < length(text) THEN '…' ELSE '' END AS snippet,
      list_max(list_transform(spans, lambda x, i: {{'n': len(list_intersect(list_distinct(list_filter(regexp_split_to_array(lower(x), '[^\p{{L}}\p{{N}}_-]+'), lambda w: length(w) > 1)), subject)), 'early': -i, 'span': x}}))['span'] AS span FROM cut""",
)
def result_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For the five best documents of each query where the first match stands, 160 characters around it, and the best span."""
    best = _reread(spark, sf_dir).where("rank <= 5").withColumn("match_at", snippets.match_offset(F.col("text"), significant_terms(F.col("asked"))))
    return best.select("query", "doc", F.col("match_at").cast("long").alias("match_at"), snippets.snippet(F.col("text"), F.col("match_at"), 160).alias("snippet"), snippets.best_span(F.col("text"), word_set(F.col("asked"))).alias("span"))
