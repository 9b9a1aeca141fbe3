"""The link graph of pages: a page links to the targets of its href attributes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.operators.graph import chain_tips, fan_out, propagate_labels, undirected
from lodestar.registry import query, table

_HREF = r'href="([^"]*)"'
_LINKS = f"links AS (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, '{_HREF}', 1)) AS target FROM pages),"


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (page_id, target)."""
    found = F.regexp_extract_all("html", F.lit(_HREF), F.lit(1))
    return table(spark, sf_dir, "pages").select("page_id", F.explode(F.array_distinct(found)).alias("target"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as edges (u, v) between named nodes."""
    return links(spark, sf_dir).select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("u"), F.col("target").alias("v"))


@query("link_extract", f"SELECT page_id, unnest(regexp_extract_all(html, '{_HREF}', 1)) AS target FROM pages")
def link_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every href of every page, in order, repeats included."""
    return table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit(_HREF), F.lit(1))).alias("target"))


@query("link_degree", f"WITH {_LINKS} x AS (SELECT 1) SELECT target, count(*) AS inbound, min(page_id) AS first_source FROM links GROUP BY target")
def link_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links(spark, sf_dir).groupBy("target").agg(F.count("*").alias("inbound"), F.min("page_id").alias("first_source"))


@query("degree_filter", f"WITH {_LINKS} o AS (SELECT page_id, count(*) AS outlinks FROM links GROUP BY page_id) SELECT page_id, url, coalesce(outlinks, 0) AS outlinks FROM pages LEFT JOIN o USING (page_id) WHERE coalesce(outlinks, 0) >= 5")
def degree_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of at least five distinct links; a page without links has none."""
    out = links(spark, sf_dir).groupBy("page_id").agg(F.count("*").alias("outlinks"))
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return pages.join(out, "page_id", "left").withColumn("outlinks", F.coalesce("outlinks", F.lit(0))).where("outlinks >= 5")


@query("graph_stats", f"WITH {_LINKS} x AS (SELECT 1) SELECT count(DISTINCT page_id) AS sources, count(DISTINCT target) AS targets, count(*) AS edges FROM links")
def graph_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links(spark, sf_dir).agg(F.countDistinct("page_id").alias("sources"), F.countDistinct("target").alias("targets"), F.count("*").alias("edges"))


@query("navmap", f"WITH {_LINKS} x AS (SELECT 1) SELECT target, count(*) AS degree FROM links GROUP BY target ORDER BY degree DESC, target LIMIT 15")
def navmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifteen targets of the highest degree."""
    return links(spark, sf_dir).groupBy("target").agg(F.count("*").alias("degree")).orderBy(F.desc("degree"), "target").limit(15)


@query("backlinks", f"WITH {_LINKS} x AS (SELECT 1) SELECT target, list_aggregate(list_sort(list(page_id)), 'string_agg', ',') AS sources FROM links GROUP BY target")
def backlinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sources of each target in order."""
    return links(spark, sf_dir).groupBy("target").agg(F.array_join(F.sort_array(F.collect_set("page_id")).cast("array<string>"), ",").alias("sources"))


@query("unresolved_links", f"WITH {_LINKS} h AS (SELECT DISTINCT '/' || regexp_extract(url, '^https?://[^/]+/([^/?#]*)', 1) AS path FROM pages) SELECT count(*) AS total, count(*) FILTER (WHERE path IS NULL) AS unresolved FROM links LEFT JOIN h ON h.path = links.target")
def unresolved_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links in all, and those whose target is no page's path."""
    paths = table(spark, sf_dir, "pages").select(F.concat(F.lit("/"), F.regexp_extract("url", r"^https?://[^/]+/([^/?#]*)", 1)).alias("target")).distinct().withColumn("known", F.lit(1))
    return links(spark, sf_dir).join(paths, "target", "left").agg(F.count("*").alias("total"), F.count(F.when(F.col("known").isNull(), 1)).alias("unresolved"))


@query(
    "pmi_edges",
    f"""WITH {_LINKS} n AS (SELECT count(DISTINCT page_id) AS n FROM links), d AS (SELECT target, count(*) AS df FROM links GROUP BY target),
    p AS (SELECT a.target AS a, b.target AS b, count(*) AS co FROM links a JOIN links b ON a.page_id = b.page_id AND a.target < b.target GROUP BY ALL)
    SELECT a, b, co, round(log2(co * n / (da.df * db.df)), 6) AS pmi FROM p JOIN d da ON da.target = a JOIN d db ON db.target = b, n WHERE co >= 2""",
)
def pmi_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets that pages link together twice or more, by pointwise mutual information; a page has few links."""
    found = links(spark, sf_dir)
    df = found.groupBy("target").agg(F.count("*").alias("df"))
    total = found.agg(F.countDistinct("page_id").alias("n"))
    a, b = found.withColumnRenamed("target", "a"), found.withColumnRenamed("target", "b")
    pairs = a.join(b, "page_id").where("a < b").groupBy("a", "b").agg(F.count("*").alias("co")).where("co >= 2")
    rated = pairs.join(df.select(F.col("target").alias("a"), F.col("df").alias("da")), "a").join(df.select(F.col("target").alias("b"), F.col("df").alias("db")), "b").crossJoin(F.broadcast(total))
    return rated.select("a", "b", "co", F.round(F.log2(F.col("co") * F.col("n") / (F.col("da") * F.col("db"))), 6).alias("pmi"))


@query(
    "fanout",
    f"""WITH {_LINKS} e AS (SELECT 'p' || page_id AS u, target AS v FROM links UNION SELECT target, 'p' || page_id FROM links),
    s AS (SELECT 'p' || page_id AS seed FROM pages WHERE page_id % 50 = 0),
    h1 AS (SELECT DISTINCT seed, v AS node FROM s JOIN e ON e.u = seed WHERE v <> seed),
    h2 AS (SELECT DISTINCT seed, e.v AS node FROM h1 JOIN e ON e.u = node WHERE e.v <> seed EXCEPT SELECT seed, node FROM h1)
    SELECT seed, hop, count(*) AS nodes FROM (SELECT seed, node, 1 AS hop FROM h1 UNION ALL SELECT seed, node, 2 FROM h2 UNION ALL SELECT seed, seed, 0 FROM s) GROUP BY ALL""",
)
def fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes at each depth up to two around the stated seeds (pages whose id is divisible by 50)."""
    both = undirected(edges(spark, sf_dir))
    seeds = table(spark, sf_dir, "pages").where("page_id % 50 = 0").select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("seed"))
    return fan_out(both, seeds, 2).groupBy("seed", "hop").agg(F.count("*").alias("nodes"))


@query(
    "decayed_traversal",
    f"""WITH {_LINKS} s AS (SELECT page_id AS seed FROM pages WHERE page_id % 50 = 0),
    h AS (SELECT seed, b.page_id AS node, count(*) AS edges FROM s JOIN links a ON a.page_id = seed JOIN links b ON b.target = a.target AND b.page_id <> seed GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY edges DESC, node) AS rn FROM h)
    SELECT seed, node, edges, round(0.5 + least(0.49, 0.05 * edges), 6) AS score FROM r WHERE rn <= 3""",
)
def decayed_traversal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From each seed the three pages that share most targets with it; a hop halves the score, more edges raise it."""
    found = links(spark, sf_dir)
    seeds = found.where("page_id % 50 = 0").select(F.col("page_id").alias("seed"), "target")
    near = seeds.join(found, "target").where("page_id <> seed").groupBy("seed", F.col("page_id").alias("node")).agg(F.count("*").alias("edges"))
    best = Window.partitionBy("seed").orderBy(F.desc("edges"), "node")
    return near.withColumn("rn", F.row_number().over(best)).where("rn <= 3").select("seed", "node", "edges", F.round(0.5 + F.least(F.lit(0.49), 0.05 * F.col("edges")), 6).alias("score"))


def _round_sql(before: str, after: str) -> str:
    return f"{after} AS (SELECT node, label FROM (SELECT e.u AS node, l.label, row_number() OVER (PARTITION BY e.u ORDER BY count(*) DESC, l.label) AS rn FROM e JOIN {before} l ON l.node = e.v GROUP BY e.u, l.label) WHERE rn = 1)"


@query(
    "communities",
    f"""WITH {_LINKS} e AS MATERIALIZED (SELECT 'p' || page_id AS u, target AS v FROM links UNION SELECT target, 'p' || page_id FROM links),
    l0 AS (SELECT DISTINCT u AS node, u AS label FROM e), {", ".join(_round_sql(f"l{i}", f"l{i + 1}") for i in range(4))}
    SELECT label, count(*) AS members FROM l4 GROUP BY label HAVING count(*) >= 4""",
)
def communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Communities of four nodes or more after four rounds of label propagation."""
    return propagate_labels(edges(spark, sf_dir), 4).groupBy("label").agg(F.count("*").alias("members")).where("members >= 4")


@query(
    "supersede_tips",
    """WITH t AS (SELECT doc_id, md5(coalesce(text, '')) AS h FROM documents), n AS (SELECT doc_id, max(doc_id) OVER (PARTITION BY h) AS tip, count(*) OVER (PARTITION BY h ORDER BY doc_id DESC) - 1 AS hops, count(*) OVER (PARTITION BY h) AS c FROM t)
    SELECT doc_id AS node, tip, hops FROM n WHERE c > 1""",
)
def supersede_tips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document that a later copy supersedes, and the last copy, by following one link at a time."""
    later = Window.partitionBy(F.md5(F.coalesce("text", F.lit("")).cast("binary"))).orderBy("doc_id")
    chain = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("node"), F.lead("doc_id").over(later).alias("next")).where("next IS NOT NULL")
    return chain_tips(chain)


@query(
    "graph_holdout",
    f"""WITH {_LINKS} pairs AS (SELECT page_id AS a, page_id + 1 AS b FROM pages WHERE page_id % 50 = 0),
    two AS (SELECT DISTINCT a.page_id AS a, b.page_id AS b FROM links a JOIN links b USING (target) WHERE a.page_id % 50 = 0)
    SELECT pairs.a, pairs.b, CASE WHEN two.a IS NOT NULL THEN 'two_hop' WHEN pairs.b NOT IN (SELECT page_id FROM pages) THEN 'dangling' ELSE 'unreached' END AS reach FROM pairs LEFT JOIN two ON two.a = pairs.a AND two.b = pairs.b""",
)
def graph_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether held-out pairs of pages are two hops apart, by way of a shared target."""
    found, pages = links(spark, sf_dir), table(spark, sf_dir, "pages").select("page_id")
    pairs = pages.where("page_id % 50 = 0").select(F.col("page_id").alias("a"), (F.col("page_id") + 1).alias("b"))
    ends = pairs.join(found.withColumnRenamed("page_id", "a"), "a").join(found.select(F.col("page_id").alias("b"), "target"), ["b", "target"]).select("a", "b").distinct().withColumn("two", F.lit(1))
    there = pages.select(F.col("page_id").alias("b")).distinct().withColumn("there", F.lit(1))
    told = pairs.join(ends, ["a", "b"], "left").join(there, "b", "left")
    return told.select("a", "b", F.when(F.col("two") == 1, "two_hop").when(F.col("there").isNull(), "dangling").otherwise("unreached").alias("reach"))
