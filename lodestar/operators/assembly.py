"""Ranking of candidate pools by a formula of capped layers, and the assembly of result pages from them.

A pool is a DataFrame (query, doc, keyword, semantic, ...) that a rank limit of its lanes bounds. Layers re-order what the
lanes found; each is capped so that it can't float what they didn't find relevant.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.functions.scalars import clamp01, proximity, weibull_recency

# What a layer adds for each match, and at most.
LINK_STEP, LINK_CAP, TAG_STEP, TAG_CAP, GRAPH_CAP = 0.02, 0.03, 0.01, 0.02, 0.05
ENTITY_STEP, ENTITY_CAP, ACTIVATION_CAP = 0.02, 0.04, 0.04
COMPANION_STEP, COMPANION_CAP, REUSE_CAP, WINDOW_CAP = 0.005, 0.03, 0.06, 0.06
TIERS = {"core": 1.4, "supporting": 1.0, "peripheral": 0.6}
TRENDS = {"strengthening": 1.05, "weakening": 0.93, "stale": 0.85}
#: Rank fusion's damping; how far a pool is wider than a page.
RRF_K, OVERFETCH, POOL_FLOOR, WIDE_FACTOR, WIDE_FLOOR = 60, 5, 50, 3, 30


@dataclass(frozen=True)
class Weights:
    """How the lanes and layers count. fusion: "linear" (a weighted sum of the lanes) or "rrf" (by their ranks)."""

    keyword: float = 0.6
    semantic: float = 0.4
    fusion: str = "linear"
    keyword_mul: float = 1.0
    semantic_mul: float = 1.0
    entity_mul: float = 1.0
    recency_mul: float = 1.0


#: Columns of a pool that may be missing, with their types and neutral values.
OPTIONAL = {
    "tier": ("string", None), "trend": ("string", None), "age_days": ("double", None), "event": ("double", None), "activation": ("double", 0.0),
    "reuse": ("double", 0.0), "entities": ("long", 0), "tags": ("array<string>", None), "since": ("double", None), "until": ("double", None), "damping": ("double", 1.0), "focus": ("double", 0.0),
}


def _filled(pool: DataFrame) -> DataFrame:
    there = set(pool.columns)
    pool = pool.withColumns({c: F.lit(neutral).cast(kind) for c, (kind, neutral) in OPTIONAL.items() if c not in there})
    return pool.withColumns({c: F.coalesce(c, F.lit(neutral)).cast(kind) for c, (kind, neutral) in OPTIONAL.items() if neutral is not None})


def _looked_up(key: Column, table: dict[str, float]) -> Column:
    found = F.lit(1.0)
    for name, value in table.items():
        found = F.when(key == name, F.lit(value)).otherwise(found)
    return found


def linked_in_pool(pool: DataFrame, links: DataFrame) -> DataFrame:
    """(query, doc, linked): how many other documents of the pool link to each; links has distinct (source, target).

    The pool's documents look up their own links, so that a target that everything links to costs no more than its pool.
    """
    members = pool.select("query", "doc")
    out = members.join(links.where("source <> target").select(F.col("source").alias("doc"), "target"), "doc")
    return out.select("query", F.col("target").alias("doc"), F.col("doc").alias("source")).join(members, ["query", "doc"]).groupBy("query", "doc").agg(F.countDistinct("source").alias("linked"))


def companions_in_pool(pool: DataFrame, companions: DataFrame) -> DataFrame:
    """(query, doc, together): sum of the recorded counts (doc, other, n) over others that are in the same pool."""
    members = pool.select("query", "doc")
    known = members.join(companions.where("doc <> other"), "doc")
    there = members.withColumnRenamed("doc", "other")
    return known.join(there, ["query", "other"], "left_semi").groupBy("query", "doc").agg(F.sum("n").alias("together"))


def tagged_in_pool(pool: DataFrame) -> DataFrame:
    """(query, doc, tagged): how many other documents of the pool share a tag with each; counted as far as the cap asks.

    A tag's documents are counted, not paired: a document that shares one tag with two others or more is at the cap, and
    only those below it are looked at tag by tag.
    """
    tags = pool.where(F.size("tags") > 0).select("query", "doc", F.explode(F.array_distinct("tags")).alias("tag"))
    enough = int(TAG_CAP / TAG_STEP)
    some = tags.groupBy("query", "tag").agg(F.slice(F.sort_array(F.collect_set("doc")), 1, enough + 1).alias("docs"))
    others = tags.join(some, ["query", "tag"]).select("query", "doc", F.explode("docs").alias("other")).where("other <> doc")
    return others.groupBy("query", "doc").agg(F.least(F.countDistinct("other"), F.lit(enough)).alias("tagged"))


def fused(pool: DataFrame, weights: Weights) -> DataFrame:
    """pool with `relevance`: the weighted lanes, or the lanes' reciprocal ranks scaled to 0 to 1 over a query's pool.

    For "rrf" the pool has keyword_rank and semantic_rank, null where a lane lacks a document.
    """
    if weights.fusion == "linear":
        return pool.withColumn("relevance", weights.keyword * weights.keyword_mul * F.col("keyword") + weights.semantic * weights.semantic_mul * F.col("semantic"))
    if weights.fusion != "rrf" or min(weights.keyword_mul, weights.semantic_mul) <= 0:
        raise ValueError("fusion is linear or rrf; the weights of ranked lanes are positive")
    share = lambda lane, mul: F.coalesce(mul / (RRF_K + F.col(f"{lane}_rank")), F.lit(0.0))
    raw = pool.withColumn("raw", share("keyword", weights.keyword_mul) + share("semantic", weights.semantic_mul))
    of = Window.partitionBy("query")
    low, high = F.min("raw").over(of), F.max("raw").over(of)
    return raw.withColumn("relevance", F.when(high == low, F.lit(1.0)).otherwise((F.col("raw") - low) / (high - low))).drop("raw")


def score(pool: DataFrame, weights: Weights = Weights(), links: DataFrame | None = None, companions: DataFrame | None = None) -> DataFrame:  # noqa: B008
    """pool with `score` (0 to 1, six places), every layer by name, and `reasons`, the layers that fired, in words.

    Columns query, doc, keyword and semantic (0 to 1) are needed; those of OPTIONAL are neutral where missing or null: tier
    and trend scale the relevance, activation, reuse, entities, tags, links and companions add up to their caps, age_days
    adds the freshness prior, and a query's window (since, until in seconds) adds the nearness of `event` and damps that prior.
    """
    named = fused(_filled(pool), weights)
    for found in (linked_in_pool(pool, links) if links is not None else None, companions_in_pool(pool, companions) if companions is not None else None, tagged_in_pool(pool) if "tags" in pool.columns else None):
        if found is not None:
            named = named.join(found, ["query", "doc"], "left")
    count = lambda c: F.coalesce(c, F.lit(0)) if c in named.columns else F.lit(0)
    windowed = F.col("since").isNotNull() | F.col("until").isNotNull()
    open_since, open_until = F.coalesce("since", F.col("event")), F.coalesce("until", F.col("event"))
    near = proximity(F.col("event"), open_since, open_until)
    near = F.when(F.greatest(open_since - F.col("event"), F.col("event") - open_until) > 7 * 86400, F.lit(0.0)).otherwise(near)
    layers = {
        "link": F.least(F.lit(GRAPH_CAP), F.least(F.lit(LINK_CAP), count("linked") * LINK_STEP) + F.least(F.lit(TAG_CAP), count("tagged") * TAG_STEP)),
        "recency": F.when(F.col("age_days").isNull(), F.lit(0.0)).otherwise(weibull_recency(F.col("age_days"))) * weights.recency_mul * F.col("damping"),
        "entity": F.least(F.lit(ENTITY_CAP), F.col("entities") * ENTITY_STEP * weights.entity_mul),
        "activated": clamp01(F.col("activation")) * ACTIVATION_CAP,
        "companion": F.least(F.lit(COMPANION_CAP), count("together") * COMPANION_STEP),
        "reused": clamp01(F.col("reuse")) * REUSE_CAP,
        "temporal": F.when(windowed & F.col("event").isNotNull(), near * WINDOW_CAP).when(windowed, F.lit(0.0)),
        "tier_mul": _looked_up(F.coalesce("tier", F.lit("")), TIERS),
        "trend_mul": _looked_up(F.coalesce("trend", F.lit("")), TRENDS),
    }
    told = named.withColumns({c: x.cast("double") for c, x in layers.items()})
    added = F.col("link") + F.col("recency") + F.col("entity") + F.col("activated") + F.col("companion") + F.col("reused") + F.coalesce("temporal", F.lit(0.0)) + F.col("focus")
    total = F.round(clamp01(F.col("relevance") * F.col("tier_mul") * F.col("trend_mul") + added), 6)
    shown = [("keyword", "keyword", 0.0), ("semantic", "semantic", 0.0), ("entity", "entity", 0.0), ("activation", "activated", 0.0), ("co_access", "companion", 0.0), ("reuse", "reused", 0.0)]
    shown += [("trend", "trend_mul", 1.0), ("links", "link", 0.0), ("recency", "recency", 0.0), ("window", "temporal", 0.0), ("tier", "tier_mul", 1.0), ("focus", "focus", 0.0)]
    reasons = F.filter(F.array(*[F.when(F.col(c) != neutral, F.concat(F.lit(f"{name} "), F.format_string("%.3f", F.col(c)))) for name, c, neutral in shown]), lambda r: r.isNotNull())
    return told.withColumn("score", total).withColumn("reasons", reasons)


def assemble(scored: DataFrame, limit: int, floor: float = 0.0, content: str | None = None, visible: str | None = None) -> DataFrame:
    """The page of each query: scored's rows with position, duplicates (rows folded into this one) and widened.

    Rows are taken in order of score (ties by doc) up to a cap, first `limit`. Of rows with one content (null has no
    copies) the best stays; then rows below the floor and those that aren't visible go. Where that leaves a page short
    though the cap cut the pool, and copies or invisible rows are why, the query alone is assembled again up to a wider
    cap. Both passes are windows of one plan over bounded pools.
    """
    wide = max(limit * OVERFETCH, POOL_FLOOR, limit * WIDE_FACTOR, WIDE_FLOOR)
    of, order = Window.partitionBy("query"), Window.partitionBy("query").orderBy(F.desc("score"), "doc")
    ranked = scored.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= wide)
    key = F.col(content) if content else F.lit(None).cast("string")
    ranked = ranked.withColumn("key", F.coalesce(key.cast("string"), F.concat(F.lit("row "), F.col("rn").cast("string"))))
    seen = F.coalesce(F.col(visible), F.lit(True)) if visible else F.lit(True)
    ranked = ranked.withColumns({"first": F.col("rn") == F.min("rn").over(Window.partitionBy("query", "key")), "seen": seen})
    narrow = F.col("rn") <= limit
    kept = F.col("first") & (F.col("score") >= floor)
    number = lambda c: F.count(F.when(c, 1)).over(of)
    told = ranked.withColumns({"left": number(narrow & kept & F.col("seen")), "before": number(narrow & kept), "folded": number(narrow & ~F.col("first")), "full": number(narrow) >= limit})
    told = told.withColumn("widened", (F.col("left") < limit) & F.col("full") & ((F.col("left") < F.col("before")) | (F.col("folded") > 0)))
    cut = told.where(narrow | F.col("widened"))
    cut = cut.withColumn("duplicates", F.count("*").over(Window.partitionBy("query", "key")) - 1).where(kept & F.col("seen"))
    page = cut.withColumn("position", F.row_number().over(Window.partitionBy("query").orderBy("rn"))).where(F.col("position") <= limit)
    return page.drop("rn", "key", "first", "seen", "left", "before", "folded", "full").withColumn("position", F.col("position").cast(T.LongType()))
