"""Walks from hits over links: greedy expansion with a decay a hop, typed fan-out, and the bridge to a query's window."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.scalars import proximity
from lodestar.session import materialize

#: Hits that a walk starts from; score of richness a typed edge, and at most, which is below the gap between two hops.
SEEDS, RICHNESS, MOST_RICHNESS = 10, 0.05, 0.49
#: Rows of a hub that are ordered at once, before its first targets are.
SALTS = 32


def first_targets(links: DataFrame, sources: DataFrame, most: int) -> DataFrame:
    """(source, targets): the `most` least targets of each of sources (source), other than itself; hubs are split first."""
    own = links.where("source <> target").join(sources.distinct(), "source", "left_semi").select("source", "target").distinct()
    salted = own.withColumn("salt", F.pmod(F.xxhash64("target"), F.lit(SALTS)))
    some = salted.withColumn("n", F.row_number().over(Window.partitionBy("source", "salt").orderBy("target"))).where(F.col("n") <= most)
    best = some.withColumn("n", F.row_number().over(Window.partitionBy("source").orderBy("target"))).where(F.col("n") <= most)
    return best.groupBy("source").agg(F.sort_array(F.collect_list("target")).alias("targets"))


def expand(hits: DataFrame, links: DataFrame, hops: int = 1, decay: float = 0.5, per_hit: int = 3, seeds: int = SEEDS) -> DataFrame:
    """hits (query, doc, score, rank) as (query, doc, score, hop, origin), and the documents that links lead to from the first of them.

    From the `seeds` best hits of a query a walk of `hops` steps follows, from each document it stands on and in order of
    arrival, the first `per_hit` links (by target) to documents that are neither hits nor reached at an equal or better
    score. A step multiplies the score by decay; origin is the document a step came from, null for hits (hop 0).

    A query's hits must be a page or pool of bounded size. A document needs to know no more of its targets than the hits
    and documents reached so far could take away, so a hub costs no more than that; each step reads the links of the
    documents that it stands on.
    """
    if hops < 0 or per_hit < 0 or not 0 < decay <= 1:
        raise ValueError("hops and links a hit aren't negative, the decay is over 0 and at most 1")
    page = materialize(hits.select("query", F.col("doc").cast("long").alias("doc"), F.col("score").cast("double").alias("score"), F.col("rank").cast("long").alias("rank")), "hits")
    most = page.groupBy("query").count().agg(F.max("count")).first()[0] or 0
    reachable = sum(min(seeds, most) * per_hit**h for h in range(1, hops + 1))
    state = page.select("query", "doc", "score", F.lit(0).cast("long").alias("hop"), F.lit(None).cast("long").alias("origin"), "rank", (F.col("rank") <= seeds).alias("front"))
    schema = "query long, doc long, score double, hop long, origin long, rank long, front boolean"

    def step(frame: pd.DataFrame) -> pd.DataFrame:
        rows = {r.doc: [r.query, r.doc, r.score, r.hop, r.origin, r.rank, False] for r in frame.itertuples()}
        present = set(frame["doc"][frame["hop"] == 0])
        order = 0
        for r in frame[frame["front"]].sort_values("rank").itertuples():
            taken = 0
            for target in r.targets if r.targets is not None else ():
                if taken >= per_hit:
                    break
                score = r.score * decay
                if target in present or (target in rows and rows[target][2] >= score):
                    continue
                taken += 1
                order += 1
                rows.pop(target, None)
                rows[target] = [r.query, target, score, r.hop + 1, r.doc, order, True]
        out = pd.DataFrame(list(rows.values()), columns=["query", "doc", "score", "hop", "origin", "rank", "front"])
        return out.astype({"origin": "Int64"})

    for _ in range(hops):
        near = first_targets(links, state.where("front").select(F.col("doc").alias("source")), most + reachable + per_hit)
        known = state.join(near, (F.col("doc") == F.col("source")) & F.col("front"), "left").drop("source")
        state = materialize(known.groupBy("query").applyInPandas(step, schema), "walk")
    return state.select("query", "doc", F.round("score", 6).alias("score"), "hop", "origin")


def bridge(rows: DataFrame, pad_days: int = 7) -> DataFrame:
    """rows (hop, score, event, since, until) with the score of linked ones (hop > 0) times their nearness to the window.

    Times are seconds; a null end is open. Linked rows over pad_days away, and those without a time in a query with a
    window, go; hits and queries without a window stay as they are.
    """
    since, until = F.coalesce("since", F.col("event")), F.coalesce("until", F.col("event"))
    far = F.greatest(since - F.col("event"), F.col("event") - until) > pad_days * 86400
    applies = (F.col("hop") > 0) & (F.col("since").isNotNull() | F.col("until").isNotNull())
    near = F.when(far | F.col("event").isNull(), F.lit(0.0)).otherwise(proximity(F.col("event"), since, until, pad_days))
    share = F.when(applies, near).otherwise(F.lit(1.0))
    return rows.withColumn("near", share).where("near > 0").withColumn("score", F.round(F.col("score") * F.col("near"), 6)).drop("near")


def typed_fanout(seeds: DataFrame, edges: DataFrame, depth: int = 2, relations: Sequence[str] = ()) -> DataFrame:
    """(query, doc, hops, edges, via, score) of documents within `depth` typed edges (source, relation, doc) of seeds (query, doc).

    hops is the least number of steps, edges the number of edges on the way that lead to the document, via their relations
    in order. A seed isn't reached. Edges without doc are dangling and not followed. Only the newest documents of a query
    are joined with the edges at each step, and each step but the last is written to the shared folder. What the last one
    finds, most of all by far, is dealt out once, by query and document, with what was found before and the seeds.
    """
    used = edges.where("doc IS NOT NULL").select("source", "relation", F.col("doc").alias("to"))
    used = used.where(F.col("relation").isin(*relations)) if relations else used
    start = materialize(seeds.select("query", "doc").distinct(), "fanout")
    known = start.select("query", "doc", F.lit(None).cast("string").alias("relation"), F.lit(0).alias("hop"), F.lit(0).cast("long").alias("n"))
    front = start
    for hop in range(1, depth + 1):
        steps = front.join(used, F.col("doc") == F.col("source")).select("query", F.col("to").alias("doc"), "relation", F.lit(hop).alias("hop"), F.lit(1).cast("long").alias("n"))
        if hop < depth:
            counted = materialize(steps.groupBy("query", "doc", "relation", "hop").agg(F.sum("n").alias("n")), "fanout")
            front = materialize(counted.select("query", "doc").distinct().join(known.select("query", "doc").distinct(), ["query", "doc"], "left_anti"), "fanout")
            known = known.unionByName(counted)
        else:
            known = known.unionByName(steps)
    each = known.repartition("query", "doc").groupBy("query", "doc", "relation").agg(F.min("hop").alias("hop"), F.sum("n").alias("n"))
    found = each.groupBy("query", "doc").agg(F.min("hop").alias("hops"), F.sum("n").alias("edges"), F.array_sort(F.collect_set("relation")).alias("via")).where("hops > 0")
    score = 1 / F.col("hops") + F.least(F.lit(MOST_RICHNESS), RICHNESS * F.col("edges"))
    return found.select("query", "doc", F.col("hops").cast("long").alias("hops"), "edges", "via", F.round(score, 6).alias("score"))
