"""Atomic facts of Markdown texts: sentences and list items with their line and the headings above them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.operators.markdown import SPACE, sentences, trimmed

# Lengths in characters between which a statement is one, and the notation of headings and list items.
LEAST, MOST = 15, 300
HEADING, ITEM, FENCE = rf"^(#{{1,6}})[{SPACE}]+(.*)$", rf"^[{SPACE}]*(?:[-*+]|\d{{1,3}}[.)])[{SPACE}]+(.+)$", r"^(?:```|~~~)"
LEVELS = 6


def collapsed(text: Column) -> Column:
    return F.substring(F.trim(F.regexp_replace(text, f"[{SPACE}]+", " ")), 1, MOST)


def lines_of(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(row, key, at, line, body, kind, level) of every line outside front matter: kind is fence, code, blank, quote, heading, item or prose.

    Front matter is what stands between --- as the very first line and the next ---, or the end. A fence opens or closes
    code. A row of docs is one text, whatever its key.
    """
    named = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    each = named.select("row", "key", F.posexplode(F.split("text", r"\r?\n")).alias("at", "line")).withColumn("body", trimmed(F.col("line")))
    text_of, before = Window.partitionBy("row"), Window.partitionBy("row").orderBy("at")
    rule = F.col("body") == "---"
    opened = F.max((F.col("at") == 0) & rule).over(text_of)
    closed = F.min(F.when((F.col("at") > 0) & rule, F.col("at"))).over(text_of)
    rest = each.withColumns({"opened": opened, "closed": closed}).where("NOT opened OR at > closed").drop("opened", "closed")
    fence = F.col("body").rlike(FENCE)
    fenced = rest.withColumn("fences", F.sum(fence.cast("int")).over(before))
    kind = (
        F.when(fence, "fence").when(F.col("fences") % 2 == 1, "code").when(F.col("body") == "", "blank").when(F.col("body").startswith(">"), "quote")
        .when(F.col("body").rlike(HEADING), "heading").when(F.col("line").rlike(ITEM), "item").otherwise("prose")
    )
    return fenced.withColumn("kind", kind).withColumn("level", F.when(F.col("kind") == "heading", F.length(F.regexp_extract("body", HEADING, 1)))).drop("fences")


def atomic_facts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line, n, kind, headings, statement) of every statement of LEAST characters or more in texts, at most MOST of each.

    Lines of prose up to a blank or another kind of line are one paragraph, whose sentences are statements ("sentence") at
    its first line; a list item's sentences, or the item if it is one, are statements ("list_item"). headings has the
    headings above, outermost first. Code, quotes and front matter state nothing; inline code is left out. Lines of one text
    meet by its row, so a text's lines must fit a window; no text waits for another. Null and empty texts state nothing.
    """
    lines = lines_of(docs, key, text)
    up_to = Window.partitionBy("row").orderBy("at")
    last = {n: F.last(F.when(F.col("level") == n, F.struct("at", collapsed(F.regexp_extract("body", HEADING, 2)).alias("title"))), ignorenulls=True).over(up_to) for n in range(1, LEVELS + 1)}
    marked = lines.withColumns({f"h{n}": c for n, c in last.items()}).withColumn("paragraph", F.sum((F.col("kind") != "prose").cast("int")).over(up_to))
    above, outer = [], F.lit(-1)
    for n in range(1, LEVELS + 1):  # a heading counts until one of its level or a higher one follows
        at = F.coalesce(F.col(f"h{n}.at"), F.lit(-1))
        above.append(F.when(at > outer, F.col(f"h{n}.title")))
        outer = F.greatest(outer, at)
    path = F.filter(F.array(*above), lambda t: t.isNotNull())
    told = marked.where(F.col("kind").isin("prose", "item")).select("row", "key", "at", "line", "body", "kind", "paragraph", path.alias("headings"))
    prose = told.where("kind = 'prose'").groupBy("row", "key", "paragraph").agg(F.sort_array(F.collect_list(F.struct("at", "body", "headings"))).alias("rows"))
    first = F.get("rows", F.lit(0))
    paragraphs = prose.select("key", first["at"].alias("at"), first["headings"].alias("headings"), F.lit("sentence").alias("kind"), sentences(F.array_join(F.transform("rows", lambda r: r["body"]), " ")).alias("said"))
    whole = F.regexp_extract("line", ITEM, 1)
    parts = told.where("kind = 'item'").select("key", "at", "headings", F.lit("list_item").alias("kind"), whole.alias("whole"), sentences(whole).alias("said"))
    items = parts.select("key", "at", "headings", "kind", F.when(F.size("said") <= 1, F.array("whole")).otherwise(F.col("said")).alias("said"))
    spread = paragraphs.unionByName(items).select("key", "at", "kind", "headings", F.posexplode("said").alias("n", "said"))
    stated = spread.withColumn("statement", collapsed(F.regexp_replace("said", r"`[^`\n]*`", " "))).where(F.length("statement") >= LEAST)
    return stated.select(F.col("key").alias(key), (F.col("at") + 1).cast("long").alias("line"), (F.col("n") + 1).cast("long").alias("n"), "kind", "headings", "statement")
