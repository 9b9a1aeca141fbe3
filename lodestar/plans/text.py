"""Text: tokens, hashes, facts, chunks, embeddings, packing to a budget."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.functions.scalars import contains_cjk, content_hash, normalize_value, token_count, token_estimate, word_set
from lodestar.operators.chunking import chunk_documents
from lodestar.operators.ledger import budget_walk
from lodestar.operators.lexical import bm25, query_terms, top
from lodestar.operators.ranking import diversify
from lodestar.registry import query, table


@query(
    "token_stats",
    r"SELECT doc_id, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\r]+'), lambda w: w <> '')) AS tokens, CAST(ceil(octet_length(encode(coalesce(text, ''))) / 4) AS BIGINT) AS estimate FROM documents",
)
def token_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "documents").select("doc_id", token_count(text).alias("tokens"), token_estimate(text).alias("estimate"))


@query("token_footprint", "SELECT source, CAST(sum(ceil(octet_length(encode(coalesce(text, ''))) / 4)) AS BIGINT) AS tokens, count(*) AS files, sum(ceil(octet_length(encode(coalesce(text, ''))) / 4)) > 20000 AS exceeded FROM documents GROUP BY source")
def token_footprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.sum(token_estimate(F.coalesce("text", F.lit(""))))
    return table(spark, sf_dir, "documents").groupBy("source").agg(n.alias("tokens"), F.count("*").alias("files"), (n > 20000).alias("exceeded"))


@query("content_hashes", "SELECT doc_id, sha256(trim(coalesce(text, '')) || chr(10) || trim(coalesce(source, ''))) AS hash FROM documents")
def content_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", content_hash(F.coalesce("text", F.lit("")), F.col("source")).alias("hash"))


@query("normalized_values", r"SELECT conv_id, turn, md5(lower(trim(regexp_replace(coalesce(text, ''), '[ \t\n\r\f]+', ' ', 'g')))) AS value FROM conversations")
def normalized_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(normalize_value(F.coalesce("text", F.lit(""))).cast("binary")).alias("value"))


@query("script_predicate", r"SELECT lang, count(*) FILTER (WHERE regexp_matches(text, '[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}]')) AS cjk, count(*) AS n FROM documents GROUP BY lang")
def script_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count(F.when(contains_cjk(F.col("text")), 1)).alias("cjk"), F.count("*").alias("n"))


_EMAIL, _MONEY, _URL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", r"[$€£][0-9]+(?:[.,][0-9]+)*", r"https?://[^\s<>\"]+"


@query(
    "facts_extract",
    f"""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents)
    SELECT doc_id, family, fact, count(*) AS n FROM (SELECT doc_id, 'email' AS family, unnest(regexp_extract_all(line, '{_EMAIL}')) AS fact FROM l UNION ALL SELECT doc_id, 'money', unnest(regexp_extract_all(line, '{_MONEY}')) FROM l UNION ALL SELECT doc_id, 'url', unnest(regexp_extract_all(line, '{_URL}')) FROM l) GROUP BY ALL""",
)
def facts_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Emails, amounts and URLs of each document, counted: one pass over the text for the three families."""
    families = {"email": _EMAIL, "money": _MONEY, "url": _URL}

    def of(family: str, pattern: str):
        return F.transform(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)), lambda x: F.struct(F.lit(family).alias("family"), x.alias("fact")))

    found = F.flatten(F.array(*[of(n, p) for n, p in families.items()]))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(found).alias("f"))
    return rows.groupBy("doc_id", F.col("f.family").alias("family"), F.col("f.fact").alias("fact")).agg(F.count("*").alias("n"))


@query(
    "expansion_terms",
    r"""WITH w AS (SELECT DISTINCT doc_id, unnest(list_distinct(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), lambda w: length(w) >= 6))) AS term FROM documents)
    SELECT term, count(*) AS df FROM w GROUP BY term HAVING count(*) >= 3 ORDER BY df DESC, term LIMIT 30""",
)
def expansion_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The thirty longer terms that most documents have."""
    words = F.array_distinct(F.filter(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), lambda w: F.length(w) >= 6))
    df = table(spark, sf_dir, "documents").select(F.explode(words).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return df.where("df >= 3").orderBy(F.desc("df"), "term").limit(30)


@query("line_pointers", "SELECT doc_id, 'd' || doc_id || ':L1-L' || len(string_split(coalesce(text, ''), chr(10))) AS pointer FROM documents")
def line_pointers(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.size(F.split(F.coalesce("text", F.lit("")), "\n"))
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(":L1-L"), lines.cast("string")).alias("pointer"))


@query("heading_chunks")
def heading_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of every document."""
    return chunk_documents(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", "chunk_index", "line_start", "line_end", "heading_path", F.length("content").cast("long").alias("chars"))


@query("mmr_rerank")
def mmr_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best and most diverse of the thirty best documents of each query."""
    docs = table(spark, sf_dir, "documents")
    pool = top(bm25(docs, query_terms(table(spark, sf_dir, "benchmark"), "item_id", "text"), "doc_id", "text"), "query", "score", "doc", 30)
    best = F.max("score").over(Window.partitionBy("query"))
    words = docs.select(F.col("doc_id").alias("doc"), word_set(F.col("text")).alias("words"))
    return diversify(pool.withColumn("score", F.col("score") / best).join(words, "doc").select("query", "doc", "score", "rank", "words"), 10)


def _fnv(feature: str) -> int:
    """32-bit FNV-1a over UTF-16 units."""
    h = 0x811C9DC5
    for unit in np.frombuffer(feature.encode("utf-16-le"), "<u2").tolist():
        h = ((h ^ unit) * 0x01000193) & 0xFFFFFFFF
    return h


@query("hashed_embedding")
def hashed_embedding(spark: SparkSession, sf_dir: str, dimension: int = 256) -> DataFrame:
    """Unit vectors of signed hashed features, words and padded letter trigrams, of each turn."""
    places: dict[str, tuple[int, float]] = {}

    def place(feature: str) -> tuple[int, float]:
        if feature not in places:
            if len(places) > 500_000:
                places.clear()
            places[feature] = _fnv(feature) % dimension, 1.0 if _fnv("sign:" + feature) & 1 else -1.0
        return places[feature]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for text in frame["text"]:
                v = np.zeros(dimension)
                for w in text.lower().split():
                    padded = f" {w} "
                    for f in ("w:" + w, *(padded[i : i + 3] for i in range(len(padded) - 2))):
                        at, sign = place(f)
                        v[at] += sign
                norm = np.linalg.norm(v)
                out.append((v / norm if norm else v).astype("float32").tolist())
            yield frame[["conv_id", "turn"]].assign(embedding=out)

    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text")).mapInPandas(run, "conv_id long, turn long, embedding array<float>")


@query(
    "budget_pack",
    """WITH RECURSIVE r AS (SELECT conv_id, turn, length(coalesce(text, '')) AS chars, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations),
    p AS (SELECT conv_id, turn, chars, rn, chars <= 2000 AS kept, CASE WHEN chars <= 2000 THEN chars ELSE 0 END AS used FROM r WHERE rn = 1
      UNION ALL SELECT r.conv_id, r.turn, r.chars, r.rn, p.used + r.chars <= 2000, p.used + CASE WHEN p.used + r.chars <= 2000 THEN r.chars ELSE 0 END FROM p JOIN r ON r.conv_id = p.conv_id AND r.rn = p.rn + 1)
    SELECT conv_id, turn, chars FROM p WHERE kept""",
)
def budget_pack(spark: SparkSession, sf_dir: str, budget: int = 2000) -> DataFrame:
    """Turns of each session in order while they fit a budget of characters; one that would overflow is skipped, not the rest."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("chars"))
    return budget_walk(rows, "conv_id", ["turn"], "chars", budget)
