"""Sources: Markdown pages, sharded JSON logs, session transcripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_HEADER = r"(?s)\A---\r?\n(.*?)\r?\n---\r?\n?"


def frontmatter(text: Column) -> Column:
    """map<string, array<string>> of the flat header between --- lines; scalars become arrays of one, [a, b] a list."""
    header = F.regexp_extract(text, _HEADER, 1)
    lines = F.filter(F.split(header, r"\r?\n"), lambda x: x.rlike(r"^[A-Za-z_][\w-]*:\s*\S"))
    key = lambda x: F.regexp_extract(x, r"^([\w-]+):", 1)
    value = lambda x: F.regexp_extract(x, r"^[\w-]+:\s*(.*?)\s*$", 1)
    items = lambda v: F.when(v.rlike(r"^\[.*\]$"), F.split(F.regexp_replace(v, r"^\[\s*|\s*\]$", ""), r"\s*,\s*")).otherwise(F.array(F.regexp_replace(v, "^[\"']|[\"']$", "")))
    pairs = F.transform(lines, lambda x: F.struct(key(x).alias("key"), items(value(x)).alias("value")))
    unique = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, F.lit(1), i), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(unique)


def body(text: Column) -> Column:
    return F.regexp_replace(text, _HEADER, "")


def pages(spark: SparkSession, root: str, glob: str = "*.md") -> DataFrame:
    """(path, mtime, size, frontmatter, body) of the Markdown files below a folder, read where they lie."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(root)
    text = F.col("content").cast("string")
    return files.select("path", F.col("modificationTime").alias("mtime"), F.col("length").alias("size"), frontmatter(text).alias("frontmatter"), body(text).alias("body"))


LOG = T.StructType([T.StructField("ts", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("payload", T.StringType()), T.StructField("_corrupt", T.StringType())])


def log_entries(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected lines) of JSON log shards: ts, kind, payload as JSON text, shard; a bad line is a row of rejects."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("shard"))
    rows = lines.select("value", "shard", F.from_json("value", LOG, {"columnNameOfCorruptRecord": "_corrupt"}).alias("r"))
    ok = F.col("r._corrupt").isNull() & F.col("r.ts").isNotNull() & F.col("r.kind").isNotNull() & F.try_to_timestamp(F.col("r.ts")).isNotNull()
    good = rows.where(ok).select(F.to_timestamp("r.ts").alias("ts"), F.col("r.kind").alias("kind"), F.col("r.payload").alias("payload"), "shard")
    return good, rows.where(~F.coalesce(ok, F.lit(False))).select("value", "shard")


def turns(spark: SparkSession, path: str) -> DataFrame:
    """(session_id, turn_id, ts, role, text) of transcripts, one JSON object a line, in the dialects that hosts write.

    A text may be a string, or a list of parts of which the texts are joined; a time may be ISO text or epoch seconds.
    """
    j = lambda p: F.get_json_object("value", p)
    parts = lambda p: F.array_join(F.from_json(j(p), "array<struct<text:string>>")["text"], "")
    content = lambda p: F.when(j(p).startswith("["), parts(p)).otherwise(j(p))
    when = F.coalesce(j("$.timestamp"), j("$.ts"))
    ts = F.coalesce(F.try_to_timestamp(when), F.timestamp_seconds(when.try_cast("double")))
    rows = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("shard"))
    return rows.select(
        F.coalesce(j("$.sessionId"), j("$.session_id"), j("$.params.sessionId"), F.col("shard")).alias("session_id"),
        F.coalesce(j("$.uuid"), j("$.turnId"), j("$.turn_id")).alias("turn_id"),
        ts.alias("ts"),
        F.coalesce(j("$.message.role"), j("$.role"), j("$.payload.role"), F.when(j("$.params.update.sessionUpdate").startswith("user"), "user").when(j("$.params.update.sessionUpdate").startswith("agent"), "assistant")).alias("role"),
        F.coalesce(content("$.message.content"), content("$.payload.content"), j("$.params.update.content.text"), content("$.content"), j("$.text")).alias("text"),
    ).where("role IS NOT NULL AND role <> 'session_meta' AND text IS NOT NULL")
