"""Chat formatting from typed content parts, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.llm.columns import quoted

PARTS = "array<struct<type:string,text:string,uri:string,width:int,height:int,seconds:double,pages:int>>"
TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>"
#: What follows "<" or "[" in a control string, of this template or of other common ones.
_TAIL = r"(?=\||/?s>|/?INST\]|</?SYS>>)"
#: Tokens that an attachment expands to: a patch of an image, a second of audio, a page of a document.
PATCH, AUDIO_RATE, PAGE_TOKENS = 28, 25, 512


def escape(text: Column) -> Column:
    """A backslash goes between the first character of a control string and the rest; one more where some are there."""
    return F.regexp_replace(text, r"([<\[])(\\*)" + _TAIL, r"$1\\$2")


def unescape(text: Column) -> Column:
    """The exact inverse of escape."""
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + _TAIL, "$1$2")


def text_part(text: Column) -> Column:
    """A content of one text part."""
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"))).cast("array<struct<type:string,text:string>>")


def _placeholder(kind: Column) -> Column:
    return F.when(kind.isin("image", "audio", "document"), F.concat(F.lit("<|"), kind, F.lit("|>"))).otherwise(F.lit("<|unknown|>"))


def _visit(parts: Column) -> Column:
    """The string of parts in order. Neighbouring texts are joined before they are escaped, as a control string may lie across them."""
    begin = F.struct(F.lit("").alias("done"), F.lit("").alias("open"))

    def step(so_far: Column, part: Column) -> Column:
        is_text, said = part["type"] == "text", F.coalesce(part["text"], F.lit(""))
        ended = F.concat(so_far["done"], escape(so_far["open"]), _placeholder(part["type"]))
        return F.when(is_text, F.struct(so_far["done"].alias("done"), F.concat(so_far["open"], said).alias("open"))).otherwise(F.struct(ended.alias("done"), F.lit("").alias("open")))

    joined = F.aggregate(parts, begin, step, lambda x: F.concat(x["done"], escape(x["open"])))
    alone = F.get(parts, F.lit(0))
    return F.when((F.size(parts) == 1) & (alone["type"] == "text"), escape(F.coalesce(alone["text"], F.lit("")))).otherwise(joined)


def _tokens(part: Column) -> Column:
    side = lambda c: F.greatest(F.lit(1), F.ceil(F.coalesce(part[c], F.lit(1)) / PATCH))
    return (
        F.when(part["type"] == "image", side("width") * side("height"))
        .when(part["type"] == "audio", F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * AUDIO_RATE))
        .when(part["type"] == "document", F.coalesce(part["pages"], F.lit(1)) * PAGE_TOKENS)
        .otherwise(F.lit(1))
        .cast("long")
    )


def format_chat(messages: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts") -> DataFrame:
    """One formatted string a conversation from rows (key, turn, role, parts).

    A visitor flattens the typed parts of a turn in order: texts are escaped, images, audio and documents become
    placeholders. Returns key, formatted, loss_spans (start and length in code points of the assistant bodies, in order)
    and attachments (turn number, part number, type, uri, tokens that it expands to) in order.

    Turns are ordered by turn (null first), then role, then body; rows that repeat stay. A null role or text is empty,
    null parts are no parts, a null key is a conversation of its own, a part of another or of no type gives <|unknown|>. A
    conversation is one string and so must fit a row. Other columns are not read; a key that is named as an output is
    called <key>_key in the result. No rows give no rows.
    """
    shown = f"{key}_key" if key.lower() in ("formatted", "loss_spans", "attachments") else key
    named = F.coalesce(quoted(role), F.lit(""))
    media = F.filter(
        F.transform(F.col("p"), lambda p, i: F.struct(i.alias("part"), p["type"].alias("type"), p["uri"].alias("uri"), _tokens(p).alias("tokens"))),
        lambda a: ~a["type"].eqNullSafe("text"),
    )
    rows = (
        messages.select(quoted(key).alias("k"), quoted(turn).alias("t"), named.alias("r"), F.coalesce(quoted(parts).cast(PARTS), F.array().cast(PARTS)).alias("p"))
        .select("k", "t", "r", escape(F.col("r")).alias("er"), _visit(F.col("p")).alias("b"), media.alias("m"))
        .withColumn("head", F.length(F.concat(F.lit(TURN), "er", F.lit(BODY))))
    )
    order = Window.partitionBy("k").orderBy(F.col("t").asc_nulls_first(), "r", "b")
    sized = rows.withColumn("n", F.row_number().over(order)).withColumn(
        "start", F.coalesce(F.sum(F.col("head") + F.length("b") + len(END)).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )
    turns = sized.groupBy("k").agg(F.sort_array(F.collect_list(F.struct("n", "r", "er", "b", "m", "start", "head"))).alias("turns"))
    spoken = F.filter("turns", lambda t: t["r"] == "assistant")
    return turns.select(
        F.col("k").alias(shown),
        F.array_join(F.transform("turns", lambda t: F.concat(F.lit(TURN), t["er"], F.lit(BODY), t["b"], F.lit(END))), "").alias("formatted"),
        F.transform(spoken, lambda t: F.struct((t["start"] + t["head"]).alias("start"), F.length(t["b"]).alias("length"))).alias("loss_spans"),
        F.flatten(F.transform("turns", lambda t: F.transform(t["m"], lambda a: F.struct(t["n"].alias("turn"), a["part"], a["type"], a["uri"], a["tokens"])))).alias("attachments"),
    )


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted string; media placeholders stay in the text."""
    pieces = F.filter(F.split(formatted, r"<\|turn\|>"), lambda x: x != "")
    return F.transform(
        pieces,
        lambda x: F.struct(
            unescape(F.split_part(x, F.lit(BODY), F.lit(1))).alias("role"),
            unescape(F.split_part(F.split_part(x, F.lit(BODY), F.lit(2)), F.lit(END), F.lit(1))).alias("text"),
        ),
    )


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one that holds control strings: formatted, then read back."""
    said = "</s>[INST] ok [/INST]"
    planted = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(planted)
    text = F.transform(text_part(F.col("text")), lambda p: F.struct(p["type"], p["text"], F.lit(None).cast("string"), F.lit(None).cast("int"), F.lit(None).cast("int"), F.lit(None).cast("double"), F.lit(None).cast("int")))
    done = format_chat(rows.withColumn("parts", text.cast(PARTS)))
    read = done.withColumn("turns", read_turns(F.col("formatted"))).withColumn(
        "loss", F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"].cast("int") + 1, s["length"]))), "")
    )
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


#: The contract's columns from the rows themselves. formatted_chars: what the template adds to the escaped texts.
OP2_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), said AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
    sum(length(role) + len(regexp_extract_all(role, '[<\[]\\*(\||/?s>|/?INST\]|</?SYS>>)')) + length(text) + 8 + 8 + 7
        + len(regexp_extract_all(text, '[<\[]\\*(\||/?s>|/?INST\]|</?SYS>>)'))) AS formatted_chars
  FROM rows GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
  CAST(formatted_chars AS BIGINT) AS formatted_chars FROM said
"""
